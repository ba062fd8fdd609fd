"""Personal data, the prefix trie and ranked search against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lexical, personal, trie

# ---- personal data

DOCS = "doc_id long, text string, kind string, base string, spans string, _text string, _id int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, "k", "b", "s", "t", 1) for i, t in rows], DOCS).repartition(2)


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_personal_base_spans_against_plain_patterns(spark):
    rnd = random.Random(4)
    pieces = ["a@b.c", "x_y%z", "@", ".", "-", "+", " ", "(", ")", "1", "42", "255", "256", "007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "é", "日本", "😀", "\n", "com", "A.B-c@d-e.f.g", "10.0.0.1", "00000255"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(1, 60))) for _ in range(1500)] + ["a@b.c_d@e.f", "a@b.c.d@e.f@g.h", "1.2.3.4.5.6.7.8.9", "5 - 6 7", "+12 3", ""]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in personal.find_personal(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 1000


def test_personal_scores_and_checksums(spark):
    rows = [
        (1, "Pay to IBAN DE89 3704 0044 0532 0130 00 please"), (2, "GB82WEST12345698765432"), (3, "GB82WEST12345698765433"), (4, "xGB82WEST12345698765432"),
        (5, "BE68 5390 0754 7034 GB82 WEST 1234 5698 7654 32"), (6, "her ssn is 078-05-1120"), (7, "part 078-05-1120"), (8, "ssn 000-05-1120, ssn 900-05-1120"),
        (9, "call 555-123-4567 now"), (10, "order 555-123-4567"), (11, "phone +1 (988) 555-2485"), (12, "version 1.2.3.4"), (13, "credit card 4111 1111 1111 1111"), (14, "order 4111111111111111"),
    ]
    got = {r.doc_id: r.spans for r in personal.find_personal(docs(spark, rows)).collect()}
    kinds = {i: [s.kind for s in spans] for i, spans in got.items()}
    assert kinds == {1: ["iban"], 2: ["iban"], 3: [], 4: [], 5: ["iban", "iban"], 6: ["ssn"], 7: [], 8: [], 9: ["local"], 10: [], 11: ["phone"], 12: ["ip"], 13: ["card"], 14: ["card"]}
    assert (got[1][0].score, got[2][0].score, got[12][0].score, got[13][0].score, got[14][0].score) == (1.0, 0.8, 0.3, 1.0, 0.4)
    assert got[5][0].value == "BE68 5390 0754 7034" and got[6][0].score == 0.6


def test_personal_odd_rows(spark):
    long = ["7" * 200_000, "1 " * 100_000, "a." * 100_000, "1.2.3.4 " * 4_000, "+1" + "(" * 200_000, "x@" * 100_000, "x@y.z " * 2_000]
    rows = [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (None, "a@b.c")] + list(enumerate(long, 10))
    out = personal.find_personal(docs(spark, rows))
    assert out.columns == ["doc_id", "base", "spans"]
    got = sorted(((r.doc_id or 0, r.n, r.end) for r in out.select("doc_id", F.size("base").alias("n"), F.expr("try_element_at(base, -1).end").alias("end")).collect()), key=str)
    want = [(0, 1, 5), (1, 0, None), (2, 0, None), (3, 1, 5), (3, 1, 5)] + [(10, 0, None), (11, 0, None), (12, 0, None), (13, 4_000, 31_999), (14, 0, None), (15, 0, None), (16, 2_000, 11_999)]
    assert got == sorted(want, key=str)
    assert personal.find_personal(docs(spark, [])).count() == 0


def test_personal_runs_no_python(spark):
    plan = personal.find_personal(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- prefix trie


def rebuilt(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            ident = hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest()
            conv[c].append(((t is not None, t or 0), r or "", ident, x or ""))
    conv = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in conv.items()}
    base = lambda c: c - int(math.fmod(c, 5))
    return {c: tuple(conv.get(base(c), [])[: zlib.crc32(str(c).encode()) % 9] + own[zlib.crc32(str(c).encode()) % 9 :]) for c, own in conv.items()}


def nodes(paths):
    members = collections.defaultdict(list)
    for c, q in paths.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    children = collections.Counter(q[:-1] for q in members if q)
    leaves, saved = collections.Counter(), collections.Counter()
    for q, m in members.items():
        for d in range(len(q) + 1):
            saved[q[:d]] += (len(m) - 1) * len(q[-1][1].encode()) if q else 0
            leaves[q[:d]] += children[q] == 0
    ends = lambda q: hashlib.sha256(",".join(map(str, sorted(c for c in members[q] if paths[c] == q))).encode()).hexdigest()
    return sorted(((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), children[q], leaves[q], saved[q], ends(q)) for q, m in members.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string, seq string, sizes string, _base int, _first int, shard int"


def of(spark, rows, **kind):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], TURNS)
    c = F.col("conv_id")
    out = trie.prefix_trie(trie.branched(df, c - c % 5, F.crc32(c.cast("string")) % 9, 8), **kind)
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("turns", [40, 1 << 18])
def test_trie_against_brute_force(spark, turns):
    rnd = random.Random(turns)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", "a", "é", "same", None])) for c in range(-6, 120) for t in range(rnd.randrange(1, 12))]
    rows += [(c, t, "user", "hot") for c in range(200, 260) for t in range(3)]  # one large group of copies
    rows += [(300, t, "user", str(t % 7)) for t in range(90)] + [(301, t, "user", str(t % 7)) for t in range(70)] + [(302, t, "user", str(t % 7)) for t in range(64)]
    rows += [(400, None, "user", "b"), (400, None, None, None), (400, 1, "user", "x"), (400, 1, "user", "w"), (400, 1, "user", "w"), (None, 0, "user", "x"), (405, None, None, None)]
    rnd.shuffle(rows)
    assert of(spark, rows, shard_turns=turns) == nodes(rebuilt(rows))


def test_trie_of_nothing_and_of_one(spark):
    assert of(spark, []) == [] and of(spark, [(None, 1, "a", "b")]) == []
    assert of(spark, [(5, 0, "a", "b")]) == nodes({5: (("a", "b"),)})


def test_levels_keep_long_conversations_apart():
    ids = np.array([1, 2, 3, *([7] * 300), 7, 7])
    sizes = np.ones(len(ids), np.int64)
    made = trie.Levels(ids, sizes, np.array([3, 300, 2, 0]), np.array([4, 3, 2, 1]))
    assert list(made.order) == [3, 0, 2, 1] and len(made.n) == 1 + 3 + 300
    assert made.n[0] == 4 and list(made.n[made.offsets[1] : made.offsets[3]]) == [1, 2, 1, 2]
    assert [(k, list(c)) for k, c in made.ends][0] == (0, [1])


# ---- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def ranked(documents, items, k=10):
    own = [(d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in documents]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    held = collections.Counter(t for _, c in own for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, ts in asked.items():
        rows = []
        for d, c in own:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
                rows += [(-score, d is not None, d or 0)] if score > 0 else []
        out += [(i, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def search(spark, documents, items, **kind):
    d = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in documents], "doc_id long, text string, n int, ids string, item_id int, rank string").repartition(3)
    q = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id int, score string")
    return sorted(map(tuple, lexical.rank_documents(d, q, **kind).collect()), key=str)


@pytest.mark.parametrize("kind", [{}, {"seed_share": 1}, {"seed_share": 2, "block_bytes": 400}, {"k": 3}])
def test_search_against_brute_force(spark, kind):
    rnd = random.Random(5)
    words = ["the", "Of", "and", "x1", "É", "é", "日本", "z" * 300, *(f"w{i}" for i in range(40))]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "-", "\n", "\x00", "."]) for _ in range(n))
    documents = [(i, text(rnd.randrange(0, 40))) for i in range(400)]
    documents += [(1000 + i, "the w1 w2 w3") for i in range(150)]  # ties
    documents += [(7, documents[7][1]), (None, "w1 w2 w3"), (None, None), (2000, None), (2001, ""), (2002, "!?"), (2003, "w5 " * 60_000)]
    items = [(i, text(8)) for i in range(30)] + [(3, "w1 and w2"), (3, "w1 and w2"), (None, "w3 É"), (50, None), (51, ""), (52, "nowhere"), (53, "THE w1 W2 w3")]
    assert search(spark, documents, items, **kind) == ranked(documents, items, **{k: v for k, v in kind.items() if k == "k"})


def test_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a")], []) == [] and search(spark, [(1, "")], [(1, "a")]) == []


def test_terms_of_long_texts(monkeypatch):
    text = ("ab-CD é\x00日本" * 50).encode()
    whole = [t for part in lexical.terms(text) for t in part]
    monkeypatch.setattr(lexical, "STEP", 7)
    assert [t for part in lexical.terms(text) for t in part] == whole and whole[:3] == [b"ab", b"cd", "é".encode()]


def test_bounds_leave_out_whole_batches():
    rng = np.random.default_rng(3)
    # documents and items of 20 separate vocabularies
    group = rng.integers(0, 20, 4000)
    lens = np.full(4000, 12)
    ids = (group[:, None] * 50 + np.argsort(rng.random((4000, 50)), axis=1)[:, :12]).ravel()
    lists = [np.sort(g * 50 + rng.permutation(50)[:6]) for g in range(20) for _ in range(5)]
    items = lexical.Items(lists, 1000, 5)
    values = rng.integers(1, 1000, len(ids))
    scored, pairs = lexical.search_block(items, np.arange(4000), lens, ids, values)
    assert scored < pairs / 8
    dense = np.zeros((4000, 1000), np.int64)
    dense[np.repeat(np.arange(4000), 12), ids] = values
    for q, i in enumerate(items.order):
        all_ = dense[:, lists[i]].sum(axis=1)
        best = np.lexsort((np.arange(4000), -all_))[:5]
        assert list(items.docs[q]) == list(best) and list(items.scores[q]) == list(all_[best])
