"""The corpus operators against brute force, round trips and edge cases."""

import base64
import itertools
import math
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat, language, neardup, packing, queries, secrets, segment, topk, toxicity, urls, vectors
from tallyspark.llm.common import connected_components, likely_in

BPE, PIECES = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, ids string, rank int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, None, None, None, 7, "x", 3) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (None, "a b c d"), (5, "x " * 5000), (6, "日本 é\u0000 \n\t%")]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    from tallyspark.llm import common

    hub = [(5000, i) for i in range(3000)] + [(i, i + 1) for i in range(6000, 6040)] + [(7, 7)]
    df = spark.createDataFrame(hub, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert len(got) == 3001 + 41 and {got[i] for i in (0, 2999, 5000)} == {0} and {got[i] for i in range(6000, 6041)} == {6000}
    with pytest.raises(RuntimeError):
        common.connected_components(df, rounds=1)


def test_rows_of_a_heavy_key_are_dealt_over_many_tasks(spark):
    from tallyspark.llm.common import heavy_keys, join_heavy

    rows = spark.createDataFrame([(7, i, "x") for i in range(4000)] + [(i % 90, i, None) for i in range(300)] + [(None, 1, "y")] * 500, "a long, b long, _piece string")
    other = spark.createDataFrame([(i, i * i) for i in range(80)], "a long, m long")
    heavy, pieces = heavy_keys(rows, "a", 4800)
    assert heavy == [7] and pieces == 32 and heavy_keys(rows, "a", 128) == ([], 1)
    joined = join_heavy(rows, other, ["a"], heavy, pieces, F.col("b"))
    got, want = ([tuple(r) for r in df.select("a", "b", "_piece", "m").collect()] for df in (joined, rows.join(other, "a")))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("16", "false", "-1")):
            spark.conf.set(k, v)
        sizes = [r[1] for r in join_heavy(rows, other, ["a"], heavy, pieces, F.col("b")).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1000  # of 4300
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_cluster_needs_a_shared_folder():
    from tallyspark.llm import common

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError):
        common.scratch(Session)


def test_likely_in_loses_nothing(spark):
    df, keys = spark.range(2000), spark.range(0, 2000, 7)
    got = {r.id for r in likely_in(df, "id", keys).collect()}
    assert set(range(0, 2000, 7)) <= got and len(got) < 400


def test_rows_reach_python_in_batches_of_few_megabytes(spark):
    from tallyspark.llm.common import ship

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "mb": [b.nbytes / 1e6]}) for b in batches)
    try:
        spark.conf.set(key, "1m")
        ship(spark)
        assert spark.conf.get(key) == "1m"  # what the session sets stays
        spark.conf.unset(key)
        ship(spark)
        long = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 10000) text")
        got = long.mapInArrow(sizes, "n long, mb double").collect()
        assert sum(r.n for r in got) == 2000 and max(r.mb for r in got) < 8
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_few_rows_start_no_python(spark):
    from tallyspark.llm.common import few_rows

    schema = pa.schema([("n", pa.int32()), ("unit", pa.string()), ("c", pa.int64())])
    df = few_rows(spark, schema, [(1, "a", 2**40), (2, None, 3)])
    assert df.dtypes == [("n", "int"), ("unit", "string"), ("c", "bigint")] and sorted(map(tuple, df.collect())) == [(1, "a", 2**40), (2, None, 3)]
    assert few_rows(spark, schema, []).collect() == []
    lineage = lambda x: x._jdf.queryExecution().toRdd().toDebugString()
    assert "PythonRDD" not in lineage(df) and "PythonRDD" in lineage(spark.createDataFrame([(1, "a", 2)], "n int, unit string, c long"))


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [math.nan] * 8), (303, [0.0] * 8), (50, rows[50][1])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk.top_k(df.where("id % 50 = 0"), df, 5, query_block=2, candidate_block=40).orderBy("query_id", "rank").collect()]
    w = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and not math.isnan(x) for x in v)]
    want = []
    for q, qv in sorted((i, v) for i, v in w if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in w if i != q)[:5]
        want += [(q, s, i) for s, i in best]
    own = Counter(r[0] for r in got)
    assert all(own[q] == 5 for q in own)
    assert {(q, -s, i) for q, s, i in want} == {(q, s, i) for q, _, i, s in got}


def test_top_k_of_repeated_rows_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    v = lambda *x: [float(a) for a in x]
    rows = [(50, v(1, 2)), (50, v(1, 2)), (1, v(1, 1)), (2, v(2, 2)), (2, v(2, 2)), (3, v(0, 0)), (None, v(1, 1)), (100, v(1, 2, 3)), (4, []), (6, v(math.inf, 1)), (7, v(1, 1))]
    spark.createDataFrame([(i, x, "w", 1) for i, x in rows], "vec_id long, embedding array<float>, w string, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op1_top_k(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(duck.sql(queries.OP1_SQL).fetchall()) and len(got) == 10
    empty = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(empty, empty).count() == 0


def test_segment_second_draws_and_inclusion():
    """Draws without replacement: the second one has the probability of all ordered pairs that end in it; and
    sums weighted by inclusion estimate those over all segmentations."""
    lat = segment.lattice(PIECES, 1.0)
    text = "tin on"
    paths = {}

    def walk(chunks, ids, lp):
        if not chunks:
            paths[tuple(ids)] = lp
            return
        def go(node, ids, lp):
            if not lat.count[node]:
                walk(chunks[1:], ids, lp)
            for e in range(lat.first[node], lat.first[node] + lat.count[node]):
                go(int(lat.to[e]), [*ids, int(lat.piece[e])], lp + lat.logp[e])
        go(lat.start[chunks[0]], ids, lp)

    n = 6000
    drawn = segment.sample(lat, [text] * n, segment._mix(np.arange(n, dtype=np.uint64)), 3)
    walk(segment.spaced(text).split(" "), [], 0.0)
    p = {k: math.exp(v) for k, v in paths.items()}
    assert sum(p.values()) == pytest.approx(1)
    assert all(len({tuple(x[0]) for x in d}) == 3 for d in drawn)
    assert all(x[1] == pytest.approx(paths[tuple(x[0])]) and x[2] >= y[2] for d in drawn for x, y in zip(d, d[1:]))
    second = Counter(tuple(d[1][0]) for d in drawn)
    want = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for b, w in want.items():
        if w > 0.02:
            assert abs(second[b] / n - w) < 4 * math.sqrt(w * (1 - w) / n) + 0.002
    # weighted by their inclusion the drawn ones stand for all: of any quantity, on average, the sum over all
    for f in (lambda x: 1.0, len):
        share = np.mean([sum(p[tuple(x[0])] * f(x[0]) / x[3] for x in d) for d in drawn])
        assert share == pytest.approx(sum(v * f(k) for k, v in p.items()), rel=0.03)


def test_segment_marks_and_long_words(spark):
    long = "x" * 5000 + " 日本語" * 300
    rows = {r.doc_id: r for r in segment.encode_samples(docs(spark, [(1, "a\u2581b"), (2, long), (3, "  two  spaces "), (4, "")]), PIECES, k=1).collect()}
    assert [rows[i].round_trip for i in (1, 2, 3, 4)] == [False, True, True, True]
    back = segment.decode(spark.createDataFrame([(rows[1].ids,), (rows[3].ids,)], "ids array<int>"), PIECES).collect()
    assert {r.text for r in back} == {"a b", "  two  spaces "}
    assert segment.encode_samples(docs(spark, []), PIECES).count() == 0


def test_segment_matches_enumeration():
    lat = segment.Lattice(PIECES, 1.0)
    word = "abac"
    lat.add(["▁" + word])
    start = lat.start["▁" + word]

    def paths(node, lp):
        if not lat.count[node]:
            yield lp
        for e in range(lat.first[node], lat.first[node] + lat.count[node]):
            yield from paths(lat.to[e], lp + lat.logp[e])

    every = sorted(paths(start, 0.0))
    assert abs(sum(map(math.exp, every)) - 1) < 1e-9
    seeds = segment._mix(np.arange(4000).astype(np.uint64))
    drawn = segment.sample(lat, [word] * 4000, seeds, 2)
    first, second = Counter(), 0
    for rows in drawn:
        assert len({tuple(r[0].tolist()) for r in rows}) == 2 and rows[0][2] >= rows[1][2]
        first[tuple(rows[0][0].tolist())] += 1
    for ids, n in first.most_common(3):
        lp = next(r[1] for rows in drawn for r in rows if tuple(r[0].tolist()) == ids)
        assert abs(n / 4000 - math.exp(lp)) < 0.03
    # few segmentations: all of them, surely included
    few = segment.sample(lat, ["", "☃"], seeds[:2], 3)
    assert len(few[0]) == 1 and len(few[0][0][0]) == 0 and all(r[3] == 1.0 for r in few[0])


def test_segment_round_trip(spark):
    rows = [*ODD, (7, "  two  spaces and\nlines "), (8, "déjà vu 😀")]
    out = segment.encode_samples(docs(spark, rows), PIECES, k=3)
    assert out.where("not round_trip").count() == 0
    again = segment.decode(out, PIECES).select("doc_id", F.col("text").alias("back")).where("doc_id = 8").distinct().collect()
    assert [r.back for r in again] == ["déjà vu 😀"]
    assert out.where("doc_id = 1").count() == 0


def brute_bins(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            j = rooms.index(r)
            go(i + 1, [*rooms[:j], r - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_plan_is_optimal_on_small_cases():
    rng = np.random.default_rng(4)
    for _ in range(60):
        items = sorted(rng.integers(1, 30, 9).tolist(), reverse=True)
        assert whole_plan(Counter(items), 30).bins == brute_bins(items, 30)


def whole_plan(counts, capacity, **limits):
    """A plan that was checked to hold every item once, in fillings that fit."""
    plan = packing.plan(counts, capacity, **limits)
    held = Counter()
    for filling, times in plan.fillings:
        assert packing.used_by(filling) <= capacity
        for n, k in filling:
            held[n] += k * times
    assert held == Counter(counts) and plan.bound <= plan.bins == sum(t for _, t in plan.fillings)
    return plan


def test_plan_of_many_short_items():
    assert whole_plan({3: 1365 * 4097}, 4096).proved
    assert whole_plan({1500: 1000, 1300: 1000, 3: 500_000}, 4096).bins == 1050
    assert whole_plan({n: 3 for n in range(1, 4097)}, 4096).proved
    assert packing.plan({}, 4096) == ([], 0, 0, True)


def test_plan_beats_best_fit():
    few = [26, 11, 6, 14, 12, 10, 7]  # best fit takes four
    plan = whole_plan(Counter(few), 30)
    assert plan.bins == 3 and plan.proved
    counts = {37: 2500, 31: 1500, 47: 500}
    plan = whole_plan(counts, 100)
    assert plan.bins == 1875 < 2000 == sum(t for _, t in packing.best_fit_decreasing(counts, 100)) and not plan.proved
    assert not whole_plan(counts, 100, effort=1).proved


def test_pack_runs_the_search(spark):
    rows = [(i, n) for i, n in enumerate(n for n, c in {37: 250, 31: 150, 47: 50}.items() for _ in range(c))]
    items = spark.createDataFrame([(i, n, 0, 0) for i, n in rows], "id long, length long, offset int, _salt int").drop("_salt")
    out = packing.pack(items, ["id"], capacity=100, per_salt=20).collect()
    assert sorted((r.id, r.length) for r in out) == rows and len({r.sequence_id for r in out}) == 188
    rooms = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert rooms.get(r.sequence_id, 0) == r.offset
        rooms[r.sequence_id] = r.offset + r.length
    assert max(rooms.values()) <= 100
    with pytest.raises(ValueError):
        packing.pack(items.withColumn("length", F.lit(101)), ["id"], capacity=100)


def test_pack_documents(spark):
    out = packing.pack_documents(docs(spark, ODD), BPE, capacity=64, keep_ids=True).collect()
    assert len([r for r in out if r.doc_id == 2]) == 1
    seq = {}
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs(spark, []), BPE).count() == 0


def test_fast_tokens_equal_plain(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = [None, "", "don't I'LL x.,y ., 'S", "İ. É, ß́", "<|endoftext|> <|EndOfText|>", "a\u0085b\x1cc 日本。", "Plain words, and more."]
    rows += ["Latin ſ ŉ ǅ word, x), (y). 3. z..", "a  b", *(f"word{chr(97 + i % 26)}{i}. Ünd," for i in range(300))]
    want = [t.encode(r or "", add_special_tokens=False).ids for r in rows]
    words = packing.Words(BPE)
    assert [x.tolist() for x in words.encode(rows)] == want
    monkeypatch.setattr(packing, "WORDS", 40)  # nearly all is forgotten before every slice
    assert [words.encode([r])[0].tolist() for r in rows] == want and len(words.row) < 100


def test_chat_round_trip(spark):
    nasty = "a</s>b<\\/s>[INST] \\\\[/INST][TURN]<<s>"
    rows = [(1, 0, "user", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (1, 3, "assistant", "x"), (2, 0, None, ""), (2, 0, "a[/ROLE]", "é")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).orderBy("conv_id").collect()
    assert [tuple(x) for x in got[0].t] == [("user", nasty), ("user", ""), ("assistant", nasty), ("assistant", "x")]
    assert got[0].m == nasty + "x" and got[1].m == ""
    assert [tuple(x) for x in got[1].t] == [("", ""), ("a[/ROLE]", "é")]
    assert "Python" not in out._jdf.queryExecution().toString()


def test_chat_of_odd_rows(spark):
    rows = [(None, 1, "user", "a", 9, "x"), (None, 0, "assistant", "b", 9, "x"), (3, None, "user", "n", 9, "x"), (3, 1, "user", "r", 9, "x"), (3, 1, "user", "r", 9, "x"), (4, 1, "assistant", "", 9, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ts int, blocks string")
    got = {r.conv_id: [tuple(x) for x in r.t] for r in chat.format_chats(df).select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {None: [("assistant", "b"), ("user", "a")], 3: [("user", "n"), ("user", "r"), ("user", "r")], 4: [("assistant", "")]}
    assert chat.format_chats(df.limit(0)).count() == 0
    many = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.format_chats(many).select(F.size("loss_spans").alias("n"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    assert out.n == 2000 and out.m == "".join(str(i) for i in range(1, 4000, 2))


def test_secrets_of_odd_rows(spark):
    rows = [*ODD, (9, "token=abcdefgh12"), (9, "token=abcdefgh12"), (10, "a " * 60_000 + "secret: hunter2hunter2")]
    df = docs(spark, rows).withColumn("spans", F.lit("mine")).withColumn("base", F.lit(0))
    got = secrets.find_secrets(df).collect()
    assert sorted((str(r.doc_id), len(r.base), len(r.spans)) for r in got) == sorted((str(i), int(i in (9, 10)), int(i in (9, 10))) for i, _ in rows)
    clean = secrets.redact(df)
    assert clean.columns == df.columns and clean.where("text like '%hunter2%' or text like '%abcdefgh12%'").count() == 0 and clean.count() == len(rows)
    assert secrets.find_secrets(df.limit(0)).count() == secrets.redact(df.limit(0)).count() == 0


def test_secrets_base_against_plain():
    """Base spans by a scanner that tries every start, over texts of the patterns' own parts."""
    import re as regex

    rng = np.random.default_rng(12)
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abcdefgh", "Ab1+/_.=-", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "deadbeef" * 5, "\n", "é", "x"]
    assign = regex.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", regex.I | regex.A)
    kinds = ((assign, lambda m: len(m[1]) >= 8), (regex.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (regex.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32))
    for _ in range(400):
        text = "".join(rng.choice(parts, 12))
        want = []
        for kind, (pattern, fits) in enumerate(kinds):
            at = 0
            while at < len(text):
                m = pattern.match(text, at)
                if not m:
                    at += 1
                    continue
                if fits(m):
                    want.append((m.start(), kind, m.end()))
                at = m.end()
        assert secrets.scan(text)[0] == sorted(want), text


def test_secrets_base_and_layers(spark):
    import base64
    import gzip
    from urllib.parse import quote

    secret = "password = hunter22"
    packed = base64.b64encode(gzip.compress(secret.encode())).decode()
    twice = base64.b64encode(base64.b64encode(b"token=abcdefgh12")).decode()
    for text, inside in ((quote(secret, safe=""), None), (packed, packed), (twice, twice), ("pass\\u0077ord=hunter22", None), (secret.encode().hex(), secret.encode().hex())):
        base, spans = secrets.scan("é " + text + " end")
        found = [s for s in spans if s[1] == 0]
        assert found, text
        assert ("é " + text + " end")[found[0][0] : found[0][2]].strip() in text
        assert set(base) <= set(spans)
    assert secrets.base_spans("token=secret: abcdefghijk") == []
    assert secrets.base_spans("AKIA" + "A" * 11) == [] and len(secrets.base_spans("AKIA" + "A" * 12)) == 1
    assert secrets.joined(secrets.scan("TOKEN:'12345678")[0]) == "assign:0:15"
    assert secrets.find_secrets(docs(spark, ODD)).count() == len(ODD)
    clean = secrets.redact(docs(spark, [(1, "my secret=abcdefgh1 x"), (2, None)])).orderBy("doc_id").collect()
    assert clean[0].text == "my [SECRET] x" and clean[0].n_chars == len(clean[0].text) and clean[1].text is None


@pytest.mark.parametrize("wrap", ("base64", "hex", "gzip"))
@pytest.mark.parametrize(
    "raw",
    ["note:\u00a0password=hunter2hunter2".encode(), "\ufeffpassword=hunter2hunter2".encode(), "password=hunter2hunter2".encode("utf-16"), "é password=hunter2hunter2 ж".encode("utf-16-be"), "password=hunter2hunter2".encode("utf-32-le")]
    + ["café password=hunter2hunter2".encode("latin-1"), b"\x1b[31mpassword=hunter2hunter2\x1b[0m", b"a\0b\x0cpassword=hunter2hunter2", "👩\u200d🚀 soft\u00adhyphen\u3000password=hunter2hunter2".encode()],
)
def test_secrets_beside_any_bytes(raw, wrap):
    import base64
    import gzip

    run = raw.hex() if wrap == "hex" else base64.b64encode(gzip.compress(raw) if wrap == "gzip" else raw).decode()
    base, spans = secrets.scan("see " + run)
    assert (4, 0, 4 + len(run)) in spans and base == [s for s in base if s[1] == 2]


def test_secrets_in_url_escapes_that_are_not_utf8():
    assert [s[1] for s in secrets.scan("%E9%20%70assword%3Dhunter2hunter2")[1]] == [0]
    assert [s[1] for s in secrets.scan("%E9%70%61%73%73%77%6F%72%64%3Dhunter2hunter2")[1]] == [0]



def found_in(text, **more):
    return [s for s in secrets.scan(text, **more)[1] if s[1] == 0]


@pytest.mark.parametrize("name", ("gzip", "bz2", "lzma", "zlib", "zstd"))
def test_secrets_in_any_member_of_a_stream(name):
    import base64
    import importlib

    import zstandard

    pack = zstandard.compress if name == "zstd" else importlib.import_module(name).compress
    run = lambda raw: base64.b64encode(raw).decode()
    first, second = pack(b"nothing here"), pack(b"password=hunter2hunter2")
    assert found_in(run(first + second)) and found_in(run(first + first + second))
    long = np.random.default_rng(1).bytes(90_000)
    for cut in (0, 30_000, 59_990, 90_000):
        data = pack(long[:cut] + b" password=hunter2hunter2 " + long[cut:])
        assert found_in(run(data), max_layer=30_000), cut
    deep = b"password=hunter2hunter2"
    for _ in range(12):
        deep = pack(deep)
    assert found_in(run(deep))
    broken = pack(b"password=hunter2hunter2 " + long)
    assert name == "bz2" or found_in(run(broken[: len(broken) // 2]))


def test_secrets_in_wrapped_and_prefixed_runs():
    import base64
    import gzip

    rng = np.random.default_rng(2)
    filler = "".join(rng.choice(list("abcdefgh ijkl"), 300))
    for raw in ((filler[:50] + "password=hunter2hunter2" + filler).encode(), gzip.compress((filler + "password=hunter2hunter2").encode())):
        b64 = base64.b64encode(raw).decode()
        for width, end in ((64, "\n"), (76, "\r\n"), (64, "\n  ")):
            lines = end.join(b64[i : i + width] for i in range(0, len(b64), width))
            for text in (lines, "-----BEGIN SECRET-----\n" + lines + "\n-----END SECRET-----", "a-name-long-enough-for-a-run\n" + lines + "\nof prose"):
                found = found_in(text)
                assert found and text[found[0][0] : found[0][2]] in text and "of prose" not in text[found[0][0] : found[0][2]]
        for prefix in ("path/", "a-", "key_", "x/yy/zzz-"):
            assert found_in("see " + prefix + b64), prefix
        hexed = raw.hex()
        assert found_in("\n".join(hexed[i : i + 64] for i in range(0, len(hexed), 64)))


def test_secrets_long_runs_take_time_in_proportion():
    import time

    began = time.process_time()
    for text in ("A" * 400_000, "ab/" * 140_000, "abcdefghijklmnopqrstuvw\n" * 16_000, "x" * 400_000 + "\n "):
        secrets.scan(text)
    assert time.process_time() - began < 20



def test_secrets_in_rarer_wrappings():
    import base64
    import zlib

    plain = "password = hunter2hunter2"
    bare = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = base64.b64encode(bare.compress((plain + " and more of it, said once again").encode()) + bare.flush()).decode()
    b64 = base64.b64encode(plain.encode()).decode()
    for wrapped in (
        "".join(f"%u{ord(c):04x}" for c in plain), "".join(f"\\{ord(c):03o}" for c in plain), plain.replace(" ", "+").replace("=", "%3D"), packed, f'"{b64[:12]}" + "{b64[12:]}"', f"'{b64[:12]}'\n  '{b64[12:]}'", f'"{b64[:20]}"."{b64[20:]}"',
    ):
        text = f"see: {wrapped} !"
        base, found = secrets.scan(text)
        assert any(k == 0 and 5 <= a < b <= 5 + len(wrapped) for a, k, b in found), wrapped
    # neither joints between other texts nor pluses alone make anything of what is nothing
    for text in ('["aaaa", "bbbb"]', "a + b " * 50, '"' + " " * 100_000, "\\12", "%u12", "+" * 1000 + "%41"):
        assert secrets.scan(text) == ([], [])


@pytest.mark.parametrize("failure", [None, MemoryError])
def test_secrets_failures_are_no_results(monkeypatch, failure):
    """A stream that cannot be read for want of a decoder or of memory is not one that holds nothing."""
    zstandard = pytest.importorskip("zstandard")
    text = base64.b64encode(zstandard.compress(b"the password = hunter2hunter2 is here")).decode()
    assert [k for _, k, _ in secrets.scan(text)[1]] == [0]
    if failure is None:
        monkeypatch.setitem(sys.modules, "zstandard", None)
    else:

        def fails(*args, **named):
            raise failure

        monkeypatch.setattr(zstandard, "ZstdDecompressor", fails)
    with pytest.raises(failure or ImportError):
        secrets.scan(text)


def test_secrets_in_frames_of_a_large_window():
    zstandard = pytest.importorskip("zstandard")
    c = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=28)).compressobj()
    filler = bytes(np.random.default_rng(1).choice(list(b"abcd "), 4000))  # what can be packed, so that nothing stands there as it is
    text = base64.b64encode(c.compress(filler + b" the password = hunter2hunter2 " + filler) + c.flush()).decode()
    assert 0 in [k for _, k, _ in secrets.scan(text)[1]]


def test_urls(spark):
    rows = [(1, "http://WWW.example.com/en/x?a=1"), (2, "https://a.example.com/en/"), (3, "http://x.net/es/1#t"), (4, None), (5, "no scheme"), (6, "http://x.org/p"), (7, "http://net"), (8, "http://b.com/q")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, "h", 0.5) for i, u in rows], "page_id long, url string, host string, label double")).collect()}
    assert [out[i].rule for i in range(1, 9)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, "com/"]
    assert out[1].verdict == "allow" and out[2].verdict == "block" and out[4].host == "" and out[7].path == ""
    assert all(r.verdict in ("allow", "block") for r in out.values())
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_learn_from_given_labels(spark):
    rng = np.random.default_rng(3)
    url = lambda bad: f"http://{'x9k2q7' if bad else 'garden'}{rng.integers(1000)}.org/{'a=1&b=2?' + 'z' * 30 if bad else 'news'}"
    labels = [(url(i % 2 == 0), i % 2 == 0) for i in range(600)]
    fresh = [(i, url(i % 2 == 0)) for i in range(200)] + [(900, None), (901, "http://a.com/x")]
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in fresh], "page_id long, url string, host string, suffix string")
    out = {r.page_id: r for r in urls.judge(pages, labels=spark.createDataFrame(labels, "url string, blocked boolean")).collect()}
    right = sum((out[i].verdict == "block") == (i % 2 == 0) for i in range(200))
    assert right >= 190 and out[901].verdict == "allow" and out[901].blocked_score is None and len(out) == len(fresh)
    # hosts that no label knows, by features that are right in four of five cases
    host = lambda i: f"http://h{i}x{rng.integers(10**6)}.s{i}.org/"
    lexical = lambda i, bad: host(i) + ("a/b/c/d/e/?p=1&q=2&r=" + "7" * 20 if bad ^ (rng.random() < 0.2) else "news")
    known = [(lexical(i, i % 3 == 0), i % 3 == 0) for i in range(3000)]
    other = spark.createDataFrame([(i, lexical(i + 5000, i % 3 == 0)) for i in range(600)], "page_id long, url string")
    got = urls.judge(other, labels=spark.createDataFrame(known, "url string, blocked boolean")).collect()
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in got) >= 0.75 * 600
    # very long and repeated urls
    long = spark.createDataFrame([(1, "http://a.org/" + "x/" * 200_000), (1, "http://a.org/" + "x/" * 200_000), (2, "http://a.org/b")], "page_id long, url string")
    assert sorted(r.page_id for r in urls.judge(long, labels=spark.createDataFrame(known[:300], "url string, blocked boolean")).collect()) == [1, 1, 2]
    # labels of one class, or none, give that class, or allow
    for some, want in ((labels[::2], "block"), (labels[1::2], "allow"), ([], "allow")):
        got = urls.judge(pages, labels=spark.createDataFrame(some, "url string, blocked boolean")).where("rule is null").select("verdict").distinct().collect()
        assert [r.verdict for r in got] == [want]


def test_urls_rules_against_plain(spark):
    import re as regex

    hosts = ["com", "a.com", "xcom", "EXAMPLE.com", "www.example.com", "w.www.example.com", "net", "n.net", "example.com.net", "", "org:80"]
    paths = ["", "/", "/en/", "/en", "/es/x", "/fr/", "?q=/en/", "#/en/", "/EN/", "/en/?a#b"]
    rows = list(enumerate([f"{s}{h}{p}" for s in ("http://", "x://y://", "//", "") for h in hosts for p in paths] + ["http://net/es/\nx"]))
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for i, u in rows:
        m = regex.search(r"://([^/?#]*)([^?#]*)", u, regex.S)
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1] if best else None), u
        assert not best or got[i].verdict == best[2]


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(len(w), words)
        if i is not None:
            sets.setdefault(i, []).append(frozenset(b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for g in range(25):
        base = rng.choice(vocabulary, 80).tolist()
        for c in range(6):
            copy = list(base)
            for _ in range(c):
                copy[rng.integers(80)] = f"n{rng.integers(10**6)}"
            rows.append((100 + 10 * g + c, " ".join(copy)))
    for words, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), words=words, percent=percent, block_docs=4).collect()}
        got.pop(None)
        assert got == brute_components(rows, words, percent)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(20, 16))
    v = np.repeat(centre, 8, axis=0) + 0.15 * rng.normal(size=(160, 16))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v.astype(np.float32))]
    rows += [(500, rows[3][1]), (501, None), (502, [0.0] * 16), (503, [math.nan] * 16), (504, [1.0]), (505, [2.0])]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    good = [(i, np.array(x, float)) for i, x in rows if x and len(x) == 16 and np.isfinite(x).all() and np.any(x)]
    ids, m = [i for i, _ in good], np.stack([x for _, x in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.9
    true = {i: int(linked[k].sum()) - 1 for k, i in enumerate(ids)}
    assert all(got[i].n_links <= true[i] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.95 * sum(true.values())
    assert got[501].n_links == got[502].n_links == got[503].n_links == 0 and got[504].n_links == 1 and got[505].component_id == 504


def near(rng, x, cos):
    """A row at the cosine from each row of x, which has length 1."""
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    return cos * x + np.sqrt(1 - np.square(cos)) * z / np.linalg.norm(z, axis=1)[:, None]


def hot_and_pairs(rng, hot, pairs, cos):
    """A large group of close copies and many groups of two."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(pairs, 64)))
    return near(rng, np.repeat(unit(rng.normal(size=(1, 64))), hot, axis=0), 0.999), x, near(rng, x, cos)


def test_near_vectors_of_repeated_ids_and_many_lengths(spark):
    rows = [(1, [1.0, 0.0])] * 3 + [(2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    rows += [(100 * d + i, [1.0] * d) for d in range(3, 70) for i in range(2)]
    df = spark.createDataFrame([(i, v, 1, "m") for i, v in rows], "vec_id long, embedding array<double>, rep int, mult string")
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    links = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got}
    assert {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, True)} <= links
    assert all((100 * d + i, 1, 100 * d, i == 0) in links for d in range(3, 70) for i in range(2))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_finds_far_links_beside_a_hot_group(spark):
    group, a, b = hot_and_pairs(np.random.default_rng(4), 600, 700, 0.91)
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([group, a, b]))]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[600 + i].component_id == got[1300 + i].component_id for i in range(700)) >= 0.99 * 700
    assert all(got[i].n_links == 599 for i in range(600))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_grid_is_visited_on_given_tables(spark, sf, monkeypatch):
    """Recall against brute force over whole tables, by visits to a part of the cells. Each vector has a near copy, as the
    smaller table has no links of its own."""
    made = []
    fit = vectors.fit
    monkeypatch.setattr(vectors, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rng = np.random.default_rng(8)
    copies = near(rng, x, 0.91 + 0.08 * rng.random((len(x), 1)))
    rows += [(10**6 + i, v.tolist()) for i, v in enumerate(copies)]
    x = np.vstack([x, copies])
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    linked = x @ x.T >= 0.9
    true = linked.sum(1) - 1
    assert len(made) == 1 and 1 < made[0].visits < len(made[0].first) * len(made[0].second) / 2
    assert all(got[i].n_links <= n for (i, _), n in zip(rows, true))
    assert sum(r.n_links for r in got.values()) >= 0.995 * true.sum() > 0


def test_visits_reach_the_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    group, a, _ = hot_and_pairs(rng, 2000, 6000, 0.9)
    x = np.vstack([group, a])[rng.permutation(8000)]
    grid = vectors.fit(x, 200_000, 0.9, 0.995, 1024)
    for cos in (0.9, 0.92, 0.95):
        b = near(rng, a, cos)
        found = (grid.visit(a) == grid.visit(b, 1)).any(1) | (grid.visit(b) == grid.visit(a, 1)).any(1)
        assert found.mean() >= 0.985, cos


def test_language(spark):
    en, fr = "the and of thing with other ", "le et de chose avec autre "
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice((en if i % 2 else fr).split(), 60)), "en" if i % 2 else "fr") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = language.learn(df, F.col("doc_id") < 60)
    out = language.identify(df.where("doc_id >= 60"), dicts).collect()
    assert all(r.lang_pred == r.lang for r in out)
    odd = {r.doc_id: r for r in language.identify(docs(spark, [(1, None), (2, "12 !"), (3, "")]), dicts).collect()}
    assert all(r.lang_pred == "und" and r.lang_rejected and r.lang_score == 0 for r in odd.values())
    assert language.identify(docs(spark, [(1, "abc")]), language.learn(docs(spark, []), F.lit(True))).first().lang_pred == "und"


def test_language_against_plain(spark):
    """Sizes by the library's own compressor, without blocks' reuse, decide; ties are rejected at every length."""
    import zstandard

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dicts = language.learn(rows, F.lit(True), per_lang=50, dict_bytes=4096)
    assert set(dicts) == {r[0] for r in rows.where("lang is not null").select("lang").distinct().collect()} and all(2000 < len(d) <= 4096 for d in dicts.values())
    made = {}
    for lang, d in dicts.items():
        z = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, source_size=language.BLOCK, dict_size=len(d), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        made[lang] = lambda raw, d=d, z=z: sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=z).compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK))
    texts = [r.text for r in rows.select("text").limit(40).collect()] + ["a", "12 3", "", None, "q"]
    for t, (lang, margin, score) in zip(texts, language.identify_texts(texts, dicts)):
        if not t or not any(map(str.isalpha, t)):
            assert (lang, margin, score) == ("und", 0.0, 0.0)
            continue
        sizes = sorted((f(language.normal(t)), name) for name, f in made.items())
        plain = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert 0 <= score <= 1 and (plain < language.CLOSE or (lang, margin) == (sizes[0][1], plain))
    same = {k: next(iter(dicts.values())) for k in ("xx", "aa", "mm")}
    out = language.identify(docs(spark, [(1, "some words that tie"), (1, "some words that tie"), (2, "long " * 3000)]), same).collect()
    assert all(r.lang_pred == "aa" and r.lang_rejected and r.lang_margin == 0 for r in out) and len(out) == 3
    assert language.identify(docs(spark, []), dicts).count() == 0


def test_even_cuts():
    for sizes, total in (([5, 5], 20), ([5, 50, 500], 60), ([], 5), ([7], 3), ([0, 0, 9], 4)):
        cut = language._even(sizes, total)
        assert sum(min(n, cut) for n in sizes) <= total
        assert cut >= max(sizes, default=0) or sum(min(n, cut + 1) for n in sizes) > total


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    plain = ["table", "window", "garden", "river", "simple", "morning", "walking", "letter", "number", "yellow"]
    bad = ["idiotic", "worthless", "scumbag"]
    rows, labels = [], []
    for i in range(240):
        w = rng.choice(plain, 20).tolist()
        if i % 4 == 0:
            w[7] = bad[i % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), lab, F.lit(True))
    tests = [(1, "you wor-thless thing"), (2, "i d i o t i c and more"), (3, "a scumxbag here"), (4, "simple morning table"), (5, None), (6, ""), (7, "river " * 3000)]
    s = {r.doc_id: r.toxicity for r in toxicity.score(docs(spark, tests), model).collect()}
    assert s[1] >= 0.3 and s[2] >= 0.3 and s[3] >= 0.3
    assert all(s[i] < 0.3 for i in (4, 5, 6, 7))
    flat = toxicity.learn(docs(spark, rows), lab.where("toxic = 0"), F.lit(True))
    assert toxicity.score(docs(spark, tests), flat).where("toxicity <> 0").count() == 0
    # nothing tells toxic texts apart: none is called so
    for labels_, texts in ((lab.where("toxic = 1"), rows), (lab, [(i, " ".join(plain)) for i, _ in rows])):
        blind = toxicity.learn(docs(spark, texts), labels_, F.lit(True))
        assert toxicity.score(docs(spark, tests), blind).where("toxicity >= 0.3").count() == 0
    assert toxicity.score(docs(spark, []), model).count() == 0 and toxicity.score(docs(spark, rows[:2] * 2), model).select("toxicity").distinct().count() <= 2


def test_document_values_are_those_of_the_worst_unit():
    model = toxicity.Model(np.random.default_rng(6).normal(size=toxicity.SIZE**3).astype(np.float32), -0.1, key=5)
    texts = ["one Two, three", None, "", " a b c d ef", "x. y. z. w", "a b c and d", "é" * 60 + " 12 !!", "one Two, three"]
    want = []
    for t in texts:
        words = (t or "").split()
        single = [len(w.strip(".*_-")) == 1 for w in words]
        units = [toxicity.unit_of(w) for w in words]
        for a in range(len(words)):
            if single[a] and (a == 0 or not single[a - 1]):
                run = list(itertools.takewhile(lambda i: single[i], range(a, len(words))))
                units += ["".join(units[i] for i in run)] * (len(run) > 3)
        want.append(max([float(model.decide([u])[0]) for u in units], default=toxicity.NO_UNIT))

    for _ in range(2):  # judged, then remembered
        assert toxicity.document_values(pa.array(texts), model).tolist() == pytest.approx(want)


def test_kernel_is_a_gapped_subsequence_kernel():
    a, b = "abc", "axbc"
    feats = []
    for u in (a, b):
        t, f = "^" + u + "$", Counter()
        for i, j, k in itertools.combinations(range(len(t)), 3):
            if k - i < toxicity.SPAN:
                f[t[i] + t[j] + t[k]] += toxicity.LAMBDA ** (k - i + 1)
        feats.append(f)
    dot = sum(feats[0][x] * feats[1][x] for x in feats[0])
    want = dot / math.sqrt(sum(v * v for v in feats[0].values()) * sum(v * v for v in feats[1].values()))
    assert toxicity.kernel([a], [b])[0, 0] == pytest.approx(want)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, d)
        assert out.columns == table.columns, name
    assert corpus_pipeline.run(spark, d).count() > 0


def clashing(spark, d):
    """Documents with nulls in any column, empty texts, repeated rows and columns named like those that stages add."""
    t = spark.read.parquet(f"{d}/documents.parquet")
    odd = [(None, "a b", None, None, None), (9001, None, "en", None, 0), (9002, "", None, "s", 0), (9003, "12 34", "en", "s", 5), (9004, "word " * 9000, None, None, None)]
    odd += [(9005, "one and the same row of text", "en", "s", 28)] * 3
    own = [f.name for f in t.schema]
    t = t.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(f.name).cast(f.dataType) for f in t.schema]))
    for c in ("toxicity", "_v", "lang_pred", "lang_rejected", "found_pred", "_lid", "kept", "component_id", "length", "sequence_id"):
        t = t.withColumn(c, F.lit("x"))
    return t, own


def test_pipeline_against_plain(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    given, _ = clashing(spark, d)
    pairs = lambda df: Counter(tuple(r) for r in df.select("doc_id", "text").collect())
    model = toxicity.learn(given, spark.read.parquet(f"{d}/labels.parquet"), F.lit(True))
    flat = getattr(model, "constant", None)
    toxic = lambda t: (flat if flat is not None else model.score(toxicity.document_values(pa.array([t], pa.string()), model))[0]) >= corpus_pipeline.TOXIC
    one = corpus_pipeline.drop_toxic(spark, given, d).cache()
    assert pairs(one) == Counter({k: n for k, n in pairs(given).items() if not toxic(k[1])}) and one.columns == given.columns

    dicts = language.learn(one, F.lit(True))

    def named(text):
        lang, margin, _ = language.identify_texts([text], dicts)[0]
        return lang != "und" and margin >= corpus_pipeline.NARROW

    two = corpus_pipeline.drop_unknown_language(spark, one, d).cache()
    assert pairs(two) == Counter({k: n for k, n in pairs(one).items() if named(k[1])})
    assert two.columns == given.columns and two.where("lang is null").count() == 0

    three = corpus_pipeline.drop_near_duplicates(spark, two, d).cache()
    rows = list(pairs(two))
    parts = brute_components(rows, 5, 80)
    assert pairs(three) == Counter((i, t) for i, t in rows if i is None or parts[i] == i) and three.columns == given.columns

    four = corpus_pipeline.mask_secrets(spark, three, d).cache()
    left = dict(pairs(four).keys())
    assert left.keys() == dict(pairs(three).keys()).keys() and four.columns == given.columns
    for i, t in pairs(three):
        spans = secrets.scan(t or "")[1]
        assert left[i] == t if not spans else "[SECRET]" in left[i] and all(t[a:b] not in left[i] for a, _, b in spans)

    five = corpus_pipeline.pack(spark, four, d).collect()
    plain, ids, seq = Tokenizer.from_file(BPE), {}, {}
    for r in sorted(five, key=lambda r: r.piece):
        ids[r.doc_id] = ids.get(r.doc_id, []) + list(r.ids)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert ids == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in left.items()}
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seq) == packing.lower_bound(Counter(r.length for r in five), 4096) == five[0].fewest_possible and five[0].proved


def test_pipeline_on_empty_tables(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing(spark, d)[0].limit(0), d)
        assert out.count() == 0, name
