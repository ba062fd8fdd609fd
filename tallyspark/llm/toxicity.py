"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Unit of judgement: a word of a sentence, lower-cased, letters only, between boundary marks; runs of four or more
single letters ("i d i o t") are one more unit. The kernel of two units is the normalised gap-weighted kernel over
subsequences of three characters, each weighted LAMBDA to the power of the stretch it spans (at most SPAN), so
inserted or missing characters only lower it. A sentence has the decision value of its worst unit, a document that
of its worst sentence, and a logistic curve turns it into a score. So an insult made of words that are each
ordinary is not seen.

Learning is multiple-instance: labels mark documents, so units that are typical of toxic documents in a bounded
sample become landmarks and positive examples (with one inserted letter too); units of clean documents are the
negative ones, with the hardest mined in further rounds. Bounds: `sample` labelled documents a class, `landmarks`
landmarks, `negatives` units.

As the decision is linear in the kernel's feature map, the landmarks fold into one weight for each subsequence, and
judging a unit costs the same whatever their number.

Defined cases: null or empty texts, or texts without letters, have no unit and get the lowest score of the curve;
without labels of both classes, or without a unit that tells them apart, every score is the share of positive labels,
but NO_EVIDENCE at most, so that nothing is called toxic. Texts are used whole; repeated rows get equal scores; of
several labels of an id the largest counts; ties between units go to the alphabetically first; an empty table gives an
empty result; columns other than the id and the text are passed through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows, fresh, materialize, ship, without, worker_state

LAMBDA, SPAN, SIZE = 0.7, 6, 128
LONG = 24  # letters of a unit judged at once; longer ones are judged in overlapping windows
NO_UNIT = -3.0
NO_EVIDENCE = 0.25
CACHE = 100_000  # tokens in each of the two generations that a worker remembers
SLICE = 2_000_000  # characters judged at once
_SINGLE = re.compile(r"[^\W\d_][.*_-]*")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_state: dict = worker_state("toxicity")
OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
POWERS = LAMBDA ** np.arange(8)


def unit_of(token: str) -> str:
    return _NOT_LETTER.sub("", token.lower())


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Of texts: the different tokens between white space, the number of each in turn, where every text's begin (and the
    last's end), and (text, unit) of runs of single letters."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
    coded = parts.flatten().dictionary_encode()
    different, number = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    single = np.array([_SINGLE.fullmatch(t) is not None for t in different], bool)
    at = np.flatnonzero(single[number]) if len(number) else np.empty(0, np.int64)
    owner = np.searchsorted(ends, at, side="right") - 1
    runs = np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1)
    return different, number, ends, [(int(owner[r[0]]), "".join(unit_of(t) for t in different[number[at[r]]])) for r in runs if len(r) >= 4]


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of every subsequence of each unit, repeated codes of a row summed."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    width = int(size.max(initial=0)) + 2
    grid = np.zeros((len(units), width + SPAN), dtype=np.int64)
    chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
    grid[np.repeat(np.arange(len(units)), size), np.arange(1, len(chars) + 1) - np.repeat(np.cumsum(size) - size, size)] = 3 + chars % (SIZE - 3)
    grid[:, 0], grid[np.arange(len(units)), size + 1] = 1, 2
    keys = []
    a = grid[:, :width]
    index = np.broadcast_to(np.arange(len(units))[:, None], a.shape)
    for j, k in OFFSETS:
        b, c = grid[:, j : j + width], grid[:, k : k + width]
        live = (a > 0) & (c > 0)
        # the span in the lowest bits, so that sorting numbers is enough
        keys.append((((index * SIZE + a) * SIZE + b) * SIZE + c)[live] * 8 + k + 1)
    key = np.concatenate(keys)
    key.sort()
    weights, key = POWERS[key & 7], key >> 3
    first = np.flatnonzero(np.diff(key, prepend=-1))
    weights = np.add.reduceat(weights, first) if len(first) else weights
    return key[first] // SIZE**3, key[first] % SIZE**3, weights


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_codes with each unit's weights scaled to length 1."""
    row, code, weight = _codes(units)
    norm = np.sqrt(np.bincount(row, weight**2, len(units)))
    return row, code, weight / np.maximum(norm, 1e-12)[row]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel matrix (left x right)."""
    _, rc, rw = r = features(right)
    codes, at = np.unique(rc, return_inverse=True)
    dense = np.zeros((len(codes), len(right)))
    dense[at, r[0]] = rw
    out = np.zeros((len(left), len(right)))
    for lo in range(0, len(left), 2000):
        row, code, weight = features(left[lo : lo + 2000])
        place = np.searchsorted(codes, code).clip(max=max(0, len(codes) - 1))
        hit = codes[place] == code if len(codes) else np.zeros(len(code), bool)
        row, place, weight = row[hit], place[hit], weight[hit]
        part = np.zeros((min(2000, len(left) - lo), len(right)))
        for at_ in range(0, len(row), 50_000):
            s = slice(at_, at_ + 50_000)
            np.add.at(part, row[s], dense[place[s]] * weight[s, None])
        out[lo : lo + 2000] = part
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 40) -> np.ndarray:
    """Linear machine (last weight is the bias): squared hinge loss with a ridge, by Newton steps on its active set."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, active = np.zeros(x.shape[1]), None
    hold = ridge * np.eye(x.shape[1])
    hold[-1, -1] = 1e-9
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (wa[:, None] * xa) + hold, xa.T @ (wa * y[active]))
        w = new if _ < 10 else (w + new) / 2
    return w


class Model:
    """Decision values of units: one weight for each subsequence, and a bias."""

    def __init__(self, table: np.ndarray, bias: float, slope: float = 4.0, shift: float = 0.0, key: int = 0):
        self.table, self.bias, self.slope, self.shift, self.key = table, bias, slope, shift, key

    def decide(self, units: list[str]) -> np.ndarray:
        """Units longer than LONG are judged in overlapping windows; the worst counts."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.flatnonzero((size >= 3) & (size <= LONG))
        owner = owner[np.argsort(size[owner], kind="stable")]  # of like lengths together, as rows are padded
        parts = [units[i] for i in owner.tolist()]
        windows = [(i, units[i][at : at + LONG]) for i in np.flatnonzero(size > LONG).tolist() for at in range(0, size[i] - LONG // 2, LONG // 2)]
        owner = np.append(owner, np.array([i for i, _ in windows], np.int64))
        parts += [p for _, p in windows]
        out = np.full(len(units), NO_UNIT)
        for lo in range(0, len(parts), 2000):
            some = parts[lo : lo + 2000]
            row, code, weight = features(some)
            value = np.bincount(row, weight * self.table[code], len(some)) + self.bias
            np.maximum.at(out, owner[lo : lo + 2000], value)
        return out

    def score(self, value):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (np.asarray(value) - self.shift), -50, 50)))


def _machine(landmarks: list[str], positive: list[str], negative: list[str]) -> Model:
    gram = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(landmarks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.r_[np.full(len(positive), 1 / max(1, len(positive))), np.full(len(negative), 2 / max(1, len(negative)))]
    w = _svm(kernel(positive + negative, landmarks) @ root, y, weight)
    alpha = root @ w[:-1]
    row, code, value = features(landmarks)
    table = np.bincount(code, value * alpha[row], SIZE**3)
    return Model(table.astype(np.float32), float(w[-1]))


def cover(bags: list[set[str]], weight: dict[str, int]) -> list[str]:
    """Few units that explain the documents: again and again the one in most documents not explained yet.

    Units that only accompany others, as in copies of one toxic document, explain nothing more and stay out."""
    left, out = [b for b in bags if b], []
    while left:
        counts: dict[str, int] = {}
        for b in left:
            for u in b:
                counts[u] = counts.get(u, 0) + 1
        best = max(counts, key=lambda u: (counts[u], weight.get(u, 0), u))
        out.append(best)
        left = [b for b in left if best not in b]
    return out


def _inserted(word: str) -> list[str]:
    """The word with one letter of its own doubled or a far letter put in, by rule."""
    out = []
    for at in (len(word) // 3, len(word) // 2, 2 * len(word) // 3):
        if 0 < at < len(word):
            out.append(word[:at] + chr(97 + (7 * at + len(word)) % 26) + word[at:])
    return out


def _known_values(different: np.ndarray, model: Model) -> np.ndarray:
    """Decision values of tokens. A worker keeps those of tokens it has met, in two generations: a full one becomes the
    old one, from which what is met again returns."""
    worker_state("toxicity")
    if _state.get("key") != model.key:
        _state.update(key=model.key, young={}, old={})
    young, old = _state["young"], _state["old"]
    words = different.tolist()
    out = np.array([young.get(t) or old.get(t, np.nan) for t in words])
    new = np.flatnonzero(np.isnan(out))
    if len(new):
        out[new] = model.decide([unit_of(t) for t in different[new]])
    young.update(zip(words, out.tolist()))
    if len(young) > CACHE:
        _state.update(young={}, old=young)
    return out


def document_values(texts: pa.Array, model: Model) -> np.ndarray:
    """Worst decision value of each text."""
    different, number, ends, runs = tokens(texts)
    value = np.append(_known_values(different, model)[number], NO_UNIT)
    out = np.where(np.diff(ends) > 0, np.maximum.reduceat(value, ends[:-1]), NO_UNIT)
    if runs:
        np.maximum.at(out, [r[0] for r in runs], model.decide([r[1] for r in runs]))
    return out


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in stretches of about SLICE bytes."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))]) // SLICE
    bounds = np.flatnonzero(np.diff(at[:-1], prepend=-1)).tolist() + [len(texts)]
    for a, b in zip(bounds, bounds[1:]):
        yield texts.slice(a, b - a)


def _value_udf(model: Model):
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *(document_values(x, model) for x in slices(texts))]), pa.float64())

    return run


def _units_udf():
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out: list[list[str]] = []
        for x in slices(texts):
            different, number, ends, runs = tokens(x)
            own = np.array([unit_of(t) for t in different], object)[number]
            sets = [set(own[a:b]) for a, b in zip(ends, ends[1:])]
            for at, unit in runs:
                sets[at].add(unit)
            out += [sorted(u for u in s if len(u) >= 3) for s in sets]
        return pa.array(out, pa.list_(pa.string()))

    return run


def _flat(share: float) -> Model:
    out = Model(np.zeros(SIZE**3, np.float32), 0.0, 0.0, 0.0)
    out.constant = min(share, NO_EVIDENCE)
    return out


def learn(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 3000, landmarks: int = 160, negatives: int = 8_000, mining: int = 2) -> Model:
    """Model from labels (id, label) of documents that satisfy where."""
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    ids = docs.where(where & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().join(marked.withColumnRenamed(id_col, "id"), "id")
    # the least id hashes of each class: at most 2 * sample ids, whose texts are then read
    few = reduce(DataFrame.unionByName, [ids.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)])
    texts = docs.where(where).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = materialize(texts.join(F.broadcast(materialize(few, "toxic-ids")), "id").select("id", "y", "text"), "toxic-sample")
    totals = {int(r[0]): r[1] for r in picked.groupBy("y").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return _flat(n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0)
    counts = (
        picked.select("y", F.explode(_units_udf()("text")).alias("unit"))
        .groupBy("unit")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )
    counts = materialize(counts, "toxic-units")
    # A unit is evidence if it is in more toxic documents, and in hardly any clean one, than one of all the units
    # would be by chance.
    rate = n_pos / (n_pos + n_neg)
    rows = counts.where("pos > 0").count()
    least = max(2, math.ceil(math.log(max(2, rows)) / -math.log(rate)) if rate < 1 else 2)
    usable = counts.where((F.col("neg") <= 0.02 * F.col("pos")) & (F.col("pos") >= min(least, max(2, n_pos // 4))))
    top = usable.orderBy(F.desc("pos"), "unit").limit(20 * landmarks)
    evident = [(i, r["unit"], r["pos"]) for i, r in enumerate(top.collect())]
    listed = few_rows(spark, pa.schema([("number", pa.int32()), ("unit", pa.string()), ("pos", pa.int64())]), evident)
    bags = (
        picked.where("y = 1").select("id", F.explode(_units_udf()("text")).alias("unit"))
        .join(F.broadcast(listed), "unit")
        .groupBy("id").agg(F.collect_set("number").alias("us")).select("us").collect()
    )  # at most `sample` rows of numbers of at most 20 * landmarks evident units
    positive = cover([{evident[i][1] for i in r[0]} for r in bags], {u: n for _, u, n in evident})
    if not positive:
        return _flat(rate)
    clean = counts.where("neg >= 1 and pos <= neg")
    negative = [r[0] for r in clean.orderBy(F.xxhash64("unit")).limit(negatives).collect()]
    marks = positive[:landmarks]
    marks += negative[: max(16, landmarks // 4)]
    grown = positive + [v for p in positive for v in _inserted(p)]
    model = _machine(marks, grown, negative)
    for turn in range(mining):
        model.key = hash((turn, model.table.tobytes(), model.bias))
        value = _value_udf(model)
        hard = [r[0] for r in clean.withColumn("v", value("unit")).orderBy(F.desc("v"), "unit").limit(3000).collect()]
        negative = list(dict.fromkeys(hard + negative))
        model = _machine(marks, grown, negative)
    model.key = hash((model.table.tobytes(), model.bias))
    # the curve, on the sample's documents
    rows = picked.select("y", _value_udf(model)("text").alias("v")).collect()
    y, v = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    # The cut between the classes gets score 0.3: the middle of the gap around the best F1.
    cuts = np.unique(v)
    if len(cuts) > 512:
        cuts = np.unique(np.quantile(cuts, np.linspace(0, 1, 512)))
    f1 = np.array([2 * ((v >= c) & (y > 0)).sum() / max(1, (v >= c).sum() + (y > 0).sum()) for c in cuts])
    at = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    cut = float((cuts[at] + cuts[at - 1]) / 2) if at else float(cuts[at])
    a = 4.0
    b = cut + math.log(0.7 / 0.3) / a
    model.slope, model.shift = a, b
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with out_col double (0 to 1) added; a column of that name is replaced."""
    ship(docs.sparkSession)
    kept = without(docs, out_col).columns
    constant = getattr(model, "constant", None)
    if constant is not None:
        return docs.select(*kept, F.lit(float(constant)).alias(out_col))
    v = fresh(docs, "_v")
    x = F.least(F.lit(50.0), F.greatest(F.lit(-50.0), model.slope * (F.col(v) - model.shift)))
    return docs.withColumn(v, _value_udf(model)(F.col(text_col))).select(*kept, (1 / (1 + F.exp(-x))).alias(out_col))
