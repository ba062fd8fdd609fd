"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of `t` half keys, each built from `half` minhashes, are computed for every document; the
t * t table keys are all pairs (A_i, B_j). So t * t tables of 2 * half minhashes cost 2 * t * half hash functions
instead of 2 * t * t * half. t follows from the threshold and the wanted recall. Table keys are formed only for
documents that share a half key of either collection with another text; the others have no table in common.

Texts with equal shingle sets are collapsed first. Documents that meet in a table, however indirectly, form a
candidate cluster (one row to the bucket's smallest member each, never all pairs). Inside a cluster all members of
compatible size are compared on their full sets, block against block, within tasks: a block has at most
`block_docs` documents and about `block_weight` shingles, and only a spanning forest of the links found leaves the
task. So links are exact on candidates, nothing is capped, and no pair rows are made.

Words are maximal runs without space or \\t\\n\\v\\f\\r, A-Z lower-cased. A document's set: its different runs of
`words` words; with fewer words, the whole sequence as one; without words or text, empty and linked with nothing.
Defined cases: rows of one id are one document (linked); a row with a null id is linked with nothing and kept;
an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, heavy_keys, join_heavy, likely_in, materialize, ship

U64 = np.uint64
MIX = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX[1]
    x = (x ^ (x >> U64(27))) * MIX[2]
    return x ^ (x >> U64(31))


def shingles(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted different 64-bit shingle hashes of a UTF-8 text."""
    import xxhash

    tokens = raw.lower().split() if raw else []
    n = len(tokens)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), U64, n)
    k = min(n, words)
    s = np.full(n - k + 1, k, U64)
    for i in range(k):
        s = _mix(s * MIX[0] + h[i : n - k + 1 + i])
    return np.unique(s)


def tables_for(threshold: float, half: int, recall: float) -> int:
    """Size of each collection, so that a pair at the threshold meets with probability recall."""
    return math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - threshold**half))


def _sketches(words: int, t: int, half: int):
    rng = np.random.default_rng(20240229)
    n = 2 * t * half
    mult, add = rng.integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=np.uint64)
    long_list = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("a", long_list), ("b", long_list)])

    def keys(s: np.ndarray) -> np.ndarray:
        least = np.full(n, np.iinfo(np.uint64).max, U64)
        for at in range(0, len(s), 4096):
            least = np.minimum(least, (s[at : at + 4096] * mult[:, None] + add[:, None]).min(axis=1))
        out = np.arange(2 * t, dtype=U64)
        for i in range(half):
            out = _mix(out * MIX[0] + least.reshape(2 * t, half)[:, i])
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out: list[list] = [[] for _ in schema]
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                    s = shingles(raw.as_py(), words)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) if len(s) else (0, 0)
                    key = keys(s) if len(s) else None
                    for o, v in zip(out, (doc, len(s), int(digest[0]), int(digest[1]), key[:t] if len(s) else None, key[t:] if len(s) else None)):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, type=f.type) for o, f in zip(out, schema)], schema=schema)

    return run


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a partition sorted by its first n_keys columns, group after group."""
    key, rows = None, []
    for b in batches:
        columns = [c.to_pylist() if not pa.types.is_list(c.type) else list(c) for c in b.columns]
        for row in zip(*columns):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Intersection sizes, rows left x columns right (indices into sets)."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    used = np.union1d(left, right)
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one document is in no intersection
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    width = int(column.max()) + 1 if len(column) else 0
    out = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, width, 8192):
        a, b = np.searchsorted(column, (lo, lo + 8192))
        m = np.zeros((len(used), min(8192, width - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out[np.ix_(np.searchsorted(used, left), np.searchsorted(used, right))].astype(np.int64)


def forest(links: np.ndarray, left: list[int], right: list[int]) -> Iterator[tuple[int, int]]:
    """(node, smallest node of its component) from a boolean matrix left x right, for nodes that differ."""
    label: dict[int, int] = {}

    def find(x: int) -> int:
        while label.setdefault(x, x) != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in np.argwhere(links):
        a, b = find(left[i]), find(right[j])
        if a != b:
            label[max(a, b)] = min(a, b)
    for x in list(label):
        if (r := find(x)) != x:
            yield x, r


def _verify(num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, rows in grouped(batches, 5):
            if len(rows) < 2:
                continue
            side = np.array([r[0] for r in rows])
            ids = [r[1] for r in rows]
            sets = [r[2].values.to_numpy(zero_copy_only=False).view(U64) for r in rows]
            size = np.array([len(s) for s in sets])
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(left) or not len(right):
                continue
            both = _shared(sets, left, right)
            linked = den * both >= num * (size[left][:, None] + size[right][None, :] - both)
            out += forest(linked, [ids[i] for i in left], [ids[j] for j in right])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    half: int = 4,
    recall: float = 0.999,
    block_docs: int = 512,
    block_weight: int = 400_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; percent is the least similarity in hundredths."""
    spark = docs.sparkSession
    ship(spark)
    threshold = percent / 100
    t = tables_for(threshold, half, recall)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = own.mapInArrow(_sketches(words, t, half), "doc_id long, n long, h1 long, h2 long, a array<long>, b array<long>")
    sketch = materialize(sketch, "sketches")
    some = sketch.where("n > 0 and doc_id is not null")
    copies = some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b"))
    copies = materialize(copies, "texts")
    # Half keys that another text has too. Positions are mixed into the keys.
    halves = copies.select("rep", F.explode(F.concat("a", "b")).alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = halves.join(shared, "key").groupBy("rep").agg(F.collect_set("key").alias("keys"))  # at most 2 t keys
    tables = (
        copies.join(live, "rep")
        .select("rep", F.explode(F.array_intersect("a", "keys")).alias("x"), F.array_intersect("b", "keys").alias("bs"))
        .select("rep", "x", F.explode("bs").alias("y"))
        .select("rep", F.xxhash64("x", "y").alias("table_key"))
    )
    tables = materialize(tables, "tables")
    heads = tables.groupBy("table_key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last")
    met = tables.join(heads.select("table_key", "head"), "table_key").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    clusters = connected_components(met.distinct())

    # Full sets of the clusters' members, in size classes: linked sets are in the same or the next class.
    base = math.log(1 / (threshold - 0.01))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(x.as_py(), words).view(np.int64) for x in part.column(2).cast(pa.binary())]
                kind = pa.array([int(math.log(max(1, len(s))) / base) for s in sets], pa.int32())
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), kind, n, pa.array(sets, pa.list_(pa.int64()))], names=["rep", "cluster", "kind", "n", "s"]
                )

    texts = likely_in(own.where("doc_id is not null and text is not null"), "doc_id", clusters.select("node"))
    members = texts.join(
        clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id"
    )
    members = members.select(F.col("doc_id").alias("rep"), "cluster", "text").mapInArrow(full, "rep long, cluster long, kind int, n long, s array<long>")
    members = materialize(members, "sets").where("n > 0")
    blocks = members.groupBy("cluster", "kind").agg(
        F.ceil(F.greatest(F.count("*") / block_docs, F.sum("n") / block_weight)).cast("int").alias("nb"), F.count("*").alias("c")
    )
    up = blocks.select("cluster", (F.col("kind") - 1).alias("kind"), F.col("nb").alias("nb_up"))
    down = blocks.select("cluster", (F.col("kind") + 1).alias("kind"), F.col("nb").alias("nb_down"))
    sizes = blocks.join(up, ["cluster", "kind"], "left").join(down, ["cluster", "kind"], "left").where("c > 1 or nb_up > 0 or nb_down > 0")
    # a cluster may hold a third of all sets: they are dealt over many tasks
    placed = join_heavy(members, sizes, ["cluster", "kind"], *heavy_keys(members, "cluster", members.count()), F.col("rep"))
    placed = placed.withColumn("h", F.pmod(F.xxhash64("rep", "n"), F.col("nb").cast("long")).cast("int"))

    def with_each(count: str, make) -> F.Column:
        n = F.coalesce(F.col(count), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<k1:int,h1:int,k2:int,h2:int,side:int>>"))

    def cell(k1, h1, k2, h2, side) -> F.Column:
        return F.struct(k1.alias("k1"), h1.alias("h1"), k2.alias("k2"), h2.alias("h2"), side.cast("int").alias("side"))

    k, h = F.col("kind"), F.col("h")
    same = with_each("nb", lambda j: cell(k, F.least(h, j), k, F.greatest(h, j), F.when(j == h, 2).when(h < j, 0).otherwise(1)))
    upper = with_each("nb_up", lambda j: cell(k, h, k + 1, j, F.lit(0)))
    lower = with_each("nb_down", lambda j: cell(k - 1, j, k, h, F.lit(1)))
    cells = placed.select("cluster", "rep", "s", F.explode(F.concat(same, upper, lower)).alias("x"))
    keys = ["cluster", "k1", "h1", "k2", "h2"]
    cells = cells.select("cluster", "x.k1", "x.h1", "x.k2", "x.h2", "x.side", "rep", "s")
    links = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(percent, 100), "a long, b long")
    parts = connected_components(links)

    heads_of = copies.select("h1", "h2", "n", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    heads_of = heads_of.select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    # copies of one text may be a third of all rows: their rows are dealt over many tasks
    common, pieces = heavy_keys(some, "h1", sketch.count())
    linked = join_heavy(some.select("doc_id", "n", "h1", "h2"), heads_of, ["h1", "h2", "n"], common, pieces, F.col("doc_id"))
    # rows of one id with different texts were one node; without words they stay alone
    alone = sketch.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = linked.select("doc_id", "n", "component").unionByName(alone)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
