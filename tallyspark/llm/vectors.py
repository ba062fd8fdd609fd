"""Near-duplicate embeddings by an inverted multi-index.

Independent codebooks of K centres on the two halves of the vectors form a grid of K * K cells; every vector lives
in the cell of its nearest centres. The multi-sequence traversal visits cells in ascending sum of both halves'
distances; how many it visits is set on a bounded sample so that the wanted share of linked pairs is found there, at
the threshold itself as well as on the farthest real links, without an upper bound. Small tables have small grids, down
to one cell for so few vectors of a length as fill one (`few`).
Every visit is verified on the full vectors in double precision, block by block within tasks. Codebooks are fitted on
at most `sample` vectors and have at most `most_centres` centres a half, which bounds what is shipped to tasks.

Equal vectors are collapsed first and counted by their multiplicity. A link found from one side only counts for both.

Defined cases: vectors that are null, of zero length or norm, or hold null or non-finite components link with
nothing (n_links 0, own component); vectors of different lengths are not compared, of which any number may be there;
repeated ids are one node, which does not link with itself; a null id takes no part and its row has null component and
is kept; an empty table gives an empty result; columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, heavy_keys, join_heavy, materialize, ship
from .neardup import forest


LINKS = "node long, links long, root long"


def centres(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means; fewer different rows than k give fewer centres."""
    rng = np.random.default_rng(seed)
    u = np.unique(x, axis=0)
    c = u[rng.permutation(len(u))[:k]]
    for _ in range(rounds):
        at = distances(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.first, self.second, self.visits = first, second, visits

    def visit(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The cells visited from each row of x, nearest first; the first one is where the row lives.

        Only rank pairs with (i + 1) * (j + 1) <= visits can be among the nearest ones."""
        visits = visits or self.visits
        half = x.shape[1] // 2
        d1, d2 = distances(x[:, :half], self.first), distances(x[:, half:], self.second)
        visits = min(visits, d1.shape[1] * d2.shape[1])
        o1, o2 = np.argsort(d1, axis=1, kind="stable")[:, :visits], np.argsort(d2, axis=1, kind="stable")[:, :visits]
        pairs = np.array([(i, j) for i in range(o1.shape[1]) for j in range(min(o2.shape[1], visits // (i + 1)))])
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        total = s1[:, pairs[:, 0]] + s2[:, pairs[:, 1]]
        best = np.argsort(total, axis=1, kind="stable")[:, :visits]
        rows = np.arange(len(x))[:, None]
        return o1[rows, pairs[best, 0]] * len(self.second) + o2[rows, pairs[best, 1]]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many cells row by row come before the one of b in the visits from a; cells as far away come before it."""
        half = a.shape[1] // 2
        d1, d2 = distances(a[:, :half], self.first), distances(a[:, half:], self.second)
        h1, h2 = distances(b[:, :half], self.first).argmin(1), distances(b[:, half:], self.second).argmin(1)
        rows = np.arange(len(a))
        total = d1[rows, h1] + d2[rows, h2] + 1e-12
        return np.array([np.searchsorted(np.sort(y), t - x, side="right").sum() - 1 for x, y, t in zip(d1, d2, total)])


def fit(x: np.ndarray, n: int, least: float, recall: float, most_centres: int, per_cell: int = 8) -> Grid:
    """Codebooks from sample x (rows of length 1) for n vectors, and the visits that reach the recall on the sample."""
    k = max(1, min(most_centres, len(x), math.ceil(math.sqrt(n / per_cell))))
    half = x.shape[1] // 2
    grid = Grid(centres(x[:, :half], k), centres(x[:, half:], k))
    # Linked pairs to hold the visits against: the farthest link of each of up to 2,000 rows, so that a large group
    # counts by its rows and not by its pairs, and made pairs at the threshold itself. Each kind has to reach the recall.
    q = x[:2000]
    far, at_least = np.zeros(len(q), int), np.full(len(q), np.inf)
    for at in range(0, len(x), 4096):
        cos = q @ x[at : at + 4096].T
        cos[cos < least] = np.inf
        own = np.arange(at, min(at + cos.shape[1], len(q)))
        cos[own, own - at] = np.inf
        low = cos.argmin(1)
        value = cos[np.arange(len(q)), low]
        far, at_least = np.where(value < at_least, low + at, far), np.minimum(value, at_least)
    rng = np.random.default_rng(11)
    base = x[rng.integers(0, len(x), 2000)]
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    made = least * base + math.sqrt(max(0.0, 1 - least * least)) * noise
    linked = np.isfinite(at_least)
    for a, b in ((q[linked], x[far[linked]]), (base, made)):
        if len(a):
            place = np.sort(np.minimum(grid.rank(a, b), grid.rank(b, a)))
            grid.visits = max(grid.visits, int(place[math.ceil(recall * len(place)) - 1]) + 1)
    return grid


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def _doubles(rows: list[np.ndarray]) -> np.ndarray:
    return np.stack(rows).astype(np.float64)


def _index(grid: Grid, kind: pa.DataType):
    schema = pa.schema([("rep", pa.int64()), ("mult", pa.int64()), ("v", pa.list_(kind)), ("cells", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, 1024 * 256 // max(256, grid.visits))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = _doubles([v.values.to_numpy() for v in part.column(2)])
                cells = grid.visit(x / _lengths(x)[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(list(cells), pa.list_(pa.int64()))], schema=schema)

    return run


def _verify(least: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, block, role, rep, mult, v, cells) sorted by the first three; residents (role 0) come first."""
        key, held, asked = None, [], []

        def compare() -> pa.RecordBatch | None:
            nonlocal asked
            queries, asked = asked, []
            if not held or not queries:
                return None
            r, q = _doubles([h[2] for h in held]), _doubles([h[2] for h in queries])
            r_id, q_id = [h[0] for h in held], [h[0] for h in queries]
            r_n, q_n = np.array([h[1] for h in held]), np.array([h[1] for h in queries])
            cos = (q @ r.T) / (_lengths(q)[:, None] * _lengths(r)[None, :])
            linked = (cos >= least) & (np.array(q_id)[:, None] != np.array(r_id)[None, :])
            if not linked.any():
                return None
            # residents that do not visit the query's cell would not count the link themselves
            home = np.array([h[3][0] for h in queries])
            visits = np.stack([h[3] for h in held])
            back = (visits[None, :, :] == home[:, None, None]).any(2) if len(home) * visits.size < 5_000_000 else np.stack([(visits == c).any(1) for c in home])
            out = [(q_id[i], int(n), None) for i, n in enumerate((linked * r_n[None, :]).sum(1)) if n]
            out += [(r_id[j], int(n), None) for j, n in enumerate(((linked & ~back) * q_n[:, None]).sum(0)) if n]
            out += [(x, 0, root) for x, root in forest(linked, q_id, r_id)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

        for b in batches:
            ks = list(zip(*(b.column(i).to_pylist() for i in range(5))))
            for (cell, block, role, rep, mult), v, cells in zip(ks, b.column(5), b.column(6)):
                if (cell, block) != key:
                    if (out := compare()) is not None:
                        yield out
                    key, held = (cell, block), []
                row = (rep, mult, v.values.to_numpy(), cells.values.to_numpy())
                if role == 0:
                    held.append(row)
                else:
                    asked.append(row)
                    if len(asked) >= 1024:
                        if (out := compare()) is not None:
                            yield out
        if (out := compare()) is not None:
            yield out

    return run


def _one_cell(rows: DataFrame) -> DataFrame:
    """Rows for _verify where each length is one cell."""
    cell = F.size("v").cast("long")
    both = rows.select(cell.alias("cell"), F.lit(0).alias("block"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), "rep", "mult", "v", F.array(cell).alias("cells"))
    return both.repartition("cell", "block").sortWithinPartitions("cell", "block", "role")


def near_vectors(
    vectors: DataFrame,
    least: float = 0.9,
    recall: float = 0.995,
    sample: int = 20_000,
    most_centres: int = 1024,
    block: int = 1024,
    few: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    spark = vectors.sparkSession
    ship(spark)
    # single precision travels as such; all that is computed is computed in doubles
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    element, kind = ("float", pa.float32()) if single else ("double", pa.float64())
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit_for_links = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0.0)
    usable = own.where(fit_for_links)
    # an id counts once, however often its row is there
    texts = usable.groupBy("v", "vec_id").count().groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    texts = materialize(texts, "vectors")
    sizes = texts.groupBy(F.size("v").alias("d")).count()
    many = sizes.where(F.col("count") > few).orderBy("d").collect()
    rest = texts.where(~F.size("v").isin([r["d"] for r in many])) if many else texts
    found = _one_cell(rest).mapInArrow(_verify(least), LINKS)
    for d, n in many:  # one index a length
        mine = texts.where(F.size("v") == d)
        if d == 1:  # both halves need a column
            mine = mine.withColumn("v", F.concat("v", F.array(F.lit(0.0).cast(element))))
        pick = mine.orderBy(F.xxhash64("v")).limit(sample).select("v").toPandas()
        x = _doubles(list(pick["v"]))
        grid = fit(x / _lengths(x)[:, None], n, least, recall, most_centres)
        index = materialize(mine.select("rep", "mult", "v").mapInArrow(_index(grid, kind), f"rep long, mult long, v array<{element}>, cells array<long>"), "cells")
        home = index.withColumn("cell", F.col("cells")[0])
        blocks = home.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
        live = home.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int").alias("block"), F.lit(0).alias("role"), "rep", "mult", "v", "cells")
        asks = index.select("rep", "mult", "v", F.slice("cells", 1, 1).alias("cells"), F.explode("cells").alias("cell")).join(blocks, "cell")
        asks = asks.select("cell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.lit(1).alias("role"), "rep", "mult", "v", "cells")
        rows = live.unionByName(asks).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
        found = found.unionByName(rows.mapInArrow(_verify(least), LINKS))
    links = materialize(found, "links")
    parts = connected_components(links.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    heads = texts.join(counts, F.col("rep") == F.col("node"), "left").drop("node").join(parts, F.col("rep") == F.col("node"), "left")
    mark = F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0).cast(element)))  # without negative zeros, as in groups
    heads = heads.select(mark.alias("mark"), "v", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"))
    # copies of one vector may be a third of all rows: their rows are dealt over many tasks
    marked = usable.withColumn("mark", mark)
    common, pieces = heavy_keys(marked, "mark", usable.count())
    linked = join_heavy(marked, heads, ["mark", "v"], common, pieces, F.col("vec_id")).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = own.where(~F.coalesce(fit_for_links, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
