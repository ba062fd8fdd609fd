"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight). Candidates are cut into blocks; inside a block every term has a
posting list (candidate, weight). Each query walks its own terms and scatters weight * posting weight into a
dense score array over the block, then a partition selection keeps its best k there. The blocks' winners
are merged by a window over (query).

Cost: every query meets every candidate once, in blocks of bounded size; nothing is broadcast or collected,
rows emitted are at most k for each query and block.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part; an all-zero
vector takes part with score 0; vectors of other lengths lack the missing terms (weight 0). Repeated rows are separate
candidates (equal ids tie), equal query rows are one query; a candidate with the query's own id is never returned. Rows
with a null id take no part; without queries or candidates the result is empty; only the named columns are used.
Weights must fit 64-bit sums: |floor(256 x)| below 2**28 is safe up to 2**7 terms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, ship

OUT = "query_id long, vec_id long, score long"
CHUNK = 64


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, w array<long>) of the usable vectors; w is floor(scale * x), x as double."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("w")
    )


def _postings(weights: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (candidates, weights), without zeros."""
    sizes = np.array([len(w) for w in weights], dtype=np.int64)
    flat = np.concatenate(weights).astype(np.int64) if len(weights) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(weights)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    live = flat != 0
    owner, term, flat = owner[live], term[live], flat[live]
    order = np.argsort(term, kind="stable")
    owner, term, flat = owner[order], term[order], flat[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return {int(t[0]): (o, f) for t, o, f in zip(np.split(term, cuts), np.split(owner, cuts), np.split(flat, cuts)) if len(t)}


def score_block(query_ids, query_weights, cand_ids, cand_weights, k: int):
    """Best k candidates of one block for each query: arrays (query_id, vec_id, score)."""
    postings = _postings(cand_weights)
    cand_ids = np.asarray(cand_ids, dtype=np.int64)
    found = []
    n = len(cand_ids)
    everyone = np.arange(n)
    for at in range(0, len(query_ids), CHUNK):
        ids = np.asarray(query_ids[at : at + CHUNK], dtype=np.int64)
        rows = query_weights[at : at + CHUNK]
        scores = np.zeros((len(ids), n), dtype=np.int64)
        by_term: dict[int, list] = {}
        for q, w in enumerate(rows):
            for t in np.flatnonzero(w):
                by_term.setdefault(int(t), []).append((q, int(w[t])))
        for t, users in by_term.items():
            if t not in postings:
                continue
            who, weight = postings[t]
            whole = len(who) == n
            for q, value in users:
                if whole:
                    scores[q] += value * weight
                else:
                    scores[q, who] += value * weight
        for q, own in enumerate(ids):
            allowed = everyone if not (cand_ids == own).any() else everyone[cand_ids != own]
            s = scores[q] if len(allowed) == n else scores[q][allowed]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                pick = np.flatnonzero(s >= least)
            else:
                pick = np.arange(len(s))
            who = cand_ids[allowed[pick]]
            best = np.lexsort((who, -s[pick]))[:k]
            found.append((np.full(len(best), own), who[best], s[pick][best]))
    if not found:
        return np.empty((3, 0), dtype=np.int64)
    return [np.concatenate(x) for x in zip(*found)]


def _search(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c, s = score_block(left["id"].to_numpy(), list(left["w"]), right["id"].to_numpy(), list(right["w"]), k)
        return pd.DataFrame({"query_id": q, "vec_id": c, "score": s})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 2048, candidate_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of queries (id, w) its k best of candidates (id, w)."""
    spark = queries.sparkSession
    ship(spark)
    queries, candidates = materialize(queries.distinct(), "topk-q"), materialize(candidates, "topk-c")
    n_q, n_c = queries.count(), candidates.count()
    qs, cs = max(1, -(-n_q // query_block)), max(1, -(-n_c // candidate_block))
    left = (
        queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(qs)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cs - 1))))
    )
    # by place in the stored table, so that equal rows are spread too
    right = (
        candidates.withColumn("cb", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cs)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))
    )
    parts = max(1, min(qs * cs, 4000))
    left, right = left.repartition(parts, "cb", "qb"), right.repartition(parts, "cb", "qb")
    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(_search(k), OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
