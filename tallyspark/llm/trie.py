"""Prefix trie of conversations: every distinct sequence of first turns is a node with its members and subtree sums.

A turn's id is the first 16 bytes of a SHA-256 over its role and text (computed by Spark), a conversation the string of
its turns' ids, 32 hex digits each. Conversations are sorted by range into shards of bounded size, so that a node's
members stand next to each other, in one shard or in several consecutive ones. In a shard the ids are numbered and laid
out as padded matrices, a band of columns at a time, so that one long conversation pads no others: numpy's lexsort orders
the rows, the OR-accumulated changes from row to row mark where nodes begin, reduceat sums members at every depth.

A node that reaches over a shard's edge (a prefix of its first or last row, as told by the neighbouring rows across the
edge) comes in parts, which one aggregation recombines. Everything summed is counted in one part only: a node itself in
the first shard that holds it, being childless in the last one.

Defined cases: a null role or text is empty; turns are ordered by (turn, role, id), null turns first, so ties have a
fixed order and repeated rows are turns of their own; rows without a conv_id take no part; without conversations there is
no node, not even the root; only conv_id, turn, role and text are used. A conversation's ids must fit a row (40 bytes a
turn), a text must fit a row. Two texts with the same 16 bytes of SHA-256 would count as one; none are expected within
2**60 turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, ship

ID = 32  # hex digits of a turn's id
BAND = 32  # columns of a padded matrix
PIECE = 256  # ids in one row of a divided node's list
SALTS = 64

NODES = (
    "key string, parent_key string, shard int, piece int, ends string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
_ARROW = pa.schema(
    [("key", pa.string()), ("parent_key", pa.string()), ("shard", pa.int32()), ("piece", pa.int32()), ("ends", pa.string())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, seq, sizes): the turns of every conversation in order, as ids and as bytes of their texts. keys are conv_id
    and columns that depend on it."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.sha2(F.concat(F.octet_length(blank("role")).cast("string"), F.lit(":"), blank("role"), blank("text")), 256)
    turn = F.struct(F.col("turn").alias("turn"), blank("role").alias("role"), F.substring(own, 1, ID).alias("id"), F.octet_length(blank("text")).cast("long").alias("size"))
    turns = rows.where("conv_id is not null").select(*keys, turn.alias("t"))
    ts = turns.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ts.select(*keys, F.array_join(F.transform("ts", lambda t: t["id"]), "").alias("seq"), F.transform("ts", lambda t: t["size"]).alias("sizes"))


def branched(conversations: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """(conv_id, seq, sizes) of conversations whose first `taken` turns (at most `most`) are those of conversation `base`;
    none where that is not there. One shuffle: by base, which also holds each conversation's rows together."""
    b, first = fresh(conversations, "_base"), "_first"
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").where("conv_id is not null")
    own = sequences(rows.withColumn(b, base).repartition(b), b, "conv_id")
    top = F.when(F.col("conv_id") == F.col(b), F.struct(F.substring("seq", 1, ID * most).alias("seq"), F.slice("sizes", 1, most).alias("sizes")))
    own = own.withColumn(first, F.max(top).over(Window.partitionBy(b))).withColumn("_h", taken.cast("int"))
    seq = F.concat(F.coalesce(F.substring(F.col(f"{first}.seq"), F.lit(1), F.col("_h") * ID), F.lit("")), F.substring(F.col("seq"), F.col("_h") * ID + 1, F.length("seq")))
    none = F.array().cast("array<bigint>")
    sizes = F.concat(F.coalesce(F.slice(F.col(f"{first}.sizes"), F.lit(1), F.col("_h")), none), F.slice("sizes", F.col("_h") + 1, F.greatest(F.size("sizes"), F.lit(1))))
    return own.select("conv_id", seq.alias("seq"), sizes.alias("sizes"))


def _common(a: str | None, b: str) -> int:
    """Turns that both begin with; -1 where there is no a."""
    if a is None:
        return -1
    low, high = 0, min(len(a), len(b)) // ID
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * ID] == b[: mid * ID] else (low, mid - 1)
    return low


def _numbered(hexes: str) -> np.ndarray:
    """Numbers of the ids, equal for equal ones and in their order."""
    halves = np.frombuffer(bytes.fromhex(hexes), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    out = np.empty(len(order), np.int64)
    if len(order):
        sorted_ = halves[order]
        out[order] = np.concatenate([[0], np.cumsum((sorted_[1:] != sorted_[:-1]).any(axis=1))])
    return out


class Levels:
    """The nodes of a shard's conversations, depth by depth (the root first); row numbers in sorted order in `order`."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lens: np.ndarray, conv: np.ndarray):
        n = len(lens)
        at = np.cumsum(lens) - lens
        self.order = np.empty(n, np.int64)
        self.offsets, parts, self.ends = [0, 1], {"n": [np.array([n])], "conv": [conv.min(keepdims=True)], "size": [np.zeros(1, np.int64)], "parent": [np.array([-1])]}, []
        self._end(np.sort(conv[lens == 0]), 0)
        node_of = np.zeros(n, np.int64)
        pos, rows, group, base = np.arange(n), np.arange(n), np.zeros(n, np.int64), 0
        while len(rows):
            here = np.minimum(np.maximum(lens[rows] - base, 0), BAND)
            width = max(1, int(here.max()))
            cols = np.arange(width)
            inside = cols < here[:, None]
            mat = np.full((len(rows), width), -1, np.int64)
            mat[inside] = ids[(at[rows, None] + base + cols)[inside]]
            longer = lens[rows] > base + width
            # what ends here stands before what goes on
            o = np.lexsort((conv[rows], longer, *mat.T[::-1], group))
            rows, mat, group, longer = rows[o], mat[o], group[o], longer[o]
            self.order[pos] = rows
            change = np.ones(mat.shape, bool)
            change[1:] = mat[1:] != mat[:-1]
            change[1:, 0] |= group[1:] != group[:-1]
            change = np.logical_or.accumulate(change, axis=1)
            for j in range(width):
                live = np.flatnonzero(mat[:, j] >= 0)
                if not len(live):
                    break
                begins = change[live, j]
                starts, r = np.flatnonzero(begins), rows[live]
                parts["n"].append(np.diff(np.append(starts, len(live))))
                parts["conv"].append(np.minimum.reduceat(conv[r], starts))
                parts["size"].append(sizes[at[r[starts]] + base + j])
                parts["parent"].append(node_of[r[starts]])
                node_of[r] = np.cumsum(begins) - 1 + self.offsets[-1]
                self.offsets.append(self.offsets[-1] + len(starts))
                done = r[lens[r] == base + j + 1]
                self._end(conv[done], node_of[done])
            group = np.cumsum(change[:, -1])[longer]
            pos, rows, base = pos[longer], rows[longer], base + width
        self.n, self.conv, self.size, self.parent = (np.concatenate(parts[k]) for k in ("n", "conv", "size", "parent"))

    def _end(self, conv: np.ndarray, node) -> None:
        """Conversations that end at nodes, in the order of nodes and ids."""
        node = np.broadcast_to(node, conv.shape)
        cuts = np.flatnonzero(np.diff(node)) + 1
        if len(conv):
            self.ends += [(int(k[0]), c) for k, c in zip(np.split(node, cuts), np.split(conv, cuts), strict=True)]


def _shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """Nodes of one shard (NODES), told of the rows before and after it."""
    shard, seqs, conv = left["shard"][0].as_py(), left["seq"].to_pylist(), left["conv_id"].to_numpy()
    lens = np.array([len(s) for s in seqs], np.int64) // ID
    flat = pa.concat_arrays([c.flatten() for c in left["sizes"].chunks]).to_numpy(zero_copy_only=False).astype(np.int64)
    levels = Levels(_numbered("".join(seqs)), flat, lens, conv)
    total, depths = len(levels.n), len(levels.offsets) - 1
    offsets = np.array(levels.offsets)
    first, last = seqs[levels.order[0]], seqs[levels.order[-1]]
    before, after = _common(right["before"][0].as_py(), first), _common(right["after"][0].as_py(), last)
    shared_before, shared_after = offsets[: before + 1], offsets[1:][: after + 1] - 1
    counted, closed = np.ones(total, np.int64), np.ones(total, np.int64)
    counted[shared_before] = 0  # an earlier shard counts it
    closed[shared_after] = 0  # a later one says whether it has children
    children, inner = np.zeros(total, np.int64), np.zeros(total, bool)
    np.add.at(children, levels.parent[1:], counted[1:])
    inner[levels.parent[1:]] = True
    leaves = (closed == 1) & ~inner
    leaves, saved = leaves.astype(np.int64), (levels.n - counted) * levels.size
    for d in range(depths - 1, 0, -1):
        own = slice(offsets[d], offsets[d + 1])
        np.add.at(leaves, levels.parent[own], leaves[own])
        np.add.at(saved, levels.parent[own], saved[own])
    keys: dict[int, str] = {}
    for path, nodes in ((first, shared_before), (last, shared_after)):
        state = hashlib.sha256()
        for d, k in enumerate(nodes):
            state.update(path[(d - 1) * ID : d * ID].encode() if d else b"")
            keys[int(k)] = state.copy().hexdigest()
    depth = np.repeat(np.arange(depths), np.diff(offsets))
    digests = [NOBODY] * total
    pieces: list[tuple[int, int, str]] = []
    for k, ids in levels.ends:
        if k in keys:
            pieces += [(k, i, ",".join(map(str, ids[at : at + PIECE].tolist()))) for i, at in enumerate(range(0, len(ids), PIECE))]
        else:
            digests[k] = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
    key = [None] * total
    for k, name in keys.items():
        key[k] = name
        digests[k] = None
    parent = levels.parent
    up = [None, *(keys.get(p) for p in parent[1:].tolist())]
    own = pa.table(
        [
            pa.array(key, pa.string()), pa.array(up, pa.string()), pa.array(np.full(total, shard), pa.int32()), pa.array(np.full(total, -1), pa.int32()), pa.nulls(total, pa.string()),
            levels.conv, depth, pa.array(levels.conv[parent], mask=parent < 0), levels.n, children, leaves, saved, pa.array(digests, pa.string()),
        ],
        schema=_ARROW,
    )
    if not pieces:
        return own
    k = np.array([p[0] for p in pieces])
    zero = np.zeros(len(k), np.int64)
    more = pa.table(
        [
            pa.array([key[x] for x in k], pa.string()), pa.array([up[x] for x in k], pa.string()), pa.array(np.full(len(k), shard), pa.int32()), pa.array([p[1] for p in pieces], pa.int32()),
            pa.array([p[2] for p in pieces], pa.string()), levels.conv[k], depth[k], pa.nulls(len(k), pa.int64()), zero, zero, zero, zero, pa.nulls(len(k), pa.string()),
        ],
        schema=_ARROW,
    )
    return pa.concat_tables([own, more])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of rows (key, shard, piece, ends) that come sorted: one hash state at a time."""
    now, state, some = None, hashlib.sha256(), False
    out: list[tuple[str, str]] = []
    for b in batches:
        for key, ends in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state, some = key, hashlib.sha256(), False
            if ends is not None:
                state.update((b"," if some else b"") + ends.encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["key", "ends_sha256"])
        out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(paths: DataFrame, shard_turns: int = 1 << 18) -> DataFrame:
    """The nodes of paths (conv_id, seq, sizes): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. A shard holds about shard_turns turns and conversations."""
    spark = paths.sparkSession
    ship(spark)
    paths = materialize(paths.select("conv_id", "seq", "sizes"), "paths")
    amount = paths.agg(F.sum(F.length("seq") / ID + 1)).first()[0] or 0
    # by id too, so that equal conversations, however many, fill several shards
    sharded = paths.repartitionByRange(max(1, -(-int(amount) // shard_turns)), "seq", "conv_id").withColumn("shard", F.spark_partition_id())
    sharded = materialize(sharded, "shards")
    edges = sharded.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    line = Window.orderBy("shard")  # two rows a shard: their number does not grow beyond that of partitions
    edges = edges.select("shard", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    nodes = materialize(sharded.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_shard, NODES), "nodes")
    parts = nodes.where("key is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums)
    listed = parts.select("key", "shard", "piece", "ends").repartition("key").sortWithinPartitions("key", "shard", "piece")
    merged = merged.join(listed.mapInArrow(_digests, "key string, ends_sha256 string"), "key")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.where("key is null and parent_key is null").select(*out)
    top = merged.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out)
    # children of divided nodes ask for the smallest member of all parts; the root may have any number of them
    asking = nodes.where("key is null and parent_key is not null").drop("parent_conv_id").unionByName(merged.where("parent_key is not null"), allowMissingColumns=True)
    asking = asking.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)))
    told = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    return inner.unionByName(top).unionByName(asking.join(told, ["parent_key", "salt"]).select(*out))
