"""Ranked lexical search, exact, by two trees at once.

Documents are read once: every text is cut into terms and leaves the count of its terms and those that the items ask for,
as a table of numbers. Weights need the statistics of all documents, which are aggregated from that table. Then blocks of
documents are searched: a hierarchy over the block's documents and one over the items, both balanced over an order that
puts like rows side by side, hold the maxima of every coordinate (of an item: 1 for its terms). The product of two nodes'
maxima bounds every score between them; where it stays below the weakest k-th score of the node's items, all of that
batch is left out, and no result with it. What remains is scored exactly, leaf by leaf.

A share of the documents is searched first: its k-th scores are lower bounds of the final ones, with which all tasks start.
Documents are not shuffled; items go to the tasks in blocks of at most BLOCK_BYTES of terms (what one item has beyond
that, it has as one row), each with a pass of its own; every task returns at most k rows an item.

Defined cases: a null text has no terms; documents with no term of an item are not returned for it; rows of one item_id
are one item with the terms of all its texts, a null item_id is an item too; every row of documents counts and is ranked,
repeated ones too; a null doc_id comes before others; without items or documents the result is empty; extra columns are
not used. Arithmetic is exact beyond 64 bits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, worker_state

# What separates terms (all other characters make them up), and the parameters of a score.
SEPARATORS = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
SHARE, SATURATION, SCALE = 90, 8, 1_000_000_000

STEP = 1 << 20  # bytes of a text that are cut at once
BLOCK_BYTES = 4 << 20
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 20
LEAF = 16
SIGNS = 48  # terms by which rows are put in order
LEAST, NOBODY = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # stand for a null doc_id, and for none

_TABLE = bytes(32 if any(a <= c <= b for a, b in SEPARATORS) else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = re.compile(b"[" + b"".join(re.escape(bytes([a])) + b"-" + re.escape(bytes([b])) for a, b in SEPARATORS) + b"]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + STEP) if len(text) > at + STEP else None
        end = found.start() if found else len(text)
        yield text[at:end].translate(_TABLE).split()
        at = end


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), once each."""

    def run(batches):
        for b in batches:
            found = [sorted({t.decode() for part in terms(_bytes(x)) for t in part}) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])

    cut = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, terms array<string>")
    return cut.select("item_id", F.explode("terms").alias("term")).distinct()


def _features(vocabulary):
    """(doc_id, n, ids, tfs): how many terms a document has, and those in the vocabulary."""

    def run(batches):
        state = worker_state("lexical")
        if state.get("key") is not vocabulary.value:
            state.clear()
            state.update(key=vocabulary.value, ids={t: i for i, t in enumerate(vocabulary.value)})
        get = state["ids"].get
        for b in batches:
            ns, ids, tfs, offsets = [], [], [], [0]
            for x in b.column(1):
                n, counts = 0, Counter()
                for part in terms(_bytes(x)):
                    n += len(part)
                    counts.update(map(get, part))
                counts.pop(None, None)
                ns.append(n)
                ids += counts.keys()
                tfs += counts.values()
                offsets.append(len(ids))
            at = pa.array(offsets, pa.int32())
            listed = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *listed], names=["doc_id", "n", "ids", "tfs"])

    return run


def ordered(ids: np.ndarray, lens: np.ndarray, size: int) -> np.ndarray:
    """Rows in an order that puts like ones side by side: by which of the terms that cut the rows best in halves they have."""
    held = np.bincount(ids, minlength=size)
    signs = np.argsort(np.abs(2 * held - len(lens)), kind="stable")[:SIGNS]
    place = np.full(size, -1)
    place[signs] = np.arange(len(signs))
    has = np.zeros((len(lens), len(signs)), bool)
    which = place[ids]
    owner = np.repeat(np.arange(len(lens)), lens)
    has[owner[which >= 0], which[which >= 0]] = True
    return np.lexsort(has.T[::-1]) if len(signs) else np.arange(len(lens))


class Maxima:
    """A balanced hierarchy over ordered rows: levels[l] has the nodes of 2**l leaves, each with the maxima of its
    coordinates as (indptr, terms, values)."""

    def __init__(self, owner: np.ndarray, ids: np.ndarray, values: np.ndarray, leaves: int, size: int):
        self.levels = []
        while True:
            key = owner * size + ids
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            values = np.maximum.reduceat(values[order], starts) if len(key) else values
            owner, ids = key[starts] // size, key[starts] % size
            self.levels.append((np.searchsorted(owner, np.arange(leaves + 1)), ids, values))
            if leaves <= 1:
                break
            owner, leaves = owner >> 1, (leaves + 1) >> 1

    def rows(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' coordinates, and where each node's begin; all have some."""
        at = self.levels[level][0]
        lens = at[nodes + 1] - at[nodes]
        starts = np.cumsum(lens) - lens
        return np.arange(lens.sum()) + np.repeat(at[nodes] - starts, lens), starts


class Items:
    """Items as a hierarchy, and the best k that each has so far."""

    def __init__(self, lists: list[np.ndarray], size: int, k: int):
        lens = np.array([len(x) for x in lists], np.int64)
        ids = np.concatenate(lists)
        self.order = ordered(ids, lens, size)
        place = np.empty(len(lens), np.int64)
        place[self.order] = np.arange(len(lens))
        self.tree = Maxima(np.repeat(place, lens), ids, np.ones(len(ids), np.int64), len(lens), size)
        self.scores, self.docs = np.zeros((len(lens), k), np.int64), np.full((len(lens), k), NOBODY)
        self.kth, self.last = np.zeros(len(lens), np.int64), np.full(len(lens), NOBODY)

    def start(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """The k-th score and its document that are known to be reached."""
        self.kth, self.last = scores[self.order], docs[self.order]

    def weakest(self) -> list[np.ndarray]:
        """The lowest k-th score below every node."""
        out = [np.maximum(self.kth, 1)]
        while len(out[-1]) > 1:
            w = out[-1]
            out.append(np.minimum(w[::2], np.append(w[1::2], w[-1:] if len(w) % 2 else w[:0])))
        return out

    def offer(self, who: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """scores[i, j] of item who[i] and docs[j]."""
        last, kth = self.last[who][:, None], self.kth[who][:, None]
        better = (scores > kth) | ((scores == kth) & (scores > 0) & (docs <= last))
        k = self.scores.shape[1]
        for i in np.flatnonzero(better.any(axis=1)):
            q, pick = who[i], better[i]
            s, d = np.concatenate([self.scores[q], scores[i, pick]]), np.concatenate([self.docs[q], docs[pick]])
            best = np.lexsort((d, -s))[:k]
            self.scores[q], self.docs[q] = s[best], d[best]
            self.kth[q], self.last[q] = min(((self.kth[q], self.last[q]), (s[best[-1]], d[best[-1]])), key=lambda x: (-x[0], x[1]))


def search_block(items: Items, docs: np.ndarray, lens: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[int, int]:
    """Offers the items what these documents (lens coordinates each: ids, values) have to offer; returns how many pairs of
    an item and a document were scored, and how many there are."""
    used, ids = np.unique(ids, return_inverse=True)
    size = len(used)
    order = ordered(ids, lens, size)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs, owner = docs[order], np.repeat(place, lens)
    leaves = -(-len(docs) // LEAF)
    tree = Maxima(owner // LEAF, ids, values, leaves, size)
    least = [np.minimum.reduceat(docs, np.arange(0, len(docs), LEAF))]
    while len(least[-1]) > 1:
        w = least[-1]
        least.append(np.minimum(w[::2], np.append(w[1::2], w[-1:] if len(w) % 2 else w[:0])))
    by_doc = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[by_doc], np.arange(0, leaves + 1) * LEAF)
    # items' terms as places in this block; the last one is for terms that it lacks
    local = []
    for _, of, _ in items.tree.levels:
        p = np.minimum(np.searchsorted(used, of), size - 1)
        local.append(np.where(used[p] == of, p, size))
    bounds_of, flat = np.zeros(size + 1, np.int64), np.zeros((size + 1, LEAF), np.int64)
    weak, scored = items.weakest(), 0
    # pairs of nodes: (level of documents, node, level of items, nodes)
    work = [(len(tree.levels) - 1, 0, len(items.tree.levels) - 1, np.zeros(1, np.int64))]
    while work:
        dl, d, il, nodes = work.pop()
        if dl >= 3:
            weak = items.weakest()
        begin, of, high = tree.levels[dl]
        mine = slice(begin[d], begin[d + 1])
        bounds_of[of[mine]] = high[mine]
        while True:
            where, starts = items.tree.rows(il, nodes)
            bound = np.add.reduceat(bounds_of[local[il][where]], starts)
            if il:
                nodes = nodes[bound >= weak[il][nodes]]
            else:
                kth = items.kth[nodes]
                nodes = nodes[(bound > kth) | ((bound == kth) & (bound > 0) & (least[dl][d] <= items.last[nodes]))]
            if not len(nodes) or not il:
                break
            il -= 1
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            nodes = np.sort(nodes[nodes < len(items.tree.levels[il][0]) - 1])
            if dl:
                break
        bounds_of[of[mine]] = 0
        if not len(nodes):
            continue
        if dl:
            work += [(dl - 1, c, il, nodes) for c in (2 * d + 1, 2 * d) if c < len(tree.levels[dl - 1][0]) - 1]
            continue
        own = by_doc[at[d] : at[d + 1]]
        flat[ids[own], owner[own] - d * LEAF] = values[own]
        where, starts = items.tree.rows(0, nodes)
        here = docs[d * LEAF : (d + 1) * LEAF]
        items.offer(nodes, here, np.add.reduceat(flat[local[0][where]], starts, axis=0)[:, : len(here)])
        scored += len(nodes) * len(here)
        flat[ids[own]] = 0
    return scored, len(items.order) * len(docs)


def _values(n: np.ndarray, lens: np.ndarray, ids: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What each term of a document adds to the score of an item that has it."""
    if int(n.max()) * documents * SHARE < 2**63:
        m = 100 - SHARE + SHARE * n * documents // total
    else:
        m = np.array([100 - SHARE + SHARE * int(x) * documents // total for x in n], np.int64)
    tf = tfs.astype(np.int64)
    return weights[ids] * (SCALE * tf // (1000 * tf + SATURATION * np.repeat(m, lens)))


def _search(shared, seeds, documents: int, total: int, k: int):
    def run(batches):
        lists, names, weights = shared.value
        items = Items(lists, len(weights), k)
        if seeds is not None:
            items.start(*seeds.value)
        held: list[tuple] = []

        def flush():
            docs, n, lens, ids, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            search_block(items, docs, lens, ids, _values(n, lens, ids, tfs, weights, documents, total))

        rows = postings = 0
        for b in batches:
            doc = b.column(0)
            docs = doc.fill_null(int(LEAST)).to_numpy(zero_copy_only=False)
            n = b.column(1).to_numpy(zero_copy_only=False)
            lens = np.diff(b.column(2).offsets.to_numpy()).astype(np.int64)
            ids, tfs = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            at = np.concatenate([[0], np.cumsum(lens)])
            first = 0
            while first < len(docs):
                last = int(min(first + BLOCK_DOCS - rows, max(first + 1, np.searchsorted(at, at[first] + BLOCK_POSTINGS - postings, side="right") - 1)))
                cut = slice(at[first], at[last])
                held.append((docs[first:last], n[first:last], lens[first:last], ids[cut], tfs[cut]))
                rows, postings, first = rows + last - first, postings + at[last] - at[first], last
                if rows >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    flush()
                    rows = postings = 0
        if held:
            flush()
        q, place = np.nonzero(items.scores > 0)
        s, d = items.scores[q, place], items.docs[q, place]
        item = items.order[q]
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array([names[i] for i in item], pa.int64()), pa.array(d, mask=d == LEAST), pa.array(s)], names=["item", "item_id", "doc_id", "score"]
        )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, seed_share: int = 32, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for every row of items (item_id, text). One of
    seed_share documents is searched first; that changes the work, not the result."""
    spark = docs.sparkSession
    ship(spark)
    asked = materialize(item_terms(items), "item-terms")
    size = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-int(size) // block_bytes)
    out = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        one = _rank_block(docs, mine, k, seed_share)
        out = one if out is None else out if one is None else out.unionByName(one)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _rank_block(docs: DataFrame, asked: DataFrame, k: int, seed_share: int) -> DataFrame | None:
    sc = docs.sparkSession.sparkContext
    by_item: dict = {}
    ids: dict[str, int] = {}
    for r in asked.collect():
        by_item.setdefault(r.item_id, []).append(ids.setdefault(r.term, len(ids)))
    if not by_item:
        return None
    names, lists = list(by_item), [np.array(sorted(x), np.int64) for x in by_item.values()]
    vocabulary = sc.broadcast([t.encode() for t in ids])
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features(vocabulary), "doc_id long, n long, ids array<int>, tfs array<int>")
    table = materialize(table, "terms")
    documents, total = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(ids), np.int64)
    for t, held in table.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # at most one row a term of the block
        weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))
    shared = sc.broadcast((lists, names, weights))
    some = table.where(F.size("ids") > 0)
    found = "item int, item_id long, doc_id long, score long"
    seeds = None
    if seed_share > 1:
        first = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(seed_share)) == 0)
        scores, last = np.zeros(len(lists), np.int64), np.full(len(lists), NOBODY)
        for r in _best(first.mapInArrow(_search(shared, None, documents, total, k), found), k).where(F.col("rank") == k).collect():  # at most one row an item
            scores[r.item], last[r.item] = r.score, LEAST if r.doc_id is None else r.doc_id
        seeds = sc.broadcast((scores, last))
    return _best(some.mapInArrow(_search(shared, seeds, documents, total, k), found), k).select("item_id", "rank", "doc_id", "score")
