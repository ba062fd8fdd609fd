"""SentencePiece encoding with sampled segmentations, and decoding.

For each text k different segmentations are drawn without replacement from the lattice of vocabulary pieces, by
Gumbel top-k: every segmentation's log probability gets Gumbel noise and the k largest win. They are found by
perturbed A-star search: a lattice node's priority is the largest perturbed value below it, which its children share
out among them (one inherits it, the others are drawn conditioned on staying below), so the search walks straight
to each winner and keeps the rest of the children as its frontier. The frontier's best value after k winners is the
threshold kappa, and a winner's inclusion score is 1 - exp(-exp(log_prob - kappa)), the probability that its value
exceeds kappa. Noise is a hash of the row key, so results do not depend on partitioning.

Piece weight: -theta * log(rank + 2) by merge rank, and of an unknown character its bytes. Pieces hold the space
mark only as a prefix, so a text's lattice is a chain of the lattices of its words; a worker keeps those it has met.

Decoding joins pieces, turns the mark into a space and drops the one that encoding put in front. So a text that itself
holds the mark (U+2581) comes back with a space in its place, and its round_trip is false; all others come back as they
are. The rank weights stand in for the unigram probabilities that a merge model's file does not hold.

Defined cases: null text is null and gives no rows; empty text gives one empty segmentation of probability 1; texts
with fewer than k segmentations give all of them, with inclusion 1; texts are used whole; rows with equal key and
text give equal results; a null key is hashed as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, worker_state

U64 = np.uint64
MARK = "▁"
STEP = 1 << 24
_MORE = re.compile("  +")
_state: dict = worker_state("segment")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Lattice:
    """Vocabulary and the word lattices met so far, as flat node and edge arrays."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.theta = theta
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        ids = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        pieces = [m.id_to_piece(i) for i in ids]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces with an inner space mark are not supported")
        self.longest = max(map(len, pieces))
        known = {i: p.encode() for i, p in zip(ids, pieces)} | {i: bytes([b]) for b, i in self.bytes.items()}
        raw = [known.get(i, b"") for i in range(m.get_piece_size())]
        self.size = np.array(list(map(len, raw)))
        self.begin, self.raw = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)
        rank = np.arange(len(ids))
        weight = -theta * np.log(rank + 2.0)
        self.floor = float(-theta * np.log(len(ids) + 2.0))
        hashes = [self._keys(p) for p in pieces]
        key = np.array([h[-1] for h in hashes], U64)
        order = np.argsort(key)
        self.keys, self.ids, self.weights = key[order], np.array(ids)[order], weight[order]
        if len(np.unique(self.keys)) != len(ids):
            raise ValueError("piece hashes collide")
        # where a key's slot is its own the table gives its place; slots of several keys are marked and searched
        slot = self._slot(self.keys)
        self.table = np.zeros(1 << 21, np.int32)
        self.table[slot] = np.arange(len(ids))
        self.several = np.bincount(slot, minlength=1 << 21) > 1
        # slots of what some longer piece begins with (and, rarely, of others)
        self.goes_on = np.zeros(1 << 21, bool)
        self.goes_on[self._slot(np.array([x for h in hashes for x in h[:-1]], U64))] = True
        self.clear()

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(43)).astype(np.int64)

    def _find(self, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
        at = self.table[slot]
        some = np.flatnonzero(self.several[slot])
        at[some] = np.searchsorted(self.keys, h[some]).clip(max=len(self.keys) - 1)
        return at

    @staticmethod
    def _keys(text: str) -> list[int]:
        """The hash of every beginning of the text, the whole one last."""
        h, out = 0, []
        for c in text:
            h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return out

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.first, self.count = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.logp, self.to, self.piece = np.empty(1 << 18), np.empty(1 << 18, np.int32), np.empty(1 << 18, np.int32)
        self.unknown: list[tuple[int, ...]] = []

    def _room(self, names: tuple[str, ...], need: int) -> None:
        for n in names:
            a = getattr(self, n)
            if len(a) < need:
                b = np.empty(max(need, 2 * len(a)), a.dtype)
                b[: len(a)] = a
                setattr(self, n, b)

    def add(self, chunks: list[str]) -> None:
        """Lattices of new chunks, given without their first mark: forward edges with their probabilities given the node."""
        size = np.array([len(c) + 1 for c in chunks], np.int64)
        codes = np.frombuffer((MARK + MARK.join(chunks)).encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
        n = len(codes)
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(chunks)), size)
        left = (begin + size)[owner] - np.arange(n)  # characters to the chunk's end
        found = []  # by length: row, how many shorter ones the row has, piece, weight
        per = np.zeros(n, np.int64)
        live, h = np.arange(n), np.zeros(n, U64)
        for length in range(1, self.longest + 1):
            if not len(live):
                break
            h = h * U64(0x100000001B3) + codes[live + length - 1] + U64(1)
            slot = self._slot(h)
            at = self._find(h, slot)
            hit = self.keys[at] == h
            rows = live[hit]
            at = at[hit]
            found.append((rows, per[rows], np.full(len(rows), length), self.ids[at], self.weights[at]))
            per[rows] += 1
            if length == 1 and len(rows) < n:
                found.append(self._bytes_of(codes, live[~hit]))
                per[live[~hit]] += 1
            on = np.flatnonzero(self.goes_on[slot] & (left[live] > length))
            live, h = live[on], h[on]
        rows, shorter, length, piece, weight = (np.concatenate(x) for x in zip(*found))
        first = np.cumsum(per) - per
        place = first[rows] + shorter
        # one node a character and one for each chunk's end
        node = np.arange(n) + owner
        total = n + len(chunks)
        w, to = np.empty(len(rows)), np.empty(len(rows), np.int64)
        w[place], to[place] = weight, node[rows] + length
        beta = np.zeros(total)
        by_left = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, int(size.max()) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = by_left[a:b]
            k = per[at]
            ends = np.cumsum(k)
            starts = ends - k
            own = np.repeat(np.arange(len(at)), k)
            e = np.arange(ends[-1]) + (first[at] - starts)[own]
            v = w[e] + beta[to[e]]
            top = np.maximum.reduceat(v, starts)
            whole = top + np.log(np.add.reduceat(np.exp(v - top[own]), starts))
            beta[node[at]] = whole
            w[e] = v - whole[own]
        self._room(("first", "count"), self.nodes + total)
        self.first[self.nodes : self.nodes + total] = 0
        self.count[self.nodes : self.nodes + total] = 0
        self.first[self.nodes + node] = self.edges + first
        self.count[self.nodes + node] = per
        self._room(("logp", "to", "piece"), self.edges + len(rows))
        e = slice(self.edges, self.edges + len(rows))
        self.logp[e], self.to[e] = w, self.nodes + to
        self.piece[self.edges + place] = piece
        self.start.update(zip(chunks, (self.nodes + begin + np.arange(len(chunks))).tolist()))
        self.nodes += total
        self.edges += len(rows)

    def _bytes_of(self, codes: np.ndarray, rows: np.ndarray):
        """Edges for characters that are no piece: one for each, of all its bytes."""
        piece, size = [], []
        for code in codes[rows].tolist():
            raw = chr(code).encode("utf-8", "replace")
            size.append(len(raw))
            if len(raw) == 1:
                piece.append(self.bytes[raw[0]])
            else:
                self.unknown.append(tuple(self.bytes[b] for b in raw))
                piece.append(-1 - len(self.unknown))
        one = np.ones(len(rows), np.int64)
        return rows, one - 1, one, np.array(piece, np.int64), self.floor * np.array(size)

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        p = self.piece[edges]
        if (p >= 0).all():
            return p
        out: list[int] = []
        for x in p.tolist():
            if x >= 0:
                out.append(x)
            else:
                out += self.unknown[-x - 2]
        return np.array(out)


def spaced(text: str) -> str:
    """The text with every space that begins a chunk left as it is, and with a mark for the others and those in front.

    Chunks are cut before every run of space marks; between the spaces stands each without its first mark."""
    plain = text.replace(MARK, " ")
    if "  " in plain or plain[:1] == " ":
        rest = plain.lstrip(" ")
        plain = MARK * (len(plain) - len(rest)) + _MORE.sub(lambda m: " " + MARK * (len(m[0]) - 1), rest)
    return plain


def _uniform(seed: np.ndarray, draw: int, place: np.ndarray, own=slice(None), edge=0) -> np.ndarray:
    """Noise in (0, 1) for edges, numbered within their nodes, from each node's seed and place; own: the node of an edge."""
    node = _mix(seed + U64(0x9E3779B97F4A7C15) * (place.astype(U64) + U64(1)) + U64(draw))
    h = _mix(node[own] + np.asarray(edge, U64) * U64(0xD1342543DE82EF95))
    return ((h >> U64(11)).astype(np.float64) + 0.5) / 2.0**53


def _walk(lat: Lattice, draw: int, seeds, doc, chunk, node, step, prefix):
    """Go from each chunk's node to its end. doc, chunk, node, step: for every chunk still open, in document order;
    prefix: log probability so far, by document.

    Gives the path (doc, place, edge, log probability, that of all before it), in order, and the frontier (place in the
    path, edge, key); a key grows with the conditioned perturbed value of its document's frontier, see _conditioned."""
    path, side, met = [], [], 0
    taken = np.zeros(len(doc), np.int64)
    q, v, s = np.arange(len(doc)), node, step
    while len(q):
        n = lat.count[v]
        live = np.flatnonzero(n)
        if len(live) < len(n):
            q, v, s, n = q[live], v[live], s[live], n[live]
        if not len(q):
            break
        taken[q] += 1
        ends = np.cumsum(n)
        begin = ends - n
        count = np.arange(ends[-1])
        own = np.repeat(np.arange(len(q)), n)
        number = count - begin[own]
        edge = number + lat.first[v][own]
        t = lat.logp[edge] - np.log(-np.log(_uniform(seeds[doc[q]], draw, chunk[q] * STEP + s, own, number)))
        top = np.maximum.reduceat(t, begin)
        gap = t - top[own]
        where = np.flatnonzero(gap == 0)[::-1]
        win = np.empty(len(q), np.int64)
        win[own[where]] = where  # the first of equals
        chosen = edge[win]
        path.append((q, s, chosen))
        rest = np.ones(len(edge), bool)
        rest[win] = False
        rest = np.flatnonzero(rest)
        side.append((own[rest] + met, edge[rest], t[rest] - np.log1p(-np.exp(np.minimum(gap[rest], -1e-12)))))
        met += len(q)
        v, s = lat.to[chosen], s + 1
    if not path:
        none = np.empty(0, np.int64)
        return (none, none, none, np.empty(0), np.empty(0)), (none, none, np.empty(0))
    q, s, chosen = (np.concatenate(x) for x in zip(*path))
    first = np.cumsum(taken) - taken
    order = first[q] + s - step[q]
    edge_of = np.empty(met, np.int64)
    edge_of[order] = chosen
    doc_of = np.repeat(doc, taken)
    place = np.arange(met) + np.repeat(chunk * STEP + step - first, taken)
    logp = lat.logp[edge_of]
    before = np.cumsum(logp) - logp
    starts = np.flatnonzero(np.concatenate(([True], doc_of[1:] != doc_of[:-1])))
    before += np.repeat(prefix[doc_of[starts]] - before[starts], np.diff(np.append(starts, met)))
    at, edge, key = (np.concatenate(x) for x in zip(*side))
    at = order[at]
    return (doc_of, place, edge_of, logp, before), (at, edge, key + before[at])


def _conditioned(value: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The perturbed value of a frontier entry, given that the largest below its parent is value: with T that value and
    Z the largest of the siblings' free values G, it is -log(exp(-T) - exp(-Z) + exp(-G)), where key stands for Z and G."""
    v = value - key
    return value - np.maximum(0.0, v) - np.log1p(np.exp(-np.abs(v)))


def sample(lat: Lattice, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (ids, log_prob, perturbed value, inclusion), largest value first."""
    parts = pc.split_pattern(pa.array([spaced(t) if t else None for t in texts], pa.string()), " ")
    if lat.nodes > 4_000_000:
        lat.clear()
    every = parts.flatten().dictionary_encode()
    different = every.dictionary.to_numpy(zero_copy_only=False)
    starts = np.array([lat.start.get(c, -1) for c in different.tolist()], np.int64)
    missing = different[starts < 0].tolist()
    for at in range(0, len(missing), 8000):
        lat.add(missing[at : at + 8000])
    starts[starts < 0] = [lat.start[c] for c in missing]
    m = len(texts)
    n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(m), n)
    first_chunk = np.cumsum(n) - n
    chunk = np.arange(len(doc)) - np.repeat(first_chunk, n)
    start = starts[every.indices.to_numpy()]
    value = -np.log(-np.log(_uniform(seeds, 0, np.zeros(m, np.int64))))
    values = [value]  # by walk and document: the largest perturbed value that it passed down
    walks = [_walk(lat, 1, seeds, doc, chunk, start, np.zeros(len(doc), np.int64), np.zeros(m))]
    everyone = np.arange(m + 1)

    def cut(p) -> list:
        bounds = np.searchsorted(p[0], everyone).tolist()
        return [(p[1][a:b], p[2][a:b], p[3][a:b]) for a, b in zip(bounds, bounds[1:])]

    paths = [[(*x, float(value[i]))] for i, x in enumerate(cut(walks[0][0]))]
    kappa = np.full(m, -np.inf)
    for turn in range(1, k + 1):
        best, source, place = np.full(m, -np.inf), np.full(m, -1), np.full(m, -1)
        for f, (p, (at, _, key)) in enumerate(walks):
            owner = p[0][at]
            top = np.full(m, -np.inf)
            np.maximum.at(top, owner, key)
            found = np.flatnonzero((key == top[owner]) & (key > -np.inf))
            own = np.full(m, -1)
            own[owner[found]] = found
            now = np.full(m, -np.inf)
            have = own >= 0
            now[have] = _conditioned(values[f][have], top[have])
            better = have & (now > best)
            best, source, place = np.where(better, now, best), np.where(better, f, source), np.where(better, own, place)
        kappa = best
        if turn == k:
            break
        ds = np.flatnonzero(source >= 0)
        if not len(ds):
            break
        prefix = np.zeros(m)
        head: dict[int, tuple] = {}
        open_doc, open_chunk, open_node, open_step = [], [], [], []
        for i in ds.tolist():
            number, at = source[i], place[i]
            p, (own, edges, key) = walks[number]
            key[at] = -np.inf  # no longer in the frontier
            where, edge, logp = int(p[1][own[at]]), int(edges[at]), lat.logp[edges[at]]
            # the frontier of a walk belongs to the path that it made for this document
            old = paths[i][number]
            keep = np.searchsorted(old[0], where)
            head[i] = (np.append(old[0][:keep], where), np.append(old[1][:keep], edge), np.append(old[2][:keep], logp))
            prefix[i] = p[4][own[at]] + logp
            c = where // STEP
            rest = np.arange(c, n[i])
            open_doc.append(np.full(len(rest), i))
            open_chunk.append(rest)
            nodes = start[first_chunk[i] + rest]
            nodes[0] = lat.to[edge]
            steps = np.zeros(len(rest), np.int64)
            steps[0] = where % STEP + 1
            open_node.append(nodes)
            open_step.append(steps)
        walks.append(_walk(lat, turn + 1, seeds, *(np.concatenate(x) for x in (open_doc, open_chunk, open_node, open_step)), prefix))
        values.append(best)
        tails = cut(walks[-1][0])
        for i in range(m):
            if i in head:
                paths[i].append((*(np.concatenate(x) for x in zip(head[i], tails[i])), float(best[i])))
            elif len(paths[i]) == turn:
                paths[i].append(None)
    out = []
    for i in range(m):
        rows = []
        for p in paths[i]:
            if p is not None:
                lp = float(p[2].sum())
                inc = 1.0 if not np.isfinite(kappa[i]) else float(-np.expm1(-np.exp(min(700.0, lp - kappa[i]))))
                rows.append((lat.ids_of(p[1]) if len(p[1]) else np.empty(0, np.int64), lp, p[3], inc))
        out.append(rows)
    return out


def lattice(path: str, theta: float) -> Lattice:
    worker_state("segment")
    if _state.get("key") != (path, theta):
        _state.update(key=(path, theta), lattice=Lattice(path, theta))
    return _state["lattice"]


def decode_ids(ids: np.ndarray, lat: Lattice) -> str:
    """The text of piece ids; ids of control pieces stand for nothing, bytes that are no characters for U+FFFD."""
    size = lat.size[ids]
    ends = np.cumsum(size)
    raw = lat.raw[np.repeat(lat.begin[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    out = raw.tobytes().decode("utf-8", "replace").replace(MARK, " ")
    return out[1:] if out[:1] == " " else out


def encode_samples(docs: DataFrame, model_path: str, k: int = 2, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, sample from 1, n_pieces, ids_crc32, log_prob, perturbed, inclusion, round_trip[, ids])."""
    ship(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("round_trip", pa.bool_())]
    ddl = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path, theta)

        def rows(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            seeds = _mix(np.array([x or 0 for x in ids], np.int64).view(U64) + U64(0x632BE59BD9B4E019))
            out: list[list] = [[] for _ in fields]
            for doc, text, found in zip(ids, texts, sample(lat, texts, seeds, k)):
                for r, (pieces, lp, value, inc) in enumerate(found, 1):
                    ok = decode_ids(pieces, lat) == text
                    row = [doc, r, len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), lp, value, inc, ok] + [pieces.astype(np.int32)] * keep_ids
                    for o, v in zip(out, row):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, type=t) for o, (_, t) in zip(out, fields)], schema=schema)

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > 400_000:
                    yield from rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield from rows(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with text string: the text of each row's ids; null ids give null."""
    ship(encoded.sparkSession)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        lat = lattice(model_path, 1.0)
        return pa.array([decode_ids(x.values.to_numpy(), lat) if x.is_valid else None for x in ids], pa.string())

    return encoded.withColumn("text", run(F.col(ids_col)))
