"""Best-fit packing by bin completion branch-and-bound.

Items are packed by length alone, and there are at most `capacity` different lengths, so the search runs on
the histogram (length -> count), whose size is bounded by the capacity and not by the data. A plan is a list of
(filling, times): a filling is the multiset of lengths in one sequence. At each node the largest open length is
taken, the undominated fillings of the room around it are enumerated (a filling is dominated if swapping an item
of it for a larger open one, or adding an open one, still fits), best fit first, and each is applied as often as
the counts allow. A branch is cut when its waste exceeds what a better plan than the incumbent may waste. The
first incumbent is plain best-fit decreasing. The search ends at the lower bound, when no branch is left, or when its
`effort` is spent; the plan says which lower bound it was held against and whether it is proved the best.

Spark then gives each item its rank among the items of its length and the plan's intervals of ranks give its
sequence and place. Ranks are counted within (length, salt), with as many salts as a length has rows for, so no
length is gathered in one task.

Defined cases: null text is empty and becomes one piece that holds only the end id; equal texts are packed as
separate documents; repeated ids are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import few_rows, materialize, ship, without, worker_state

# ---------------------------------------------------------------- tokens

_state: dict = worker_state("packing")
WORDS = 60_000  # chunks that a worker remembers when it forgets the rarer half and those met in one slice only
SLICE = 1_000_000  # characters that are encoded at once
_LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")  # all letters whose lower case is one letter
_LAST_MARK = re.compile("(?<=[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])[.,](?![^ ])")
_BEYOND = re.compile("[^\u0000-\u024f]")
# Byte-level vocabularies write byte n as chr(n), where that is printable Latin-1, else as the next of U+0100 on.
_PRINTED = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


class Words:
    """Ids of the chunks met so far: one row a chunk, its ids a stretch of one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.kind = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        hidden = [n for n in range(256) if n not in _PRINTED]
        self.written = {n: 0x100 + i for i, n in enumerate(hidden)}
        self.row: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, self.kind), 0
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.met = np.empty(0, np.int64)  # slices that held the chunk, halved when others are forgotten

    def _learn(self, missing: list[str]) -> None:
        latin, tokenize, out, other = _LATIN.fullmatch, self.model.tokenize, [], []
        for c in missing:
            # letters in lower case are one word to the vocabulary, which its model takes byte by byte
            if c.isascii() and c.isalpha() and c.islower():
                out.append([t.id for t in tokenize(c)])
            elif latin(c) and c == c.lower():
                out.append([t.id for t in tokenize(c.encode().decode("latin-1").translate(self.written))])
            else:
                other.append(len(out))
                out.append(())
        if other:
            for i, e in zip(other, self.encoder.encode_batch_fast([missing[i] for i in other], add_special_tokens=False)):
                out[i] = e.ids
        size = np.fromiter(map(len, out), np.int64, len(out))
        need = self.used + int(size.sum())
        if need > len(self.flat):
            grown = np.empty(max(need, 2 * len(self.flat)), self.kind)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : need] = np.fromiter(itertools.chain.from_iterable(out), self.kind, need - self.used)
        first = self.used + np.cumsum(size) - size
        self.row.update(zip(missing, range(len(self.first), len(self.first) + len(out))))
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])
        self.met = np.concatenate([self.met, np.zeros(len(out), np.int64)])
        self.used = need

    def _forget(self) -> None:
        least = max(2, int(np.partition(self.met, -(WORDS // 2))[-(WORDS // 2)]) + 1)
        kept = self.met >= least
        place = np.cumsum(kept) - 1
        stay = kept.tolist()
        self.row = {w: int(place[r]) for w, r in self.row.items() if stay[r]}
        first, self.size, self.met = self.first[kept], self.size[kept], self.met[kept] // 2
        self.flat = stretches(self.flat, first, self.size)
        self.used = len(self.flat)
        self.first = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text.

        White space only separates the words of these vocabularies, so a text's ids are those of its space-separated
        chunks in turn. Case is folded first where that is the vocabulary's own folding for sure (Latin letters)."""
        if len(self.row) > WORDS:
            self._forget()
        plain = []
        for t in texts:
            t = (t or "").replace("\n", " ").replace("\t", " ")
            # special tokens are written in lower case only, so folding must not make one
            t = t if _BEYOND.search(t) or "<|" in t else t.lower()
            plain.append(_LAST_MARK.sub(" \\g<0>", t))  # a mark between a letter and a space is a word of its own
        parts = pc.split_pattern(pa.array(plain, pa.string()), " ")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        coded = parts.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False)
        get = self.row.get
        rows = np.array([get(c, -1) for c in different.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        rows[new] = len(self.first) + np.arange(len(new))
        if len(new):
            self._learn(different[new].tolist())
        self.met[rows] += 1
        rows = rows[coded.indices.to_numpy()]
        size = self.size[rows]
        ids = stretches(self.flat, self.first[rows], size)
        bounds = np.concatenate([[0], np.cumsum(size)])[ends].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def stretches(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches flat[first : first + size], one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _words(path: str) -> Words:
    worker_state("packing")
    if _state.get("path") != path:
        _state.update(path=path, words=Words(path))
    return _state["words"]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, cut only where longer than capacity."""
    ship(docs.sparkSession)
    end = np.array([end_id], np.uint32)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path)

        def rows(docs: list, texts: list) -> pa.RecordBatch:
            out: list[list] = [[] for _ in fields]
            for doc, ids in zip(docs, words.encode(texts)):
                ids = np.concatenate([ids, end], dtype="<u4", casting="unsafe")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    row = [doc, piece, start, len(part), zlib.crc32(part)]
                    for o, v in zip(out, row + [part.view("<i4")] * keep_ids):
                        o.append(v)
            return pa.RecordBatch.from_arrays([pa.array(o, type=t) for o, (_, t) in zip(out, fields)], schema=schema)

        for b in batches:
            docs, texts, size = [], [], 0
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                docs.append(doc)
                texts.append(t)
                size += len(t or "")
                if size > SLICE:
                    yield rows(docs, texts)
                    docs, texts, size = [], [], 0
            if docs:
                yield rows(docs, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


# ---------------------------------------------------------------- plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The sum bound, raised by items that cannot share: for each threshold, large items and what they leave."""
    lengths = sorted(counts)
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for t in [x for x in lengths if x <= capacity // 2][:: max(1, len(lengths) // 256)] or [1]:
        alone = sum(c for n, c in counts.items() if n > capacity - t)
        half = [(n, c) for n, c in counts.items() if capacity // 2 < n <= capacity - t]
        small = sum(n * c for n, c in counts.items() if t <= n <= capacity // 2)
        room = sum(c * (capacity - n) for n, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(small - room) // capacity)))
    return best


#: A filling is one sequence's items as (length, how many), lengths descending.
Filling = tuple[tuple[int, int], ...]


class Plan(NamedTuple):
    """Fillings and how often each is used; proved: no plan has fewer bins (the bound is met or the search ran out)."""

    fillings: list[tuple[Filling, int]]
    bins: int
    bound: int
    proved: bool


def used_by(filling: Filling) -> int:
    return sum(n * k for n, k in filling)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Bins of equal filling are kept together as (filling, times), so the work follows the lengths, not the items."""
    rooms: dict[int, list[tuple[Filling, int]]] = {}
    order: list[int] = []  # rooms in use, ascending

    def put(filling: Filling, times: int, room: int) -> None:
        if times:
            if room not in rooms:
                bisect.insort(order, room)
            rooms.setdefault(room, []).append((filling, times))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            i = bisect.bisect_left(order, n)
            if i == len(order):  # new bins: as many full ones as there are, the rest in one more
                per = capacity // n
                put(((n, per),), left // per, capacity - per * n)
                if left % per:
                    put(((n, left % per),), 1, capacity - left % per * n)
                break
            room = order[i]
            filling, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            per = room // n
            full = min(times, left // per)
            put(filling + ((n, per),), full, room - per * n)
            left -= full * per
            some = left if full < times else 0
            if some:
                put(filling + ((n, some),), 1, room - some * n)
                left = 0
            put(filling, times - full - bool(some), room)
    return [x for group in rooms.values() for x in group]


def fillings(room: int, counts: dict[int, int], limit: int, one_perfect: bool) -> tuple[list[Filling], bool, int]:
    """Undominated fillings of room from counts, least waste first, whether these are all that matter, and the choices made.

    Length after length, from the largest, decides how many of it go in, the most first; a stack holds the open choices.
    With one_perfect the first filling without waste is enough. `limit` choices end the search once a filling is found."""
    ascending = sorted(n for n, c in counts.items() if c and n <= room)
    if not ascending:
        return [()], True, 1
    if ascending[-1] == room:
        return [((room, 1),)], True, 1
    for n in reversed(ascending if one_perfect else ()):  # a perfect pair is the cheapest find
        if 2 * n < room:
            break
        if counts.get(room - n, 0) > (2 * n == room):
            return [((n, 2),) if 2 * n == room else ((n, 1), (room - n, 1))], False, 1
    mass = list(itertools.accumulate((n * counts[n] for n in ascending), initial=0))
    found: dict[Filling, int] = {}

    def dominated(chosen: Filling, waste: int) -> bool:
        """Whether an open item fits as well, or in the place of a smaller one."""
        taken = dict(chosen)
        for low, high in [(0, waste), *((n, n + waste) for n in taken)]:
            at = bisect.bisect_right(ascending, high) - 1
            while at >= 0 and ascending[at] > low:
                if counts[ascending[at]] > taken.get(ascending[at], 0):
                    return True
                at -= 1
        return False

    # (room left, how many of the lengths are still to be decided, smallest length passed by with some left, chosen)
    stack: list[tuple[int, int, int, Filling]] = [(room, len(ascending), room + 1, ())]
    steps = 0
    while stack:
        left, i, passed, chosen = stack.pop()
        steps += 1
        i = bisect.bisect_right(ascending, left, 0, i)
        if left == 0 and one_perfect:
            return [chosen], False, steps
        if left and left - mass[i] >= passed:  # whatever follows, an item passed by would fit
            continue
        if i == 0:
            if not dominated(chosen, left):
                found[chosen] = left
            if steps > limit:
                break
            continue
        n = ascending[i - 1]
        most = min(counts[n], left // n)
        # fewer than the most only where the others can fill what then is left
        least = max(0, most - (mass[i - 1] // n + 1))
        for k in range(least, most + 1):
            stack.append((left - k * n, i - 1, min(passed, n) if k < counts[n] else passed, chosen + ((n, k),) if k else chosen))
        if len(stack) > limit and found:
            break
    return sorted(found, key=lambda f: (found[f], f)), not stack, steps


def _search(counts: dict[int, int], capacity: int, best: list[tuple[Filling, int]], bound: int, effort: int, fill_limit: int) -> tuple[list[tuple[Filling, int]], bool, int]:
    """The best plan found, at first the one given; whether no better one is left; and the effort that remains."""
    bins = sum(t for _, t in best)
    total = sum(n * c for n, c in counts.items())
    open_ = dict(counts)
    path: list[tuple[Filling, int]] = []
    waste = 0
    whole = True

    def moves() -> Iterator[tuple[Filling, int]]:
        nonlocal whole, effort
        big = max(open_)
        rest = dict(open_)
        rest[big] -= 1
        listed, all_, steps = fillings(capacity - big, rest, fill_limit, True)
        effort -= steps
        for i in itertools.count():
            if i == len(listed) and not all_:  # the others, now that the first ones have led nowhere
                others, all_, steps = fillings(capacity - big, rest, fill_limit, False)
                effort -= steps
                whole, all_ = whole and all_, True
                listed += [f for f in others if f not in listed]
            if i == len(listed):
                return
            f = listed[i]
            f = ((big, 1 + f[0][1]), *f[1:]) if f and f[0][0] == big else ((big, 1), *f)
            most = min(open_[n] // k for n, k in f)
            # once leaves all other numbers open, as the same filling can follow again
            yield from ((f, times) for times in ((most, 1) if most > 1 else (1,)))

    def apply(move: tuple[Filling, int], sign: int) -> None:
        nonlocal waste
        filling, times = move
        for n, k in filling:
            now = open_.get(n, 0) - sign * times * k
            if now:
                open_[n] = now
            else:
                del open_[n]
        waste += sign * times * (capacity - used_by(filling))

    stack = [moves()] if bins > bound else []
    while stack and effort > 0 and bins > bound:
        move = next(stack[-1], None)
        if move is None:
            stack.pop()
            if path:
                apply(path.pop(), -1)
            continue
        effort -= NODE
        apply(move, 1)
        path.append(move)
        if waste > (bins - 1) * capacity - total:  # as many bins as the best plan, or more
            apply(path.pop(), -1)
        elif not open_:
            best, bins = list(path), sum(t for _, t in path)
            apply(path.pop(), -1)
        else:
            stack.append(moves())
    return best, whole and not stack, effort


NODE = 20  # what a node costs beside the choices at it


def plan(counts: dict[int, int], capacity: int, effort: int = 600_000, fill_limit: int = 2_000) -> Plan:
    """Every item once, in as few bins as the search finds.

    First only the items of the incumbent's imperfect bins are searched for a better plan, then all. The search ends at
    the lower bound, when every branch is cut (both prove the plan), or when the effort (choices made) is spent; a node
    whose fillings were not all listed (fill_limit) leaves the plan unproved too, unless it meets the bound."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return Plan([], 0, 0, True)
    bound = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    whole = False
    if sum(t for _, t in best) > bound:
        perfect = [x for x in best if used_by(x[0]) == capacity]
        others = [x for x in best if used_by(x[0]) < capacity]
        left: dict[int, int] = {}
        for filling, times in others:
            for n, k in filling:
                left[n] = left.get(n, 0) + k * times
        found, _, rest = _search(left, capacity, others, bound - sum(t for _, t in perfect), effort // 2, fill_limit)
        best, whole, _ = _search(counts, capacity, perfect + found, bound, effort // 2 + rest, fill_limit)
    bins = sum(t for _, t in best)
    return Plan(best, bins, bound, whole or bins == bound)


def placements(fillings_: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, items a bin, first sequence, first offset), by rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in fillings_:
        offset = 0
        for n, per in filling:
            out.setdefault(n, []).append((used.get(n, 0), per, sequence, offset))
            used[n] = used.get(n, 0) + per * times
            offset += per * n
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack(items: DataFrame, order_by: list[str], length_col: str = "length", capacity: int = 4096, effort: int = 600_000, per_salt: int = 2_000) -> DataFrame:
    """items with sequence_id, offset, fewest_possible (long) and proved (boolean): the lower bound on the number of
    sequences, and whether the plan is known to have as few as can be. Lengths are 1 to capacity. items must be a
    stored table (it is read three times and must not change between); order_by makes rows distinct enough to number
    them. A length's rows are ranked in groups of about per_salt."""
    spark = items.sparkSession
    ship(spark)
    # at most capacity + 1 rows reach the driver
    lengths = items.groupBy(F.when(F.col(length_col).between(1, capacity), F.col(length_col).cast("int")).alias("n")).count().collect()
    counts = {r[0]: r[1] for r in lengths}
    if None in counts:
        raise ValueError(f"lengths must be 1 to {capacity}")
    found = plan(counts, capacity, effort)
    shared = spark.sparkContext.broadcast(placements(found.fillings))  # bounded by the number of lengths, not of items
    salts = few_rows(spark, pa.schema([("_n", pa.int32()), ("_salts", pa.int64())]), [(n, -(-c // per_salt)) for n, c in counts.items()])
    salted = items.join(F.broadcast(salts), F.col(length_col).cast("int") == F.col("_n"))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.col("_salts"))).drop("_n", "_salts")
    cells = salted.groupBy(length_col, "_salt").count()
    before = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(length_col, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(length_col, "_salt").orderBy(*order_by)
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(starts, [length_col, "_salt"])
    ranked = ranked.withColumn("_rank", (F.col("_first") + F.col("_own")).cast("long")).drop("_own", "_first", "_salt")

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(group):
                n = int(length[group[0]])
                rows = shared.value[n]
                at = np.searchsorted(rows[:, 0], rank[group], side="right") - 1
                first, per, sequence, offset = rows[at].T
                within = rank[group] - first
                seq[group] = sequence + within // per
                off[group] = offset + within % per * n
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    placed = ranked.withColumn("_p", place(F.col(length_col).cast("long"), "_rank"))
    added = {"sequence_id": F.col("_p.sequence_id"), "offset": F.col("_p.offset"), "fewest_possible": F.lit(found.bound).cast("long"), "proved": F.lit(found.proved)}
    return placed.select(*without(items, *added).columns, *[c.alias(n) for n, c in added.items()])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack documents (doc_id, text)."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity=capacity)
