"""Secret scanning with a recursive decoding worklist.

Every layer of a text is scanned with the base patterns. New layers come from unwrapping URL escapes (%uXXXX and, where
there are others, + for a space too), Unicode, octal and HTML escapes, from joining the parts of quoted texts (whole
layers, with exact position maps), and from base64 or hexadecimal runs (one layer a run), whose bytes may be gzip, zlib,
bzip2, xz, zstandard or bare deflate streams (the last if its first 64 bytes are ASCII). Layers are worked off until none is new; a layer already
seen over the same piece of the text is not taken again, which ends cycles. A finding in a layer is mapped to the
piece of the original text that carries it. Bytes that are no UTF-8 and characters that are not printable hide nothing.

Spans are code points, end exclusive. Defined cases: null text is empty and has no findings; texts are scanned
whole; repeated rows give repeated results, of which findings of one stretch and kind count once; an empty table gives
an empty result; columns other than the id and the text are ignored (redact passes them on); a stream of more than `max_layer` bytes is taken in windows of that many,
which bounds the memory and not the time: a decompression bomb costs the time that its contents take. What a broken
stream holds before it breaks counts; a failure that is not the stream's (no decoder, no memory) ends the job.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex")
MAX_LAYER = 1 << 26
# Bytes that windows of a long stream have in common, that are fed to a decompressor and that are taken from it at once.
OVERLAP, FED, CHUNK = 1 << 20, 1 << 12, 1 << 20


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns.
ASSIGN = re.compile(
    "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")

# The shortest assignment has 14 characters, 19 in base64 without padding and 28 in hexadecimal.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){14,}(?![0-9A-Za-z])")
URL = re.compile("(?:%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4})+")
# As forms have it: a space is a plus.
FORM = re.compile(r"(?:%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|\+)+")
PLUS = re.compile(r"(\++)")
WIDE_URL = re.compile("((?:%u[0-9A-Fa-f]{4})+)")
# What stands between the parts of a quoted text: `" "`, `" + "` or `" . "`.
JOINT = re.compile(r"""(?<=[A-Za-z0-9+/=_-])(["'])\s*+(?:[+.]\s*+)?\1(?=[A-Za-z0-9+/_-])""")
ESCAPE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\[0-3][0-7]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[a-z]{2,6};)+")
# The runs of wrapped lines: the last one may be short, and a line of prose is none.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++(?![ \t]+\w))+={0,2}")
WRAPPED_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){14,}+(?:\r?\n[ \t]*(?:[0-9a-fA-F]{2})++(?![0-9A-Za-z]))+")
LINE_END = re.compile(r"\r?\n[ \t]*")
SEPARATOR = re.compile("[/_-]")
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?=1AY&SY)|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
MEMBER = re.compile(rb"(?P<gzip>\x1f\x8b)|(?P<zlib>\x78(?=.))|(?P<bzip2>BZh)|(?P<xz>\xfd7zXZ\0)|(?P<zstd>\x28\xb5\x2f\xfd)", re.S)
ZEROS = re.compile(rb"\0*")
WIDE = re.compile(rb"(?:[\x01-\xff]\0\0\0){4,}|(?:[\x01-\xff]\0){4,}")
ONE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|(&[^;]{1,9};)|\\([0-3][0-7]{2})")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kind by its place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _unescape(run: str) -> str:
    def one(m: re.Match) -> str:
        if m[5]:
            return html.unescape(m[5])
        if m[6]:
            return chr(int(m[6], 8))
        n = int(m[1] or m[2] or m[3] or m[4], 16)
        return chr(n) if n < 0x110000 else m[0]

    out = ONE.sub(one, run)
    # surrogate halves that belong together
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in out) else out


def _url(run: str) -> str:
    units = lambda x: bytes.fromhex(x.replace("%u", "")).decode("utf-16-be", "replace")
    return "".join(units(part) if part[:2] == "%u" else unquote_to_bytes(part).decode(errors="replace") for part in WIDE_URL.split(run))


def _form(run: str) -> str:
    return "".join(" " * len(part) if part[:1] == "+" else _url(part) for part in PLUS.split(run))


class Layer:
    """A decoded text and where its characters come from: pieces (position here, position above, end above);
    in a piece with an end all characters stand for that whole stretch, in others one for one."""

    def __init__(self, text: str, above: Layer | None = None, pieces: list[tuple[int, int, int | None]] | None = None):
        self.text, self.above, self.pieces = text, above, pieces or []
        self.at = [p[0] for p in self.pieces]

    def up(self, start: int, end: int) -> tuple[int, int]:
        here: Layer | None = self
        while here.above is not None:
            a = here.pieces[bisect_right(here.at, start) - 1]
            b = here.pieces[bisect_right(here.at, end - 1) - 1]
            start = a[1] if a[2] is not None else a[1] + start - a[0]
            end = b[2] if b[2] is not None else b[1] + end - b[0]
            here = here.above
        return start, end


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    parts, pieces, at, last = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None or new == m[0]:
            continue
        if m.start() > last:
            pieces.append((at, last, None))
            parts.append(layer.text[last : m.start()])
            at += m.start() - last
        if new:
            pieces.append((at, m.start(), m.end()))
            parts.append(new)
            at += len(new)
        last = m.end()
    if not last:
        return None
    if last < len(layer.text):
        pieces.append((at, last, None))
        parts.append(layer.text[last:])
    return Layer("".join(parts), layer, pieces)


def _deflated(raw: bytes, at: int) -> bool:
    """Whether a deflate stream without a header may begin here: its first bytes inflate to some text. What is none breaks
    off within a few bytes, or has a block of a kind or length that there is not."""
    if len(raw) - at < 8 or raw[at] & 6 == 6:
        return False
    try:
        out = zlib.decompressobj(-15).decompress(raw[at : at + FED], 64)
    except zlib.error:
        return False
    return len(out) >= 14 and out.isascii()


def _chunks(raw: bytes, at: int, bare: bool = False) -> Iterator[bytes]:
    """What the compressed members from raw[at:] on hold, up to where they end or break; bare: one without a header."""
    try:
        while (m := MEMBER.match(raw, at)) or bare:
            kind = "zlib" if bare else m.lastgroup
            if kind == "zstd":
                import io

                import zstandard

                # reads on over frames, of any window that the format's library knows
                with zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(io.BytesIO(raw[at:]), read_across_frames=True) as r:
                    try:
                        while out := r.read(CHUNK):
                            yield out
                    except zstandard.ZstdError as broken:
                        if "Allocation error" in str(broken):
                            raise
                return
            d = zlib.decompressobj(-15) if bare else zlib.decompressobj(47) if kind in ("gzip", "zlib") else bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor()
            while not d.eof and at < len(raw):
                part = raw[at : at + FED]
                at += len(part)
                out = d.decompress(part, CHUNK)
                while True:
                    if out:
                        yield out
                    if d.eof or not (d.unconsumed_tail if kind in ("gzip", "zlib") else not d.needs_input):
                        break
                    out = d.decompress(d.unconsumed_tail if kind in ("gzip", "zlib") else b"", CHUNK)
            if bare:
                return
            at -= len(d.unused_data)
            at += len(ZEROS.match(raw, at)[0])
    except (zlib.error, lzma.LZMAError, OSError, EOFError):  # a broken stream (bzip2's is an OSError): what came before it counts
        return


def _windows(chunks: Iterator[bytes], most: int) -> Iterator[bytes]:
    """The chunks as one text where they fit most bytes, else in windows that overlap."""
    kept, new = bytearray(), 0
    for c in chunks:
        kept += c
        new += len(c)
        while len(kept) > most:
            yield bytes(kept[:most])
            del kept[: most - min(OVERLAP, most // 2)]
            new = len(kept) - min(OVERLAP, most // 2)
    if new:
        yield bytes(kept)


def _layers(raw: bytes, starts: list[int], most: int) -> Iterator[bytes]:
    """raw and what the compressed streams in it hold, and those in them, until none is new. A stream may begin at any
    byte; the two bytes that zlib begins with count at the starts only."""

    def inside(data: bytes, starts: list[int]) -> Iterator[bytes]:
        zlibs = [x for x in starts if (m := MEMBER.match(data, x)) and m.lastgroup == "zlib" and (data[x] * 256 + data[x + 1]) % 31 == 0]
        for at in sorted({m.start() for m in STREAM.finditer(data)} | set(zlibs)):
            yield from _windows(_chunks(data, at), most)
        for at in starts:
            if _deflated(data, at):
                yield from _windows(_chunks(data, at, bare=True), most)

    yield raw
    seen = {hashlib.blake2b(raw, digest_size=16).digest()}
    work = [inside(raw, starts)]
    while work:
        data = next(work[-1], None)
        if data is None:
            work.pop()
        elif (mark := hashlib.blake2b(data, digest_size=16).digest()) not in seen:
            seen.add(mark)
            yield data
            work.append(inside(data, [0]))


def _texts(raw: bytes, starts: list[int], most: int) -> Iterator[str]:
    """Whatever the bytes are, the base patterns decide: they are ASCII, which other bytes do not hide. Noise holds
    next to no further runs. A second text has the ASCII of UTF-16 and UTF-32 stretches narrowed."""
    for data in _layers(raw, starts, most):
        yield data.decode(errors="replace")
        narrow = WIDE.sub(lambda m: m[0].replace(b"\0", b""), data) if b"\0" in data else data
        if narrow != data:
            yield narrow.decode(errors="replace")


def _decoded(run: str) -> Iterator[tuple[bytes, list[int]]]:
    """The bytes of a base64 run, which may have line ends in it, and where its parts begin in them. A part begins
    after a line end, '/', '-' or '_'; parts a multiple of four characters apart are read with the same bytes."""
    lines = LINE_END.split(run.rstrip("="))
    body = "".join(lines)
    begins, at = {0}, 0
    for x in lines[:-1]:
        at += len(x)
        begins.add(at)
    begins |= {m.end() for m in SEPARATOR.finditer(body)} | {m.start() for m in SEPARATOR.finditer(body)}
    by_phase: dict[int, list[int]] = {}
    for x in sorted(begins):
        by_phase.setdefault(x % 4, []).append(x)
    plain = body.replace("-", "+").replace("_", "/")
    for phase, places in by_phase.items():
        own = plain[phase:]
        if len(own) % 4 == 1:
            own = own[:-1]
        try:
            yield base64.b64decode(own + "=" * (-len(own) % 4), validate=True), [(x - phase) // 4 * 3 for x in places]
        except binascii.Error:
            continue


def _runs(layer: Layer, most: int) -> Iterator[Layer]:
    wrapped = WRAPPED.finditer(layer.text) if "\n" in layer.text else ()
    for m in (*BASE64.finditer(layer.text), *wrapped):
        for raw, starts in _decoded(m[0]):
            for text in _texts(raw, starts, most):
                yield Layer(text, layer, [(0, m.start(), m.end())])
    for m in (*HEX_RUN.finditer(layer.text), *(WRAPPED_HEX.finditer(layer.text) if "\n" in layer.text else ())):
        for text in _texts(bytes.fromhex(m[0]), [0], most):
            yield Layer(text, layer, [(0, m.start(), m.end())])


def scan(text: str, max_layer: int = MAX_LAYER) -> tuple[list, list]:
    """Base spans and all spans (start, kind, end), each sorted."""
    base = sorted(base_spans(text))
    found = set(base)
    work, seen = [Layer(text)], {(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest(), 0, len(text))}
    while work:
        layer = work.pop()
        new = []
        if "%" in layer.text:
            new.append(_replaced(layer, URL, _url))
            if "+" in layer.text:
                new.append(_replaced(layer, FORM, _form))
        if "\\" in layer.text or "&" in layer.text:
            new.append(_replaced(layer, ESCAPE, _unescape))
        if '"' in layer.text or "'" in layer.text:
            new.append(_replaced(layer, JOINT, lambda joint: ""))
        for x in itertools.chain(new, _runs(layer, max_layer)):
            if x is None or not x.text:
                continue
            where = x.up(0, len(x.text))
            mark = (hashlib.blake2b(x.text.encode("utf-8", "replace"), digest_size=16).digest(), *where)
            if mark in seen:
                continue
            seen.add(mark)
            work.append(x)
            for start, kind, end in base_spans(x.text):
                a, b = x.up(start, end)
                found.add((a, kind, b))
    return base, sorted(found)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """docs' id with base and all findings: arrays of (kind, start, end)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("base", span), ("spans", span)])
    ddl = f"`{id_col}` {kind.simpleString()}, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, all_ = [], []
            for x in b.column(1):
                for out, spans in zip((base, all_), scan(x.as_py() or "", max_layer)):
                    out.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(all_, span)], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, ddl)


def redact(docs: DataFrame, mark: str = "[SECRET]", max_layer: int = MAX_LAYER) -> DataFrame:
    """docs with every finding of text (overlapping ones as one) replaced by mark; n_chars follows where present."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            spans = scan(t, max_layer)[1]
            if not spans:
                return t
            out, last = [], 0
            for a, _, b in spans:
                if a >= last:
                    out += [t[last:a], mark]
                last = max(last, b)
            return "".join(out) + t[last:]

        return pa.array([one(t.as_py()) for t in texts], pa.string())

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
