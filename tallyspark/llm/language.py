"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary of at most `dict_bytes`, cut from a bounded sample of
labelled texts. A text is cut into blocks (so that the dictionary, not the text's own repeats, decides on long
texts too), every block is compressed against each dictionary, and the language with the smallest sum wins.
The score is the margin to the second best, mapped to 0..1; a text is rejected where the margin is narrow.

What is shipped to tasks is languages x dict_bytes; languages are the distinct labels, at most `max_langs` of them
(more is an error, not a cut).

Defined cases: null text, or text without a letter, is `und`, score 0, rejected; so is everything when no
labelled text exists. Ties go to the alphabetically first language. Texts are used whole; repeated rows give
repeated results; an empty table gives an empty result; only the named columns are used.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fresh, materialize, ship, without, worker_state

BLOCK, LEVEL = 2048, 6
CLOSE = 0.01  # a margin below this is measured again, more finely
_state: dict = worker_state("language")
_NOT_WORD = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    return (" " + _NOT_WORD.sub(" ", text.lower()).strip() + " ").encode()


def learn(docs: DataFrame, where: Column, text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, dict_bytes: int = 1 << 16, max_langs: int = 200) -> dict[str, bytes]:
    """lang -> dictionary, from at most per_lang different texts a language (least text hashes) that satisfy where."""
    own = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")
    )
    order = Window.partitionBy("lang").orderBy("h")
    # counts by the leading bits of the hash tell which ranges hold the least per_lang; only their rows are ordered
    keyed = own.groupBy("lang", "h").count().select("lang", "h", F.shiftright("h", 52).alias("range"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("range")) - F.col("n")
    ranges = keyed.groupBy("lang", "range").agg(F.count("*").alias("n")).withColumn("below", below).where(F.col("below") < per_lang)
    near = keyed.join(ranges.select("lang", "range"), ["lang", "range"], "left_semi")
    pick = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select("lang", "h")
    pick = materialize(pick, "lang-pick")
    langs = [r[0] for r in pick.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()]
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not langs:
        return {}
    # per_lang * max_langs small rows at most, each of twice its share of the dictionary, as others may be shorter
    share = max(64, dict_bytes * 2 // per_lang)
    middle = F.greatest(F.lit(1), (F.char_length("text") / 2 - share / 2).cast("int"))
    slices = own.join(F.broadcast(pick), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.col("text").substr(middle, F.lit(share))).alias("text"))
    parts: dict[str, list[bytes]] = {}
    for r in slices.orderBy("lang", "h").collect():
        parts.setdefault(r[0], []).append(normal(r[2]))
    out = {k: b"".join(x[: _even([len(y) for y in v], dict_bytes)] for x in v) for k, v in parts.items()}
    return {k: v for k, v in out.items() if v.strip()}


def _even(sizes: list[int], total: int) -> int:
    """The largest size such that all of these, cut to it, come to at most total."""
    left, most = total, 0
    for i, n in enumerate(sorted(sizes)):
        most = left // (len(sizes) - i)
        if n > most:
            return most
        left -= n
    return max(sizes, default=0)


def _compressors(dicts: dict[str, bytes]):
    worker_state("language")
    key = hash(tuple(sorted(dicts.items())))
    if _state.get("key") != key:
        import zstandard as z

        made = []
        for lang in sorted(dicts):
            d = z.ZstdCompressionDict(dicts[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            # matches from three bytes on: a word's syllables tell as much as whole words
            p = z.ZstdCompressionParameters.from_level(
                LEVEL, source_size=BLOCK, dict_size=len(dicts[lang]), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            d.precompute_compress(compression_params=p)
            made.append((lang, z.ZstdCompressor(dict_data=d, compression_params=p)))
        _state.update(key=key, made=made)
    return _state["made"]


def _size(compressor, raw: bytes) -> int:
    return sum([len(compressor.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)])


def _order(sizes: list[tuple[int, str]]) -> tuple[list[tuple[int, str]], float]:
    """Languages from the smallest size on, and the margin of the first."""
    order = sorted(sizes)
    return order, (order[1][0] - order[0][0]) / max(1, order[1][0]) if len(order) > 1 else 1.0


def _turns(raw: bytes, most: int = 16) -> list[bytes]:
    """The text begun at up to `most` of its words, what comes before put at the end: the sum of their sizes is finer than
    the whole bytes of one."""
    words = raw.split()
    k = min(len(words), most)
    return [b" " + b" ".join(words[j:] + words[:j]) + b" " for j in (i * len(words) // k for i in range(k))]


def identify_texts(texts: list[str | None], dicts: dict[str, bytes]) -> list[tuple[str, float, float]]:
    """(language, margin, score) of each text."""
    raws = [normal(t) if t else b"" for t in texts]
    letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    if not dicts:
        return [("und", 0.0, 0.0) for _ in texts]
    # one compressor after the other over the whole batch: its tables stay in the processor's cache
    made = _compressors(dicts)
    sizes = [(lang, [_size(c, r) for r in raws]) for lang, c in made]
    out = []
    for i, some in enumerate(letters):
        if not some:
            out.append(("und", 0.0, 0.0))
            continue
        order, margin = _order([(s[i], lang) for lang, s in sizes])
        if margin < CLOSE and len(turns := _turns(raws[i])) > 1:
            order, margin = _order([(sum(_size(c, t) for t in turns), lang) for lang, c in made])
        out.append((order[0][1], margin, 1.0 - math.exp(-20.0 * margin) if len(order) > 1 else 1.0))
    return out


def identify(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.002, prefix: str = "lang_") -> DataFrame:
    """docs with lang_pred string, lang_margin double, lang_score double, lang_rejected boolean added (the names begin
    with prefix); columns of these names are replaced. A text is rejected whose margin is below narrow, at any length;
    of short texts, whose sizes are a few bytes, these are the ties."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<lang:string,margin:double,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [r for at in range(0, len(texts), 256) for r in identify_texts(texts.slice(at, 256).to_pylist(), dicts)]
        columns = zip(*rows) if rows else ((), (), ())
        kinds = (pa.string(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "margin", "score"])

    # not deterministic for the planner: a later filter must not run it twice
    lid = fresh(docs, "_lid")
    out = docs.withColumn(lid, run.asNondeterministic()(F.col(text_col)))
    r = F.col(lid)
    return out.select(
        *without(docs, *[prefix + n for n in ("pred", "margin", "score", "rejected")]).columns,
        r["lang"].alias(f"{prefix}pred"),
        r["margin"].alias(f"{prefix}margin"),
        r["score"].alias(f"{prefix}score"),
        ((r["lang"] == "und") | (r["margin"] < narrow)).alias(f"{prefix}rejected"),
    )
