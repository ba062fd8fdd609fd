"""Personal data by expressions only: patterns propose spans, checksums confirm them, words nearby adjust their score.

Every kind has a pattern whose leftmost non-overlapping matches are proposed, a test that a proposal must pass (Luhn for
cards, mod 97 for bank accounts, ranges for addresses, counts of digits), a score to start from, and words whose presence
just before or after it raises or lowers the score. Spans of the base kinds stay whatever their score; the others, which
the method adds, are reported from a score of `least` on.

Patterns never step back over what they have matched (possessive, or tied to the beginning of a run), so a text takes time
in proportion to its length whatever it holds, and no stack grows with it. The two arrays of a kind (what matches, what
lies between) give all places by one running sum.

Defined cases: a null text is empty and has no spans; places are code points, ends exclusive; spans of different kinds may
overlap; repeated rows give repeated rows, a null id stays null, an empty table gives an empty result; only the id and the
text are used, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import running

# Countries by the length of their bank account numbers (two letters, two digits, the rest).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}

BEFORE, AFTER = 48, 24  # characters that count as nearby
UP, DOWN = 0.3, 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # leftmost matches of it are proposed
    plain: str  # the same without lookaround and possessives, for engines that lack them
    score: float
    base: bool
    near: str = ""  # words that raise the score
    far: str = ""  # words that lower it


_IBAN = "|".join(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_COUNTRIES.items())
_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0.9, True, "mail|contact|write", "example|noreply"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.6, True, "ip|address|host|server|login", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9]([\x20-]?[0-9])+", 0.7, True, "card|visa|credit|debit|payment", "order|serial|isbn|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, True, "phone|tel|call|mobile|fax", ""),
    Kind("iban", rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})", f"(?:{_IBAN})", 0.8, False, "iban|account|bank|konto|compte|cuenta", ""),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, False, "ssn|social security|taxpayer", "order|part|invoice"),
    Kind("local", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", 0.3, False, "phone|tel|call|mobile|cell|fax", "order|part|invoice"),
)


def _mod97(number: Column) -> Column:
    """Whether a bank account number without spaces passes its checksum."""
    turned = F.concat(F.substring(number, 5, 40), F.substring(number, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        digit = F.ascii(c) < 58
        return F.when(digit, (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column, before: Column, after: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    apart = lambda of: ~F.coalesce(F.right(before, F.lit(1)).rlike(of), F.lit(False)) & ~F.coalesce(F.left(after, F.lit(1)).rlike(of), F.lit(False))
    if kind == "ip":
        # a part is at most 255 whatever zeros lead it
        return value.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return apart("[A-Za-z0-9]") & _mod97(F.replace(value, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return apart("[0-9-]") & ~value.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "local":
        return apart("[0-9+-]") & ~F.coalesce(F.right(before, F.lit(BEFORE)).rlike(r"\+[0-9][\x20().0-9-]*$"), F.lit(False))
    return F.lit(True)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    around = F.lower(F.concat(F.right(before, F.lit(BEFORE)), F.lit(" "), F.left(after, F.lit(AFTER))))
    words = lambda of: F.when(around.rlike(rf"(^|[^a-z])({of})"), 1).otherwise(0) if of else F.lit(0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(kind.score + words(kind.near) * UP - words(kind.far) * DOWN, 2)))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs' id with base and spans: arrays of (kind, start, end, score, value), by kind in the order of KINDS, then start."""
    out = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    hits = {k.name: F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(0)) for k in KINDS}
    hits["email"] = F.when(F.contains("_text", F.lit("@")), hits["email"]).otherwise(none)
    out = out.select("*", *[h.alias(f"_{n}") for n, h in hits.items()])
    out = out.select("*", *[F.when(F.size(f"_{k.name}") > 0, F.split("_text", k.pattern, -1)).otherwise(none).alias(f"_{k.name}_between") for k in KINDS]).drop("_text")
    # what lies before a match and the match, as one length
    steps = {k.name: F.zip_with(f"_{k.name}_between", f"_{k.name}", lambda b, v: F.char_length(b) + F.coalesce(F.char_length(v), F.lit(0))) for k in KINDS}
    out = out.select("*", *[s.alias(f"_{n}_step") for n, s in steps.items()])
    out = out.select("*", *[running(F.col(f"_{n}_step")).alias(f"_{n}_at") for n in steps])

    def spans(k: Kind) -> Column:
        between = f"_{k.name}_between"

        def one(v: Column, i: Column) -> Column:
            before, after = F.get(between, i), F.get(between, i + 1)
            start = F.get(f"_{k.name}_at", i) + F.char_length(before)
            ok = _confirmed(k.name, v, before, after)
            return F.when(ok, F.struct(F.lit(k.name).alias("kind"), start.alias("start"), (start + F.char_length(v)).alias("end"), _score(k, before, after).alias("score"), v.alias("value")))

        found = F.filter(F.transform(f"_{k.name}", one), lambda s: s.isNotNull())
        return found if k.base else F.filter(found, lambda s: s["score"] >= least)

    out = out.select(F.col("_id").alias(id_col), *[spans(k).alias(f"_{k.name}") for k in KINDS])
    base = F.concat(*[F.col(f"_{k.name}") for k in KINDS if k.base])
    return out.select(id_col, base.alias("base"), F.concat(*[F.col(f"_{k.name}") for k in KINDS]).alias("spans"))
