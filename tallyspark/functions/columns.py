"""Column expressions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,7)"


def first_text(*names: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def asset_key(kind: Column, code: Column, issuer: Column) -> Column:
    """`native`, CODE:ISSUER, or the code alone without an issuer."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.when(kind == "native", "native").otherwise(F.concat_ws(":", blank(code), blank(issuer)))


def price_of(rational: Column, base: Column, counter: Column) -> Column:
    """The rational price, else counter by base, else 0."""
    return F.coalesce(rational, F.when(base > 0, counter.cast("double") / base.cast("double")), F.lit(0.0))


def toid(id_col: Column) -> Column:
    """The number before the dash of an effect id; null if malformed."""
    return F.when(id_col.rlike(r"^\d+-\d+$"), F.substring_index(id_col, "-", 1).try_cast("bigint"))


# What an effect type begins with or equals, and its category, in the order of testing.
CATEGORIES = (
    ("signer_", "Signers"),
    ("trustline_", "Trustlines"),
    ("claimable_balance_", "Claimable balances"),
    ("liquidity_pool_", "Liquidity pools"),
    ("offer_", "DEX offers & trades"),
    ("data_", "Data entries"),
    ("contract_", "Smart contracts"),
    ("account_", "Account balances & settings"),
)
WHOLE_TYPES = (("trade", "DEX offers & trades"), ("sequence_bumped", "Account balances & settings"))


def effect_category(kind: Column) -> Column:
    """Sponsorship is tested first: such types begin with another category's prefix."""
    out = F.when(kind.contains("sponsorship"), "Sponsorship")
    for prefix, name in CATEGORIES:
        out = out.when(kind.startswith(prefix), name)
    for whole, name in WHOLE_TYPES:
        out = out.when(kind == whole, name)
    return out.otherwise("Other")


def money(text: Column) -> Column:
    """A decimal amount out of text; null where it is none."""
    return text.try_cast("decimal(19,7)").cast(MONEY)


def epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO time; null where it is none."""
    return F.unix_seconds(F.try_to_timestamp(text))


def ratio(n: Column, d: Column) -> Column:
    """A rational given as two whole numbers in text; null where it is none."""
    n, d = n.try_cast("decimal(20,0)").cast("double"), d.try_cast("decimal(20,0)").cast("double")
    return F.when(d != 0, n / d)


def direction(account: Column, source: Column, destination: Column) -> Column:
    return (
        F.when((source == account) & (destination == account), "self")
        .when(destination == account, "incoming")
        .when(source == account, "outgoing")
        .otherwise("related")
    )


# The form of a contract's id (a letter for what it is, 32 bytes and a checksum, in base 32), and the
# polynomial of its checksum (CRC-16).
CONTRACT_FORM, POLYNOMIAL = "^C[A-D][A-Z2-7]{54}$", 0x1021


#: How many characters of an id are read as one number.
CHUNKS = (12, 12, 12, 12, 8)


def parity_masks() -> list[list[int]]:
    """For each bit of the checksum, the bits of the id's numbers (CHUNKS) of which an even count are set where it is right.
    A checksum is linear: it is the exclusive or of what each bit of the id does to it."""
    out, power, shifts = [[0] * len(CHUNKS) for _ in range(16)], 1, [5 * sum(CHUNKS[k + 1 :]) for k in range(len(CHUNKS))]
    for bit in range(5 * sum(CHUNKS)):  # from the last one on
        chunk = next(k for k, low in enumerate(shifts) if bit >= low)
        does = power if bit >= 16 else 1 << (bit + 8) % 16  # the checksum itself has its lower byte first
        for n in range(16):
            out[n][chunk] |= (does >> n & 1) << bit - shifts[chunk]
        power = power << 1 ^ (0x10000 | POLYNOMIAL if power & 0x8000 else 0)
    return out


def is_contract(c: Column) -> Column:
    """Whether a text is a contract's id, checksum included. Five bits a character: 52 and four fifths of them are what the
    checksum is of, the last 16 bits are the checksum. They are read as five numbers, whose bits have to be even by each mask."""
    digits = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    numbers = F.array(*[F.conv(F.substring(digits, 1 + sum(CHUNKS[:k]), n), 32, 10).cast("bigint") for k, n in enumerate(CHUNKS)])

    def checked(x: Column) -> Column:
        odd = lambda masks: F.bit_count(reduce(Column.bitwiseXOR, [F.get(x, F.lit(k)).bitwiseAND(F.lit(m)) for k, m in enumerate(masks)])).bitwiseAND(F.lit(1))
        return reduce(Column.__and__, [odd(masks) == 0 for masks in parity_masks()])

    return F.coalesce(F.when(c.rlike(CONTRACT_FORM), F.get(F.transform(F.array(numbers), checked), F.lit(0))), F.lit(False))
