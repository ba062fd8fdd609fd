"""Dimension and data-quality jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.tables import read_matching


def asset_dimension(uses: dict[str, tuple], ledger: str = "ledger") -> DataFrame:
    """Assets over several tables, each given with all its asset columns (table, column, ...): label, uses in all and by
    table, first and last ledger. A row that names an asset in two columns uses it twice; a table without a ledger column
    counts without one."""
    at = lambda df: F.col(ledger).cast("long") if ledger in df.columns else F.lit(None).cast("long")
    rows = [df.select(F.explode(F.array(*columns)).alias("asset"), F.lit(name).alias("resource"), at(df).alias("ledger")) for name, (df, *columns) in uses.items()]
    every = reduce(DataFrame.unionByName, rows).where("asset is not null and asset <> ''")
    by = [F.count_if(F.col("resource") == name).alias(f"{name}_uses") for name in uses]
    out = every.groupBy("asset").agg(F.count("*").alias("uses"), *by, F.min("ledger").alias("first_ledger"), F.max("ledger").alias("last_ledger"))
    return out.withColumn("label", F.when(F.col("asset") == "native", "XLM (native)").otherwise(F.col("asset")))


# The form of an issued asset's reference.
ISSUED = "^[A-Za-z0-9]{1,12}:[A-Za-z0-9]+$"


def audit_asset_refs(df: DataFrame, columns: list[str], issued: str = ISSUED) -> DataFrame:
    """(name, reason, n) over the columns given: ok, empty, no_issuer (a code alone) or malformed."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("ref")) for c in columns])).alias("x")
    ref = F.coalesce("x.ref", F.lit(""))
    reason = F.when(ref == "", "empty").when((ref == "native") | ref.rlike(issued), "ok").when(F.instr(ref, ":") == 0, "no_issuer").otherwise("malformed")
    return df.select(stacked).groupBy(F.col("x.name").alias("name"), reason.alias("reason")).agg(F.count("*").alias("n"))


def price_source_report(trades: DataFrame, offers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(resource, source, n, disagree) of raw trades and offers: priced by the rational, by the amounts (of an offer: the
    decimal price) or not at all, and how many rationals are off the other price by more than a share of it."""

    def source(df: DataFrame, name: str, rational: Column, other: Column) -> DataFrame:
        kind = F.when(rational.isNotNull(), "rational").when(other.isNotNull(), "amounts").otherwise("none")
        off = F.coalesce(F.abs(rational - other) > tolerance * other, F.lit(False))
        return df.select(F.lit(name).alias("resource"), kind.alias("source"), off.alias("off"))

    base, counter = (F.col(c).try_cast("double") for c in ("base_amount", "counter_amount"))
    both = source(trades, "trades", ratio(F.col("price.n"), F.col("price.d")), F.when(base > 0, counter / base)).unionByName(
        source(offers, "offers", ratio(F.col("price_r.n"), F.col("price_r.d")), F.col("price").try_cast("double"))
    )
    return both.groupBy("resource", "source").agg(F.count("*").alias("n"), F.count_if("off").alias("disagree"))


# The forms of ids.
ID_FORMS = {"effects": r"^\d+-\d+$", "trades": r"^\d+-\d+$", "operations": r"^\d+$"}


def id_report(tables: dict[str, DataFrame], forms: dict[str, str] = ID_FORMS) -> DataFrame:
    """(resource, pattern, n): ids that decode, are empty, or do not decode (wrong form, or a number beyond 64 bits)."""

    def one(name: str, df: DataFrame) -> DataFrame:
        number = F.substring_index("id", "-", 1).try_cast("bigint")
        pattern = F.when(F.coalesce("id", F.lit("")) == "", "empty").when(F.col("id").rlike(forms[name]) & number.isNotNull(), "decodes").otherwise("malformed")
        return df.select(F.lit(name).alias("resource"), pattern.alias("pattern"))

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()]).groupBy("resource", "pattern").agg(F.count("*").alias("n"))


def batch_overlap(archive: DataFrame, batch: DataFrame, token: str) -> DataFrame:
    """Rows of the batch, with whether the archive holds them."""
    known = archive.select(token).distinct().withColumn("_hit", F.lit(True))
    return batch.join(known, token, "left").withColumn("repeated", F.coalesce("_hit", F.lit(False))).drop("_hit")


def stored_overlap(archive: DataFrame, batch: DataFrame, token: str, width: int | None = None, **layout) -> DataFrame:
    """batch_overlap with an archive that is stored by buckets of its token: see read_matching."""
    return batch_overlap(read_matching(archive, batch, token, width, **layout), batch, token)


def tier_difference(entries: DataFrame) -> DataFrame:
    """Keys that are in one tier only."""
    tier = lambda d: F.max(F.when(F.col("durability") == d, True).otherwise(False))
    return entries.groupBy("contract_id", "key").agg(tier("persistent").alias("p"), tier("temporary").alias("t")).where("p <> t").select("contract_id", "key", F.when(F.col("p"), "persistent").otherwise("temporary").alias("only_in"))
