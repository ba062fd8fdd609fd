"""Ordered analyses; windows over rows are partitioned by a key and a stretch of its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import MONEY


STRETCH = 10_000  # ledgers (or whatever orders the rows) that are put in order by one task for one key


def _stretch(c: str, width: int) -> Column:
    """The stretch that a row falls in: order columns are cut in equal ones, so that no key's rows meet in one task."""
    return F.floor(F.col(c).cast("bigint") / width)


def _beside(df: DataFrame, key: str, order: list[str], value: str, name: str, width: int, ahead: bool = False) -> DataFrame:
    """df with name: value of the row before (or after) in a key's order, null where there is none. Neighbours are found
    within stretches; over their edges goes one row a key and stretch."""
    rows = df.withColumn("_stretch", _stretch(order[0], width))
    edge = (F.min_by if ahead else F.max_by)(value, F.struct(*order)).alias("_edge")
    over = Window.partitionBy(key).orderBy("_stretch")
    edges = rows.groupBy(key, "_stretch").agg(edge).select(key, "_stretch", (F.lead if ahead else F.lag)("_edge").over(over).alias("_edge"))
    within = Window.partitionBy(key, "_stretch").orderBy(*order)
    step = F.lead if ahead else F.lag
    both = rows.join(edges, (rows[key].eqNullSafe(edges[key])) & (rows["_stretch"].eqNullSafe(edges["_stretch"]))).select(rows["*"], edges["_edge"])
    return both.withColumn(name, F.when(step(F.lit(True)).over(within).isNull(), F.col("_edge")).otherwise(step(value).over(within))).drop("_stretch", "_edge")


def balance_history(deltas: DataFrame, accounts: DataFrame, width: int = STRETCH) -> DataFrame:
    """Running balance that ends at the account's current one: sums by account and stretch of ledgers, those of earlier
    stretches carried into each, and running sums within."""
    rows = deltas.withColumn("_stretch", _stretch("ledger", width))
    every = Window.partitionBy("account")
    before = every.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("account", "_stretch").agg(F.sum("delta").alias("_sum")).join(accounts.select(F.col("id").alias("account"), F.col("balance").alias("_current")), "account")
    opening = F.col("_current") - F.sum("_sum").over(every) + F.coalesce(F.sum("_sum").over(before), F.lit(0))
    run = Window.partitionBy("account", "_stretch").orderBy("ledger", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.join(sums.select("account", "_stretch", opening.cast(MONEY).alias("_opening")), ["account", "_stretch"])
    return own.select("account", "event_id", "delta", (F.col("_opening") + F.sum("delta").over(run)).cast(MONEY).alias("running"))


def latest_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sequence_gaps(txs: DataFrame, order: list[str], account: str = "source_account", sequence: str = "source_sequence", width: int = STRETCH) -> DataFrame:
    """Steps of an account's sequence other than 1, in the order given (its first column a number): gap, repeat or
    regression."""
    rows = _beside(txs.select(account, *order, sequence), account, order, sequence, "_last", width)
    step = F.col(sequence) - F.col("_last")
    kind = F.when(step == 0, "repeat").when(step < 0, "regression").when(step > 1, "gap")
    return rows.select(account, *order, step.cast("bigint").alias("step"), kind.alias("kind")).where("kind is not null")


def status_transitions(polls: DataFrame, width: int = 86_400) -> DataFrame:
    """Polls whose status is another than the one before, and the seconds until the next such one; stretches are days."""
    order = ["polled_at", "poll"]
    rows = polls.select("transaction_id", *order, "status").withColumn("polled_at", F.col("polled_at").cast("bigint"))
    changed = _beside(rows, "transaction_id", order, "status", "_before", width).where(F.col("_before").isNull() | (F.col("_before") != F.col("status"))).drop("_before")
    out = _beside(changed, "transaction_id", order, "polled_at", "_next", width, ahead=True)
    return out.select("transaction_id", "poll", "status", (F.col("_next") - F.col("polled_at")).alias("seconds"), F.col("status").isin("completed", "error").alias("terminal"))


def trade_bars(trades: DataFrame, width: int = 7) -> DataFrame:
    first, last = F.struct("ledger", "id"), F.struct("ledger", "id")
    return trades.groupBy("base_asset", "counter_asset", F.floor(F.col("ledger") / width).alias("bucket")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", last).alias("close"), F.sum("base_amount").cast(MONEY).alias("volume")
    )
