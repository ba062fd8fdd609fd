"""Structured Streaming counterparts. Sources are files here; any stream with the same columns will do."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.aggregates import with_direction
from ..operators.filters import filter_direction
from ..operators.normalize import normalize_payments
from ..sources.tables import SCHEMAS, shared_folder


def stream_payments(spark: SparkSession, folder: str, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Raw payments as they arrive as files, with their declared schema."""
    return spark.readStream.schema(SCHEMAS["payments"]).format(format).option("maxFilesPerTrigger", files_per_trigger).load(f"{folder}/payments")


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events file as a stream; the glob keeps other tables out."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def watch_accounts(payments: DataFrame, accounts: DataFrame, mode: str = "all") -> DataFrame:
    """Normalised payments of a stream that touch a watched account (one-column list), a row for each account they touch,
    with the direction from its side, as far as the mode lets it pass (see filter_direction)."""
    touched = with_direction(payments).join(accounts.toDF("inspected").distinct(), "inspected")
    return filter_direction(touched, mode)


def resumable(stream: DataFrame, token: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each token once, though the source may repeat it within the delay. What was taken before a stop does not come
    again: a query that is started anew with its checkpoint goes on behind it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([token])


def run_resumable(stream: DataFrame, spark: SparkSession, token: str, source: str, where: str | None = None) -> DataFrame:
    """Each token of a source once, however long ago it came first, for sources whose tokens ascend: what is kept is the
    highest token of each source (one row), written with every batch; a row at or below it has been taken before. A
    batch that is repeated after a failure starts from the state of the one before it, and replaces what it wrote."""
    where = where or shared_folder(spark, "resumable")
    kind = stream.select(F.col(source).alias("_source"), F.col(token).alias("_token")).schema

    def write(df: DataFrame, batch: int) -> None:
        before = spark.read.schema(kind).parquet(f"{where}/highest/batch={batch - 1}") if batch else spark.createDataFrame([], kind)
        fresh = df.join(before, F.col(source).eqNullSafe(F.col("_source")), "left").where(F.col("_token").isNull() | (F.col(token) > F.col("_token")))
        fresh.select(*stream.columns).dropDuplicates([source, token]).write.mode("overwrite").parquet(f"{where}/rows/batch={batch}")
        now = before.unionByName(df.select(F.col(source).alias("_source"), F.col(token).alias("_token"))).where("_token is not null")
        now.groupBy("_source").agg(F.max("_token").alias("_token")).write.mode("overwrite").parquet(f"{where}/highest/batch={batch}")

    _await(stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{where}-state").foreachBatch(write).start())
    return spark.read.schema(stream.schema).parquet(f"{where}/rows/batch=*")


def kinds_of(streams: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(kind, time) of several streams, each with its time in seconds, as one."""
    out = None
    for kind, (stream, time) in streams.items():
        rows = stream.select(F.lit(kind).alias("kind"), time.cast("bigint").alias("time"))
        out = rows if out is None else out.unionByName(rows)
    return out


def run_windowed(stream: DataFrame, spark: SparkSession, width: int = 86_400, delay: int = 3_600, where: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts (kind, start, n) by windows of so many seconds of a stream (kind, time), and the rows that came too late
    (kind, time, start). A window is closed once the newest time of earlier batches is its end and the delay past; what
    comes for it then is reported instead of counted. Batches write counts, late rows and their newest time under their
    number, so one that is repeated replaces itself."""
    where = where or shared_folder(spark, "windowed")

    def write(df: DataFrame, batch: int) -> None:
        newest = spark.read.schema("newest long, batch long").parquet(f"{where}/newest").where(F.col("batch") < batch).agg(F.max("newest")).first()[0] if batch else None
        rows = df.where("time is not null").withColumn("start", F.floor(F.col("time") / width) * width)
        late = F.col("start") + width + delay <= newest if newest is not None else F.lit(False)
        rows.where(late).write.mode("overwrite").parquet(f"{where}/late/batch={batch}")
        rows.where(~late).groupBy("kind", "start").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{where}/counts/batch={batch}")
        rows.agg(F.max("time").alias("newest")).write.mode("overwrite").parquet(f"{where}/newest/batch={batch}")

    _await(stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{where}-state").foreachBatch(write).start())
    counted = spark.read.schema("kind string, start long, n long").parquet(f"{where}/counts/batch=*").groupBy("kind", "start").agg(F.sum("n").alias("n"))
    return counted, spark.read.schema("kind string, time long, start long").parquet(f"{where}/late/batch=*")


def stream_counts(stream: DataFrame, key: str, time: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), key, "n")


def stream_balances(stream: DataFrame, account: str, delta: str) -> DataFrame:
    return stream.groupBy(account).agg(F.sum(F.col(delta).cast("decimal(19,7)")).cast("decimal(38,7)").alias("balance"), F.count("*").alias("n"))


def payment_stream(stream: DataFrame) -> DataFrame:
    """Raw payment-like operations, normalised as in batch."""
    return normalize_payments(stream)


def run_bounded(stream: DataFrame, spark: SparkSession, mode: str = "append", seconds: float | None = None, events: int | None = None, where: str | None = None) -> DataFrame:
    """Process what there is and stop, at the latest after so many seconds, or once so many events have been written
    (whole batches, so that a source with few files a batch stops closer). Every batch goes to a table in the shared
    folder, under its number, which a batch that is repeated after a failure overwrites; a run that is given the folder
    of an earlier one goes on behind it."""
    where = where or shared_folder(spark, "stream")
    path = lambda batch: f"{where}/batch={batch if mode != 'complete' else 0}"
    written = 0

    def write(df: DataFrame, batch: int) -> None:
        nonlocal written
        if events is None:
            df.write.mode("overwrite").parquet(path(batch))
            return
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path(batch))
        written += seen.get["n"]

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{where}-state").foreachBatch(write).start()
    began = time.monotonic()
    while not query.awaitTermination(1):
        if (seconds is not None and time.monotonic() - began > seconds) or (events is not None and written >= events):
            query.stop()
            break
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{where}/batch=*")


def run_updates(stream: DataFrame, spark: SparkSession, keys: list[str], where: str | None = None) -> DataFrame:
    """As run_bounded, in update mode: a batch writes only what it has changed, and the newest row of each key is read."""
    where = where or shared_folder(spark, "updates")
    run_bounded(stream, spark, "update", where=where)
    written = spark.read.schema(f"{stream.select(*stream.columns).schema.toDDL()}, batch long").parquet(where)
    return written.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("_newest")).select(*keys, "_newest.*")


def _await(query) -> None:
    query.awaitTermination()


def observe_counts(stream: DataFrame, condition, spark: SparkSession) -> DataFrame:
    """(received, passed): rows that came and rows that met the condition, counted in the batch that they came in; each
    batch's counts are a row of a table, so any number of batches adds up."""
    seen = stream.select(F.coalesce(condition, F.lit(False)).alias("passed"))
    where = shared_folder(spark, "observed")

    def write(df: DataFrame, batch: int) -> None:
        df.agg(F.count("*").alias("received"), F.count_if("passed").alias("passed")).write.mode("overwrite").parquet(f"{where}/batch={batch}")

    _await(seen.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{where}-state").foreachBatch(write).start())
    counted = spark.read.schema("received long, passed long").parquet(f"{where}/batch=*")
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "passed")])


def archive_events(stream: DataFrame, path: str, bucket: int = 10_000) -> None:
    """Append to an archive by ledger bucket. A batch that is repeated after a failure overwrites what it wrote."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("bucket", F.floor(F.col("ledger") / bucket)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")

    _await(stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-state").foreachBatch(write).start())


def retention_gaps(archive: DataFrame, bucket: int = 10_000) -> DataFrame:
    """(after, before, missing): consecutive stored ledgers with others missing in between. Neighbours are found within
    buckets; only the first and last ledger of each bucket meet in one ordering."""
    held = archive.select("ledger").distinct().withColumn("bucket", F.floor(F.col("ledger") / bucket))
    inner = held.select(F.col("ledger").alias("after"), F.lead("ledger").over(Window.partitionBy("bucket").orderBy("ledger")).alias("before"))
    ends = held.groupBy("bucket").agg(F.min("ledger").alias("low"), F.max("ledger").alias("after"))
    outer = ends.select("after", F.lead("low").over(Window.orderBy("bucket")).alias("before"))
    return inner.unionByName(outer).where("before > after + 1").withColumn("missing", F.col("before") - F.col("after") - 1)
