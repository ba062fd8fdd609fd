"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on clusters: installed, or --py-files), and
    have rows go to them 4 MB at a time, unless the session sets another size: texts are long, so that Spark's 10,000 rows
    are many times what an executor has beside its heap."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "4m")
    top = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [top, env.get("PYTHONPATH")]))


_states: dict[str, dict] = {}


def worker_state(name: str) -> dict:
    """What an operator keeps in a Python worker; workers are reused, so it drops what others have left there, and the
    memory that Arrow holds on to goes back to the system."""
    left = [kept for other, kept in _states.items() if other != name and kept]
    for kept in left:
        kept.clear()
    if left:
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
    return _states.setdefault(name, {})


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir; where unset, a local session (tests) has an own
    temporary one, and any other is refused."""
    conf = spark.sparkContext.getConf()
    where = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_rows(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """Rows of the driver as a table. They go as Arrow: tuples would start Python workers on the executors, of another kind
    than those of the operators and kept beside them."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, which the caller makes anew."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def fold_of(doc_id, n: int):
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def likely_in(df: DataFrame, key: str, keys: DataFrame, log2_bits: int = 26) -> DataFrame:
    """Rows of df whose key hashes to a bit that a row of keys (one column) has set; all whose key is in keys are among
    them. A filter before a join, so that rows without a partner are not shuffled: the bitmap is at most
    2 ** log2_bits bits (8 MB), however many keys there are, and then lets more rows through."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << log2_bits))
    bucket = lambda c: F.shiftright(place(c), 15).cast("int")
    bit = lambda c: place(c).bitwiseAND(F.lit((1 << 15) - 1))
    only = F.col(keys.columns[0])
    maps = keys.select(bucket(only).alias("_bucket"), bit(only).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    own = df.withColumn("_bucket", bucket(F.col(key))).withColumn("_bit", bit(F.col(key)))
    byte = "cast(conv(hex(substring(_map, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    found = own.join(F.broadcast(maps), "_bucket").where(F.expr(f"getbit({byte}, cast(_bit % 8 as int)) = 1"))
    return found.select(*df.columns)


def heavy_keys(rows: DataFrame, key: str, total: int, shares: int = 256, least: int = 128) -> tuple[list, int]:
    """Values of key that hold more than one in `shares` of the total rows, and `least` at that: by counting fewer than
    `shares` of them, however many keys there are. With them, into how many pieces (at most `shares`) the largest has
    to be cut so that none holds more."""
    most = max(least, total // shares)
    if total <= most:
        return [], 1
    found = rows.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > most)).collect()
    return [r[0] for r in found], max((-(-r[1] // most) for r in found), default=1)


def join_heavy(rows: DataFrame, other: DataFrame, on: list[str], heavy: list, pieces: int, by: Column) -> DataFrame:
    """rows joined with other, which has one row a key. Rows of keys whose first column is among heavy are dealt over
    `pieces` tasks by `by`, and other's rows of these keys are there once for each piece."""
    if not heavy:
        return rows.join(other, on)
    piece = fresh(rows, "_piece")
    cut = F.when(F.col(on[0]).isin(heavy), F.lit(pieces)).otherwise(F.lit(1)).cast("long")
    left = rows.withColumn(piece, F.pmod(F.xxhash64(by), cut))
    right = other.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    return left.join(right, [*on, piece]).drop(piece)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node reachable.

    Alternates the large-star and small-star steps; each is one aggregation and one join. Nothing is gathered: the
    edges of a hub are dealt over many tasks (hubs are found anew in each round; there are fewer than 256 of them).
    Every round is written to the shared folder. Self loops and repeated edges change nothing; without edges the result
    is empty; no convergence within the rounds is an error."""

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def labelled(rows: DataFrame, own: Column, hubs: tuple[list, int]) -> DataFrame:
        """rows (a, b) with m, the least of own over the rows of a."""
        return join_heavy(rows, rows.groupBy("a").agg(F.min(own).alias("m")), ["a"], *hubs, F.col("b"))

    def large(e: DataFrame, hubs: tuple[list, int]) -> DataFrame:
        return labelled(both(e), F.least("a", "b"), hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame, hubs: tuple[list, int]) -> DataFrame:
        # a > b throughout; a node has no more rows than it had ends before the large step
        moved = labelled(e, F.col("b"), hubs).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(e.groupBy("a").agg(F.min("b").alias("b")))

    def stamp(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "cc")
    before = stamp(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        hubs = heavy_keys(both(now), "a", 2 * before[0])
        now = materialize(small(large(now, hubs), hubs).distinct(), "cc")
        after = stamp(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.unionByName(roots)
