"""Trees of any depth: nodes as stored tables, one a level, unfolded from the roots and folded from the leaves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..sources.tables import shared_folder, stored


@dataclass(frozen=True)
class Levels:
    """Nodes by depth. `at` is a node's number within its level, `up` that of its parent, `place` its place there, `parts`
    its children (an array of VARIANT; null or empty for a leaf)."""

    spark: SparkSession
    folder: str
    schema: StructType
    count: int

    def at(self, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/depth={depth}")

    def all(self) -> DataFrame:
        """Nodes of all levels, with their depth."""
        return self.spark.read.schema(StructType([*self.schema, *StructType().add("depth", IntegerType())])).parquet(self.folder)


def unfold(roots: DataFrame, describe: Callable[[DataFrame], DataFrame], carry: list[str]) -> Levels:
    """The levels of all trees of roots, which have what is to be known of a node, and `parts`. describe makes the same
    columns for lower nodes out of `node` and the carried columns, which every node has from its root. One job a level,
    until one has no nodes; each holds that level only."""
    spark = roots.sparkSession
    folder, depth = shared_folder(spark, "levels"), 0
    level = roots.withColumns({"up": F.lit(None).cast("bigint"), "place": F.lit(None).cast("int")})
    names = level.columns
    schema = None
    while True:
        level = level.select(*names).withColumn("at", F.monotonically_increasing_id())
        schema = schema or StructType.fromJson(level.schema.jsonValue())
        level.write.parquet(f"{folder}/depth={depth}")
        done = Levels(spark, folder, schema, depth + 1)
        inner = done.at(depth).where(F.size("parts") > 0)
        if inner.isEmpty():
            return done
        lower = describe(inner.select(*carry, F.col("at").alias("up"), F.posexplode("parts").alias("place", "node")))
        level = lower.select(*[F.col(c) if c in lower.columns else F.lit(None).cast(schema[c].dataType).alias(c) for c in names])
        depth += 1


def fold(levels: Levels, combine: Callable[[DataFrame], DataFrame], results: dict[str, str]) -> DataFrame:
    """The roots with their results (name: type). combine adds the results to nodes that have `kids`, the results of their
    children in order. One job a level, from the deepest on; a plan reads one level and what the next one came to. Files
    of numbers and repeated texts are far smaller than their rows in memory, so by their size millions of kids would be
    broadcast through the driver; the sides are sorted and merged instead."""
    kind = "array<struct<place:int," + ",".join(f"{n}:{t}" for n, t in results.items()) + ">>"
    below = None
    for depth in reversed(range(levels.count)):
        level = levels.at(depth)
        rows = level.withColumn("kids", F.array().cast(kind))
        if below is not None:
            inner = F.coalesce(F.size("parts") > 0, F.lit(False))
            kids = below.groupBy(F.col("up").alias("_up")).agg(F.sort_array(F.collect_list(F.struct("place", *results))).cast(kind).alias("kids"))
            rows = rows.where(~inner).unionByName(level.where(inner).join(kids.hint("merge"), F.col("at") == F.col("_up")).drop("_up"))
        rows = combine(rows)
        if depth:
            below = stored(rows.select("up", "place", *results), "folded")
    return rows.drop("kids", "parts", "up", "place", "at")
