"""Summaries that grow by increments: each increment leaves partial results, which are merged when read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_BITS = 12  # of approximate distinct counts: a standard error of 1.04 / sqrt(2 ** 12), 1.6 %


@dataclass(frozen=True)
class Summary:
    """Measures by keys, each a kind and what it is of: ("count",), ("sum", c), ("min", c), ("max", c), ("first", c, order),
    ("last", c, order) (the value of c at the least and greatest order), ("distinct", c), exact, from a table of its own
    that has every value of a key once an increment, or ("approx_distinct", c), from a sketch."""

    keys: tuple[str, ...]
    measures: dict[str, tuple] = field(default_factory=dict)

    def _partial(self, kind: str, of: tuple) -> Column:
        if kind in ("first", "last"):
            return (F.min if kind == "first" else F.max)(F.when(F.col(of[1]).isNotNull(), F.struct(F.col(of[1]).alias("order"), F.col(of[0]).alias("value"))))
        one = {"count": lambda: F.count("*"), "sum": lambda: F.sum(of[0]), "min": lambda: F.min(of[0]), "max": lambda: F.max(of[0]), "approx_distinct": lambda: F.hll_sketch_agg(of[0], SKETCH_BITS)}
        return one[kind]()

    @staticmethod
    def _merged(kind: str, name: str) -> Column:
        if kind in ("first", "last"):
            return (F.min if kind == "first" else F.max)(name)["value"]
        if kind == "approx_distinct":
            return F.hll_sketch_estimate(F.hll_union_agg(name))
        return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[kind](name)

    def _plain(self) -> dict[str, tuple]:
        return {n: m for n, m in self.measures.items() if m[0] != "distinct"}

    def _distinct(self) -> dict[str, tuple]:
        return {n: m for n, m in self.measures.items() if m[0] == "distinct"}

    def _states(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(F.count("*").alias("_rows"), *[self._partial(kind, of).alias(n) for n, (kind, *of) in self._plain().items()])

    def _values(self, df: DataFrame, column: str) -> DataFrame:
        return df.select(*self.keys, F.col(column).alias("value")).where("value is not null").distinct()

    def add(self, df: DataFrame, path: str, increment: int) -> None:
        """What an increment comes to, under its number: one that is repeated after a failure replaces itself."""
        self._states(df).write.mode("overwrite").parquet(f"{path}/states/increment={increment}")
        for n, (_, column) in self._distinct().items():
            self._values(df, column).write.mode("overwrite").parquet(f"{path}/{n}/increment={increment}")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """The keys with all measures, over all increments."""
        states = spark.read.parquet(f"{path}/states")
        out = states.groupBy(*self.keys).agg(*[self._merged(kind, n).alias(n) for n, (kind, *_) in self._plain().items()], F.sum("_rows").alias("_rows"))
        for n in self._distinct():
            held = spark.read.parquet(f"{path}/{n}").select(*self.keys, "value").distinct().groupBy(*self.keys).agg(F.count("*").alias("_n"))
            same = [out[k].eqNullSafe(held[k]) for k in self.keys]
            on = same[0]
            for s in same[1:]:
                on = on & s
            out = out.join(held, on, "left").select(out["*"], F.coalesce(held["_n"], F.lit(0)).alias(n))
        return out.select(*self.keys, *self.measures)

    def follow(self, stream: DataFrame, path: str):
        """A stream's batches as increments, until what there is has been taken; goes on behind an earlier run."""
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-state").foreachBatch(lambda df, batch: self.add(df, path, batch)).start()
        query.awaitTermination()
        return self.read(stream.sparkSession, path)
