"""What grows by increments or batches, and what narrows down to a rank."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import joins as J
from tallyspark.operators import quality as Q
from tallyspark.sources import tables as S
from tallyspark.sources.summaries import Summary
from tallyspark.streaming import streams as R

ROWS = "k string, v long, who string, at long"


def some_rows(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(50)]), f"w{rnd.randrange(4000)}", i) for i in range(n)]


def test_increments_equal_one_run(spark, tmp_path):
    summary = Summary(("k",), {"n": ("count",), "total": ("sum", "v"), "least": ("min", "v"), "most": ("max", "v"), "first": ("first", "who", "at"), "last": ("last", "who", "at"), "people": ("distinct", "who"), "about": ("approx_distinct", "who")})
    rows = some_rows(6000)
    parts = [rows[:2000], rows[2000:2500], rows[2500:]]
    for i in (0, 1, 2, 1):  # one of them is replayed
        summary.add(spark.createDataFrame(parts[i], ROWS), f"{tmp_path}/three", i)
    summary.add(spark.createDataFrame(rows, ROWS), f"{tmp_path}/one", 0)
    exact = [c for c in ("k", *summary.measures) if c != "about"]
    got, whole = (sorted(map(tuple, summary.read(spark, f"{tmp_path}/{x}").select(exact).collect()), key=str) for x in ("three", "one"))
    assert got == whole and len(got) == 3
    mine = [r for r in rows if r[0] is None]
    assert (None, len(mine), sum(r[1] or 0 for r in mine), 0, 49, mine[0][2], mine[-1][2], len({r[2] for r in mine})) in got
    for r in summary.read(spark, f"{tmp_path}/three").collect():
        assert abs(r.about - r.people) < 0.08 * r.people


def test_a_stream_is_summed_by_batches(spark, tmp_path):
    rows = some_rows(300, 2)
    summary = Summary(("k",), {"n": ("count",), "people": ("distinct", "who")})
    want = lambda part: {k: (n, len({r[2] for r in part if r[0] == k})) for k, n in Counter(r[0] for r in part).items()}
    for upto in (100, 200, 300):
        spark.createDataFrame(rows[upto - 100 : upto], ROWS).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = summary.follow(stream, f"{tmp_path}/out")
        assert {r.k: (r.n, r.people) for r in got.collect()} == want(rows[:upto])


def test_quantiles_are_exact(spark):
    rnd = random.Random(5)
    values = {"hot": [rnd.randrange(10**6) for _ in range(4000)], "wide": [rnd.randrange(-(2**63), 2**63) for _ in range(300)], "same": [7] * 50, "one": [-5], "edge": [0, 65535, 65536, 2**32, 2**48, -1, -65536, 2**63 - 1, -(2**63)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("hot", None)]
    got = {(r.k, r.percent): r.v for r in A.exact_quantiles(spark.createDataFrame(rows, "k string, v long"), "k", "v", (1, 50, 90, 99, 100)).collect()}
    assert got == {(k, p): sorted(vs)[max(1, math.ceil(len(vs) * p / 100)) - 1] for k, vs in values.items() for p in (1, 50, 90, 99, 100)}


def test_late_rows_are_reported(spark, tmp_path):
    put = lambda n, *at: spark.createDataFrame([(x,) for x in at], "at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}")
    put("effects", 5, 95, 130), put("payments", 5), put("trades", 250)
    stream = R.kinds_of({n: (spark.readStream.schema("at long").parquet(f"{tmp_path}/{n}"), F.col("at")) for n in ("effects", "payments", "trades")})
    run = lambda: R.run_windowed(stream, spark, 100, 20, f"{tmp_path}/out")
    counted, late = run()
    assert sorted(map(tuple, counted.collect())) == [("effects", 0, 2), ("effects", 100, 1), ("payments", 0, 1), ("trades", 200, 1)] and late.count() == 0
    # the newest time was 250: windows up to 200 are closed, that from 200 on is not
    put("payments", 99, 199, 201), put("trades", 400, None)
    counted, late = run()
    assert sorted(map(tuple, counted.collect())) == [("effects", 0, 2), ("effects", 100, 1), ("payments", 0, 1), ("payments", 200, 1), ("trades", 200, 1), ("trades", 400, 1)]
    assert sorted(map(tuple, late.collect())) == [("payments", 99, 0), ("payments", 199, 100)]


def test_old_tokens_do_not_come_again(spark, tmp_path):
    schema = "token long, source string, at timestamp"
    put = lambda *rows: spark.createDataFrame([(t, s, None) for t, s in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sorted(((r.token, r.source) for r in R.run_resumable(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), spark, "token", "source", f"{tmp_path}/out").collect()), key=str)
    put((1, "a"), (2, "a"), (2, "a"), (1, "b"), (3, None))
    assert run() == [(1, "a"), (1, "b"), (2, "a"), (3, None)]
    for _ in range(3):
        put((1, "a"), (2, "b"), (3, "a"), (3, None), (9, "c"))  # days later or not: time is not asked
        assert run() == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, None), (9, "c")]
    state = spark.read.parquet(f"{tmp_path}/out/highest/batch=3").collect()
    assert {r["_source"]: r["_token"] for r in state} == {"a": 3, "b": 2, "c": 9, None: 3} and len(state) == 4


@pytest.mark.parametrize("most", [10_000, 1])
def test_a_batch_opens_only_its_buckets(spark, tmp_path, most):
    S.store_by_ledger(spark.range(0, 100_000, 2).withColumnRenamed("id", "token"), f"{tmp_path}/archive", "token", 1000)
    archive = spark.read.schema("token long, bucket long").parquet(f"{tmp_path}/archive")
    spark.createDataFrame([(3002, "a"), (3003, "b"), (5004, "c"), (10**9, "d"), (None, "e"), (3002, "f")], "token long, name string").write.parquet(f"{tmp_path}/batch")
    out = Q.stored_overlap(archive, spark.read.schema("token long, name string").parquet(f"{tmp_path}/batch"), "token", 1000, most=most)
    assert {r.name: r.repeated for r in out.collect()} == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": True}
    lines = out._jdf.queryExecution().sparkPlan().toString().split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "bucket" in x)
    semi = next(i for i, x in enumerate(lines) if "LeftSemi" in x)
    assert "bucket" in lines[scan].split("PartitionFilters: [")[1].split("PushedFilters")[0]
    # the batch's tokens go to where the archive is read; what is between them is of the batch's side
    assert "BroadcastHashJoin" in lines[semi] and not any("Exchange" in x for x in lines[semi + 1 : scan])


def test_a_batch_is_joined_with_an_archive_by_hash(spark, tmp_path):
    S.store_by_hash(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").alias("ledger")), f"{tmp_path}/archive", "hash", 64)
    archive = spark.read.schema("hash string, ledger long, bucket long").parquet(f"{tmp_path}/archive")
    rows = spark.range(3).select(F.col("id").cast("string").alias("id"), F.sha2((F.col("id") * 4000).cast("string"), 256).alias("transaction_hash"), F.lit(None).cast("long").alias("ledger"))
    mine = S.read_matching(archive, rows.withColumnRenamed("transaction_hash", "hash"), "hash", buckets=64)
    assert {r.id: r.ledger for r in J.attach_ledgers(rows, mine).collect()} == {"0": 0, "1": 4000, "2": None}
    lines = mine._jdf.queryExecution().sparkPlan().toString().split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "bucket" in x)
    assert "bucket" in lines[scan].split("PartitionFilters: [")[1] and not any("Exchange" in x for x in lines[:scan])
