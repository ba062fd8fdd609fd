"""Every ledger query against DuckDB at the smallest scale, literal cases, and plan checks."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import filters as X
from tallyspark.operators import joins as J
from tallyspark.operators import normalize as N
from tallyspark.operators import windows as W
from tallyspark.plans import registry
from tallyspark.plans.views import BASE, Tables

DATA = "/root/testdata/sf0.001"


def text(v):
    return str(v.normalize()) if isinstance(v, decimal.Decimal) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_plans(spark):
    t = Tables(spark, DATA)
    for df in (A.trade_summary(N.normalize_trades(t.raw_trades)), N.decode_event_values(t.raw_contract_events), A.claimable_at(t.raw_claimables, 5, "last_modified_ledger")):
        plan = plan_of(df)
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_plans(spark):
    t = Tables(spark, DATA)
    for df in (A.ledger_effects_summary(N.index_effects(t.effects)), A.offer_book_summary(N.normalize_offers(t.raw_offers)), A.asset_summary(N.normalize_assets(t.raw_assets))):
        assert "Expand" not in plan_of(df)
    quotes = J.quote_paths(t.spark.createDataFrame([("A", "B", 2)], "src string, dst string, rate long"), t.spark.createDataFrame([("A", "B")], "src string, target string"))
    assert "CartesianProduct" not in plan_of(quotes) and "NestedLoop" not in plan_of(quotes)
    plain = spark.read.parquet(f"{DATA}/orders.parquet").withColumnRenamed("o_orderkey", "ledger")
    recent = plan_of(X.recent_ledgers(plain, lookback=10))
    assert "NestedLoop" not in recent and "GreaterThanOrEqual(o_orderkey" in recent  # the range reaches the scan


def test_malformed_effect_ids(spark):
    ids = ["0000000012884905985-0000000001", None, "", "no-toid-here", "12884905985", "12884905985-", "-1"]
    out = N.index_effects(spark.createDataFrame([(i,) for i in ids], "id string")).collect()
    assert (out[0].id_ledger, out[0].tx_order, out[0].op_index, out[0].effect_index) == (3, 1, 1, 1)
    assert all(r.toid is None and r.effect_index is None for r in out[1:])


def test_reserves(spark):
    rows = [("a", 3, 0, 0, decimal.Decimal(50)), ("b", 2, 0, 1, decimal.Decimal(50)), ("c", 1, 3, 0, decimal.Decimal(0)), ("d", 4, 1, 0, decimal.Decimal(0)), ("e", 0, 0, 3, decimal.Decimal(0))]
    df = spark.createDataFrame(rows, "id string, subentry_count long, num_sponsored long, num_sponsoring long, balance decimal(19,7)")
    a = {r.id: r for r in A.reserve_requirements(df).collect()}
    assert a["a"].reserve_stroops == a["d"].reserve_stroops == 25_000_000 and a["b"].available == decimal.Decimal("47.5")
    ledgers = spark.createDataFrame([(1, 1), (2, 5_000_000)], "sequence long, base_reserve long")
    b = {r.id: r for r in A.reserve_impact(df, ledgers).collect()}
    assert b["c"].entries_b == 0 and b["c"].relief == 15_000_000 and b["e"].responsibility == 15_000_000 and b["e"].minimum == 25_000_000
    assert A.reserve_impact(df, ledgers.limit(0)).where("minimum = 25000000").count() > 0


def test_running_balance_ends_at_current(spark):
    d = decimal.Decimal
    deltas = spark.createDataFrame([("a", 2, 2, d(10)), ("a", 1, 1, d(-3))], "account string, ledger long, event_id long, delta decimal(38,7)")
    out = W.balance_history(deltas, spark.createDataFrame([("a", d(107))], "id string, balance decimal(19,7)")).orderBy("event_id").collect()
    assert [r.running for r in out] == [d(97), d(107)]


def test_page_is_truncated(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    rows = X.page(df, "k", 3, 4).orderBy("k").collect()
    assert [r.k for r in rows] == [4, 5, 6, 7] and all(r.truncated for r in rows)
    assert not any(r.truncated for r in X.page(df, "k", 7, 4).collect())
    assert X.filter_direction(spark.createDataFrame([("self",), ("related",)], "direction string"), "incoming").count() == 1


def test_admissible_ledgers_of_every_transaction(spark):
    ledgers = spark.createDataFrame([(5,), (9,), (70_000,), (200_000,)], "sequence long")
    txs = [("closed", 6, 70_000), ("open", 6, 0), ("on it", 9, 0), ("next stretch", 10, 0), ("far", 140_000, 0), ("late", 200_001, 0), ("none", 10, 20), ("crossed", 9, 5), ("null", None, None), ("wide", 1, 2_000_000_000), ("beyond", 2**40, 2**41), ("below", -5, 5)]
    got = {r.hash: (r.earliest, r.ledgers) for r in J.admissible_ledgers(spark.createDataFrame(txs, "hash string, min_ledger long, max_ledger long"), ledgers).collect()}
    assert got == {"closed": (9, 2), "open": (9, 3), "on it": (9, 3), "next stretch": (70_000, 2), "far": (200_000, 1), "late": (None, 0), "none": (None, 0), "crossed": (None, 0), "null": (5, 4), "wide": (5, 4), "beyond": (None, 0), "below": (5, 1)}


def test_admissible_ledgers_by_time(spark):
    ledgers = [(5, 100), (6, 105), (7, 105), (9, 120), (70_000, 400_000)]
    txs = [(f"{a}-{b}-{c}-{d}", a, b, c, d) for a in (0, 6, 10) for b in (0, 7, 80_000) for c in (None, 0, 101, 105, 500_000) for d in (None, 0, 99, 105, 119, 400_000)]
    df = spark.createDataFrame(txs, "hash string, min_ledger long, max_ledger long, min_time long, max_time long")
    want = {}
    for name, a, b, c, d in txs:
        fit = [s for s, at in ledgers if s >= a and (not b or s <= b) and at >= (c or 0) and (not d or at <= d)]
        want[name] = (min(fit, default=None), len(fit))
    assert {r.hash: (r.earliest, r.ledgers) for r in J.admissible_ledgers_and_times(df, spark.createDataFrame(ledgers, "sequence long, closed_at long")).collect()} == want


def test_created_balances_of_every_transaction(spark):
    tx = lambda n, op, effect: f"{n * 4096 + op:019d}-{effect:010d}"
    made = "claimable_balance_created"
    rows = [(tx(1, 1, 1), made, "B1"), (tx(1, 2, 1), made, "B2"), (tx(2, 1, 1), made, "B3"), (tx(3, 1, 1), "claimable_balance_claimed", "B1"), (tx(3, 1, 2), "trade", None), ("odd", made, "B4"), ("odd", "trade", None)]
    got = J.created_balances_by_tx(spark.createDataFrame(rows, "id string, type string, balance_id string")).collect()
    assert sorted(((r.tx, r.balance_id) for r in got), key=str) == sorted([(1, "B1"), (1, "B2"), (2, "B3"), (3, None), (None, "B4")], key=str)


def test_quote_paths_of_all_pairs(spark):
    from itertools import permutations

    edges = [("A", "B", 2), ("B", "C", 3), ("A", "C", 5), ("C", "D", 2), ("D", "A", 1), ("A", "B", 1), ("E", "E", 4)]
    df = spark.createDataFrame(edges, "src string, dst string, rate long")
    best = {(a, b): max(r for x, y, r in edges if (x, y) == (a, b)) for a, b, _ in edges}
    want = {}
    for n in (2, 3, 4):
        for path in permutations("ABCDE", n):
            if all(step in best for step in zip(path, path[1:])):
                rate = 1
                for step in zip(path, path[1:]):
                    rate *= best[step]
                want[path[0], path[-1]] = max(rate, want.get((path[0], path[-1]), 0))
    asked = spark.createDataFrame(list(permutations("ABCDE", 2)), "src string, target string")
    assert {(r.src, r.target): r.rate for r in J.quote_paths(df, asked, 3).collect()} == want
    trades = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "A"), ("C", "C")], "base_asset string, counter_asset string")
    assert {tuple(r) for r in J.traded_pairs(trades).collect()} == {("A", "B"), ("B", "A"), ("C", "A"), ("A", "C")}
