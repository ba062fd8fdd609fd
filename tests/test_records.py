"""Literal records, as a raw table has them, through the normalisers and reports."""

import decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import filters as X
from tallyspark.operators import joins as J
from tallyspark.operators import normalize as N
from tallyspark.operators import quality as Q
from tallyspark.operators import windows as W
from tallyspark.plans.views import contract_key
from tallyspark.sources import tables as S
from tallyspark.streaming import streams as R

D = decimal.Decimal


def raw(spark, name, *records):
    """Records of a declared table, what they leave out being null."""
    schema = spark.createDataFrame([], S.SCHEMAS[name]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in records], schema)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("name", sorted(S.SCHEMAS))
def test_tables_are_read_as_declared(spark, tmp_path, name):
    raw(spark, name, {}).write.parquet(f"{tmp_path}/{name}")
    df = S.read_table(spark, str(tmp_path), name)
    assert df.count() == 1
    steps = {
        "payments": N.normalize_payments, "trades": N.normalize_trades, "offers": N.normalize_offers, "liquidity_pools": N.normalize_pools, "assets": N.normalize_assets, "ledgers": N.normalize_ledgers,
        "transactions": N.normalize_transactions, "contract_events": N.normalize_contract_events, "effects": N.normalize_effects, "accounts": N.normalize_accounts,
    }
    if name in steps:
        assert steps[name](df).count() == 1  # a record of nulls only is normalised too


def test_payments(spark):
    native = {"id": "1", "type": "payment", "from": "A", "to": "B", "amount": "12.3400000", "asset_type": "native", "ledger": 5}
    issued = {"id": "", "paging_token": "2", "type": None, "from": "B", "to": "C", "amount": "3", "asset_type": "credit_alphanum4", "asset_code": "USD", "asset_issuer": "I"}
    created = {"id": "3", "type": "create_account", "funder": "A", "account": "B", "starting_balance": "100"}
    sent = {"id": "4", "type": "path_payment_strict_send", "from": "A", "to": "B", "destination_amount": "7", "destination_asset_type": "credit_alphanum4", "destination_asset_code": "EUR", "destination_asset_issuer": "J", "asset_type": "native"}
    merged = {"id": "5", "type": "account_merge", "account": "B", "into": "A", "source_account": "B", "amount": "9"}
    muxed = {"id": "6", "from": "A", "from_muxed": "MA", "to": "B", "to_muxed": "", "amount": "none"}
    got = {r.id: r for r in N.normalize_payments(raw(spark, "payments", native, issued, created, sent, merged, muxed)).collect()}
    assert (got["1"].source, got["1"].destination, got["1"].amount, got["1"].asset) == ("A", "B", D("12.34"), "native")
    assert (got["2"].type, got["2"].amount, got["2"].asset) == ("payment", D(3), "USD:I")  # a missing type keeps its amount
    assert (got["3"].source, got["3"].destination, got["3"].amount) == ("A", "B", D(100))
    assert (got["4"].amount, got["4"].asset) == (D(7), "EUR:J")
    assert (got["5"].destination, got["5"].amount) == ("B", None)
    assert (got["6"].source, got["6"].destination, got["6"].amount) == ("MA", "B", None)


def test_payment_summary(spark):
    rows = [{"id": str(i), "from": a, "to": b, "amount": "1", **asset} for i, (a, b, asset) in enumerate([("X", "G", {"asset_type": "native"}), ("Y", "G", {"asset_type": "native"}), ("G", "Z", {"asset_type": "credit_alphanum4", "asset_code": "USD", "asset_issuer": "I"})])]
    p = N.normalize_payments(raw(spark, "payments", *rows))
    s = one(A.payment_summary(p).where("inspected = 'G'"))
    assert (s.total, s.incoming, s.outgoing, s.self_payments, s.related) == (3, 2, 1, 0, 0)
    assert {r.asset: r.n for r in A.counts(A.with_direction(p), "inspected", "asset").where("inspected = 'G'").collect()} == {"native": 2, "USD:I": 1}


def test_ledgers_are_attached_once_a_hash(spark):
    p = spark.createDataFrame([("1", "h", None), ("2", "h", None), ("3", "x", None), ("4", "h", 9)], "id string, transaction_hash string, ledger long")
    t = spark.createDataFrame([("h", 7), ("h", 7)], "hash string, ledger long")
    assert {r.id: r.ledger for r in J.attach_ledgers(p, t).collect()} == {"1": 7, "2": 7, "3": None, "4": 9}


def test_trades(spark):
    base = {"base_asset_type": "native", "counter_asset_type": "credit_alphanum4", "counter_asset_code": "USD", "counter_asset_issuer": "I"}
    rows = [
        {**base, "id": "123456789-0", "price": ("3", "8"), "base_amount": "1", "counter_amount": "1", "base_account": "A", "counter_liquidity_pool_id": "P"},
        {**base, "id": "nodashes", "base_amount": "20", "counter_amount": "50", "base_liquidity_pool_id": "P", "trade_type": "liquidity_pool", "base_is_seller": True},
        {**base, "paging_token": "7-1", "base_amount": "0", "counter_amount": "50", "price": ("1", "0")},
        {**base, "id": "8-1", "base_amount": "2", "counter_amount": "1", "price": ("x", "2")},
    ]
    got = {r.id: r for r in N.normalize_trades(raw(spark, "trades", *rows)).collect()}
    assert [got[i].price for i in ("123456789-0", "nodashes", "7-1", "8-1")] == [0.375, 2.5, 0.0, 0.5]
    assert (got["123456789-0"].operation_id, got["nodashes"].operation_id, got["nodashes"].ledger) == ("123456789", "nodashes", None)
    assert (got["nodashes"].base_party, got["123456789-0"].counter_party, got["7-1"].venue, got["nodashes"].base_is_seller) == ("P", "P", "orderbook", True)
    assert got["7-1"].base_asset == "native" and got["7-1"].counter_asset == "USD:I"


def test_trade_summary(spark):
    rows = [{"id": "1-0", "base_amount": "100", "counter_amount": "25", "price": ("1", "4"), "ledger_close_time": "2024-01-02T00:00:00Z"}, {"id": "2-0", "base_amount": "300", "counter_amount": "150", "trade_type": "liquidity_pool", "ledger_close_time": "2024-01-01T00:00:00Z"}]
    s = one(A.trade_summary(N.normalize_trades(raw(spark, "trades", *rows)), ()))
    assert (s.base_volume, s.counter_volume, s.mean_price, s.vwap, s.high, s.low, s.orderbook_trades, s.pool_trades) == (D(400), D(175), 0.375, 0.4375, 0.5, 0.25, 1, 1)
    assert s.last_time - s.first_time == 86_400
    empty = one(A.trade_summary(N.normalize_trades(raw(spark, "trades")), ()))
    assert (empty.trades, empty.base_volume, empty.vwap, empty.mean_price, empty.first_time) == (0, D(0), 0.0, 0.0, None)
    assert one(A.trade_summary(N.normalize_trades(raw(spark, "trades", {"base_amount": "0", "counter_amount": "0"})), ())).vwap == 0.0


def test_effects(spark):
    pool = {"id": "0000000012884905985-0000000003", "type": "liquidity_pool_deposited", "liquidity_pool": ("p1",)}
    rows = [
        {"id": "0000000012884905985-0000000001", "type": "account_credited", "account": "A", "asset_type": "native", "amount": "5.5"},
        {"id": "0000000012884905985-0000000002", "type": "trustline_sponsorship_created", "account": "", "trustor": "T", "asset_code": "USD"},
        pool, {"id": "x", "type": "offer_created", "seller": "S"}, {"id": "y", "type": "", "contract": "C"}, {"id": "z", "type": "sequence_bumped"}, {"id": "w", "type": "trader", "starting_balance": "4"},
    ]
    got = {r.id: r for r in N.normalize_effects(raw(spark, "effects", *rows)).collect()}
    assert [got[i].subject for i in (rows[0]["id"], rows[1]["id"], pool["id"], "x", "y", "z")] == ["A", "T", "pool:p1", "S", "C", "(none)"]
    assert [got[i].category for i in (rows[0]["id"], rows[1]["id"], pool["id"], "x", "y", "z", "w")] == ["Account balances & settings", "Sponsorship", "Liquidity pools", "DEX offers & trades", "Other", "Account balances & settings", "Other"]
    assert (got[rows[0]["id"]].asset, got[rows[1]["id"]].asset, got["x"].asset, got["y"].type, got["w"].amount, got["x"].ledger, got[pool["id"]].ledger) == ("native", "USD", None, "unknown", D(4), None, 3)


def test_effects_of_a_ledger(spark):
    i = lambda ledger, tx, op, e: f"{(ledger << 32) + (tx << 12) + op:019d}-{e:010d}"
    rows = [(i(3, 1, 1, 1), 3, "account_credited", "A"), (i(3, 1, 1, 2), 3, "account_debited", "B"), (i(3, 1, 2, 1), 3, "trade", "A"), (i(3, 2, 1, 1), 3, "data_created", "B"), (i(4, 1, 1, 1), 4, "trade", "A")]
    by = A.ledger_effects_summary(N.index_effects(spark.createDataFrame(rows, "id string, ledger long, type string, account string")))
    three = one(by.where("ledger = 3"))
    assert (three.effects, three.operations, three.transactions, three.accounts, three.types) == (4, 3, 2, 2, 4)
    # the same order in two ledgers is two transactions
    total = one(A.effects_overview(by))
    assert (total.ledgers, total.effects, total.transactions) == (2, 5, 3)
    assert one(A.effects_overview(by.limit(0))).effects == 0


def test_native_balance_changes(spark):
    rows = [("1", "account_credited", "native", "5.5", None), ("2", "account_debited", None, "2", None), ("3", "account_created", None, None, "100"), ("4", "account_credited", "credit_alphanum4", "9", None)]
    df = spark.createDataFrame(rows, "id string, type string, asset_type string, amount string, starting_balance string").withColumns({c: F.col(c).cast("decimal(19,7)") for c in ("amount", "starting_balance")})
    assert {r.id: r.delta for r in X.native_balance_effects(df).collect()} == {"1": D("5.5"), "2": D(-2), "3": D(100)}


def test_offers_and_pools(spark):
    usd, native = ("credit_alphanum4", "USD", "I"), ("native", None, None)
    rows = [
        {"id": "1", "seller": "A", "selling": native, "buying": usd, "amount": "10", "price_r": ("1", "4"), "price": "9"},
        {"id": "2", "seller": "A", "selling": native, "buying": usd, "amount": "110", "price": "0.25"},
        {"id": "3", "seller": "B", "selling": usd, "buying": native, "amount": "50", "price_r": ("2", "1")},
    ]
    o = N.normalize_offers(raw(spark, "offers", *rows))
    assert {r.id: r.buying_amount for r in o.collect()} == {"1": 2.5, "2": 27.5, "3": 100.0}
    s = one(A.offer_book_summary(o))
    assert (s.offers, s.sellers, s.pairs) == (3, 2, 2)
    assert {(r.side, r.asset): r.total for r in A.offer_totals(o).collect()} == {("selling", "native"): D(120), ("selling", "USD:I"): D(50), ("buying", "USD:I"): D(30), ("buying", "native"): D(100)}
    top = one(A.best_prices(o).where("base = 'native'"))
    assert (top.best_ask, top.best_bid, top.spread) == (0.25, 0.5, -0.25)
    r = N.normalize_pools(raw(spark, "liquidity_pools", {"id": "p", "fee_bp": 30, "type": "constant_product", "total_trustlines": 8, "total_shares": "10", "reserves": [("native", "100"), ("USD:I:x", None)]}, {"id": "q", "total_trustlines": 12, "reserves": [("odd", "1"), ("", "2")]}, {"id": "none"}))
    s = one(A.pool_summary(r))
    assert (s.pools, s.reserve_entries, s.participants) == (3, 4, 20)
    assert {x.type: x.pools for x in A.pool_summary(r, ("type",)).collect()} == {"constant_product": 1, "Unknown": 2}
    assert [(x.kind, x.code, x.issuer, x.amount) for x in r.where("place is not null").orderBy("id", "place").collect()] == [("native", "XLM", None, D(100)), ("issued", "USD", "I:x", D(0)), ("unknown", "odd", None, D(1)), ("unknown", "Unknown", None, D(2))]
    bounds = one(A.price_bounds(spark.createDataFrame([(1.5,)], "spot double"), 200))
    assert (bounds.min_price, bounds.max_price) == (1.47, 1.53)
    holders = raw(spark, "accounts", {"id": "h", "balances": [("liquidity_pool_shares", None, None, "2.5", None, None, None, None, None, "p")]}, {"id": "none"})
    assert {x.asset: x.amount for x in A.pool_positions(r, holders).collect()} == {"native": 25.0, "USD:I:x": 0.0}


def test_assets(spark):
    rows = [{"asset_code": "USD", "asset_issuer": "I", "accounts": (5, 2, None), "num_accounts": 99}, {"asset_code": "USD", "asset_issuer": "J", "num_accounts": 4, "flags": (True, None, None, None)}, {}]
    n = N.normalize_assets(raw(spark, "assets", *rows))
    got = {r.asset: r for r in n.collect()}
    assert (got["USD:I"].holders, got["USD:J"].holders, got["USD:J"].authorized, got["Unknown:Unknown"].holders) == (7, 4, 4, 0)
    assert (got["USD:J"].auth_required, got["USD:J"].auth_revocable, got["USD:I"].auth_required, got["USD:I"].claimable_amount) == (True, False, False, D(0))
    assert one(A.ambiguous_codes(n)).asset_code == "USD"
    lines = spark.createDataFrame([("a", "USD", "I", D(5), True, False), ("b", "USD", "I", D(3), False, True)], "account string, asset_code string, asset_issuer string, balance decimal(19,7), is_authorized boolean, is_authorized_to_maintain_liabilities boolean")
    claims = spark.createDataFrame([("USD:I", D(2)), ("native", D(8))], "asset string, amount decimal(19,7)")
    s = one(A.asset_stats(lines, claims, N.normalize_pools(raw(spark, "liquidity_pools", {"id": "p", "reserves": [("USD:I", "4"), ("native", "1")]}))))
    assert (s.supply, s.authorized_count, s.maintain_amount, s.claimable_count, s.pool_amount) == (D(14), 1, D(3), 1, D(4))


def test_contract_events(spark):
    contract = contract_key(7)
    name = lambda x, kind="scvSymbol": [(kind, x), ("scvU32", "1")]
    rows = [
        {"id": "1", "ledger": 100, "tx_hash": "a", "contract_id": contract, "topic": name("transfer")}, {"id": "2", "ledger": 300, "tx_hash": "a", "contract_id": "CBAD", "topic": name("transfer"), "in_successful_contract_call": False},
        {"id": "3", "ledger": 200, "tx_hash": "b", "contract_id": contract, "topic": name("mint")}, {"id": "4", "topic": name("text", "scvString")}, {"id": "5"},
    ]
    e = N.normalize_contract_events(raw(spark, "contract_events", *rows))
    assert {r.id: (r.contract_id, r.name, r.successful) for r in e.collect()} == {"1": (contract, "transfer", True), "2": ("", "transfer", False), "3": (contract, "mint", True), "4": ("", "(unnamed)", True), "5": ("", "(unnamed)", True)}
    s = one(A.contract_event_totals(e))
    assert (s.events, s.contracts, s.transactions, s.failed, s.first_ledger, s.last_ledger) == (5, 1, 2, 1, 100, 300)
    assert {r.value: r.n for r in A.contract_event_summary(e).where("grouped_by = 'name'").collect()} == {"transfer": 2, "mint": 1, "(unnamed)": 2}
    assert one(A.most_active(e, "contract_id", 1, "id")).n == 2


def test_values(spark):
    big = str(2**127)
    nested = '[{"type":"scvMap","value":[{"key":{"type":"scvSymbol","value":"a\\"b"},"val":{"type":"scvVec","value":[]}}]},{"type":"scvVoid"}]'
    cases = [
        (("scvU32", "7"), "7"), (("scvI128", big), f'"{big}"'), (("scvBytes", "AQID"), '"0x010203"'), (("scvString", 'q"\n'), '"q\\"\\n"'), (("scvBool", "true"), "true"), (None, "null"), (("scvVec", nested), '[{"a\\"b":[]},null]'),
        (("scvU32", "x"), None), (("scvBytes", "?"), None), (("scvVec", "["), None), (("scvVec", '[{"type":"scvError","value":"1"}]'), None), (("scvError", "1"), None),
    ]
    got = {r.id: r for r in N.decode_event_values(raw(spark, "contract_events", *[{"id": str(i), "value": v} for i, (v, _) in enumerate(cases)])).collect()}
    assert [got[str(i)].value for i in range(len(cases))] == [want for _, want in cases]
    assert all((got[str(i)].error is None) == got[str(i)].decoded == (want is not None) for i, (_, want) in enumerate(cases))
    assert got["11"].error == "unsupported type scvError" and got["7"].error == "not a value of type scvU32"


def test_values_of_any_depth(spark):
    deep = '[{"type":"scvVec","value":' * 40 + '[{"type":"scvMap","value":[{"key":{"type":"scvU32","value":"1"},"val":{"type":"scvBool","value":"true"}},{"key":{"type":"scvSymbol","value":"k"},"val":{"type":"scvVoid"}}]}]' + "}]" * 40
    rows = [{"id": "1", "value": ("scvVec", deep)}, {"id": "2", "value": ("scvVec", deep.replace("scvBool", "scvError"))}, {"id": "3", "value": ("scvMap", "[]")}, {"id": "4", "value": ("scvMap", "[1]")}, {"id": "5", "value": ("scvU32", "5")}]
    df = N.decode_event_values(raw(spark, "contract_events", *rows))
    assert {r.id: r.value for r in df.collect()} == {"1": "[" * 41 + '{"1":true,"k":null}' + "]" * 41, "2": None, "3": "{}", "4": None, "5": "5"}
    assert df._jdf.queryExecution().executedPlan().toString().count("Join") < 4  # whatever the depth


def test_topics(spark):
    rows = [{"id": "1", "topic": [("scvSymbol", "transfer"), ("scvAddress", "G1"), ("scvVec", '[{"type":"scvU64","value":"9"}]'), ("scvError", "1"), (None, None)]}, {"id": "2"}, {"id": "3", "topic": []}]
    got = sorted((r.id, r.place, r.value, r.decoded) for r in N.decode_event_topics(raw(spark, "contract_events", *rows)).collect())
    assert got == [("1", 0, '"transfer"', True), ("1", 1, '"G1"', True), ("1", 2, '["9"]', True), ("1", 3, None, False), ("1", 4, "null", True)]


def test_transactions(spark):
    rows = [
        {"hash": "a", "successful": True, "ledger_attr": 9, "memo_type": "none", "memo": "x", "fee_charged": "100"}, {"hash": "b", "successful": False, "ledger": 8, "memo_type": "text", "memo": "hi", "result_codes": ("txFailed", ["op_success", "opUnderfunded", "op_success"])},
        {"hash": "c", "result_code": "txBadSeq", "memo_type": "text", "memo": ""}, {"hash": "d", "successful": False, "result_codes": (None, ["op_success"])},
    ]
    t = N.normalize_transactions(raw(spark, "transactions", *rows))
    got = {r.hash: r for r in t.collect()}
    assert [(got[h].ledger, got[h].memo, got[h].result_code) for h in "abcd"] == [(9, None, "tx_success"), (8, "hi", "tx_failed"), (None, None, "tx_bad_seq"), (None, None, "tx_failed")]
    assert {r.hash: (r.failing_index, r.failing_code) for r in A.failing_operations(t).collect()} == {"b": (1, "op_underfunded"), "c": (None, None), "d": (None, None)}
    assert {r.code: r.n for r in A.operation_code_counts(t).collect()} == {"op_success": 3, "op_underfunded": 1}
    told = {r.hash: r.explanation for r in J.explain_codes(t).collect()}
    assert told["c"] == J.EXPLANATIONS["tx_bad_seq"] and told["a"] == J.FALLBACK
    assert len(J.EXPLANATIONS) == 18 and len(J.EFFECTS) == 36


def test_time_bounds(spark):
    rows = [("at the end", 0, 100), ("over", 0, 99), ("never", 0, 0), ("crossed", 50, 50), ("negative", -1, 0), ("soon", 101, 200), ("none", None, None)]
    df = X.classify_time_bounds(spark.createDataFrame(rows, "hash string, min_time long, max_time long"), 100)
    got = {r.hash: (r.bounds, r.opens_in, r.closes_in) for r in df.collect()}
    assert got == {"at the end": ("valid", None, 0), "over": ("expired", None, None), "never": ("open_ended", None, None), "crossed": ("invalid", None, None), "negative": ("invalid", None, None), "soon": ("not_yet_valid", 1, 100), "none": ("open_ended", None, None)}


def test_fees(spark):
    def stats(fees, base):
        t = spark.createDataFrame([(1, f) for f in fees], "ledger long, fee_charged long")
        return A.fee_stats(t, spark.createDataFrame([(1, base, 30, 100)] if base else [], "sequence long, base_fee long, operation_count long, max_tx_set_size int"))

    s = one(stats([150] * 6 + [200] * 4, 100))
    assert (s.p50, s.p90, s.recommended, s.base_fee, s.capacity_usage, s.mode_fee) == (150, 200, 200, 100, 0.3, 150)
    assert one(stats([50], None)).recommended == 100
    e = {r.operations: (r.low, r.recommended, r.high) for r in A.fee_estimates(stats([50, 50, 300], 100), (1, 3)).collect()}
    assert e == {1: (100, 300, 300), 3: (300, 900, 900)}
    with pytest.raises(ValueError):
        A.fee_estimates(stats([50], 100), (0,))


def test_accounts(spark):
    rows = [
        {"id": "a", "thresholds": (1, 2, 3), "signers": [("a", 3), ("b", 1)], "flags": (True, True, None, True), "balances": [("credit_alphanum4", "USD", "I", "5", "10", "1", None, True, None, None), ("native", None, None, "7.5", None, None, None, None, None, None)]},
        {"id": "b", "signers": [("a", 2)], "flags": (None, None, True, True)}, {"id": "c", "signers": []}, {"id": "d"},
    ]
    n = N.normalize_accounts(raw(spark, "accounts", *rows))
    got = {r.id: r for r in n.collect()}
    assert (got["a"].native_balance, got["a"].primary_weight, got["a"].total_weight, got["b"].primary_weight, got["d"].total_weight) == (D("7.5"), 3, 4, 0, 0)
    power = A.signing_power(n)
    p = {r.id: r for r in power.collect()}
    assert (p["a"].master_low, p["a"].master_high, p["b"].master_low, p["b"].all_low, p["c"].locked) == (True, True, False, True, True)
    assert {r.level: (r.master, r["all"]) for r in A.signing_counts(power).collect()} == {"low": (1, 2), "med": (1, 2), "high": (1, 2)}
    audit = {r.id: r for r in A.flag_audit(n).collect()}
    assert (audit["a"].mask, audit["a"].findings, audit["a"].defaults) == (11, ["gated_and_freezable", "clawback"], False)
    assert (audit["b"].findings, audit["b"].locked) == (["immutable", "clawback", "clawback_without_revocable", "master_disabled", "locked_issuer"], False)
    assert (audit["c"].findings, audit["c"].defaults, audit["d"].locked) == (["locked"], True, True)
    line = one(N.normalize_trustlines(raw(spark, "accounts", *rows)))
    assert (line.asset_code, line.balance, line.is_authorized, line.is_authorized_to_maintain_liabilities) == ("USD", D(5), True, False)


def test_trustlines_asked_for(spark):
    lines = spark.createDataFrame([("a", "USD", "I", True, True), ("b", "USD", "I", False, True), ("c", "USD", "I", False, False)], "account string, asset_code string, asset_issuer string, is_authorized boolean, is_authorized_to_maintain_liabilities boolean")
    asked = spark.createDataFrame([(x, "USD", i) for x, i in (("a", "I"), ("b", "I"), ("c", "I"), ("a", "J"))], "account string, asset_code string, asset_issuer string")
    issuers = spark.createDataFrame([("I", True, False, False)], "id string, auth_required boolean, auth_revocable boolean, auth_clawback_enabled boolean")
    got = {(r.account, r.asset_issuer): (r.state, r.auth_required) for r in J.trustline_state(asked, lines, issuers).collect()}
    assert got == {("a", "I"): ("AUTHORIZED", True), ("b", "I"): ("MAINTAIN_LIABILITIES", True), ("c", "I"): ("UNAUTHORIZED", True), ("a", "J"): ("NOT_FOUND", None)}


def test_claim_predicates(spark):
    cases = [
        ('{"unconditional":true}', "unconditional", True), ('{"before_relative_time":"3600"}', "before_relative_time(3600)", True), ('{"not":{"unconditional":true}}', "not(unconditional)", False), ('{"before_absolute_time":"10"}', "before_absolute_time(10)", False),
        ('{"and":[{"before_relative_time":"60"},{"or":[{"not":{"before_absolute_time":"10"}},{"unconditional":true}]}]}', "and(before_relative_time(60), or(not(before_absolute_time(10)), unconditional))", False),
        ("{}", "unknown", None), ("no json", "unknown", None), (None, "unknown", None), ('{"not":{"not":{"not":{"not":{"unconditional":true}}}}}', "not(not(not(not(unconditional))))", True),
        ('{"and":[]}', "and()", True), ('{"or":[]}', "or()", False), ('{"not":5}', "not(unknown)", None), ('{"or":[{"unconditional":true},{"odd":1}]}', "or(unconditional, unknown)", True), ('{"and":[{"odd":1},{"unconditional":true}]}', "and(unknown, unconditional)", None),
        ('{"not":' * 41 + '{"and":[{"unconditional":true}]}' + "}" * 41, "not(" * 41 + "and(unconditional)" + ")" * 41, False),
    ]
    df = raw(spark, "claimable_balances", *[{"id": str(i), "claimants": [("d", p)], "last_modified_ledger": 1000} for i, (p, _, _) in enumerate(cases)])
    got = {r.id: (r.predicate, r.claimable) for r in A.claimable_at(df, 1100, "last_modified_ledger").collect()}
    assert [got[str(i)] for i in range(len(cases))] == [(text, ok) for _, text, ok in cases]


def test_claims_change_where_relative_bounds_run_out(spark):
    two = '{"and":[{"before_relative_time":"100"},{"not":{"before_relative_time": "40"}}]}'
    odd = '{"before\\u005frelative_time":"100"}'
    rows = [{"id": f"{p}{made}", "claimants": [(p, text)], "last_modified_ledger": made} for p, text in (("two", two), ("odd", odd), ("big", '{"before_relative_time":"9223372036854775807"}')) for made in (None, 0, 899, 900, 901, 959, 960, 961, 2000)]
    got = {r.id: r.claimable for r in A.claimable_at(raw(spark, "claimable_balances", *rows), 1000, "last_modified_ledger").collect()}
    for made in (0, 899, 900, 901, 959, 960, 961, 2000):
        assert got[f"two{made}"] == (1000 < made + 100 and not 1000 < made + 40) and got[f"odd{made}"] == (1000 < made + 100)
    assert got["twoNone"] is None and got["oddNone"] is None and got["big0"] is True and got["big900"] is None and got["bigNone"] is None


def test_invocations(spark):
    tree = '{"contract":"A","function":"f","args":1,"sub":[{"contract":"B","function":"g","args":0,"sub":[]},{"contract":"C","function":"h","args":2}]}'
    auth = spark.createDataFrame([("1", tree)], "id string, t string").select("id", F.parse_json("t").alias("invocation"))
    assert sorted((r.depth, r.contract, r.root) for r in A.flatten_invocations(auth).collect()) == [(0, "A", "A"), (1, "B", "A"), (1, "C", "A")]
    deep = '{"contract":"A","sub":[' * 40 + '{"contract":"Z"}' + "]}" * 40
    calls = A.flatten_invocations(spark.createDataFrame([("1", deep), ("2", tree), ("3", None)], "id string, t string").select("id", F.parse_json("t").alias("invocation")))
    assert {(r.id, r.depth, r.contract) for r in calls.where("id <> '2'").collect()} == {("1", d, "A") for d in range(40)} | {("1", 40, "Z"), ("3", 0, None)}
    assert "Union" not in calls._jdf.queryExecution().executedPlan().toString()
    results = lambda *s: one(A.invocation_summary(spark.createDataFrame([(x,) for x in s], "status string")))
    assert (results().total, results("success", "success").succeeded, results("success", None).failed) == (0, 2, 1)


def test_support_matrix(spark):
    p = raw(spark, "payments", {"id": "1", "from": "A", "to": "B", "ledger": 3, "transaction_hash": "h", "transaction_successful": True}, {"id": "2", "from": "B", "to": "C", "ledger": 4, "transaction_successful": False}, {"id": "3", "from": "C", "to": "C", "transaction_successful": True})
    ids = lambda df: sorted(r.id for r in df.collect())
    watch = spark.createDataFrame([("A",), ("B",)], "id string")
    assert ids(X.filter_resource(p, "payments", account=watch)) == ["1"] and ids(X.filter_resource(p, "payments", account="C")) == ["3"]
    assert ids(X.filter_resource(p, "payments", ledger=3, transaction="h")) == ["1"]
    ops = raw(spark, "operations", {"id": "1", "source_account": "A", "transaction_successful": False})
    assert ids(X.filter_resource(ops, "operations", account="A")) == [] and ids(X.filter_resource(ops, "operations", include_failed=True, account="A")) == ["1"]
    for resource, criteria in (("payments", {"operation": 1}), ("trades", {"account": "A"}), ("transactions", {"transaction": "h"}), ("effects", {"include_failed": True}), ("payments", {"liquidity_pool": "p"})):
        with pytest.raises(ValueError):
            X.filter_resource(p, resource, **criteria)


def test_ledger_ranges():
    assert X.ledger_range(20_000) == (2_720, 20_000) and X.ledger_range(100) == (1, 100) and X.ledger_range(0) == (1, 1)
    assert X.ledger_range(100, 5, 50) == (5, 50) and X.ledger_range(100, 80, 50) == (50, 50) and X.ledger_range(100, -3, 1000) == (1, 100)


def test_created_balances(spark):
    i = lambda tx, e: f"{tx << 12:019d}-{e:010d}"
    rows = [(i(1, 1), "trade", None), (i(1, 2), "claimable_balance_created", "B1"), (i(1, 3), "claimable_balance_created", "B2"), (i(2, 1), "trade", None), ("odd", "claimable_balance_created", "B3")]
    assert {r.tx: r.balance_id for r in J.created_balance_ids(spark.createDataFrame(rows, "id string, type string, balance_id string")).collect()} == {1: "B1", 2: None}


def test_chain_and_drift(spark):
    ledgers = spark.createDataFrame([(1, "a", None, 5), (2, "b", "a", 11), (3, "c", "x", 15), (5, "e", "d", 30)], "sequence long, hash string, prev_hash string, closed_at long")
    assert {r.sequence: (r.problem, r.interval) for r in J.ledger_chain(ledgers).collect()} == {1: ("gap", None), 2: (None, 6), 3: ("hash", 4), 5: ("gap", None)}
    a = spark.createDataFrame([("a", "x", 1, 2, None, 4)], "id string, home_domain string, low_threshold int, med_threshold int, high_threshold int, primary_weight int")
    want = spark.createDataFrame([("x", 1, 3, None, 5)], "home_domain string, low_threshold int, med_threshold int, high_threshold int, primary_weight int")
    assert sorted((r.setting, r.actual, r.expected) for r in J.config_drift(a, want, "home_domain").collect()) == [("med_threshold", 2, 3), ("primary_weight", 4, 5)]


def test_strict_paths(spark):
    edges = spark.createDataFrame([("A", "B", 2.0), ("B", "C", 5.0), ("A", "C", 4.0)], "src string, dst string, rate double")
    asked = spark.createDataFrame([("A", "C", D(25), D(3)), ("A", "B", D(25), D(3)), ("C", "A", D(1), D(1))], "src string, target string, receive decimal(19,7), send_max decimal(19,7)")
    assert {(r.src, r.target): (r.spend, r.within) for r in J.strict_receive(edges, asked).collect()} == {("A", "C"): (2.5, True), ("A", "B"): (12.5, False), ("C", "A"): (None, False)}
    sent = J.strict_send(edges, asked.select("src", "target", F.lit(3).cast("decimal(19,7)").alias("send")))
    assert {(r.src, r.target): r.received for r in sent.collect()} == {("A", "C"): 30.0, ("A", "B"): 6.0, ("C", "A"): None}


def test_four_hops_leave_no_asset_twice(spark):
    edges = [("A", "B", 2), ("B", "C", 2), ("C", "B", 2), ("C", "D", 2), ("D", "E", 2), ("B", "D", 3), ("A", "D", 1)]
    df = spark.createDataFrame(edges, "src string, dst string, rate long")
    got = {r.hops: r.rate for h in (1, 2, 3, 4) for r in J.quote_paths(df, spark.createDataFrame([("A", "E")], "src string, target string"), h).withColumn("hops", F.lit(h)).collect()}
    assert got == {2: 2, 3: 12, 4: 16}


def test_triage(spark):
    log = spark.createDataFrame([("Missing required AUTH",), ("authentic",), ("TTL expired",), (None,)], "message string")
    assert {r["class"]: r.n for r in A.triage_errors(log, A.RULE_SETS["preflight"]).collect()} == {"authorization": 1, "expired": 1, "unknown": 2}
    assert {r["class"]: r.n for r in A.triage_errors(log, A.RULE_SETS["multi_contract"]).collect()} == {"authorization": 2, "expired": 1, "unknown": 1}


def test_storage_reports(spark):
    entries = raw(spark, "storage_entries", *[{"contract_id": c, "key": "k", "durability": "persistent", "live_until_ledger": x} for c, x in (("at", 100), ("past", 99), ("none", None), ("restore", 500))])
    sims = raw(spark, "simulations", {"contract_id": "restore", "status": "restore"}, {"contract_id": "at", "status": "success"})
    assert {r.contract_id: r.state for r in A.archive_status(entries, sims, 100).collect()} == {"at": "accessible", "past": "archived", "none": "unknown", "restore": "archived"}
    two = raw(spark, "storage_entries", *[{"contract_id": "c", "key": k, "durability": "persistent", "live_until_ledger": 500} for k in "ab"], {"contract_id": "c", "key": "a", "durability": "temporary", "live_until_ledger": 500})
    named = raw(spark, "simulations", {"contract_id": "c", "status": "restore", "read_write": [("contract_data", "c", "a", "persistent"), None]}, {"contract_id": "d", "status": "restore", "read_only": []})
    assert {r.state: r.n for r in A.archive_status(two, named, 100).collect()} == {"archived": 1, "accessible": 2}
    assert {r.contract_id: (r.state, r.least_seconds) for r in A.ttl_report(entries.where("contract_id <> 'none'"), 100).collect()} == {"at": ("expired", 0), "past": ("expired", 0), "restore": ("expiring", 2000)}
    profile = one(A.simulation_profile(raw(spark, "simulations", {"contract_id": "c", "status": "success", "instructions": 123456, "read_bytes": 2048, "write_bytes": 512, "read_only": [None, None], "read_write": [None], "min_resource_fee": "7"}, {"contract_id": "c"})))
    assert (profile.instructions, profile.read_bytes, profile.write_bytes, profile.read_only_keys, profile.read_write_keys, profile.fee_p50) == (123456, 2048, 512, 2, 1, 7)


def test_reports_on_references(spark):
    refs = spark.createDataFrame([("native", "USD:I"), ("", "USD"), (None, "US$:I:J")], "a string, b string")
    assert {(r.name, r.reason): r.n for r in Q.audit_asset_refs(refs, ["a", "b"]).collect()} == {("a", "ok"): 1, ("a", "empty"): 2, ("b", "ok"): 1, ("b", "no_issuer"): 1, ("b", "malformed"): 1}
    t = raw(spark, "trades", {"id": "1-1", "price": ("1", "2"), "base_amount": "2", "counter_amount": "1"}, {"id": "x", "price": ("1", "2"), "base_amount": "2", "counter_amount": "3"}, {"id": "", "base_amount": "0"}, {"id": "99999999999999999999-1"})
    assert {(r.source): (r.n, r.disagree) for r in Q.price_source_report(t, raw(spark, "offers")).collect()} == {"rational": (2, 1), "none": (2, 0)}
    assert {r.pattern: r.n for r in Q.id_report({"trades": t}).collect()} == {"decodes": 1, "malformed": 2, "empty": 1}
    assert Q.asset_dimension({"a": (refs, "a")}).count() == 1
    pair = spark.createDataFrame([("X", "Y", 1), ("Y", "", 2), ("Z", "Z", 3)], "sold string, bought string, ledger long")
    assert {r.asset: (r.uses, r.t_uses, r.first_ledger) for r in Q.asset_dimension({"t": (pair, "sold", "bought")}).collect()} == {"X": (1, 1, 1), "Y": (2, 2, 1), "Z": (2, 2, 3)}


def test_sequences(spark):
    rows = [("a", 1, 5), ("a", 2, 6), ("a", 3, 6), ("a", 4, 9), ("a", 5, 2)]
    got = W.sequence_gaps(spark.createDataFrame(rows, "who string, at int, number long"), ["at"], "who", "number").collect()
    assert sorted((r.at, r.step, r.kind) for r in got) == [(3, 0, "repeat"), (4, 3, "gap"), (5, -7, "regression")]


def test_summaries_are_replaced_by_partition(spark, tmp_path):
    path = f"{tmp_path}/summary"
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], "bucket long, k string, n long")
    for rows in (df, df, df.where("bucket = 2").withColumn("n", F.lit(7).cast("long"))):
        S.write_summary(rows, path, ["bucket"])
    assert sorted((r.bucket, r.n) for r in spark.read.parquet(path).collect()) == [(1, 5), (2, 7)]


def test_ranges_are_read_from_their_buckets(spark, tmp_path):
    path = f"{tmp_path}/events"
    S.store_by_ledger(raw(spark, "contract_events", *[{"id": str(i), "ledger": i * 60_000, "type": "contract"} for i in range(1, 9)]), path)
    df = S.read_stored_events(spark, path, 110_000, 250_000, ["contract"])
    assert sorted(r.id for r in df.collect()) == ["2", "3", "4"] and df.columns == raw(spark, "contract_events").columns
    assert "PartitionFilters: [isnotnull(bucket" in df._jdf.queryExecution().executedPlan().toString()


def test_a_shared_folder_is_asked_for_on_clusters(monkeypatch):
    class Conf(dict):
        pass

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: Conf())

    class Session:
        conf, sparkContext = Conf(), Context

    with pytest.raises(ValueError):
        S.shared_folder(Session, "x")


def test_bounded_streams(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for i in range(12):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    seen = one(R.observe_counts(stream, F.col("id") % 2 == 0, spark))
    assert (seen.received, seen.passed) == (120, 60)
    assert R.run_bounded(stream, spark).count() == 120
    some = R.run_bounded(stream, spark, events=5).count()
    assert 5 <= some <= 120 and some % 10 == 0


def stored(spark, tmp_path, name, *records):
    """Records of a declared table, as read from its files."""
    raw(spark, name, *records).write.parquet(f"{tmp_path}/{name}")
    return S.read_table(spark, str(tmp_path), name)


def test_criteria_on_declared_tables(spark, tmp_path):
    tx = lambda ledger, order: ledger << 32 | order << 12
    ops = [{"id": str(n), "paging_token": str(n), "transaction_hash": h, "transaction_successful": True, "source_account": a} for n, h, a in ((tx(2, 1) + 1, "h1", "A"), (tx(2, 1) + 2, "h1", "B"), (tx(2, 2) + 1, "h2", "A"), (tx(3, 1) + 1, "h3", "C"), (7, "h0", "C"))]
    pays = [{**o, "id": "" if i == 1 else o["id"], "ledger": 2 if i == 0 else None} for i, o in enumerate(ops)]
    txs = [{"hash": h, "successful": h != "h2", "ledger_attr": a, "ledger": b} for h, a, b in (("h1", 2, None), ("h2", None, 2), ("h3", 3, 2), ("h0", 0, None))]
    fx = [{"id": f"{n:019d}-{i:010d}", "balance_id": b, "liquidity_pool": (p,) if p else None} for n, i, b, p in ((tx(2, 1) + 1, 1, "B1", None), (tx(2, 1) + 1, 2, None, "P1"), (tx(2, 2) + 1, 1, None, "P1"), (tx(3, 1) + 1, 1, "B1", None))] + [{"id": "odd", "balance_id": "B1"}]
    sold = {"base_asset_type": "native", "counter_asset_type": "credit_alphanum4", "counter_asset_code": "USD"}
    trades = [{**sold, "id": "1", "counter_asset_issuer": "I"}, {**sold, "id": "2", "counter_asset_issuer": "J"}, {"id": "3", "base_asset_type": "credit_alphanum4", "base_asset_code": "USD", "base_asset_issuer": "I", "counter_asset_type": "native"}]
    tables = {n: stored(spark, tmp_path, n, *rows) for n, rows in (("operations", ops), ("payments", pays), ("transactions", txs), ("effects", fx), ("trades", trades))}
    key = {"transactions": "hash", "payments": "paging_token"}

    def found(resource, **criteria):
        df = X.filter_resource(tables[resource], resource, operations=tables["operations"], effects=tables["effects"], **criteria)
        assert df.columns == tables[resource].columns
        return sorted(r[key.get(resource, "id")] for r in df.collect())

    watch = lambda *values: spark.createDataFrame([(v,) for v in values], f"x {'string' if isinstance(values[0], str) else 'long'}")
    o, e = [r["id"] for r in ops], [r["id"] for r in fx]
    for ledger in (2, watch(2)):
        assert found("operations", ledger=ledger) == found("payments", ledger=ledger) == sorted(o[:3])
        assert found("effects", ledger=ledger) == e[:3] and found("transactions", ledger=ledger) == ["h1"]
    assert found("transactions", ledger=2, include_failed=True) == ["h1", "h2"] and found("operations", ledger=0) == ["7"]
    for h in ("h1", watch("h1")):
        assert found("operations", transaction=h) == found("payments", transaction=h) == o[:2] and found("effects", transaction=h) == e[:2]
    assert found("effects", transaction="nowhere") == []
    for n in (tx(2, 1) + 1, watch(tx(2, 1) + 1)):
        assert found("effects", operation=n) == e[:2]
    for p in ("P1", watch("P1", "P2")):
        assert found("effects", liquidity_pool=p) == [e[1], e[2]] and found("operations", liquidity_pool=p) == sorted([o[0], o[2]]) and found("transactions", liquidity_pool=p) == ["h1"]
    for b in ("B1", watch("B1")):
        assert found("effects", claimable_balance=b) == sorted([e[0], e[3], "odd"])
        assert found("operations", claimable_balance=b) == found("payments", claimable_balance=b) == sorted([o[0], o[3]]) and found("transactions", claimable_balance=b) == ["h1", "h3"]
    assert found("trades", asset_pair=("native", "USD:I")) == found("trades", asset_pair=("USD:I", "native")) == ["1", "3"]
    assert found("operations", account="A", ledger=2) == sorted([o[0], o[2]])
    with pytest.raises(ValueError, match="effects"):
        X.filter_resource(tables["operations"], "operations", liquidity_pool="P1")


def test_numbers_reach_the_scan(spark, tmp_path):
    n = 50_000_000 << 32 | 3 << 12
    effects = stored(spark, tmp_path, "effects", {"id": f"{n + 1:019d}-0000000001", "liquidity_pool": ("P",)})
    operations = stored(spark, tmp_path, "operations", {"id": str(n + 1), "transaction_hash": "h", "transaction_successful": True})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    pushed = lambda df: next(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in x).split("PushedFilters")[1]
    for df, low in (
        (X.filter_resource(effects, "effects", ledger=50_000_000), f"GreaterThanOrEqual(id,{50_000_000 << 32:019d}-)"),
        (X.filter_resource(operations, "operations", ledger=50_000_000), f"GreaterThanOrEqual(id,{50_000_000 << 32})"),
        (X.filter_resource(effects, "effects", operation=n + 1), f"LessThan(id,{n + 1:019d}.)"),
        (X.filter_resource(effects, "effects", operations=operations, transaction="h"), f"GreaterThanOrEqual(id,{n:019d}-)"),
        (X.filter_resource(effects, "effects", liquidity_pool="P"), "EqualTo(liquidity_pool.id,P)"),
    ):
        assert low in pushed(df) and df.count() == 1


def test_contract_ids_by_checksum(spark):
    good = [contract_key(n) for n in range(40)]
    account = "G" + good[0][1:]
    bad = ["", None, "CNOTAREALCONTRACT", account, good[0][:-1], good[0] + "A", good[0].lower(), " " + good[0], *(g[:i] + ("B" if g[i] != "B" else "A") + g[i + 1 :] for g in good[:3] for i in range(1, 56))]
    df = raw(spark, "contract_events", *[{"id": str(i), "contract_id": c} for i, c in enumerate([*good, *bad])])
    out = N.normalize_contract_events(df)
    assert sorted(r.contract_id for r in out.collect()) == [""] * len(bad) + sorted(good)
    assert one(X.audit_identifiers(df, X.identifier_rules(contract="contract_id"))).violations == len(bad)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_one_busy_account_spreads_over_tasks(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, rnd.randrange(0, 400_000), rnd.choice(["busy"] * 9 + ["quiet"]), D(rnd.randrange(-50, 50)), rnd.choice([1, 2, 5, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, ledger long, account string, delta decimal(38,7), seq long")
    accounts = spark.createDataFrame([("busy", D(1000)), ("quiet", D(5))], "id string, balance decimal(19,7)")
    got = W.balance_history(df, accounts)
    want, last, order = {}, {}, sorted(rows, key=lambda r: (r[1], r[0]))
    for name, balance in (("busy", 1000), ("quiet", 5)):
        mine = [r for r in order if r[2] == name]
        now = balance - sum(r[3] for r in mine)
        for r in mine:
            now += r[3]
            want[r[0]] = now
    assert {r.event_id: r.running for r in got.collect()} == want
    gaps = {}
    for i, ledger, account, _, seq in order:
        before = last.get(account, "none")
        if seq is not None and before not in ("none", None) and seq - before != 1:
            gaps[i] = seq - before
        last[account] = seq
    assert {r.event_id: r.step for r in W.sequence_gaps(df, ["ledger", "event_id"], "account", "seq").collect()} == gaps
    polls = df.select(F.col("account").alias("transaction_id"), F.col("ledger").alias("polled_at"), F.col("event_id").alias("poll"), F.coalesce(F.col("seq"), F.lit(0)).cast("string").alias("status"))
    changes, now = [], {}
    for i, at, account, _, seq in order:
        if now.get(account) != str(seq or 0):
            changes.append((account, i, at))
        now[account] = str(seq or 0)
    ahead = {i: next((u - at for b, j, u in changes[n + 1 :] if b == a), None) for n, (a, i, at) in enumerate(changes)}
    assert {r.poll: r.seconds for r in W.status_transitions(polls, 20_000).collect()} == ahead
    # stretches of the busy account meet in different tasks
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = max(r["count"] for r in W.balance_history(df, accounts).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 1500


def test_kids_of_a_tree_are_not_broadcast(spark):
    """Stored kids are small as files and large as rows, so their size must not send them through the driver."""
    made = raw(spark, "claimable_balances", {"id": "B1", "claimants": [("G1", '{"and":[{"before_absolute_time":"900"},{"not":{"unconditional":false}}]}')], "last_modified_ledger": 1})
    done = A.claimable_at(made, 500, "last_modified_ledger")
    assert "BroadcastHashJoin" not in done._jdf.queryExecution().executedPlan().toString()
    assert tuple(one(done)) == ("B1", "G1", "and(before_absolute_time(900), not(unconditional))", True)


def test_totals_check_an_id_once_an_event(spark):
    """Ids with one character changed are none; the check is in the plan once, and without a step a character."""
    good = [contract_key(n) for n in range(30)]
    bad = [x[:n] + ("A" if x[n] != "A" else "B") + x[n + 1 :] for n, x in zip(range(2, 56), good * 2)]
    e = N.normalize_contract_events(raw(spark, "contract_events", *[{"id": str(n), "contract_id": x, "tx_hash": "t"} for n, x in enumerate(good + bad + [None, "", good[0]])]))
    totals = A.contract_event_totals(e)
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and "aggregate(" not in plan
    s = one(totals)
    assert (s["events"], s["contracts"], s["transactions"], s["failed"]) == (len(good) + len(bad) + 3, len(good), 1, 0)
    s = one(A.contract_event_totals(e.where("false")))
    assert (s["events"], s["contracts"], s["transactions"], s["failed"], s["first_ledger"]) == (0, 0, 0, 0, None)


@pytest.mark.parametrize("name, most", (("jn3b_batch_refs", 1), ("flt1l_by_watched_balances", 2), ("src1b_every_table", 2)))
def test_operations_are_made_up_once(spark, monkeypatch, name, most):
    """Queries that read several views of the operations read the lines that those are made up of once (claimable balances
    do so on their own)."""
    from tallyspark.plans import registry, views

    made, get = [], views.Tables.__getattr__
    monkeypatch.setattr(views.Tables, "__getattr__", lambda self, x: made.append(x) or get(self, x))
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert 1 <= made.count("lineitem") <= most


def test_windowed_times_are_made_up_once(spark, monkeypatch):
    from tallyspark.plans import registry

    kept, store = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: kept.append(name) or store(df, name))
    assert registry.queries()["str7b_windows_by_kind"](spark, "/root/testdata/sf0.001").count()
    assert kept == ["effects_times", "payments_times", "trades_times"]
