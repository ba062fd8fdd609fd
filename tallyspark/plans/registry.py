"""Queries of the ledger operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as X
from ..operators import joins as J
from ..operators import normalize as N
from ..operators import quality as Q
from ..operators import windows as W
from ..sources import tables as S
from ..streaming import streams as R
from .catalog import add as _add
from .catalog import oracle_sql, queries  # noqa: F401
from .normal_sql import NA, NC, ND, NE, NF, NI, NO, NP, NR, NT, NU, NX
from .views import Tables

_add("nrm1_normalize_payments", lambda t: N.normalize_payments(t.raw_payments), f"SELECT * FROM {NP}")
_add("nrm2_normalize_trades", lambda t: N.normalize_trades(t.raw_trades), f"SELECT * FROM {NT}")
_add("nrm4_normalize_pools", lambda t: N.normalize_pools(t.raw_pools), f"SELECT * FROM {NR}")
_add("nrm5_normalize_assets", lambda t: N.normalize_assets(t.raw_assets), f"SELECT * FROM {NA}")
_add("nrm7_normalize_transactions", lambda t: N.normalize_transactions(t.raw_transactions), f"SELECT * FROM {NX}")
_add("nrm8_normalize_contract_events", lambda t: N.normalize_contract_events(t.raw_contract_events), f"SELECT * FROM {NC}")
_add("nrm9_normalize_effects", lambda t: N.normalize_effects(t.raw_effects), f"SELECT * FROM {NF}")
_add("nrm11_index_effects", lambda t: N.index_effects(t.effects).select("event_id", "id", "toid", "id_ledger", "tx_order", "op_index", "effect_index"), f"SELECT event_id, id, toid, id_ledger, tx_order, op_index, effect_index FROM {NE}")

_add("flt2_trades_for_pair", lambda t: X.trades_for_pair(N.normalize_trades(t.raw_trades), "ECONOMY", "Brand#3"), f"SELECT id, counter_amount AS base_amount, base_amount AS counter_amount, CASE WHEN price = 0 THEN 0.0 ELSE 1.0 / price END AS price FROM {NT} WHERE base_asset = 'Brand#3' AND counter_asset = 'ECONOMY'")
_add("flt3_filter_offers", lambda t: X.filter_offers(N.normalize_offers(t.raw_offers), "Brand#3", "ECONOMY"), f"SELECT * FROM {NO} WHERE selling = 'Brand#3' AND buying = 'ECONOMY'")
_add("flt4_filter_assets", lambda t: X.filter_assets(N.normalize_assets(t.raw_assets), "Brand#3"), f"SELECT * FROM {NA} WHERE asset_code = 'Brand#3'")
_add("flt7_native_balance_effects", lambda t: X.native_balance_effects(t.effects).select("event_id", "account", "delta"), f"SELECT event_id, account, delta FROM {ND} WHERE delta IS NOT NULL")
_add("flt8_balances_for_claimants", lambda t: X.balances_for_claimants(t.claimables, t.accounts.where("med_threshold = 1").select("id")).select("id", "destination", "amount"), "SELECT id, destination, amount FROM claimables WHERE destination IN (SELECT id FROM accounts WHERE med_threshold = 1)")
_add("flt9_filter_direction", lambda t: X.filter_direction(A.with_direction(N.normalize_payments(t.raw_payments)), "incoming").select("id", "inspected", "direction"), f"SELECT id, inspected, direction FROM {NI} WHERE direction IN ('incoming', 'self')")
_add("flt10_page", lambda t: X.page(t.effects.select("event_id", "type"), "event_id", 100, 50), "SELECT event_id, type, (SELECT count(*) > 50 FROM (SELECT 1 FROM effects WHERE event_id > 100 LIMIT 51)) AS truncated FROM effects WHERE event_id > 100 ORDER BY event_id LIMIT 50")
_add("flt13_lookup", lambda t: X.lookup(t.transactions.select(F.col("ledger").alias("sequence")), t.ledgers.select("sequence", "hash"), "sequence"), "SELECT r.sequence, l.hash, l.sequence IS NOT NULL AS found FROM (SELECT DISTINCT ledger AS sequence FROM transactions) r LEFT JOIN ledgers l ON l.sequence = r.sequence")

_add("jn1_attach_ledgers", lambda t: J.attach_ledgers(N.normalize_payments(t.raw_payments).withColumn("ledger", F.lit(None).cast("bigint")), t.transactions).select("id", "ledger"), "SELECT p.id, t.ledger FROM payments p LEFT JOIN transactions t ON t.hash = p.transaction_hash")
_add("jn2_attach_trade_tx", lambda t: J.attach_trade_tx(N.normalize_trades(t.raw_trades), t.operations).select("id", "operation_id", "transaction_hash"), f"SELECT n.id, n.operation_id, o.transaction_hash FROM {NT} n LEFT JOIN operations o ON CAST(o.id AS VARCHAR) = n.operation_id")
_add("jn4_intent_vs_outcome", lambda t: J.intent_vs_outcome(t.operations, N.index_effects(t.effects)), f"SELECT coalesce(a.ledger, b.ledger) AS ledger, coalesce(a.tx_order, b.tx_order) AS tx_order, coalesce(a.n, 0) AS operations, coalesce(b.n, 0) AS effects FROM (SELECT ledger, tx_order, count(*) AS n FROM operations GROUP BY ALL) a FULL JOIN (SELECT id_ledger AS ledger, tx_order, count(*) AS n FROM {NE} GROUP BY ALL) b ON a.ledger = b.ledger AND a.tx_order = b.tx_order")
_add("jn7b_all_admissible_ledgers", lambda t: J.admissible_ledgers(t.transactions, t.ledgers), "SELECT t.hash, min(l.sequence) AS earliest, count(l.sequence) AS ledgers FROM transactions t LEFT JOIN ledgers l ON l.sequence >= t.min_ledger AND (t.max_ledger = 0 OR l.sequence <= t.max_ledger) GROUP BY t.hash")
_add("jn9_probe_storage", lambda t: J.probe_storage(t.storage, t.storage.select("contract_id", "key").distinct()).select("contract_id", "key", "durability", "value", "found"), "SELECT k.contract_id, k.key, d.durability, s.value, s.key IS NOT NULL AS found FROM (SELECT DISTINCT contract_id, key FROM storage) k CROSS JOIN (SELECT 'persistent' AS durability UNION ALL SELECT 'temporary') d LEFT JOIN storage s ON s.contract_id = k.contract_id AND s.key = k.key AND s.durability = d.durability")
_add("jn10b_created_balances_by_tx", lambda t: J.created_balances_by_tx(t.effects), f"SELECT toid // 4096 AS tx, balance_id FROM {NE} WHERE type = 'claimable_balance_created' UNION ALL SELECT DISTINCT toid // 4096, NULL FROM {NE} WHERE toid IS NOT NULL AND toid // 4096 NOT IN (SELECT toid // 4096 FROM {NE} WHERE type = 'claimable_balance_created' AND toid IS NOT NULL)")
_EDGES = "SELECT selling AS src, buying AS dst, greatest(1, CAST(price_n AS BIGINT)) % 4 + 1 AS rate FROM offers UNION ALL SELECT buying, selling, CAST(price_d AS BIGINT) % 3 + 1 FROM offers"


def _edges(t: Tables):
    o = t.offers
    return o.select(F.col("selling").alias("src"), F.col("buying").alias("dst"), (F.greatest(F.lit(1), "price_n") % 4 + 1).alias("rate")).unionByName(
        o.select(F.col("buying").alias("src"), F.col("selling").alias("dst"), (F.col("price_d") % 3 + 1).alias("rate"))
    )


_pairs = lambda t: J.traded_pairs(N.normalize_trades(t.raw_trades))
_PAIRS = f"(SELECT base_asset AS src, counter_asset AS target FROM {NT} WHERE base_asset <> counter_asset UNION SELECT counter_asset, base_asset FROM {NT} WHERE base_asset <> counter_asset)"


def _quoted(hops: int) -> str:
    """(src, target, rate) of every traded pair, by all paths of different assets."""
    walks = ["SELECT src, dst, rate, [src, dst] AS seen FROM e"] + [f"SELECT w.src, e.dst, w.rate * e.rate AS rate, list_append(seen, e.dst) AS seen FROM w{n} w JOIN e ON e.src = w.dst WHERE NOT list_contains(seen, e.dst)" for n in range(1, hops)]
    named = ", ".join(f"w{n} AS ({w})" for n, w in enumerate(walks, 1))
    every = " UNION ALL ".join(f"SELECT src, dst, rate FROM w{n}" for n in range(1, hops + 1))
    return f"WITH e AS (SELECT src, dst, max(rate) AS rate FROM ({_EDGES}) WHERE src <> dst GROUP BY src, dst), {named} SELECT r.src, r.target, CAST(max(w.rate) AS BIGINT) AS rate FROM {_PAIRS} r JOIN ({every}) w ON w.src = r.src AND w.dst = r.target GROUP BY r.src, r.target"


_add("jn13_quote_paths", lambda t: J.quote_paths(_edges(t), _pairs(t), 3), _quoted(3))
_add("jn13b_all_quote_paths", lambda t: J.quote_paths(_edges(t), _pairs(t), 2), _quoted(2))
_add("jn14_fee_bump_audit", lambda t: J.fee_bump_audit(t.transactions), "SELECT o.hash, o.inner_hash, o.fee_charged - i.fee_charged AS escalation, o.fee_account <> i.source_account AS payer_differs FROM transactions o JOIN transactions i ON i.hash = o.inner_hash")

_add("agg1_trade_summary", lambda t: A.trade_summary(N.normalize_trades(t.raw_trades)), f"SELECT *, CASE WHEN base_volume = 0 THEN 0.0 ELSE round(CAST(counter_volume AS DOUBLE) / CAST(base_volume AS DOUBLE), 6) END AS vwap FROM (SELECT base_asset, counter_asset, count(*) AS trades, CAST(sum(base_amount) AS DECIMAL(38,7)) AS base_volume, CAST(sum(counter_amount) AS DECIMAL(38,7)) AS counter_volume, round(avg(price), 6) AS mean_price, max(price) AS high, min(price) AS low, min(close_time) AS first_time, max(close_time) AS last_time, count(*) FILTER (WHERE venue = 'orderbook') AS orderbook_trades, count(*) FILTER (WHERE venue = 'liquidity_pool') AS pool_trades FROM {NT} GROUP BY base_asset, counter_asset)")
_add("agg2_payment_summary", lambda t: A.payment_summary(N.normalize_payments(t.raw_payments)), f"SELECT inspected, count(*) AS total, count(*) FILTER (WHERE direction = 'incoming') AS incoming, count(*) FILTER (WHERE direction = 'outgoing') AS outgoing, count(*) FILTER (WHERE direction = 'self') AS self_payments, count(*) FILTER (WHERE direction = 'related') AS related FROM {NI} GROUP BY inspected")
_add("agg3_payments_by_asset", lambda t: A.counts(A.with_direction(N.normalize_payments(t.raw_payments)), "inspected", "asset"), f"SELECT inspected, asset, count(*) AS n FROM {NI} GROUP BY inspected, asset")
_add("agg4_ledger_effects_summary", lambda t: A.ledger_effects_summary(N.index_effects(t.effects)), f"SELECT ledger, count(*) AS effects, count(DISTINCT type) AS types, count(DISTINCT account) AS accounts, count(DISTINCT toid // 4096) AS transactions, count(DISTINCT toid) AS operations FROM {NE} GROUP BY ledger")
_add("agg5_effects_by_type", lambda t: A.effects_by(N.normalize_effects(t.raw_effects), "type"), f"SELECT type, count(*) AS n, count(DISTINCT subject) AS subjects FROM {NF} GROUP BY type")
_add("agg6_effects_by_category", lambda t: A.share_of_total(N.normalize_effects(t.raw_effects), "category"), f"SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM effects), 1) AS share FROM {NF} GROUP BY category")
_add("agg8_contract_event_summary", lambda t: A.contract_event_summary(N.normalize_contract_events(t.raw_contract_events)), f"SELECT CASE WHEN g = 1 THEN 'name' WHEN g = 2 THEN 'type' ELSE 'total' END AS grouped_by, coalesce(name, type, '') AS value, n, first_ledger, last_ledger, failed FROM (SELECT name, type, grouping(name, type) AS g, count(*) AS n, min(ledger) FILTER (WHERE ledger > 0) AS first_ledger, max(ledger) FILTER (WHERE ledger > 0) AS last_ledger, count(*) FILTER (WHERE NOT successful) AS failed FROM {NC} GROUP BY GROUPING SETS ((name), (type), ()))")
_add("agg10_offer_book_summary", lambda t: A.offer_book_summary(N.normalize_offers(t.raw_offers)), f"SELECT count(*) AS offers, count(DISTINCT seller) AS sellers, count(DISTINCT pair) AS pairs FROM {NO}")
_add("agg11_offer_totals", lambda t: A.offer_totals(N.normalize_offers(t.raw_offers)), f"SELECT selling AS asset, 'selling' AS side, CAST(sum(amount) AS DECIMAL(38,7)) AS total FROM {NO} GROUP BY selling UNION ALL SELECT buying, 'buying', CAST(sum(CAST(buying_amount AS DECIMAL(38,7))) AS DECIMAL(38,7)) FROM {NO} GROUP BY buying")
_add("agg12_order_book_depth", lambda t: A.order_book_depth(N.normalize_offers(t.raw_offers)), f"SELECT *, CAST(sum(amount) OVER (PARTITION BY selling, buying ORDER BY price ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,7)) AS depth FROM (SELECT selling, buying, price, CAST(sum(amount) AS DECIMAL(38,7)) AS amount FROM {NO} GROUP BY selling, buying, price)")
_add("agg14_pool_inventory", lambda t: A.pool_inventory(N.normalize_pools(t.raw_pools)), f"SELECT kind, code, issuer, CAST(sum(amount) AS DECIMAL(38,7)) AS amount, count(*) AS n FROM {NR} WHERE place IS NOT NULL GROUP BY kind, code, issuer")
_add("agg15_asset_summary", lambda t: A.asset_summary(N.normalize_assets(t.raw_assets)), f"SELECT count(*) AS records, count(DISTINCT asset_code) AS codes, count(DISTINCT asset_issuer) AS issuers, CAST(sum(holders) AS BIGINT) AS holders, CAST(sum(claimable_balances) AS BIGINT) AS claimable_balances FROM {NA}")
_add("agg16_ambiguous_codes", lambda t: A.ambiguous_codes(N.normalize_assets(t.raw_assets)), f"SELECT asset_code, count(DISTINCT asset_issuer) AS issuers FROM {NA} GROUP BY asset_code HAVING count(DISTINCT asset_issuer) > 1")
_add("agg22_sponsorships", lambda t: A.sponsorships(t.effects), "SELECT sponsor, replace(type, '_sponsorship_created', '') AS entry, count(*) AS n FROM effects WHERE type LIKE '%_sponsorship_created' GROUP BY ALL")
_add("agg23_reserve_requirements", lambda t: A.reserve_requirements(t.accounts), "SELECT *, available <= 0 AS below FROM (SELECT id, balance, reserve_stroops, CAST(balance - CAST(reserve_stroops / 10000000 AS DECIMAL(19,7)) AS DECIMAL(38,7)) AS available FROM (SELECT id, balance, (2 + greatest(0, subentry_count - num_sponsored + num_sponsoring)) * 5000000 AS reserve_stroops FROM accounts))")
_add("agg27_trustline_headroom", lambda t: A.trustline_headroom(t.trustlines), """SELECT account, asset_code, CAST("limit" - balance - buying_liabilities AS DECIMAL(38,7)) AS headroom, "limit" = 922337203685.4775807 AS unlimited, balance = 0 AS removable FROM trustlines""")
_add("agg28_claimable_summary", lambda t: A.claimable_summary(t.claimables), "SELECT destination, asset, predicate, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,7)) AS amount FROM claimables GROUP BY ALL")
_add("agg30_batch_profile", lambda t: A.batch_profile(t.operations), "SELECT size, count(*) AS transactions FROM (SELECT transaction_hash, count(*) AS size FROM operations GROUP BY 1) GROUP BY size")
_add("agg31_memo_breakdown", lambda t: A.share_of_total(t.transactions, "memo_type"), "SELECT memo_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM transactions), 1) AS share FROM transactions GROUP BY memo_type")
_add("agg32_muxed_deposits", lambda t: A.muxed_deposits(t.payments), """SELECT "to", muxed_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,7)) AS amount FROM payments GROUP BY ALL""")
_add("agg34_state_changes", lambda t: A.state_changes(t.simulations), "SELECT CASE WHEN before_value IS NULL AND after_value IS NULL THEN 'none' WHEN before_value IS NULL THEN 'created' WHEN after_value IS NULL THEN 'removed' ELSE 'updated' END AS kind, count(*) AS n FROM simulations GROUP BY 1")
_add("agg39_auth_entries", lambda t: A.auth_entries(t.simulations, 50000000), "SELECT credential, signed, coalesce(CASE WHEN credential = 'address' THEN expiration_ledger < 50000000 END, false) AS expired, count(*) AS n, CAST(max(CASE WHEN credential = 'address' THEN floor((expiration_ledger - 50000000) * 5 / 60.0) END) AS BIGINT) AS most_minutes FROM simulations GROUP BY 1, 2, 3")

_add("win1_balance_history", lambda t: W.balance_history(X.native_balance_effects(t.effects), t.accounts), f"SELECT account, event_id, delta, CAST(balance - sum(delta) OVER (PARTITION BY account) + sum(delta) OVER (PARTITION BY account ORDER BY ledger, event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,7)) AS running FROM (SELECT e.account, e.event_id, e.ledger, e.delta, a.balance FROM {ND} e JOIN accounts a ON a.id = e.account WHERE e.delta IS NOT NULL)")
_add("win2_latest_n", lambda t: W.latest_n(t.effects.select("account", "event_id", "type"), "account", "event_id", 5), "SELECT * FROM (SELECT account, event_id, type, CAST(row_number() OVER (PARTITION BY account ORDER BY event_id DESC) AS INT) AS rank FROM effects) WHERE rank <= 5")
_add("win5_status_transitions", lambda t: W.status_transitions(t.polls), "SELECT transaction_id, poll, status, lead(polled_at) OVER (PARTITION BY transaction_id ORDER BY polled_at, poll) - polled_at AS seconds, status IN ('completed', 'error') AS terminal FROM (SELECT *, lag(status) OVER (PARTITION BY transaction_id ORDER BY polled_at, poll) AS b FROM polls) WHERE b IS NULL OR b <> status")
_add("win6_trade_bars", lambda t: W.trade_bars(N.normalize_trades(t.raw_trades)), f"SELECT base_asset, counter_asset, ledger // 7 AS bucket, arg_min(price, (ledger, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ledger, id)) AS close, CAST(sum(base_amount) AS DECIMAL(38,7)) AS volume FROM {NT} GROUP BY 1, 2, 3")
_add("top4_most_active", lambda t: A.most_active(t.transactions, "source_account", 10), "SELECT source_account, count(*) AS n FROM transactions GROUP BY source_account ORDER BY n DESC, source_account LIMIT 10")
_add("set4_tier_difference", lambda t: Q.tier_difference(t.storage), "SELECT contract_id, key, CASE WHEN bool_or(durability = 'persistent') THEN 'persistent' ELSE 'temporary' END AS only_in FROM storage GROUP BY contract_id, key HAVING count(DISTINCT durability) = 1")


# Nested raw columns over the flat views, for the operators that unnest them.
_CALL = "named_struct('contract', {}, 'function', {}, 'args', {}, 'sub', {})"
_LEAF = "named_struct('contract', concat('C', id % 5), 'function', 'h', 'args', 2)"
_SUB = [_CALL.format(f"concat('C', (id + {k + 1}) % 25)", f"'g{k}'", k, f"slice(array({_LEAF}), 1, {k})") for k in (0, 1)]
_TREE = "parse_json(to_json(" + _CALL.format("contract_id", "concat('f', id % 3)", "id % 4", f"slice(array({', '.join(_SUB)}), 1, cast(id % 3 as int))") + "))"
_KEY = "named_struct('key_type', {}, 'contract', contract_id, 'key', cast(id % {} as string), 'durability', {})"


def _raw_simulations(t: Tables):
    return t.simulations.select(
        F.col("id").cast("string").alias("id"), "contract_id", "status", F.col("message").alias("error"), F.col("min_resource_fee").cast("string").alias("min_resource_fee"), "instructions", "read_bytes", "write_bytes",
        F.expr("array(" + _KEY.format("'contract_code'", 7, "'persistent'") + ", " + _KEY.format("'contract_data'", 9, "'temporary'") + ")").alias("read_only"),
        F.expr("array(" + _KEY.format("'contract_data'", 11, "'persistent'") + ")").alias("read_write"),
        F.expr("array(named_struct('key', contract_id, 'before', before_value, 'after', after_value))").alias("state_changes"),
        F.expr("array(named_struct('ok', id % 4 <> 0, 'type', 'contract', 'contract', contract_id), named_struct('ok', id % 3 = 0, 'type', 'diagnostic', 'contract', contract_id))").alias("events"),
    )


def _stored(t: Tables, df, name: str, format: str = "parquet", by: str | None = None) -> str:
    where = S.shared_folder(t.spark, "raw")
    writer = df.write.partitionBy(by) if by else df.write
    if format == "parquet":
        writer = writer.option("compression", "zstd")
    writer.format(format).save(f"{where}/{name}")
    return where


def _archive(t: Tables):
    path = S.shared_folder(t.spark, "archive")
    stream = R.stream_events(t.spark, t.folder).select("event_id", F.expr("50000000 + (unix_seconds(ts) - 1704067200) div 5").alias("ledger"))
    R.archive_events(stream, path)
    return t.spark.read.schema("event_id long, ledger long").parquet(f"{path}/*")


_OPFX = "SELECT *, concat(lpad(cast(id + CASE WHEN l_linenumber = 3 THEN 4000 ELSE 0 END as {}), 19, '0'), '-1') AS effect_id FROM operations"


def _operation_effects(t: Tables):
    return _effects_of(t.operations)


def _effects_of(operations):
    return operations.select(F.expr("concat(lpad(cast(id + if(l_linenumber = 3, 4000, 0) as string), 19, '0'), '-1')").alias("id"), F.col("l_quantity").alias("delta"))


_add("src3_read_storage", lambda t: S.read_storage_entries(t.spark, _stored(t, t.storage, "storage_entries", by="durability"), "persistent").select("contract_id", "key", "durability", "value", "last_modified_ledger", "live_until_ledger"), "SELECT contract_id, key, durability, value, last_modified_ledger, live_until_ledger FROM storage WHERE durability = 'persistent'")
_add("src4_read_simulations", lambda t: S.read_simulations(t.spark, _stored(t, _raw_simulations(t), "simulations", "json")).select("id", "status", F.col("read_only")[1]["key"].alias("second_key"), F.col("events")[0]["ok"].alias("first_ok"), F.col("_corrupt_record").isNotNull().alias("corrupt")), "SELECT CAST(id AS VARCHAR) AS id, status, CAST(id % 9 AS VARCHAR) AS second_key, id % 4 <> 0 AS first_ok, false AS corrupt FROM simulations")
_add("jn3_attach_operation_refs", lambda t: J.attach_operation_refs(_operation_effects(t), t.operations), f"SELECT e.effect_id AS id, e.l_quantity AS delta, CAST(split_part(e.effect_id, '-', 1) AS BIGINT) AS operation_id, o.transaction_hash, o.ledger FROM ({_OPFX.format('varchar')}) e LEFT JOIN operations o ON o.id = CAST(split_part(e.effect_id, '-', 1) AS BIGINT)")
_add("jn16_check_effect_scopes", lambda t: J.check_effect_scopes(t.operations.select("ledger", "id"), t.operations.join(t.transactions.where("tx_order <> 2").select(F.col("hash").alias("transaction_hash")), "transaction_hash").select("ledger", "id")), "SELECT ledger, id, 1 AS surplus FROM operations WHERE transaction_hash NOT IN (SELECT hash FROM transactions WHERE tx_order <> 2)")
_add("agg7_effects_per_operation", lambda t: A.effects_per_operation(N.index_effects(_operation_effects(t)), t.operations), f"SELECT ledger, count(*) AS operations, CAST(coalesce(sum(n), 0) AS BIGINT) AS effects, count(*) FILTER (WHERE n IS NULL) AS without_effects, CAST(coalesce(sum(n), 0) AS DOUBLE) / count(*) AS effects_per_operation FROM operations o LEFT JOIN (SELECT CAST(split_part(effect_id, '-', 1) AS BIGINT) AS oid, count(*) AS n FROM ({_OPFX.format('varchar')}) GROUP BY 1) e ON e.oid = o.id GROUP BY ledger")
_add("agg35_invocation_summary", lambda t: A.invocation_summary(t.simulations), "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status <> 'success') AS failed FROM simulations")
_CALLS = """(SELECT id, 0 AS depth, contract_id AS root, contract_id AS contract, concat('f', id % 3) AS function, id % 4 AS args FROM simulations
 UNION ALL SELECT id, 1, contract_id, concat('C', (id + 1) % 25), 'g0', 0 FROM simulations WHERE id % 3 > 0 UNION ALL SELECT id, 1, contract_id, concat('C', (id + 2) % 25), 'g1', 1 FROM simulations WHERE id % 3 = 2
 UNION ALL SELECT id, 2, contract_id, concat('C', id % 5), 'h', 2 FROM simulations WHERE id % 3 = 2)"""
_calls = lambda t: A.flatten_invocations(t.simulations.select("id", F.expr(_TREE).alias("invocation")))
_add("agg40_flatten_invocations", _calls, f"SELECT * FROM {_CALLS}")
_add("agg40_invocation_trees", lambda t: A.invocation_trees(_calls(t)), f"SELECT id, count(*) AS calls, max(depth) AS deepest FROM {_CALLS} GROUP BY id")
_add("agg41_footprint_keys", lambda t: A.footprint_keys(_raw_simulations(t)), "SELECT access, key_type, durability, count(*) AS n, count(DISTINCT key) AS keys FROM (SELECT 'read_only' AS access, 'contract_code' AS key_type, 'persistent' AS durability, id % 7 AS key FROM simulations UNION ALL SELECT 'read_only', 'contract_data', 'temporary', id % 9 FROM simulations UNION ALL SELECT 'read_write', 'contract_data', 'persistent', id % 11 FROM simulations) GROUP BY 1, 2, 3")
_add("agg43_diagnostics", lambda t: A.diagnostics(_raw_simulations(t)), "SELECT type, contract, count(*) FILTER (WHERE good) AS ok, count(*) FILTER (WHERE NOT good) AS failed FROM (SELECT 'contract' AS type, contract_id AS contract, id % 4 <> 0 AS good FROM simulations UNION ALL SELECT 'diagnostic', contract_id, id % 3 = 0 FROM simulations) GROUP BY 1, 2")
_add("str4_bounded_run", lambda t: R.run_bounded(R.stream_events(t.spark, t.folder).select("event_id", "event_type"), t.spark, seconds=600), "SELECT event_id, event_type FROM events")
_add("str5_observe_counts", lambda t: R.observe_counts(R.stream_events(t.spark, t.folder), F.col("event_type") == "purchase", t.spark), "SELECT count(*) AS received, count(*) FILTER (WHERE event_type = 'purchase') AS passed FROM events")
_add("str6_retention_gaps", lambda t: R.retention_gaps(_archive(t)), "SELECT ledger AS after, nxt AS before, nxt - ledger - 1 AS missing FROM (SELECT ledger, lead(ledger) OVER (ORDER BY ledger) AS nxt FROM (SELECT DISTINCT ledger FROM contract_events)) WHERE nxt > ledger + 1")

from . import reports  # noqa: E402, F401  its queries join the list
