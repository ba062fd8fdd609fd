"""Queries over the raw-shaped records, and the reports built on them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as X
from ..operators import joins as J
from ..operators import markets as M
from ..operators import normalize as N
from ..operators import quality as Q
from ..operators import windows as W
from ..sources import tables as S
from ..sources.summaries import Summary
from ..streaming import streams as R
from .catalog import add
from .normal_sql import NA, NC, NE, NF, NI, NL, NO, NP, NR, NT, NU, NX, is_contract
from .registry import _OPFX, _PAIRS, _edges, _effects_of, _operation_effects, _pairs, _quoted, _raw_simulations, _stored
from .views import CONTRACTS, Tables

payments = lambda t: N.normalize_payments(t.raw_payments)
trades = lambda t: N.normalize_trades(t.raw_trades)
offers = lambda t: N.normalize_offers(t.raw_offers)
reserves = lambda t: N.normalize_pools(t.raw_pools)
assets = lambda t: N.normalize_assets(t.raw_assets)
ledgers = lambda t: N.normalize_ledgers(t.raw_ledgers)
transactions = lambda t: N.normalize_transactions(t.raw_transactions)
accounts = lambda t: N.normalize_accounts(t.raw_accounts)
events = lambda t: N.normalize_contract_events(t.raw_contract_events)
BIG = "CAST({} AS BIGINT)"
MONEY = "CAST({} AS DECIMAL(38,7))"


def _values(rows: dict[str, str]) -> str:
    """A dictionary as a table (code, text)."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in rows.items()) + ") d(code, text)"


# ---------------------------------------------------------------- sources and sinks

RAW = {
    "ledgers": "raw_ledgers", "transactions": "raw_transactions", "operations": "raw_operations", "payments": "raw_payments", "effects": "raw_effects", "trades": "raw_trades", "offers": "raw_offers",
    "assets": "raw_assets", "liquidity_pools": "raw_pools", "claimable_balances": "raw_claimables", "accounts": "raw_accounts", "contract_events": "raw_contract_events",
}


def _every_table(t: Tables):
    t, out = t.with_stored_operations(), None
    for name, view in RAW.items():
        one = S.read_table(t.spark, _stored(t, getattr(t, view), name), name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def _event_archive(t: Tables) -> str:
    path = S.shared_folder(t.spark, "events")
    S.store_by_ledger(t.raw_contract_events.drop("event_id"), path)
    return path


_CONTRACTS = CONTRACTS[2:5]
_WHERE = "ledger BETWEEN 50000000 AND 50200000 AND type = 'contract' AND contract_id IN ({})".format(", ".join(f"'{c}'" for c in _CONTRACTS))


def _summary_twice(t: Tables):
    """A summary that is written, written again, and then written for its newest bucket only."""
    path = S.shared_folder(t.spark, "summary")
    rows = A.counts(transactions(t).withColumn("bucket", F.floor(F.col("ledger") / 1000)), "bucket", "status")
    S.write_summary(rows, path, ["bucket"])
    S.write_summary(rows, path, ["bucket"])
    newest = rows.agg(F.max("bucket")).first()[0]
    S.write_summary(rows.where(F.col("bucket") == newest), path, ["bucket"])
    return t.spark.read.schema("status string, n long, bucket long").parquet(path)


add("src1_read_table", lambda t: S.read_table(t.spark, _stored(t, t.raw_ledgers, "ledgers"), "ledgers"), "SELECT * FROM raw_ledgers")
add("src1b_every_table", _every_table, " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {v}" for n, v in RAW.items()))
add(
    "src2_read_contract_events",
    lambda t: S.read_stored_events(t.spark, _event_archive(t), 50000000, 50200000, ["contract"], _CONTRACTS).select("id", "contract_id", "ledger"),
    f"SELECT id, contract_id, ledger FROM raw_contract_events WHERE {_WHERE}",
)
add(
    "src5_stream_payments",
    lambda t: R.run_bounded(R.stream_payments(t.spark, _stored(t, t.raw_payments, "payments")).select("paging_token", "type", "amount"), t.spark),
    "SELECT paging_token, type, amount FROM raw_payments",
)
add("snk1_write_summary", _summary_twice, f"SELECT ledger // 1000 AS bucket, status, count(*) AS n FROM {NX} GROUP BY ALL")

_GROWING = Summary(("bucket", "status"), {"n": ("count",), "fees": ("sum", "fee_charged"), "least": ("min", "fee_charged"), "most": ("max", "fee_charged"), "opened_by": ("first", "source_account", "hash"), "closed_by": ("last", "source_account", "hash"), "accounts": ("distinct", "source_account")})


def _grown(t: Tables):
    """A summary by three increments, the second of which comes twice."""
    path = S.shared_folder(t.spark, "growing")
    rows = transactions(t).withColumn("bucket", F.floor(F.col("ledger") / 1000))
    for part in (0, 1, 2, 1):
        _GROWING.add(rows.where(F.col("ledger") % 3 == part), path, part)
    return _GROWING.read(t.spark, path)


add(
    "snk1b_growing_summary",
    _grown,
    f"SELECT ledger // 1000 AS bucket, status, count(*) AS n, CAST(sum(fee_charged) AS BIGINT) AS fees, min(fee_charged) AS least, max(fee_charged) AS most, arg_min(source_account, hash) AS opened_by, arg_max(source_account, hash) AS closed_by, count(DISTINCT source_account) AS accounts FROM {NX} GROUP BY ALL",
)
add(
    "snk1c_followed_stream",
    lambda t: Summary(("event_type",), {"n": ("count",), "users": ("distinct", "user_id"), "last_user": ("last", "user_id", "event_id")}).follow(R.stream_events(t.spark, t.folder), S.shared_folder(t.spark, "followed")),
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, arg_max(user_id, event_id) AS last_user FROM events GROUP BY event_type",
)

# ---------------------------------------------------------------- normalised tables


def _value_sql(kind: str, value: str, depth: int) -> str:
    among = lambda kinds: "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    out = f"""CASE WHEN {kind} IN ('void', 'scvVoid') THEN 'null' WHEN {kind} = 'scvBool' THEN CASE WHEN {value} IN ('true', 'false') THEN {value} END
      WHEN {kind} IN {among(N.WHOLE)} THEN CASE WHEN regexp_full_match({value}, '-?\\d+') THEN {value} END WHEN {kind} IN {among(N.WIDE)} THEN CASE WHEN regexp_full_match({value}, '-?\\d+') THEN '"' || {value} || '"' END
      WHEN {kind} = 'scvBytes' THEN '"0x' || lower(hex(from_base64({value}))) || '"' WHEN {kind} IN {among(N.TEXTS)} THEN CAST(to_json({value}) AS VARCHAR)"""
    if depth:
        x, p = f"x{depth}", f"p{depth}"
        child = lambda at: _value_sql(f"json_extract_string({x}, '{at}.type')", f"json_extract_string({x}, '{at}.value')", depth - 1)
        key = child("$.key")
        named = f"""CASE WHEN {key} LIKE '"%' THEN {key} ELSE '"' || replace({key}, '"', '\\"') || '"' END"""
        whole = lambda left, right, each: f"CASE WHEN json_valid({value}) THEN list_transform([list_transform(json_extract({value}, '$[*]'), lambda {x}: {each})], lambda {p}: CASE WHEN len(list_filter({p}, lambda z{depth}: z{depth} IS NULL)) = 0 THEN '{left}' || array_to_string({p}, ',') || '{right}' END)[1] END"
        out += f" WHEN {kind} = 'scvVec' THEN {whole('[', ']', child('$'))} WHEN {kind} = 'scvMap' THEN {whole('{', '}', named + " || ':' || " + child('$.val'))}"
    return out + " END"


_KNOWN = "('void', 'scvVoid', 'scvBool', 'scvBytes', 'scvVec', 'scvMap', " + ", ".join(f"'{k}'" for k in (*N.WHOLE, *N.WIDE, *N.TEXTS)) + ")"
add("nrm3_normalize_offers", offers, f"SELECT * FROM {NO}")
add("nrm6_normalize_ledgers", ledgers, f"SELECT * FROM {NL}")
add("nrm10_normalize_accounts", accounts, f"SELECT * FROM {NU}")
add(
    "nrm12_decode_event_values",
    lambda t: N.decode_event_values(t.raw_contract_events),
    f"""SELECT id, k AS xdr_type, v AS value, v IS NOT NULL AS decoded, CASE WHEN v IS NULL THEN CASE WHEN k IN {_KNOWN} THEN 'not a value of type ' || k ELSE 'unsupported type ' || k END END AS error
    FROM (SELECT id, k, {_value_sql('k', 'w', 2)} AS v FROM (SELECT id, coalesce(value.xdr_type, 'void') AS k, value.value AS w FROM raw_contract_events))""",
)
add(
    "nrm12b_decode_report",
    lambda t: N.decode_report(N.decode_event_values(t.raw_contract_events)),
    f"SELECT k AS xdr_type, count(*) AS n, count(*) FILTER (WHERE {_value_sql('k', 'w', 2)} IS NULL) AS failed FROM (SELECT coalesce(value.xdr_type, 'void') AS k, value.value AS w FROM raw_contract_events) GROUP BY k",
)
add(
    "nrm8b_decode_topics",
    lambda t: N.decode_event_topics(t.raw_contract_events),
    f"""SELECT id, place, k AS xdr_type, v AS value, v IS NOT NULL AS decoded FROM (SELECT *, {_value_sql('k', 'w', 0)} AS v FROM (
    SELECT id, CAST(i - 1 AS INT) AS place, topic[i].xdr_type AS k, topic[i].value AS w FROM (SELECT id, topic, unnest(range(1, len(topic) + 1)) AS i FROM raw_contract_events)))""",
)
add(
    "nrm13_explode_account_data",
    lambda t: N.explode_account_data(t.accounts.select("id", F.create_map(F.lit("domain"), F.base64("home_domain"), F.lit("none"), F.lit("")).alias("data_attr"))),
    "SELECT id, 'domain' AS name, home_domain AS value FROM accounts UNION ALL SELECT id, 'none', NULL FROM accounts",
)
add(
    "nrm14_normalize_trustlines",
    lambda t: N.normalize_trustlines(t.raw_accounts),
    """SELECT account, b.asset_code, b.asset_issuer, CAST(TRY_CAST(b.balance AS DECIMAL(19,7)) AS DECIMAL(38,7)) AS balance, CAST(TRY_CAST(b."limit" AS DECIMAL(19,7)) AS DECIMAL(38,7)) AS "limit",
    CAST(TRY_CAST(b.buying_liabilities AS DECIMAL(19,7)) AS DECIMAL(38,7)) AS buying_liabilities, CAST(TRY_CAST(b.selling_liabilities AS DECIMAL(19,7)) AS DECIMAL(38,7)) AS selling_liabilities,
    b.is_authorized, b.is_authorized_to_maintain_liabilities FROM (SELECT id AS account, unnest(balances) AS b FROM raw_accounts) WHERE b.asset_type NOT IN ('native', 'liquidity_pool_shares')""",
)

# ---------------------------------------------------------------- filters

_WATCHED = "(SELECT id FROM accounts WHERE auth_immutable)"
add(
    "flt1_filter_resource",
    lambda t: X.filter_resource(t.raw_transactions, "transactions", account=t.accounts.where("auth_immutable").select("id"), include_failed=False).select("hash", "source_account"),
    f"SELECT hash, source_account FROM raw_transactions WHERE successful AND source_account IN {_WATCHED}",
)
add(
    "flt1b_payments_of_any_party",
    lambda t: X.filter_resource(t.raw_payments, "payments", account=t.accounts.where("auth_immutable").select("id")).select("paging_token", "type"),
    "SELECT paging_token, type FROM raw_payments WHERE " + " OR ".join(f'coalesce({c} IN {_WATCHED}, false)' for c in ("source_account", "account", '"from"', '"to"', "funder", '"into"')),
)
# Each criterion on every resource that it is supported for, over records as their declared tables have them.
_FLT1 = {"transactions": ("raw_transactions", "hash"), "operations": ("raw_operations", "id"), "payments": ("raw_payments", "paging_token"), "effects": ("raw_op_effects", "id"), "trades": ("raw_trades", "paging_token")}


def _filtered(t: Tables, criterion: str, wanted):
    out = None
    if len(X.SUPPORT[criterion]) > 1:  # operations, payments and effects are made up of the same rows
        t = t.with_stored_operations()
        wanted = S.stored(wanted.distinct(), "wanted") if isinstance(wanted, DataFrame) else wanted
    for resource in X.SUPPORT[criterion]:
        view, key = _FLT1[resource]
        rows = X.filter_resource(getattr(t, view), resource, operations=t.raw_operations, effects=t.raw_op_effects, **{criterion: wanted})
        rows = rows.select(F.lit(resource).alias("resource"), F.col(key).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _met(**conditions: str) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS resource, {_FLT1[r][1]} AS id FROM {_FLT1[r][0]} WHERE {c}" + (" AND successful" if r == "transactions" else "") for r, c in conditions.items())


_NUMBER = {"operations": "CAST(id AS BIGINT)", "payments": "CAST(paging_token AS BIGINT)", "effects": "CAST(split_part(id, '-', 1) AS BIGINT)"}
_one = lambda df, c: df.agg(F.min(c)).first()[0]
_LEDGERS = "(SELECT ledger FROM transactions WHERE ledger % 97 = 0)"


def _ledger_met(test: str) -> str:
    return _met(transactions=f"coalesce(ledger_attr, ledger) {test}", **{r: f"{n} // 4294967296 {test}" for r, n in _NUMBER.items()})


add("flt1c_by_ledger", lambda t: _filtered(t, "ledger", _one(t.transactions, "ledger")), _ledger_met("= (SELECT min(ledger) FROM transactions)"))
add("flt1d_by_watched_ledgers", lambda t: _filtered(t, "ledger", t.transactions.where("ledger % 97 = 0").select("ledger")), _ledger_met(f"IN {_LEDGERS}"))
_HASHES = "(SELECT hash FROM transactions WHERE o_orderkey % 31 = 0)"


def _transaction_met(test: str) -> str:
    return _met(operations=f"transaction_hash {test}", payments=f"transaction_hash {test}", effects=f"{_NUMBER['effects']} // 4096 IN (SELECT {_NUMBER['operations']} // 4096 FROM raw_operations WHERE transaction_hash {test})")


add("flt1e_by_transaction", lambda t: _filtered(t, "transaction", _one(t.operations, "transaction_hash")), _transaction_met("= (SELECT min(transaction_hash) FROM operations)"))
add("flt1f_by_watched_transactions", lambda t: _filtered(t, "transaction", t.transactions.where("o_orderkey % 31 = 0").select("hash")), _transaction_met(f"IN {_HASHES}"))
add("flt1g_by_operation", lambda t: _filtered(t, "operation", _one(t.operations, "id")), _met(effects=f"{_NUMBER['effects']} = (SELECT min(id) FROM operations)"))
add("flt1h_by_watched_operations", lambda t: _filtered(t, "operation", t.operations.where("l_partkey % 3 = 0").select("id")), _met(effects=f"{_NUMBER['effects']} IN (SELECT id FROM operations WHERE l_partkey % 3 = 0)"))


def _named_met(named: str, test: str, **more: str) -> str:
    numbers = f"(SELECT {_NUMBER['effects']} FROM raw_op_effects WHERE {named} {test})"
    own = {"transactions": f"hash IN (SELECT transaction_hash FROM raw_operations WHERE {_NUMBER['operations']} IN {numbers})", "operations": f"{_NUMBER['operations']} IN {numbers}", "effects": f"{named} {test}"}
    return _met(**own, **{r: f"{_NUMBER[r]} IN {numbers}" for r in more})


add("flt1i_by_pool", lambda t: _filtered(t, "liquidity_pool", _one(t.raw_op_effects, "liquidity_pool.id")), _named_met("liquidity_pool.id", "= (SELECT min(liquidity_pool.id) FROM raw_op_effects)"))
add("flt1j_by_watched_pools", lambda t: _filtered(t, "liquidity_pool", t.pools.where("p_partkey % 5 = 0").select("id")), _named_met("liquidity_pool.id", "IN (SELECT id FROM pools WHERE p_partkey % 5 = 0)"))
add("flt1k_by_claimable_balance", lambda t: _filtered(t, "claimable_balance", _one(t.raw_op_effects, "balance_id")), _named_met("balance_id", "= (SELECT min(balance_id) FROM raw_op_effects)", payments=""))
add("flt1l_by_watched_balances", lambda t: _filtered(t, "claimable_balance", t.raw_claimables.where("last_modified_ledger % 7 = 0").select("id")), _named_met("balance_id", "IN (SELECT id FROM raw_claimables WHERE last_modified_ledger % 7 = 0)", payments=""))
add("flt1m_by_asset_pair", lambda t: _filtered(t, "asset_pair", ("ECONOMY", "Brand#3")), _met(trades="(base_asset_code = 'Brand#3' AND counter_asset_code = 'ECONOMY') OR (base_asset_code = 'ECONOMY' AND counter_asset_code = 'Brand#3')"))
_PARTY = {"transactions": ("source_account",), "operations": ("source_account", "account", '"from"', '"to"', "funder", '"into"', "trustor"), "payments": ("source_account", "account", '"from"', '"to"', "funder", '"into"'), "effects": ("account", "source_account", "destination", "trustor", "seller")}
add("flt1n_by_watched_accounts", lambda t: _filtered(t, "account", t.accounts.where("auth_immutable").select("id")), _met(**{r: "(" + " OR ".join(f"coalesce({c} IN {_WATCHED}, false)" for c in columns) + ")" for r, columns in _PARTY.items()}))
add(
    "flt1o_include_failed",
    lambda t: X.filter_resource(t.raw_transactions, "transactions", account=_one(t.transactions, "source_account"), include_failed=True).select("hash", "successful"),
    "SELECT hash, successful FROM raw_transactions WHERE source_account = (SELECT min(source_account) FROM transactions)",
)
add("flt5_recent_ledgers", lambda t: X.recent_ledgers(t.effects).select("event_id", "ledger"), "SELECT event_id, ledger FROM effects WHERE ledger >= greatest(1, (SELECT max(ledger) FROM effects) - 17280)")
add("flt5b_ledger_range", lambda t: X.recent_ledgers(t.effects, 50100000, 10**9).select("event_id", "ledger"), "SELECT event_id, ledger FROM effects WHERE ledger >= 50100000")
add(
    "flt6_effects_for_accounts",
    lambda t: X.effects_for_accounts(t.raw_effects, t.accounts.where("low_threshold = 0").select("id"), "event_id").select("event_id", "account", "destination"),
    "SELECT event_id, account, destination FROM raw_effects WHERE " + " OR ".join(f"coalesce({c} IN (SELECT id FROM accounts WHERE low_threshold = 0), false)" for c in X.PARTIES),
)
add(
    "flt11_audit_identifiers",
    lambda t: X.audit_identifiers(t.raw_contract_events, X.identifier_rules(contract="contract_id", ledger="ledger", hash="tx_hash")).unionByName(X.audit_identifiers(t.raw_assets, X.identifier_rules(asset_code="asset_code"))),
    f"""SELECT 'contract' AS rule, count(*) FILTER (WHERE NOT {is_contract('contract_id')}) AS violations FROM raw_contract_events
    UNION ALL SELECT 'ledger', count(*) FILTER (WHERE NOT coalesce(ledger BETWEEN 1 AND 2147483647, false)) FROM raw_contract_events
    UNION ALL SELECT 'hash', count(*) FILTER (WHERE NOT coalesce(regexp_matches(tx_hash, '^[0-9a-fA-F]{{64}}$'), false)) FROM raw_contract_events
    UNION ALL SELECT 'asset_code', count(*) FILTER (WHERE NOT coalesce(regexp_matches(asset_code, '^[A-Za-z0-9]{{1,12}}$'), false)) FROM raw_assets""",
)
_BOUNDS = """(SELECT *, CASE WHEN bounds = 'not_yet_valid' THEN min_time - 1055 END AS opens_in, CASE WHEN bounds IN ('valid', 'not_yet_valid') AND max_time > 0 THEN max_time - 1055 END AS closes_in FROM (
    SELECT hash, min_time, max_time, CASE WHEN min_time < 0 OR max_time < 0 OR (max_time > 0 AND max_time <= min_time) THEN 'invalid' WHEN min_time > 1055 THEN 'not_yet_valid' WHEN max_time > 0 AND max_time < 1055 THEN 'expired'
    WHEN max_time = 0 THEN 'open_ended' ELSE 'valid' END AS bounds FROM transactions))"""
_bounds = lambda t: X.classify_time_bounds(t.transactions, 1055)
add("flt12_classify_time_bounds", lambda t: _bounds(t).select("hash", "min_time", "max_time", "bounds", "opens_in", "closes_in"), f"SELECT * FROM {_BOUNDS}")
add("flt12b_time_bound_counts", lambda t: X.time_bound_counts(_bounds(t)), f"SELECT bounds, count(*) AS n, min(closes_in) AS soonest_close FROM {_BOUNDS} GROUP BY bounds")

# ---------------------------------------------------------------- joins

_HEARD = f"(SELECT CAST(split_part(effect_id, '-', 1) AS BIGINT) FROM ({_OPFX.format('varchar')}))"
add(
    "jn5_silent_operations",
    lambda t: J.silent_operations(t.operations, N.index_effects(_operation_effects(t)), ledgers(t)),
    f"SELECT s.*, l.operation_count AS header_operations FROM (SELECT ledger, count(*) FILTER (WHERE id NOT IN {_HEARD}) AS silent, count(*) AS operations FROM operations GROUP BY ledger) s LEFT JOIN {NL} l ON l.sequence = s.ledger WHERE silent > 0",
)
add(
    "jn6_explain_codes",
    lambda t: J.explain_codes(transactions(t)).select("hash", "result_code", "explanation"),
    f"SELECT hash, result_code, coalesce(text, '{J.FALLBACK}') AS explanation FROM {NX} LEFT JOIN {_values(J.EXPLANATIONS)} ON code = lower(trim(result_code))",
)
add(
    "jn6b_explain_effects",
    lambda t: J.explain_codes(t.raw_effects.select("event_id", "type"), "type", J.EFFECTS),
    f"SELECT event_id, type, coalesce(text, '{J.FALLBACK}') AS explanation FROM raw_effects LEFT JOIN {_values(J.EFFECTS)} ON code = lower(trim(type))",
)
add(
    "jn7_admissible_ledgers",
    lambda t: J.admissible_ledgers(transactions(t), ledgers(t)),
    f"SELECT t.hash, min(l.sequence) AS earliest, count(l.sequence) AS ledgers FROM {NX} t LEFT JOIN {NL} l ON l.sequence >= t.min_ledger AND (t.max_ledger = 0 OR l.sequence <= t.max_ledger) GROUP BY t.hash",
)
_ASKED = "(SELECT id AS account, CASE WHEN auth_required THEN 'C' || (num % 25) ELSE 'C1' END AS asset_code, 'G' || lpad(CAST(num % 10 AS VARCHAR), 6, '0') AS asset_issuer FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS num FROM accounts))"


def _asked(t: Tables):
    num = F.col("id").substr(2, 20).cast("long")
    code = F.when(F.col("auth_required"), F.concat(F.lit("C"), num % 25)).otherwise("C1")
    return t.accounts.select(F.col("id").alias("account"), code.alias("asset_code"), F.concat(F.lit("G"), F.lpad((num % 10).cast("string"), 6, "0")).alias("asset_issuer"))


_TIMED = {"min_time": "ledger * 5 + min_time - 1060", "max_time": "CASE WHEN max_time = 0 THEN 0 ELSE ledger * 5 + max_time - 1060 END"}
add(
    "jn7c_admissible_by_time",
    lambda t: J.admissible_ledgers_and_times(t.transactions.withColumns({c: F.expr(x) for c, x in _TIMED.items()}), t.ledgers),
    f"""SELECT t.hash, min(l.sequence) AS earliest, count(l.sequence) AS ledgers FROM (SELECT hash, min_ledger, max_ledger, {', '.join(f'{x} AS {c}' for c, x in _TIMED.items())} FROM transactions) t
    LEFT JOIN ledgers l ON l.sequence >= t.min_ledger AND (t.max_ledger = 0 OR l.sequence <= t.max_ledger) AND l.closed_at >= t.min_time AND (t.max_time = 0 OR l.closed_at <= t.max_time) GROUP BY t.hash""",
)
# Batches against archives in buckets: the last ledgers' payments, trades and effects with all transactions or operations.
def _kept(t: Tables, df, key: str, width: int | None = None):
    path = S.shared_folder(t.spark, "kept")
    S.store_by_ledger(df, path, key, width) if width else S.store_by_hash(df, path, key, 64)
    return t.spark.read.schema(df.schema.add("bucket", "long")).parquet(path)


_NEWEST = "(SELECT max(ledger) - 30 FROM transactions)"
_newest = lambda t, df: df.where(F.col("ledger") > t.transactions.agg(F.max("ledger") - 30).first()[0])


def _batch_ledgers(t: Tables):
    batch = _newest(t, payments(t)).select("id", "transaction_hash", F.lit(None).cast("bigint").alias("ledger"))
    mine = S.read_matching(_kept(t, t.transactions.select("hash", "ledger"), "hash"), batch.select(F.col("transaction_hash").alias("hash")), "hash", buckets=64)
    return J.attach_ledgers(batch, mine).select("id", "ledger")


def _batch_trades(t: Tables):
    batch = _newest(t, trades(t)).select("id", "operation_id")
    operations = _kept(t, t.operations.select("id", "transaction_hash"), "id", 2**32 * 100)
    mine = S.read_matching(operations, batch.select(F.col("operation_id").try_cast("bigint").alias("id")), "id", 2**32 * 100)
    return J.attach_trade_tx(batch, mine).select("id", "operation_id", "transaction_hash")


def _batch_refs(t: Tables):
    operations = _kept(t, t.operations.select("id", "transaction_hash", "ledger", "l_linenumber", "l_quantity"), "id", 2**32 * 100)
    # the batch comes out of what has been stored: operations cost a shuffle of all their rows to make up
    batch = _effects_of(operations).where(F.substring_index("id", "-", 1).cast("bigint") >= _one(operations, "id") + 2**32 * 2000)
    mine = S.read_matching(operations.drop("l_linenumber", "l_quantity"), batch.select(F.substring_index("id", "-", 1).cast("bigint").alias("id")), "id", 2**32 * 100)
    return J.attach_operation_refs(batch, mine)


add("jn3b_batch_refs", _batch_refs, f"SELECT e.effect_id AS id, e.l_quantity AS delta, CAST(split_part(e.effect_id, '-', 1) AS BIGINT) AS operation_id, o.transaction_hash, o.ledger FROM ({_OPFX.format('varchar')}) e LEFT JOIN operations o ON o.id = CAST(split_part(e.effect_id, '-', 1) AS BIGINT) WHERE CAST(split_part(e.effect_id, '-', 1) AS BIGINT) >= (SELECT min(id) FROM operations) + 4294967296 * 2000")
add("jn1b_batch_ledgers", _batch_ledgers, f"SELECT p.id, t.ledger FROM {NP} p LEFT JOIN transactions t ON t.hash = p.transaction_hash WHERE p.ledger > {_NEWEST}")
add("jn2b_batch_trades", _batch_trades, f"SELECT n.id, n.operation_id, o.transaction_hash FROM {NT} n LEFT JOIN operations o ON CAST(o.id AS VARCHAR) = n.operation_id WHERE n.ledger > {_NEWEST}")
add(
    "jn8_trustline_state",
    lambda t: J.trustline_state(_asked(t), t.trustlines, t.accounts),
    f"""SELECT r.*, CASE WHEN l.account IS NULL THEN 'NOT_FOUND' WHEN l.is_authorized THEN 'AUTHORIZED' WHEN l.is_authorized_to_maintain_liabilities THEN 'MAINTAIN_LIABILITIES' ELSE 'UNAUTHORIZED' END AS state,
    i.auth_required, i.auth_revocable, i.auth_clawback_enabled FROM {_ASKED} r LEFT JOIN trustlines l ON l.account = r.account AND l.asset_code = r.asset_code AND l.asset_issuer = r.asset_issuer LEFT JOIN accounts i ON i.id = r.asset_issuer""",
)
add(
    "jn10_created_balance_ids",
    lambda t: J.created_balance_ids(t.effects),
    f"SELECT toid // 4096 AS tx, arg_min(balance_id, id) FILTER (WHERE type = 'claimable_balance_created' AND balance_id IS NOT NULL) AS balance_id FROM {NE} WHERE toid IS NOT NULL GROUP BY 1",
)
_AT = "min(ledger) FILTER (WHERE type = 'claimable_balance_{0}') AS {0}"
add(
    "jn11_claimable_lifecycle",
    lambda t: J.claimable_lifecycle(t.effects),
    f"SELECT *, coalesce(claimed, clawed_back) - created AS age, coalesce(claimed, clawed_back) IS NULL AS still_open FROM (SELECT balance_id, {_AT.format('created')}, {_AT.format('claimed')}, {_AT.format('clawed_back')} FROM effects WHERE balance_id IS NOT NULL GROUP BY balance_id) WHERE created IS NOT NULL",
)
_AFTER = {
    "home_domain": "CASE WHEN auth_immutable THEN 'x' WHEN NOT auth_required THEN home_domain END", "sponsor": "CASE WHEN auth_revocable THEN 'G000007' ELSE sponsor END",
    "native_balance": "CAST(native_balance + CASE WHEN auth_required THEN 5 ELSE 0 END AS DECIMAL(38,7))", "num_sponsoring": "num_sponsoring + CASE WHEN auth_immutable THEN 2 ELSE 0 END",
}


def _snapshots(t: Tables):
    before = accounts(t)
    after = before.select("id", *[F.expr(sql).alias(c) for c, sql in _AFTER.items()])
    return J.diff_snapshots(before, after, "id", ["home_domain", "sponsor"], ["native_balance", "num_sponsoring"])


_text = lambda c: f"CAST({c} AS VARCHAR)"
add(
    "jn12_diff_snapshots",
    _snapshots,
    "SELECT *, CASE WHEN before IS NULL AND after IS NOT NULL THEN 'set' WHEN before IS NOT NULL AND after IS NULL THEN 'removed' WHEN before <> after THEN 'changed' ELSE 'same' END AS change FROM ("
    + " UNION ALL ".join(
        f"SELECT id, '{c}' AS attribute, {_text(c)} AS before, {_text(sql)} AS after, {MONEY.format(f'{sql} - {c}') if c in ('native_balance', 'num_sponsoring') else 'CAST(NULL AS DECIMAL(38,7))'} AS delta FROM {NU}" for c, sql in _AFTER.items()
    )
    + ")",
)
add(
    "jn13c_strict_receive",
    lambda t: J.strict_receive(_edges(t), _pairs(t).withColumns({"receive": F.lit(25).cast("decimal(19,7)"), "send_max": F.lit(5).cast("decimal(19,7)")}), 3),
    f"""SELECT r.src, r.target, CAST(25 AS DECIMAL(19,7)) AS receive, CAST(5 AS DECIMAL(19,7)) AS send_max, round(25.0 / CAST(rate AS DOUBLE), 7) AS spend, coalesce(round(25.0 / CAST(rate AS DOUBLE), 7) <= 5, false) AS within
    FROM {_PAIRS} r LEFT JOIN ({_quoted(3)}) q ON q.src = r.src AND q.target = r.target""",
)
add(
    "jn13d_strict_send",
    lambda t: J.strict_send(_edges(t), _pairs(t).withColumn("send", F.lit(10).cast("decimal(19,7)")), 3),
    f"SELECT r.src, r.target, CAST(10 AS DECIMAL(19,7)) AS send, round(CAST(10 AS DOUBLE) * rate, 7) AS received FROM {_PAIRS} r LEFT JOIN ({_quoted(3)}) q ON q.src = r.src AND q.target = r.target",
)


# Quotes for an amount: books of the offers, the pools of a pair of codes as one, what was traded as requests.
def _markets(t: Tables):
    known = reserves(t).where("place is not null and kind <> 'unknown'")
    side = lambda n, c: known.where(F.col("place") == n).select("id", F.col("code").alias(c), F.col("amount").alias(f"{c}_amount"), "fee_percent")
    pairs = side(0, "a").join(side(1, "b").drop("fee_percent"), "id").where("a <> b").groupBy("a", "b").agg(F.sum("a_amount").alias("x"), F.sum("b_amount").alias("y"), F.max("fee_percent").alias("fee_percent"))
    one = lambda n, c, amount: F.struct(F.lit(n).alias("place"), F.lit("issued").alias("kind"), F.col(c).alias("asset"), F.col(amount).cast("decimal(38,7)").alias("amount"))
    pools = pairs.select(F.concat_ws("|", "a", "b").alias("id"), "fee_percent", F.inline(F.array(one(0, "a", "x"), one(1, "b", "y"))))
    return M.book_markets(offers(t)).unionByName(M.pool_markets(pools))


def _asks(t: Tables):
    volumes = trades(t).where("base_asset <> counter_asset").groupBy("base_asset", "counter_asset").agg(F.max("base_amount").alias("amount"))
    return volumes.select(F.concat_ws("/", "counter_asset", "base_asset").alias("request"), F.col("counter_asset").alias("src"), F.col("base_asset").alias("target"), "amount", (F.col("amount") * 3).cast("decimal(38,7)").alias("send_max"))


def _routed(receive: bool) -> str:
    """(request, amount) of the best of all paths of at most three markets."""
    there, begin, goal, best = ("src", "target", "src", "min") if receive else ("dst", "src", "target", "max")
    book = "b.bi + (l.amount - b.bo) * b.price AS v FROM {0} l JOIN b ON b.dst = l.here AND l.amount > b.bo AND l.amount <= b.bo + b.given" if receive else "b.bo + (l.amount - b.bi) / b.price AS v FROM {0} l JOIN b ON b.src = l.here AND l.amount > b.bi AND l.amount <= b.bi + b.taken"
    pool = "p.ri * l.amount / (p.ro - l.amount) / p.keep AS v FROM {0} l JOIN p ON p.dst = l.here AND l.amount < p.ro" if receive else "p.ro * (l.amount * p.keep) / (p.ri + l.amount * p.keep) AS v FROM {0} l JOIN p ON p.src = l.here"
    on = lambda n: f"(SELECT * FROM l{n} WHERE here <> goal)"
    step = lambda n: f"l{n + 1} AS (SELECT request, here, goal, start, v AS amount FROM (SELECT l.request, l.goal, l.start, b.{there} AS here, {book.format(on(n))} UNION ALL SELECT l.request, l.goal, l.start, p.{there} AS here, {pool.format(on(n))}) WHERE v > 0 AND here <> start)"
    return f"""WITH lv AS (SELECT *, CAST(round(CAST(given AS DOUBLE) * price, 7) AS DECIMAL(38,7)) AS taken FROM (SELECT selling, buying, price, CAST(sum(amount) AS DECIMAL(38,7)) AS given FROM {NO} WHERE price > 0 AND amount > 0 AND selling <> buying GROUP BY ALL)),
    b AS (SELECT buying AS src, selling AS dst, price, CAST(given AS DOUBLE) AS given, CAST(taken AS DOUBLE) AS taken, CAST(coalesce(sum(taken) OVER w, 0) AS DOUBLE) AS bi, CAST(coalesce(sum(given) OVER w, 0) AS DOUBLE) AS bo FROM lv WINDOW w AS (PARTITION BY selling, buying ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT id, place, code, amount, fee_percent FROM {NR} WHERE place IS NOT NULL AND kind <> 'unknown'),
    g AS (SELECT x.code AS a, y.code AS b, CAST(CAST(sum(x.amount) AS DECIMAL(38,7)) AS DOUBLE) AS x, CAST(CAST(sum(y.amount) AS DECIMAL(38,7)) AS DOUBLE) AS y, 1 - max(x.fee_percent) / 100 AS keep FROM k x JOIN k y ON x.id = y.id AND x.place = 0 AND y.place = 1 WHERE x.code <> y.code GROUP BY ALL),
    p AS (SELECT a AS src, b AS dst, x AS ri, y AS ro, keep FROM g WHERE x > 0 AND y > 0 UNION ALL SELECT b, a, y, x, keep FROM g WHERE x > 0 AND y > 0),
    q AS (SELECT concat(counter_asset, '/', base_asset) AS request, counter_asset AS src, base_asset AS target, max(base_amount) AS amount FROM {NT} WHERE base_asset <> counter_asset GROUP BY ALL),
    l0 AS (SELECT request, {begin} AS here, {goal} AS goal, {begin} AS start, CAST(amount AS DOUBLE) AS amount FROM q WHERE amount > 0),
    {", ".join(map(step, range(3)))}, f AS (SELECT request, {best}(amount) AS amount FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE here = goal GROUP BY request)
    SELECT q.request, src, target, q.amount, """


_UNROUTED = "FROM q LEFT JOIN f ON f.request = q.request"
add("jn13e_quote_send", lambda t: M.quote_send(_markets(t), _asks(t).drop("send_max"), 3).drop("path"), _routed(False) + f"round(f.amount, 7) AS received {_UNROUTED}")
add(
    "jn13f_quote_receive",
    lambda t: M.quote_receive(_markets(t), _asks(t), 3).drop("path"),
    _routed(True) + f"CAST(q.amount * 3 AS DECIMAL(38,7)) AS send_max, round(f.amount, 7) AS spent, coalesce(round(f.amount, 7) <= CAST(CAST(q.amount * 3 AS DECIMAL(38,7)) AS DOUBLE), false) AS within {_UNROUTED}",
)
add(
    "jn15_account_relationships",
    lambda t: J.account_relationships(t.raw_accounts, t.trustlines, t.effects, payments(t)),
    f"""SELECT account, kind, other, count(*) AS n FROM (SELECT id AS account, 'signer' AS kind, s.key AS other FROM (SELECT id, unnest(signers) AS s FROM raw_accounts) UNION ALL SELECT account, 'issuer', asset_issuer FROM trustlines
    UNION ALL SELECT account, 'sponsor', sponsor FROM effects UNION ALL SELECT source, 'counterparty', destination FROM {NP} UNION ALL SELECT destination, 'counterparty', source FROM {NP}) WHERE account <> other GROUP BY 1, 2, 3""",
)
_LATER = "CASE WHEN last_modified_ledger % 7 = 0 THEN 'new' WHEN last_modified_ledger % 4 <> 0 THEN value END"
add(
    "jn17_diff_storage",
    lambda t: J.diff_storage(t.storage, t.storage.withColumn("value", F.expr(_LATER))),
    f"SELECT *, CASE WHEN before IS NULL OR after IS NULL THEN 'unavailable' WHEN before = after THEN 'identical' ELSE 'changed' END AS state FROM (SELECT contract_id, key, durability, value AS before, {_LATER} AS after FROM storage)",
)
add(
    "jn18_config_drift",
    lambda t: J.config_drift(accounts(t), accounts(t).groupBy("home_domain").agg(*[F.min(c).alias(c) for c in J.CONFIGURED]), "home_domain"),
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT a.id, '{c}' AS setting, a.{c} AS actual, e.{c} AS expected FROM {NU} a JOIN (SELECT home_domain, min({c}) AS {c} FROM {NU} GROUP BY home_domain) e ON e.home_domain = a.home_domain" for c in J.CONFIGURED)
    + ") WHERE actual IS DISTINCT FROM expected",
)

# ---------------------------------------------------------------- aggregates

add(
    "agg1b_market_summary",
    lambda t: A.trade_summary(trades(t), ()),
    f"""SELECT *, CASE WHEN base_volume = 0 THEN 0.0 ELSE round(CAST(counter_volume AS DOUBLE) / CAST(base_volume AS DOUBLE), 6) END AS vwap FROM (SELECT count(*) AS trades, {MONEY.format('coalesce(sum(base_amount), 0)')} AS base_volume,
    {MONEY.format('coalesce(sum(counter_amount), 0)')} AS counter_volume, coalesce(round(avg(price), 6), 0.0) AS mean_price, coalesce(max(price), 0.0) AS high, coalesce(min(price), 0.0) AS low, min(close_time) AS first_time, max(close_time) AS last_time,
    count(*) FILTER (WHERE venue = 'orderbook') AS orderbook_trades, count(*) FILTER (WHERE venue = 'liquidity_pool') AS pool_trades FROM {NT})""",
)
add(
    "agg4b_effects_overview",
    lambda t: A.effects_overview(A.ledger_effects_summary(N.index_effects(t.effects))),
    f"SELECT count(*) AS ledgers, {BIG.format('sum(n)')} AS effects, {BIG.format('sum(x)')} AS transactions FROM (SELECT ledger, count(*) AS n, count(DISTINCT toid // 4096) AS x FROM {NE} GROUP BY ledger)",
)
add(
    "agg8b_contract_event_totals",
    lambda t: A.contract_event_totals(events(t)),
    f"SELECT count(*) AS events, count(*) FILTER (WHERE NOT successful) AS failed, min(ledger) FILTER (WHERE ledger > 0) AS first_ledger, max(ledger) FILTER (WHERE ledger > 0) AS last_ledger, count(DISTINCT nullif(contract_id, '')) AS contracts, count(DISTINCT nullif(tx_hash, '')) AS transactions FROM {NC}",
)
add(
    "agg9_most_active_contract",
    lambda t: A.most_active(events(t).withColumn("position", F.col("paging_token").cast("long")), "contract_id", 1, "position"),
    f"SELECT contract_id, n FROM (SELECT contract_id, count(*) AS n, min(CAST(paging_token AS BIGINT)) AS f FROM {NC} WHERE contract_id <> '' GROUP BY contract_id) ORDER BY n DESC, f LIMIT 1",
)
add(
    "agg11b_offer_totals_by_seller",
    lambda t: A.offer_totals(offers(t), ("seller",)),
    f"SELECT seller, selling AS asset, 'selling' AS side, {MONEY.format('sum(amount)')} AS total FROM {NO} GROUP BY seller, selling UNION ALL SELECT seller, buying, 'buying', {MONEY.format('sum(CAST(buying_amount AS DECIMAL(38,7)))')} FROM {NO} GROUP BY seller, buying",
)
_LEAST = f"(SELECT selling, buying, min(price) AS least FROM (SELECT selling, buying, price FROM {NO} UNION ALL SELECT buying, selling, 2 / nullif(price, 0) FROM {NO}) WHERE price > 0 GROUP BY ALL)"
add(
    "agg12b_best_prices",
    lambda t: A.best_prices(offers(t).unionByName(offers(t).withColumns({"selling": F.col("buying"), "buying": F.col("selling"), "price": F.try_divide(F.lit(2.0), "price")}))),
    f"SELECT coalesce(a.selling, b.buying) AS base, coalesce(a.buying, b.selling) AS counter, a.least AS best_ask, 1 / b.least AS best_bid, round(a.least - 1 / b.least, 7) AS spread FROM {_LEAST} a FULL JOIN {_LEAST} b ON a.selling = b.buying AND a.buying = b.selling",
)
_POOLS = f"count(*) FILTER (WHERE coalesce(place, 0) = 0) AS pools, count(place) AS reserve_entries, CAST(coalesce(sum(participants) FILTER (WHERE coalesce(place, 0) = 0), 0) AS BIGINT) AS participants FROM {NR}"
add("agg13_pool_summary", lambda t: A.pool_summary(reserves(t)), f"SELECT {_POOLS}")
add("agg13b_pool_summary_by_type", lambda t: A.pool_summary(reserves(t), ("type",)), f"SELECT type, {_POOLS} GROUP BY type")
add(
    "agg14b_pool_positions",
    lambda t: A.pool_positions(reserves(t), t.raw_accounts),
    f"""SELECT account, pool, asset, shares, round(CAST(amount AS DOUBLE) * coalesce(CAST(shares AS DOUBLE) / CAST(nullif(total_shares, 0) AS DOUBLE), 0.0), 6) AS amount FROM (SELECT id AS account, b.liquidity_pool_id AS pool, CAST(coalesce(TRY_CAST(b.balance AS DECIMAL(19,7)), 0) AS DECIMAL(19,7)) AS shares
    FROM (SELECT id, unnest(balances) AS b FROM raw_accounts) WHERE b.asset_type = 'liquidity_pool_shares') s JOIN {NR} r ON r.id = s.pool WHERE r.place IS NOT NULL""",
)
add(
    "agg14c_pool_price_bounds",
    lambda t: A.pool_price_bounds(reserves(t)),
    f"SELECT id, spot, round(spot - spot * 0.02, 7) AS min_price, round(spot + spot * 0.02, 7) AS max_price FROM (SELECT id, CAST(max(amount) FILTER (WHERE place = 1) AS DOUBLE) / CAST(nullif(max(amount) FILTER (WHERE place = 0), 0) AS DOUBLE) AS spot FROM {NR} GROUP BY id) WHERE spot IS NOT NULL",
)
add(
    "agg17_asset_stats",
    lambda t: A.asset_stats(t.trustlines, t.raw_claimables.select("asset", F.col("amount").cast("decimal(19,7)").alias("amount")), reserves(t)),
    "SELECT asset, "
    + ", ".join(f"count(*) FILTER (WHERE place = '{p}') AS {p}_count, {MONEY.format(f'coalesce(sum(amount) FILTER (WHERE place = {chr(39)}{p}{chr(39)}), 0)')} AS {p}_amount" for p in A.PLACES)
    + f""", {MONEY.format('sum(amount)')} AS supply FROM (SELECT asset_code || ':' || asset_issuer AS asset, CASE WHEN is_authorized THEN 'authorized' WHEN is_authorized_to_maintain_liabilities THEN 'maintain' ELSE 'unauthorized' END AS place, {MONEY.format('balance')} AS amount FROM trustlines
    UNION ALL SELECT asset, 'claimable', CAST(CAST(amount AS DECIMAL(19,7)) AS DECIMAL(38,7)) FROM raw_claimables UNION ALL SELECT asset, 'pool', amount FROM {NR} WHERE place IS NOT NULL) WHERE asset <> 'native' GROUP BY asset""",
)
_Q = "percentile_disc({0}) WITHIN GROUP (ORDER BY fee_charged) AS p{1}"
_FEES = f"SELECT ledger // 1000 AS bucket, min(fee_charged) AS min_fee, {', '.join(_Q.format(p / 100, p) for p in (50, 90, 95, 99))} FROM {NX} GROUP BY 1"
_MODE = f"SELECT bucket, arg_max(fee, n * 1000000 - fee) AS mode_fee FROM (SELECT ledger // 1000 AS bucket, fee_charged AS fee, count(*) AS n FROM {NX} GROUP BY 1, 2) GROUP BY bucket"
_LOAD = f"SELECT sequence // 1000 AS bucket, arg_max(base_fee, sequence) AS base_fee, round(CAST(sum(operation_count) AS DOUBLE) / CAST(nullif(sum(max_tx_set_size), 0) AS DOUBLE), 4) AS capacity_usage FROM {NL} GROUP BY 1"
_STATS = f"(SELECT f.bucket, min_fee, mode_fee, p50, p90, p95, p99, coalesce(base_fee, 100) AS base_fee, capacity_usage, greatest(coalesce(base_fee, 100), p90) AS recommended FROM ({_FEES}) f JOIN ({_MODE}) m ON m.bucket = f.bucket LEFT JOIN ({_LOAD}) l ON l.bucket = f.bucket)"
_stats = lambda t: A.fee_stats(transactions(t), ledgers(t))
add("agg18_fee_stats", _stats, f"SELECT * FROM {_STATS}")
add(
    "agg19_fee_estimates",
    lambda t: A.fee_estimates(_stats(t)),
    f"SELECT bucket, operations, greatest(base_fee, p50) * operations AS low, greatest(base_fee, p50, p90) * operations AS recommended, greatest(base_fee, p50, p90, p99) * operations AS high FROM {_STATS} CROSS JOIN (SELECT unnest([1::BIGINT, 2, 10]) AS operations)",
)
add("agg20_failure_summary", lambda t: A.failure_summary(transactions(t)), f"SELECT result_code, count(*) AS n FROM {NX} WHERE status = 'failed' GROUP BY result_code")
add(
    "agg20b_failing_operations",
    lambda t: A.failing_operations(transactions(t)),
    f"SELECT hash, result_code, CAST(i - 1 AS INTEGER) AS failing_index, operation_codes[i] AS failing_code FROM (SELECT *, nullif(coalesce(list_position(list_transform(operation_codes, lambda c: c <> 'op_success'), true), 0), 0) AS i FROM {NX} WHERE status = 'failed')",
)
add("agg20c_operation_code_counts", lambda t: A.operation_code_counts(transactions(t)), f"SELECT code, count(*) AS n FROM (SELECT unnest(operation_codes) AS code FROM {NX} WHERE status = 'failed') GROUP BY code")
add(
    "agg21_counterparties",
    lambda t: A.counterparties(t.raw_operations),
    'SELECT account, counterparty, count(*) AS n FROM (SELECT DISTINCT id, source_account AS account, unnest([source_account, funder, account, "to", "from", "into"]) AS counterparty FROM raw_operations) WHERE account <> \'\' AND counterparty <> \'\' AND counterparty <> account GROUP BY ALL',
)
_NEED = f"(SELECT id, native_balance, (2 + greatest(0, subentry_count - num_sponsored + num_sponsoring)) * 5000000 AS reserve_stroops, CAST(native_balance - CAST((2 + greatest(0, subentry_count - num_sponsored + num_sponsoring)) * 0.5 AS DECIMAL(19,7)) AS DECIMAL(38,7)) AS available FROM {NU})"
add(
    "agg23b_reserve_totals",
    lambda t: A.reserve_totals(A.reserve_requirements(accounts(t).withColumnRenamed("native_balance", "balance"))),
    f"SELECT count(*) AS accounts, count(*) FILTER (WHERE available <= 0) AS at_or_below, {BIG.format('sum(reserve_stroops)')} AS reserve_stroops, {MONEY.format('sum(available)')} AS available FROM {_NEED}",
)
add(
    "agg24_reserve_impact",
    lambda t: A.reserve_impact(accounts(t), ledgers(t)),
    f"""SELECT id, b AS entries_b, 2 + subentry_count AS entries_unsponsored, num_sponsoring * r AS responsibility, num_sponsored * r AS relief, b * r AS minimum, (2 + subentry_count) * r AS minimum_unsponsored
    FROM (SELECT *, greatest(0, 2 + subentry_count + num_sponsoring - num_sponsored) AS b FROM {NU}), (SELECT arg_max(base_reserve, sequence) AS r FROM {NL})""",
)
_MASK = "CAST(auth_required AS INT) + 2 * CAST(auth_revocable AS INT) + 4 * CAST(auth_immutable AS INT) + 8 * CAST(auth_clawback_enabled AS INT)"
_NOTED = """list_filter([CASE WHEN auth_immutable THEN 'immutable' END, CASE WHEN auth_required AND auth_revocable THEN 'gated_and_freezable' END, CASE WHEN auth_revocable AND NOT auth_required THEN 'freezable' END, CASE WHEN auth_required AND NOT auth_revocable THEN 'gated' END,
    CASE WHEN auth_clawback_enabled THEN 'clawback' END, CASE WHEN auth_clawback_enabled AND NOT auth_revocable THEN 'clawback_without_revocable' END, CASE WHEN primary_weight = 0 AND other_signers > 0 THEN 'master_disabled' END,
    CASE WHEN primary_weight = 0 AND other_signers = 0 THEN 'locked' END, CASE WHEN auth_immutable AND primary_weight = 0 THEN 'locked_issuer' END], lambda x: x IS NOT NULL)"""
add("agg25_flag_audit", lambda t: A.flag_audit(accounts(t)), f"SELECT id, {_MASK} AS mask, {_MASK} = 0 AS defaults, primary_weight = 0 AND other_signers = 0 AS locked, {_NOTED} AS findings FROM {NU}")
add("agg25b_finding_counts", lambda t: A.finding_counts(A.flag_audit(accounts(t))), f"SELECT finding, count(*) AS n FROM (SELECT unnest({_NOTED}) AS finding FROM {NU}) GROUP BY finding")
_MEETS = ", ".join(f"{weight} >= greatest(1, {n}_threshold) AS {who}_{n}" for who, weight in (("master", "primary_weight"), ("all", "total_weight")) for n in A.LEVELS)
add("agg26_signing_power", lambda t: A.signing_power(accounts(t)), f"SELECT id, {_MEETS}, total_weight = 0 AS locked FROM {NU}")
add(
    "agg26b_signing_counts",
    lambda t: A.signing_counts(A.signing_power(accounts(t))),
    " UNION ALL ".join(f"SELECT '{n}' AS level, count(*) FILTER (WHERE primary_weight >= greatest(1, {n}_threshold)) AS master, count(*) FILTER (WHERE total_weight >= greatest(1, {n}_threshold)) AS \"all\" FROM {NU}" for n in A.LEVELS),
)
add(
    "agg27b_headroom_totals",
    lambda t: A.headroom_totals(A.trustline_headroom(t.trustlines)),
    'SELECT asset_code, count(*) AS lines, count(*) FILTER (WHERE "limit" = 922337203685.4775807) AS unlimited, count(*) FILTER (WHERE balance = 0) AS removable, CAST(coalesce(sum("limit" - balance - buying_liabilities) FILTER (WHERE "limit" <> 922337203685.4775807), 0) AS DECIMAL(38,7)) AS headroom FROM trustlines GROUP BY asset_code',
)


def _predicate_sql(p: str, holds: bool, depth: int = 3) -> str:
    """The text of a predicate (JSON), or whether it holds at 500 for a balance of time `created`."""
    x = f"x{depth}"
    at = lambda key: f"json_extract_string({p}, '$.{key}')"
    inside = lambda key: f"json_extract({p}, '$.{key}')"
    if holds:
        out = f"CASE WHEN {inside('unconditional')} IS NOT NULL THEN CAST({at('unconditional')} AS BOOLEAN) WHEN {inside('before_absolute_time')} IS NOT NULL THEN 500 < TRY_CAST({at('before_absolute_time')} AS BIGINT) WHEN {inside('before_relative_time')} IS NOT NULL THEN 500 < created + TRY_CAST({at('before_relative_time')} AS BIGINT)"
    else:
        out = f"CASE WHEN {inside('unconditional')} IS NOT NULL THEN 'unconditional'" + "".join(f" WHEN {inside(k)} IS NOT NULL THEN '{k}(' || {at(k)} || ')'" for k in ("before_absolute_time", "before_relative_time"))
    if depth > 1:
        deeper = _predicate_sql(inside("not"), holds, depth - 1)
        out += f" WHEN {inside('not')} IS NOT NULL THEN " + (f"NOT ({deeper})" if holds else f"'not(' || {deeper} || ')'")
        for word in ("and", "or"):
            each = f"list_transform(json_extract({p}, '$.{word}[*]'), lambda {x}: {_predicate_sql(x, holds, depth - 1)})"
            whole = f"list_bool_{word}({each})" if holds else f"'{word}(' || array_to_string({each}, ', ') || ')'"
            out += f" WHEN {inside(word)} IS NOT NULL THEN {whole}"
    return out + (" END" if holds else " ELSE 'unknown' END")


add(
    "agg29_claimable_at",
    lambda t: A.claimable_at(t.raw_claimables, 500, "last_modified_ledger"),
    f"SELECT id, destination, {_predicate_sql('p', False)} AS predicate, {_predicate_sql('p', True)} AS claimable FROM (SELECT id, created, c.destination, CAST(c.predicate AS JSON) AS p FROM (SELECT id, last_modified_ledger AS created, unnest(claimants) AS c FROM raw_claimables))",
)
add(
    "agg31b_memo_deposits",
    lambda t: A.memo_deposits(payments(t), transactions(t)),
    f"SELECT destination, memo_type, memo, count(*) AS n, {MONEY.format('coalesce(sum(amount), 0)')} AS amount FROM {NP} p LEFT JOIN {NX} x ON x.hash = p.transaction_hash GROUP BY ALL",
)
_COUNT = "count(*) FILTER (WHERE status = '{0}') AS {0}"
add(
    "agg33_simulation_profile",
    lambda t: A.simulation_profile(_raw_simulations(t)),
    f"SELECT contract_id, count(*) AS n, {', '.join(map(_COUNT.format, ('success', 'error', 'restore')))}, {', '.join(BIG.format(f'sum({c})') + f' AS {c}' for c in ('instructions', 'read_bytes', 'write_bytes'))}, 2 * count(*) AS read_only_keys, count(*) AS read_write_keys, "
    + ", ".join(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY min_resource_fee) AS fee_p{p}" for p in (50, 90, 99))
    + " FROM simulations GROUP BY contract_id",
)
# Messages that the rule sets tell apart, by event.
_LOGS = (
    "Error: account not found", "tx_too_late", "Missing value for key", "host invocation failed: trap", "auth required", "other thing", "Unknown method f", "argument count", "entry archived", "txTooEarly", "HostValidationError", "missing function g",
    "contract does not exist", "SymbolNotFound", "TRY_AGAIN_LATER", "invalid contract id",
)
_MESSAGE = "CASE id % {} ".format(len(_LOGS)) + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_LOGS)) + " END"
_has = lambda parts: "(" + " OR ".join(f"contains(lower(message), '{p}')" for p in parts) + ")"
for _name, _rules in A.RULE_SETS.items():
    add(
        f"agg36_triage_errors_{_name}",
        lambda t, rules=_rules: A.triage_errors(t.simulations.select(F.expr(_MESSAGE).alias("message")), rules),
        "SELECT CASE " + " ".join(f"WHEN {_has(some)}{' AND ' + _has(also) if also else ''} THEN '{name}'" for name, some, also in _rules) + f" ELSE 'unknown' END AS class, count(*) AS n FROM (SELECT {_MESSAGE} AS message FROM simulations) GROUP BY 1",
    )
_LEFT = "live_until_ledger - 50010000"
add(
    "agg37_ttl_report",
    lambda t: A.ttl_report(t.storage, 50010000),
    f"SELECT contract_id, durability, CASE WHEN {_LEFT} <= 0 THEN 'expired' WHEN {_LEFT} < 17280 THEN 'expiring' ELSE 'healthy' END AS state, count(*) AS n, min({_LEFT}) AS least_left, greatest(0, min({_LEFT})) * 5 AS least_seconds FROM storage GROUP BY 1, 2, 3",
)
_RESTORED = "(contract_id, key, durability) IN (SELECT (contract_id, CAST(k AS VARCHAR), d) FROM (SELECT contract_id, unnest([id % 7, id % 9, id % 11]) AS k, unnest(['persistent', 'temporary', 'persistent']) AS d FROM simulations WHERE status = 'restore'))"
add(
    "agg38_archive_status",
    lambda t: A.archive_status(t.storage, _raw_simulations(t), 50010000),
    f"""SELECT contract_id, CASE WHEN {_RESTORED} OR live_until_ledger < 50010000 THEN 'archived' WHEN live_until_ledger IS NULL THEN 'unknown' ELSE 'accessible' END AS state, count(*) AS n FROM storage GROUP BY 1, 2""",
)
add(
    "agg42_ledger_profile",
    lambda t: A.ledger_profile(ledgers(t)),
    f"""SELECT sequence // 100 AS bucket, {BIG.format('sum(successful_transaction_count)')} AS ok, {BIG.format('sum(failed_transaction_count)')} AS failed, {BIG.format('sum(operation_count)')} AS operations,
    round(CAST(sum(failed_transaction_count) AS DOUBLE) / CAST(nullif(sum(successful_transaction_count) + sum(failed_transaction_count), 0) AS DOUBLE), 6) AS failure_rate, CAST(arg_max(base_fee, sequence) / 10000000 AS DECIMAL(19,7)) AS base_fee,
    CAST(arg_max(base_reserve, sequence) / 10000000 AS DECIMAL(19,7)) AS base_reserve, array_to_string(list_sort(list(DISTINCT protocol_version)), ',') AS protocols FROM {NL} GROUP BY 1""",
)
add("agg44_operation_types", lambda t: A.operation_types(t.operations), "SELECT source_account, type, count(*) AS n FROM operations GROUP BY ALL UNION ALL SELECT NULL, type, count(*) FROM operations GROUP BY type")
add(
    "agg45_storage_summary",
    lambda t: A.storage_summary(J.probe_storage(t.storage.withColumn("value", F.expr("if(last_modified_ledger % 9 = 0, 'no json', value)")), t.storage.select("contract_id", "key").distinct())),
    """SELECT d.durability, count(s.key) AS found, count(*) - count(s.key) AS missing, count(*) FILTER (WHERE s.value IS NOT NULL AND s.last_modified_ledger % 9 = 0) AS undecodable
    FROM (SELECT DISTINCT contract_id, key FROM storage) k CROSS JOIN (SELECT 'persistent' AS durability UNION ALL SELECT 'temporary') d LEFT JOIN storage s ON s.contract_id = k.contract_id AND s.key = k.key AND s.durability = d.durability GROUP BY 1""",
)
_SPANS = {"ledgers": (NL, "sequence"), "transactions": (NX, "ledger"), "payments": (NP, "ledger"), "trades": (NT, "ledger"), "contract_events": ("(SELECT nullif(ledger, 0) AS ledger FROM raw_contract_events)", "ledger")}
add(
    "agg46_coverage",
    lambda t: A.coverage({"ledgers": (ledgers(t), "sequence"), "transactions": (transactions(t), "ledger"), "payments": (payments(t), "ledger"), "trades": (trades(t), "ledger"), "contract_events": (t.raw_contract_events, "ledger")}),
    " UNION ALL ".join(f"SELECT '{n}' AS resource, min({c}) AS oldest, max({c}) AS newest, max({c}) - min({c}) + 1 - count(DISTINCT {c}) AS missing FROM {sql}" for n, (sql, c) in _SPANS.items()),
)

# ---------------------------------------------------------------- windows, order, sets, quality

add(
    "win3_sequence_gaps",
    lambda t: W.sequence_gaps(t.transactions, ["o_orderkey"]),
    "SELECT source_account, o_orderkey, step, CASE WHEN step = 0 THEN 'repeat' WHEN step < 0 THEN 'regression' WHEN step > 1 THEN 'gap' END AS kind FROM (SELECT source_account, o_orderkey, CAST(source_sequence - lag(source_sequence) OVER (PARTITION BY source_account ORDER BY o_orderkey) AS BIGINT) AS step FROM transactions) WHERE step IS NOT NULL AND step <> 1",
)
add(
    "win4_ledger_chain",
    lambda t: J.ledger_chain(ledgers(t)),
    f"SELECT l.sequence, CASE WHEN b.sequence IS NULL THEN 'gap' WHEN b.hash IS DISTINCT FROM l.prev_hash THEN 'hash' END AS problem, l.closed_at - b.closed_at AS interval FROM {NL} l LEFT JOIN {NL} b ON b.sequence + 1 = l.sequence",
)
add("top1_ordered_counts", lambda t: A.ordered_counts(t.effects, "type"), "SELECT type, count(*) AS n FROM effects GROUP BY type ORDER BY n DESC, type")
add("top2_newest", lambda t: A.newest(t.effects.select("event_id", "ledger"), "event_id", 1000), "SELECT event_id, ledger FROM effects ORDER BY event_id DESC LIMIT 200")


def _kinds(t: Tables):
    """The payment-like operations apart, each without the columns that its kind does not have."""
    raw = t.raw_payments
    paths = [c for c in raw.columns if c.startswith(("source_a", "destination_")) and c != "source_account"]
    plain = raw.where("coalesce(type, 'payment') = 'payment'").drop(*paths, "funder", "account", "starting_balance", "into", "into_muxed")
    path = raw.where("type like 'path%'").drop("funder", "account", "starting_balance", "into", "into_muxed")
    created = raw.where("type = 'create_account'").drop(*paths, "from", "from_muxed", "to", "to_muxed", "amount", "into", "into_muxed")
    merged = raw.where("type = 'account_merge'").drop(*paths, "from", "from_muxed", "to", "to_muxed", "amount", "funder", "starting_balance")
    return A.union_payment_kinds(plain, path, created, merged)


add("set1_union_payment_kinds", lambda t: N.normalize_payments(_kinds(t)).select("id", "type", "source", "destination", "amount"), f"SELECT id, type, source, destination, amount FROM {NP}")
add(
    "set3_batch_overlap",
    lambda t: Q.batch_overlap(t.claimables.select(F.col("id").alias("balance_id")), t.effects.where("balance_id is not null").select("event_id", "balance_id"), "balance_id"),
    "SELECT event_id, balance_id, balance_id IN (SELECT id FROM claimables) AS repeated FROM effects WHERE balance_id IS NOT NULL",
)


def _archived_tokens(t: Tables):
    path = S.shared_folder(t.spark, "tokens")
    S.store_by_ledger(t.events.select("event_id").where("event_id % 3 <> 1"), path, "event_id", 1000)
    archive = t.spark.read.schema("event_id long, bucket long").parquet(path)
    return Q.stored_overlap(archive, t.contract_events.where("event_id % 2 = 0").select("event_id", "contract_id"), "event_id", 1000)


add("set3b_stored_overlap", _archived_tokens, "SELECT event_id, contract_id, event_id % 3 <> 1 AS repeated FROM contract_events WHERE event_id % 2 = 0")
_USES = {"payments": f"SELECT asset, ledger FROM {NP}", "trades": f"SELECT base_asset, ledger FROM {NT} UNION ALL SELECT counter_asset, ledger FROM {NT}", "offers": f"SELECT selling, last_modified_ledger FROM {NO} UNION ALL SELECT buying, last_modified_ledger FROM {NO}", "pools": f"SELECT asset, last_modified_ledger FROM {NR}"}
add(
    "qlt1_asset_dimension",
    lambda t: Q.asset_dimension({"payments": (payments(t), "asset"), "trades": (trades(t), "base_asset", "counter_asset"), "offers": (offers(t).withColumnRenamed("last_modified_ledger", "ledger"), "selling", "buying"), "pools": (reserves(t).withColumnRenamed("last_modified_ledger", "ledger"), "asset")}),
    "SELECT asset, count(*) AS uses, "
    + ", ".join(f"count(*) FILTER (WHERE r = '{n}') AS {n}_uses" for n in _USES)
    + ", min(ledger) AS first_ledger, max(ledger) AS last_ledger, CASE WHEN asset = 'native' THEN 'XLM (native)' ELSE asset END AS label FROM ("
    + " UNION ALL ".join(f"SELECT *, '{n}' AS r FROM ({sql}) u(asset, ledger)" for n, sql in _USES.items())
    + ") WHERE asset IS NOT NULL AND asset <> '' GROUP BY asset",
)
add(
    "qlt2_audit_asset_refs",
    lambda t: Q.audit_asset_refs(t.pools.withColumn("asset_c", F.concat(F.lit("C"), (F.col("p_partkey") % 25).cast("string"), F.lit(":G1"))), ["asset_a", "asset_b", "asset_c"]),
    """SELECT name, CASE WHEN coalesce(ref, '') = '' THEN 'empty' WHEN ref = 'native' OR regexp_matches(ref, '^[A-Za-z0-9]{1,12}:[A-Za-z0-9]+$') THEN 'ok' WHEN instr(ref, ':') = 0 THEN 'no_issuer' ELSE 'malformed' END AS reason, count(*) AS n
    FROM (SELECT 'asset_a' AS name, asset_a AS ref FROM pools UNION ALL SELECT 'asset_b', asset_b FROM pools UNION ALL SELECT 'asset_c', 'C' || (p_partkey % 25) || ':G1' FROM pools) GROUP BY ALL""",
)
_RATIONAL = "CASE WHEN TRY_CAST({0}.d AS DECIMAL(20,0)) <> 0 THEN CAST(TRY_CAST({0}.n AS DECIMAL(20,0)) AS DOUBLE) / CAST(TRY_CAST({0}.d AS DECIMAL(20,0)) AS DOUBLE) END"
add(
    "qlt3_price_source_report",
    lambda t: Q.price_source_report(t.raw_trades, t.raw_offers),
    f"""SELECT resource, CASE WHEN r IS NOT NULL THEN 'rational' WHEN o IS NOT NULL THEN 'amounts' ELSE 'none' END AS source, count(*) AS n, count(*) FILTER (WHERE abs(r - o) > 0.01 * o) AS disagree FROM (
    SELECT 'trades' AS resource, {_RATIONAL.format('price')} AS r, CASE WHEN TRY_CAST(base_amount AS DOUBLE) > 0 THEN TRY_CAST(counter_amount AS DOUBLE) / TRY_CAST(base_amount AS DOUBLE) END AS o FROM raw_trades
    UNION ALL SELECT 'offers', {_RATIONAL.format('price_r')}, TRY_CAST(price AS DOUBLE) FROM raw_offers) GROUP BY 1, 2""",
)
add(
    "qlt4_id_report",
    lambda t: Q.id_report({"effects": t.raw_effects, "trades": t.raw_trades, "operations": t.raw_operations}),
    " UNION ALL ".join(
        f"SELECT '{n}' AS resource, CASE WHEN coalesce(id, '') = '' THEN 'empty' WHEN regexp_matches(id, '{Q.ID_FORMS[n]}') AND TRY_CAST(split_part(id, '-', 1) AS BIGINT) IS NOT NULL THEN 'decodes' ELSE 'malformed' END AS pattern, count(*) AS n FROM raw_{n} GROUP BY 2"
        for n in ("effects", "trades", "operations")
    ),
)

# ---------------------------------------------------------------- streams

_stream = lambda t: R.payment_stream(R.stream_payments(t.spark, _stored(t, t.raw_payments, "payments")))
_events = lambda t: R.stream_events(t.spark, t.folder)


def _stopped_and_resumed(t: Tables):
    """A run over the earlier events, then another with its checkpoint over all, some repeated: nothing comes twice."""
    folder = S.shared_folder(t.spark, "arriving")
    middle = t.events.agg(F.timestamp_seconds(F.avg(F.unix_seconds(F.col("ts").cast("timestamp"))))).first()[0]
    halves = t.events.withColumn("late", F.col("ts") > F.lit(middle))
    where = S.shared_folder(t.spark, "resumed")

    def run():
        stream = t.spark.readStream.schema(t.events.schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
        return R.run_bounded(R.resumable(stream, "event_id", "ts").select("event_id"), t.spark, where=where)

    halves.where("not late").drop("late").write.parquet(folder)
    run()
    rest = halves.where("late").drop("late")
    rest.unionByName(rest).write.mode("append").parquet(folder)
    return run()


add("str1_payment_stream", lambda t: R.run_bounded(_stream(t), t.spark), f"SELECT * FROM {NP}")
add(
    "str2_watch_accounts",
    lambda t: R.run_bounded(R.watch_accounts(_stream(t), t.accounts.where("auth_immutable").select("id"), "incoming").select("id", "inspected", "direction"), t.spark),
    f"SELECT id, inspected, direction FROM {NI} WHERE direction IN ('incoming', 'self') AND inspected IN {_WATCHED}",
)
add("str3_resumable", _stopped_and_resumed, "SELECT event_id FROM events")


def _again(t: Tables):
    """Events of 25 sources in order; then all once more, days later, with what is new."""
    folder, where = S.shared_folder(t.spark, "arriving"), S.shared_folder(t.spark, "resumed")
    rows = t.contract_events.select("event_id", "contract_id")
    cut = rows.agg(F.max("event_id")).first()[0] // 2

    def run():
        return R.run_resumable(t.spark.readStream.schema(rows.schema).parquet(folder), t.spark, "event_id", "contract_id", where)

    rows.where(F.col("event_id") <= cut).write.parquet(folder)
    run()
    rows.unionByName(rows).write.mode("append").parquet(folder)
    return run()


add("str3b_highest_tokens", _again, "SELECT event_id, contract_id FROM contract_events")


def _windowed(t: Tables):
    """Effects, payments and trades by day and kind: the newer half of each comes first, the older half when most of its
    windows are closed."""
    folders = {n: S.shared_folder(t.spark, n) for n in ("effects", "payments", "trades")}
    times = {"effects": "created_at", "payments": "created_at", "trades": "ledger_close_time"}
    where = S.shared_folder(t.spark, "windowed")
    # read several times below, and costly to make up
    tables = {n: S.stored(getattr(t, f"raw_{n}").select(F.unix_seconds(F.to_timestamp(c)).alias("time")), f"{n}_times") for n, c in times.items()}
    middles = {n: rows.agg(F.avg("time").cast("long")).first()[0] for n, rows in tables.items()}

    def run():
        streams = {n: (t.spark.readStream.schema("time long").parquet(f), F.col("time")) for n, f in folders.items()}
        return R.run_windowed(R.kinds_of(streams), t.spark, 86_400 * 7, 3_600, where)

    for newer in (True, False):
        for n, rows in tables.items():
            rows.where(F.col("time") >= middles[n] if newer else F.col("time") < middles[n]).write.mode("append").parquet(folders[n])
        counted, late = run()
    return counted.select("kind", "start", "n", F.lit(False).alias("late")).unionByName(late.groupBy("kind", "start").agg(F.count("*").alias("n"), F.lit(True).alias("late")))


_TIMES = " UNION ALL ".join(f"SELECT '{n}' AS kind, CAST(epoch(strptime({c}, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) AS time FROM raw_{n}" for n, c in (("effects", "created_at"), ("payments", "created_at"), ("trades", "ledger_close_time")))
add(
    "str7b_windows_by_kind",
    _windowed,
    f"""WITH r AS ({_TIMES}), m AS (SELECT kind, CAST(floor(avg(time)) AS BIGINT) AS middle FROM r GROUP BY kind), x AS (SELECT r.*, time // 604800 * 604800 AS start, time >= middle AS newer FROM r JOIN m USING (kind))
    SELECT kind, start, count(*) AS n, late FROM (SELECT *, NOT newer AND start + 604800 + 3600 <= (SELECT max(time) FROM x WHERE newer) AS late FROM x) GROUP BY ALL""",
)
add("str7_stream_counts", lambda t: R.run_bounded(R.stream_counts(_events(t), "event_type", "ts"), t.spark, "complete"), "SELECT CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add(
    "str8_stream_balances",
    lambda t: R.run_updates(R.stream_balances(_events(t), "user_id", "value"), t.spark, ["user_id"]),
    "SELECT user_id, CAST(sum(CAST(value AS DECIMAL(19,7))) AS DECIMAL(38,7)) AS balance, count(*) AS n FROM events GROUP BY user_id",
)
