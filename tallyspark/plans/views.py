"""Ledger tables as projections of the driver's tables.

Each view is one SELECT that Spark and DuckDB both read; the few functions that differ are filled in by dialect.
In Spark a view is a DataFrame over the parquet files, in the oracle it is a common table expression.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import stored

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")



def contract_key(n: int) -> str:
    """A contract's id out of a number, with its checksum."""
    body = bytes([2 << 3]) + hashlib.sha256(str(n).encode()).digest()
    return base64.b32encode(body + binascii.crc_hqx(body, 0).to_bytes(2, "little")).decode()


#: Ids of the contracts C0 to C24, by their last digits.
CONTRACTS = [contract_key(n) for n in range(25)]

DIALECT = {
    "spark": {
        "days": lambda x: f"datediff(cast({x} as date), date'1995-01-01')",
        "epoch": lambda x: f"unix_seconds(cast({x} as timestamp))",
        "div": lambda a, b: f"(({a}) div {b})",
        "str": lambda x: f"cast({x} as string)",
        "iso": lambda x: f"date_format(timestamp_seconds({x}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
        "row": lambda *x: "named_struct(" + ", ".join("'{}', {}".format(n.strip(' \n"'), e) for n, e in (y.split("=", 1) for y in x)) + ")",
        "list": lambda *x: "array(" + ", ".join(x) + ")",
        "collect": lambda x: f"collect_list({x})",
    },
    "duck": {
        "days": lambda x: f"date_diff('day', date '1995-01-01', cast({x} as date))",
        "epoch": lambda x: f"cast(floor(epoch({x})) as bigint)",
        "div": lambda a, b: f"(({a}) // {b})",
        "str": lambda x: f"cast({x} as varchar)",
        "iso": lambda x: f"strftime(make_timestamp(({x}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')",
        "row": lambda *x: "struct_pack(" + ", ".join("{} := {}".format(n.strip(), e) for n, e in (y.split("=", 1) for y in x)) + ")",
        "list": lambda *x: "[" + ", ".join(x) + "]",
        "collect": lambda x: f"list({x})",
    },
}

VIEWS = {
    "transactions": """
SELECT md5({str:o_orderkey}) AS hash, cast(50000000 + {days:o_orderdate} as bigint) AS ledger,
  row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS tx_order,
  concat('G', lpad({str:o_custkey}, 6, '0')) AS source_account, o_orderstatus <> 'F' AS successful,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'text' WHEN '2-HIGH' THEN 'id' WHEN '3-MEDIUM' THEN 'hash' WHEN '4-NOT SPECIFIED' THEN 'none' ELSE 'return' END AS memo_type,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('m', {str:o_orderkey % 50}) END AS memo,
  cast(100 * (1 + o_orderkey % 9) + 10 * (o_orderkey % 4) as bigint) AS fee_charged, cast(2000 as bigint) AS max_fee,
  cast(1 + o_orderkey % 9 as bigint) AS operation_count,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 0 END AS source_sequence,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 'txBadSeq' WHEN 1 THEN 'txFailed' WHEN 2 THEN 'txInsufficientFee' ELSE NULL END ELSE NULL END AS result_code,
  CASE WHEN o_orderkey % 7 = 0 THEN md5({str:o_orderkey - 7}) ELSE NULL END AS inner_hash,
  concat('G', lpad({str:o_custkey + o_orderkey % 2}, 6, '0')) AS fee_account,
  cast(CASE WHEN o_orderkey % 17 = 0 THEN -5 ELSE 1000 + o_orderkey % 100 end as bigint) AS min_time,
  cast(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1050 + o_orderkey % 60 end as bigint) AS max_time,
  cast(50000000 + {days:o_orderdate} - o_orderkey % 5 as bigint) AS min_ledger,
  cast(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 50000000 + {days:o_orderdate} + o_orderkey % 7 END as bigint) AS max_ledger,
  o_orderkey FROM orders""",
    "ledgers": """
SELECT ledger AS sequence, md5({str:ledger}) AS hash, CASE WHEN ledger % 97 = 0 THEN 'broken' ELSE md5({str:ledger - 1}) END AS prev_hash,
  count(*) FILTER (WHERE successful) AS successful_transaction_count, count(*) FILTER (WHERE NOT successful) AS failed_transaction_count,
  cast(sum(operation_count) as bigint) AS operation_count, cast(ledger * 5 as bigint) AS closed_at,
  cast(CASE WHEN ledger % 10 = 0 THEN NULL ELSE 100 END as bigint) AS base_fee_in_stroops, cast(NULL as bigint) AS base_reserve_in_stroops,
  cast(20 + ledger % 3 as int) AS protocol_version
FROM transactions WHERE ledger % 211 <> 0 GROUP BY ledger""",
    "operations": """
SELECT t.ledger * 4294967296 + t.tx_order * 4096 + l.op_index AS id, t.hash AS transaction_hash, t.ledger, t.tx_order, l.op_index, t.source_account, t.successful,
  CASE l_linenumber WHEN 4 THEN 'path_payment_strict_send' WHEN 5 THEN 'create_account' WHEN 6 THEN 'account_merge' WHEN 7 THEN 'path_payment_strict_receive' ELSE 'payment' END AS type,
  l.* FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS op_index FROM lineitem) l
JOIN transactions t ON t.o_orderkey = l.l_orderkey""",
    "payments": """
SELECT {str:id} AS id, type, ledger, transaction_hash, source_account,
  CASE WHEN type = 'payment' OR type LIKE 'path%' THEN source_account END AS "from",
  CASE WHEN type = 'payment' AND op_index % 9 = 0 THEN concat('M', source_account) WHEN op_index % 4 = 0 THEN '' END AS from_muxed,
  CASE WHEN type = 'payment' OR type LIKE 'path%' THEN concat('G', lpad({str:l_suppkey}, 6, '0')) END AS "to",
  cast(NULL as string) AS to_muxed,
  CASE WHEN type = 'create_account' THEN source_account END AS funder,
  CASE WHEN type IN ('create_account', 'account_merge') THEN CASE WHEN type = 'create_account' THEN concat('G', lpad({str:l_suppkey}, 6, '0')) ELSE source_account END END AS account,
  CASE WHEN type = 'account_merge' THEN concat('G', lpad({str:l_suppkey}, 6, '0')) END AS "into",
  cast(NULL as string) AS into_muxed,
  CASE WHEN type = 'payment' OR type LIKE 'path%' THEN cast(l_extendedprice as decimal(19,7)) END AS amount,
  CASE WHEN type LIKE 'path%' THEN cast(l_extendedprice / 2 as decimal(19,7)) END AS destination_amount,
  CASE WHEN type = 'create_account' THEN cast(l_quantity as decimal(19,7)) END AS starting_balance,
  CASE WHEN l_returnflag = 'N' THEN 'native' ELSE 'credit_alphanum12' END AS asset_type,
  CASE WHEN l_returnflag <> 'N' THEN concat('C', {str:l_partkey % 25}) END AS asset_code,
  CASE WHEN l_returnflag <> 'N' THEN concat('G', lpad({str:l_partkey % 10}, 6, '0')) END AS asset_issuer,
  CASE WHEN type LIKE 'path%' THEN 'credit_alphanum12' END AS destination_asset_type,
  CASE WHEN type LIKE 'path%' THEN concat('D', {str:l_partkey % 7}) END AS destination_asset_code,
  CASE WHEN type LIKE 'path%' THEN concat('G', lpad({str:l_partkey % 3}, 6, '0')) END AS destination_asset_issuer,
  l_suppkey % 5 AS muxed_id
FROM operations""",
    "trades": """
SELECT concat({str:o.id}, '-', {str:o.l_linenumber}) AS id, o.ledger, o.ledger * 5 AS close_time,
  p.p_brand AS base_asset, p.p_type AS counter_asset,
  CASE WHEN o.l_discount = 0 THEN cast(0 as decimal(19,7)) ELSE cast(o.l_quantity as decimal(19,7)) END AS base_amount,
  cast(o.l_extendedprice as decimal(19,7)) AS counter_amount,
  cast(CASE WHEN o.l_linenumber = 7 THEN NULL ELSE o.l_partkey + 1 end as bigint) AS price_n,
  cast(CASE WHEN o.l_linenumber = 7 THEN NULL ELSE o.l_suppkey % 9 end as bigint) AS price_d,
  CASE WHEN o.l_linestatus = 'F' THEN 'liquidity_pool' WHEN o.l_linenumber = 2 THEN NULL ELSE 'orderbook' END AS trade_type,
  CASE WHEN o.l_linestatus <> 'F' THEN o.source_account END AS base_account,
  CASE WHEN o.l_linestatus = 'F' THEN concat('L', {str:o.l_suppkey}) END AS base_liquidity_pool_id,
  concat('G', lpad({str:o.l_suppkey}, 6, '0')) AS counter_account
FROM operations o JOIN part p ON o.l_partkey = p.p_partkey""",
    "offers": """
SELECT {str:o.id} AS id, concat('G', lpad({str:o.l_suppkey}, 6, '0')) AS seller, p.p_brand AS selling, p.p_type AS buying,
  cast(o.l_quantity as decimal(19,7)) AS amount, cast(o.l_tax * 100 as bigint) AS price_n, cast(o.l_discount * 100 as bigint) AS price_d,
  cast(o.l_linenumber as double) AS price, o.ledger AS last_modified_ledger
FROM operations o JOIN part p ON o.l_partkey = p.p_partkey WHERE o.l_linestatus = 'O'""",
    "effects": """
SELECT CASE WHEN event_id % 50 = 0 THEN 'no-toid-here' ELSE concat(lpad({str:({epoch:ts} - 1704067200) * 858993459 + (event_id % 30) * 4096 + event_id % 5}, 19, '0'), '-', lpad({str:event_id % 4 + 1}, 10, '0')) END AS id,
  50000000 + {div:{epoch:ts} - 1704067200,5} AS ledger,
  CASE event_id % 12 WHEN 0 THEN 'account_created' WHEN 1 THEN 'account_credited' WHEN 2 THEN 'account_debited' WHEN 3 THEN 'trustline_created' WHEN 4 THEN 'trustline_sponsorship_created' WHEN 5 THEN 'trade'
    WHEN 6 THEN 'claimable_balance_created' WHEN 7 THEN CASE WHEN event_id % 24 = 7 THEN 'claimable_balance_claimed' ELSE 'offer_created' END WHEN 8 THEN 'liquidity_pool_deposited' WHEN 9 THEN 'contract_credited' WHEN 10 THEN CASE WHEN event_id % 72 = 22 THEN 'claimable_balance_clawed_back' ELSE 'mystery' END ELSE 'signer_created' END AS type,
  concat('G', lpad({str:user_id}, 6, '0')) AS account,
  CASE WHEN event_id % 12 = 4 THEN concat('G', lpad({str:user_id % 7}, 6, '0')) END AS sponsor,
  CASE WHEN event_id % 24 = 1 THEN 'credit_alphanum4' ELSE 'native' END AS asset_type,
  cast(CASE WHEN event_id % 12 IN (1, 2) THEN value END as decimal(19,7)) AS amount,
  cast(CASE WHEN event_id % 12 = 0 THEN value END as decimal(19,7)) AS starting_balance,
  CASE WHEN event_id % 12 = 6 OR event_id % 24 = 7 OR event_id % 72 = 22 THEN concat('B', {str:{div:event_id,12}}) END AS balance_id, event_id
FROM events""",
    "contract_events": """
SELECT {str:event_id} AS id, concat('C', {str:user_id % 25}) AS contract_id, 50000000 + {div:{epoch:ts} - 1704067200,5} AS ledger,
  CASE event_id % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'system' ELSE 'diagnostic' END AS type,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS name, CASE WHEN event_id % 10 = 3 THEN false WHEN event_id % 10 = 4 THEN NULL ELSE true END AS in_successful_contract_call,
  md5({str:{div:event_id,3}}) AS tx_hash, props, event_id FROM events""",
    "accounts": """
SELECT concat('G', lpad({str:c_custkey}, 6, '0')) AS id, cast(c_custkey % 7 as bigint) AS subentry_count, cast(c_custkey % 5 as bigint) AS num_sponsored,
  cast(c_custkey % 4 as bigint) AS num_sponsoring, cast(c_acctbal as decimal(19,7)) AS balance,
  cast(c_custkey % 3 as int) AS low_threshold, cast(c_custkey % 5 as int) AS med_threshold, cast(c_custkey % 8 as int) AS high_threshold,
  cast(c_custkey % 6 as int) AS master_weight, cast(c_custkey % 4 as int) AS other_weight,
  c_custkey % 2 = 0 AS auth_required, c_custkey % 3 = 0 AS auth_revocable, c_custkey % 5 = 0 AS auth_immutable, c_custkey % 7 = 0 AS auth_clawback_enabled,
  c_mktsegment AS home_domain FROM customer""",
    "trustlines": """
SELECT concat('G', lpad({str:c_custkey}, 6, '0')) AS account, concat('C', {str:c_custkey % 25}) AS asset_code, concat('G', lpad({str:c_custkey % 10}, 6, '0')) AS asset_issuer,
  cast(c_acctbal as decimal(19,7)) AS balance, cast(CASE WHEN c_custkey % 6 = 0 THEN 922337203685.4775807 ELSE 20000 END as decimal(19,7)) AS "limit",
  cast(c_custkey % 30 as decimal(19,7)) AS buying_liabilities, c_custkey % 3 = 0 AS is_authorized, c_custkey % 2 = 0 AS is_authorized_to_maintain_liabilities
FROM customer""",
    "assets": """
SELECT p_brand AS asset_code, p_type AS asset_issuer, cast(count(*) as bigint) AS num_accounts, cast(CASE WHEN max(p_size) > 45 THEN NULL ELSE sum(p_size) end as bigint) AS authorized,
  cast(CASE WHEN max(p_size) > 45 THEN NULL ELSE min(p_size) end as bigint) AS maintain, cast(CASE WHEN max(p_size) > 45 THEN NULL ELSE max(p_size) end as bigint) AS unauthorized,
  cast(CASE WHEN min(p_size) = 1 THEN NULL ELSE count(*) % 5 end as bigint) AS num_claimable_balances FROM part GROUP BY p_brand, p_type""",
    "pools": """
SELECT md5({str:p_partkey}) AS id, 'constant_product' AS type, cast(30 as int) AS fee_bp, cast(p_size as bigint) AS total_trustlines,
  cast(p_retailprice as decimal(19,7)) AS total_shares, CASE WHEN p_partkey % 4 = 0 THEN 'native' ELSE concat(p_brand, ':', p_type) END AS asset_a, cast(p_size as decimal(19,7)) AS amount_a,
  concat(p_type, ':', p_brand) AS asset_b, cast(p_retailprice * 2 as decimal(19,7)) AS amount_b, p_partkey FROM part""",
    "claimables": """
SELECT concat('B', {str:o.o_orderkey}) AS id, CASE WHEN o.o_orderkey % 3 = 0 THEN 'native' ELSE concat('C', {str:o.o_orderkey % 25}) END AS asset, cast(o.o_totalprice as decimal(19,7)) AS amount,
  concat('G', lpad({str:l.l_suppkey}, 6, '0')) AS destination,
  CASE l.l_suppkey % 4 WHEN 0 THEN 'unconditional' WHEN 1 THEN 'absolute' WHEN 2 THEN 'relative' ELSE 'not' END AS predicate, cast(l.l_suppkey * 10 as bigint) AS bound
FROM orders o JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey""",
    "storage": """
SELECT concat('C', {str:user_id % 25}) AS contract_id, {str:{div:event_id,2}} AS key, CASE WHEN event_id % 2 = 0 THEN 'persistent' ELSE 'temporary' END AS durability,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE props END AS value, cast(event_id as bigint) AS last_modified_ledger, cast(event_id % 7 * 9000 + 50000000 - 5000 as bigint) AS live_until_ledger
FROM events WHERE event_id % 5 <> 1""",
    "simulations": """
SELECT event_id AS id, concat('C', {str:user_id % 25}) AS contract_id, CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'restore' ELSE 'success' END AS status,
  cast(event_id * 37 % 100000 as bigint) AS instructions, cast(event_id * 13 % 5000 as bigint) AS read_bytes, cast(event_id * 7 % 900 as bigint) AS write_bytes,
  cast(event_id * 31 % 1000 as bigint) AS min_resource_fee, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a' END AS before_value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'b' END AS after_value,
  CASE event_id % 6 WHEN 0 THEN 'Error: account not found' WHEN 1 THEN 'transaction too late' WHEN 2 THEN 'Insufficient balance' WHEN 3 THEN 'contract trap' WHEN 4 THEN 'timeout' ELSE 'other thing' END AS message,
  cast(event_id % 5 * 40 + 49999950 as bigint) AS expiration_ledger, CASE WHEN event_id % 3 = 0 THEN 'source_account' ELSE 'address' END AS credential, event_id % 2 = 0 AS signed FROM events""",
    "polls": """
SELECT concat('T', {str:user_id}) AS transaction_id, {epoch:ts} AS polled_at, event_id AS poll,
  CASE WHEN event_id % 10 < 4 THEN 'pending' WHEN event_id % 10 < 7 THEN 'processing' WHEN event_id % 10 < 9 THEN 'completed' ELSE 'error' END AS status FROM events""",
    # The same records as their declared raw schemas have them: numbers as text, nested columns, defaults left out.
    "raw_ledgers": """
SELECT hash AS id, CASE WHEN sequence % 4 <> 0 THEN hash END AS hash, prev_hash, sequence, cast(successful_transaction_count as int) AS successful_transaction_count,
  cast(CASE WHEN sequence % 6 <> 0 THEN failed_transaction_count END as int) AS failed_transaction_count, cast(operation_count as int) AS operation_count,
  cast(CASE WHEN sequence % 3 <> 0 THEN operation_count + failed_transaction_count END as int) AS tx_set_operation_count, {iso:closed_at} AS closed_at, '105443902087.3472865' AS total_coins,
  concat({str:sequence % 1000}, '.5') AS fee_pool, base_fee_in_stroops, base_reserve_in_stroops, cast(CASE WHEN sequence % 5 <> 0 THEN 100 END as int) AS max_tx_set_size, protocol_version FROM ledgers""",
    "raw_transactions": """
SELECT hash AS id, hash, successful, CASE WHEN o_orderkey % 2 = 0 THEN ledger END AS ledger_attr, CASE WHEN o_orderkey % 2 = 1 THEN ledger END AS ledger, {iso:ledger * 5} AS created_at, source_account,
  {str:source_sequence} AS source_account_sequence, fee_account, {str:fee_charged} AS fee_charged, {str:max_fee} AS max_fee, cast(operation_count as int) AS operation_count, memo_type, memo,
  CASE WHEN o_orderkey % 3 <> 0 THEN result_code END AS result_code,
  CASE WHEN NOT successful THEN {row:transaction=result_code;operations=CASE o_orderkey % 4 WHEN 0 THEN {list:'op_success';'opUnderfunded';'op_success'} WHEN 1 THEN {list:'op_no_trust';'op_line_full'} WHEN 2 THEN {list:'op_success'} END} END AS result_codes,
  CASE WHEN inner_hash IS NOT NULL THEN {row:hash=inner_hash;max_fee={str:max_fee}} END AS inner_transaction, min_time, max_time, min_ledger, max_ledger, o_orderkey FROM transactions""",
    "raw_payments": """
SELECT CASE WHEN cast(id as bigint) % 8 = 1 THEN '' ELSE id END AS id, id AS paging_token, CASE WHEN type = 'payment' AND cast(id as bigint) % 5 = 1 THEN NULL ELSE type END AS type, source_account,
  {iso:ledger * 5} AS created_at, transaction_hash, true AS transaction_successful, ledger, "from", from_muxed, "to", to_muxed, {str:amount} AS amount, asset_type, asset_code, asset_issuer,
  {str:amount} AS source_amount, asset_type AS source_asset_type, asset_code AS source_asset_code, asset_issuer AS source_asset_issuer, {str:destination_amount} AS destination_amount,
  destination_asset_type, destination_asset_code, CASE WHEN cast(id as bigint) % 7 <> 0 THEN destination_asset_issuer END AS destination_asset_issuer, funder, account, {str:starting_balance} AS starting_balance, "into", into_muxed FROM payments""",
    "raw_operations": """
SELECT p.id, p.id AS paging_token, p.type, p.source_account, {iso:p.ledger * 5} AS created_at, p.transaction_hash, true AS transaction_successful, p."from", p."to", p.funder, p.account, p."into",
  CASE WHEN cast(p.id as bigint) % 6 = 1 THEN 'G000001' END AS trustor, {str:p.amount} AS amount, p.asset_type, p.asset_code, p.asset_issuer FROM payments p""",
    "raw_trades": """
SELECT CASE WHEN ledger % 5 <> 0 THEN id END AS id, id AS paging_token, {iso:close_time} AS ledger_close_time, trade_type, base_account, base_liquidity_pool_id, {str:base_amount} AS base_amount,
  'credit_alphanum12' AS base_asset_type, base_asset AS base_asset_code, cast(NULL as string) AS base_asset_issuer, CASE WHEN ledger % 3 <> 0 THEN counter_account END AS counter_account,
  CASE WHEN ledger % 3 = 0 THEN 'Lcounter' END AS counter_liquidity_pool_id, {str:counter_amount} AS counter_amount, 'credit_alphanum12' AS counter_asset_type, counter_asset AS counter_asset_code,
  cast(NULL as string) AS counter_asset_issuer, CASE WHEN ledger % 2 = 0 THEN true END AS base_is_seller, {row:n={str:price_n};d=CASE WHEN price_n % 50 = 7 THEN 'none' ELSE {str:price_d} END} AS price FROM trades""",
    "raw_offers": """
SELECT id, id AS paging_token, seller, {row:asset_type='credit_alphanum12';asset_code=selling;asset_issuer=cast(NULL as string)} AS selling,
  {row:asset_type='credit_alphanum12';asset_code=buying;asset_issuer=cast(NULL as string)} AS buying, {str:amount} AS amount, {str:price} AS price, {row:n={str:price_n};d={str:price_d}} AS price_r,
  last_modified_ledger, {iso:last_modified_ledger * 5} AS last_modified_time FROM offers""",
    "raw_assets": """
SELECT 'credit_alphanum12' AS asset_type, asset_code, CASE WHEN num_accounts % 7 <> 0 THEN asset_issuer END AS asset_issuer, concat(asset_code, '_', asset_issuer) AS paging_token, num_accounts,
  CASE WHEN authorized IS NOT NULL THEN {row:authorized=CASE WHEN maintain % 3 <> 0 THEN authorized END;authorized_to_maintain_liabilities=maintain;unauthorized=unauthorized} END AS accounts,
  CASE WHEN num_accounts % 2 = 0 THEN {row:authorized='12.5';authorized_to_maintain_liabilities={str:num_accounts};unauthorized=cast(NULL as string)} END AS balances, num_claimable_balances,
  concat({str:num_accounts}, '.25') AS claimable_balances_amount, num_accounts % 4 AS num_liquidity_pools, '7.0000001' AS liquidity_pools_amount, cast(NULL as bigint) AS num_contracts, cast(NULL as string) AS contracts_amount,
  CASE WHEN num_accounts % 5 <> 0 THEN {row:auth_required=num_accounts % 2 = 0;auth_revocable=cast(NULL as boolean);auth_immutable=false;auth_clawback_enabled=num_accounts % 3 = 0} END AS flags FROM assets""",
    "raw_pools": """
SELECT id, id AS paging_token, CASE WHEN p_partkey % 6 <> 0 THEN fee_bp END AS fee_bp, CASE WHEN p_partkey % 9 <> 0 THEN type END AS type, CASE WHEN p_partkey % 8 <> 0 THEN total_trustlines END AS total_trustlines,
  {str:total_shares} AS total_shares, CASE WHEN p_partkey % 11 <> 0 THEN {list:{row:asset=asset_a;amount={str:amount_a}};{row:asset=CASE WHEN p_partkey % 10 = 0 THEN '' ELSE asset_b END;amount={str:amount_b}}} END AS reserves,
  p_partkey AS last_modified_ledger, {iso:p_partkey * 5} AS last_modified_time FROM pools""",
    "raw_claimables": """
SELECT id, max(asset) AS asset, {str:max(amount)} AS amount, {collect:{row:destination=destination;predicate=predicate}} AS claimants, cast(min(o_orderkey) as bigint) AS last_modified_ledger FROM (
  SELECT *, cast(substr(id, 2) as bigint) AS o_orderkey FROM (SELECT id, asset, amount, destination, translate(CASE bound % 7 WHEN 0 THEN '<"unconditional":true>' WHEN 1 THEN concat('<"before_absolute_time":"', {str:bound}, '">') WHEN 2 THEN concat('<"before_relative_time":"', {str:bound}, '">')
    WHEN 3 THEN concat('<"not":<"before_absolute_time":"', {str:bound}, '">>') WHEN 4 THEN concat('<"and":[<"before_relative_time":"', {str:bound}, '">,<"not":<"before_absolute_time":"300">>]>')
    WHEN 5 THEN concat('<"or":[<"not":<"unconditional":true>>,<"before_absolute_time":"', {str:bound}, '">]>') ELSE '<"odd":1>' END, '<>', concat(chr(123), chr(125))) AS predicate FROM claimables)) GROUP BY id""",
    "raw_effects": """
SELECT id, type, CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 9 <> 1 THEN account END AS account, CASE WHEN event_id % 7 = 0 THEN 'G000003' END AS source_account, CASE WHEN type = 'account_created' THEN account END AS created_account,
  CASE WHEN event_id % 11 = 0 THEN 'G000005' END AS destination, {iso:ledger * 5} AS created_at, CASE WHEN event_id % 36 = 1 THEN 'Ccontract' END AS contract, CASE WHEN event_id % 36 = 10 THEN {row:id={str:event_id}} END AS liquidity_pool,
  CASE WHEN asset_type <> 'native' THEN 'USD' END AS asset_code, CASE WHEN asset_type <> 'native' AND event_id % 48 = 1 THEN 'G000009' END AS asset_issuer, CASE WHEN event_id % 8 <> 3 THEN asset_type END AS asset_type,
  {str:amount} AS amount, {str:starting_balance} AS starting_balance, CASE WHEN event_id % 36 = 0 THEN account END AS trustor, cast(NULL as string) AS offer_id, CASE WHEN event_id % 36 = 9 THEN account END AS seller,
  sponsor, cast(NULL as string) AS new_sponsor, cast(NULL as string) AS former_sponsor, balance_id, cast(NULL as int) AS weight, cast(NULL as string) AS name, event_id FROM effects""",
    "raw_op_effects": """
SELECT concat(lpad({str:id}, 19, '0'), '-0000000001') AS id, CASE l_linenumber WHEN 1 THEN 'liquidity_pool_trade' WHEN 2 THEN 'claimable_balance_created' WHEN 3 THEN 'trustline_created' ELSE 'account_debited' END AS type,
  source_account AS account, CASE WHEN l_linenumber = 4 THEN concat('G', lpad({str:l_suppkey}, 6, '0')) END AS source_account, cast(NULL as string) AS created_account, CASE WHEN l_linenumber = 5 THEN concat('G', lpad({str:l_suppkey}, 6, '0')) END AS destination,
  {iso:ledger * 5} AS created_at, cast(NULL as string) AS contract, CASE WHEN l_linenumber = 1 THEN {row:id=md5({str:l_partkey})} END AS liquidity_pool, CASE WHEN l_linenumber = 3 THEN 'USD' END AS asset_code, cast(NULL as string) AS asset_issuer, 'native' AS asset_type,
  {str:cast(l_extendedprice as decimal(19,7))} AS amount, cast(NULL as string) AS starting_balance, CASE WHEN l_linenumber = 3 THEN source_account END AS trustor, cast(NULL as string) AS offer_id, CASE WHEN l_linenumber = 6 THEN concat('G', lpad({str:l_suppkey}, 6, '0')) END AS seller,
  cast(NULL as string) AS sponsor, cast(NULL as string) AS new_sponsor, cast(NULL as string) AS former_sponsor, CASE WHEN l_linenumber = 2 THEN concat('B', {str:l_orderkey}) END AS balance_id, cast(NULL as int) AS weight, cast(NULL as string) AS name FROM operations""",
    "raw_contract_events": """
SELECT id, CASE WHEN event_id % 13 <> 0 THEN type END AS type, CASE WHEN event_id % 17 <> 0 THEN ledger END AS ledger, {iso:ledger * 5} AS ledger_closed_at, tx_hash,
  CASE WHEN event_id % 19 = 0 THEN contract_id WHEN event_id % 19 = 1 THEN concat('C', lpad(translate(substr(contract_id, 2), '0189', 'WXYZ'), 55, 'A'))
    ELSE CASE cast(substr(contract_id, 2) as int) {cases} END END AS contract_id,
  CASE WHEN name IS NULL THEN NULL ELSE {list:{row:xdr_type=CASE WHEN event_id % 14 = 0 THEN 'scvString' ELSE 'scvSymbol' END;value=name};{row:xdr_type='scvU32';value='7'}} END AS topic,
  CASE WHEN event_id % 15 <> 0 THEN {row:xdr_type=kind;value=typed} END AS value,
  in_successful_contract_call, id AS paging_token, event_id FROM (SELECT *,
  CASE event_id % 9 WHEN 0 THEN 'scvU32' WHEN 1 THEN 'scvI128' WHEN 2 THEN 'scvBytes' WHEN 3 THEN 'scvString' WHEN 4 THEN 'scvVec' WHEN 5 THEN 'scvMap' WHEN 6 THEN 'scvBool' WHEN 7 THEN 'scvU32' ELSE 'scvError' END AS kind,
  CASE event_id % 9 WHEN 0 THEN {str:event_id} WHEN 1 THEN '-170141183460469231731687303715884105728' WHEN 2 THEN 'AQID' WHEN 3 THEN props
    WHEN 4 THEN translate(concat('[<"type":"scvI64","value":"', {str:event_id}, '">,<"type":"scvVec","value":[<"type":"scvBool","value":"true">]>]'), '<>', concat(chr(123), chr(125)))
    WHEN 5 THEN translate(concat('[<"key":<"type":"scvSymbol","value":"k">,"val":<"type":"scvU32","value":"', {str:event_id}, '">>,<"key":<"type":"scvU32","value":"2">,"val":<"type":"scvBytes","value":"AQID">>]'), '<>', concat(chr(123), chr(125)))
    WHEN 6 THEN 'true' WHEN 7 THEN 'abc' ELSE 'x' END AS typed FROM contract_events)""",
    "raw_accounts": """
SELECT id, {str:num} AS sequence, cast(subentry_count as int) AS subentry_count, cast(CASE WHEN num % 5 <> 4 THEN num_sponsored END as int) AS num_sponsored, cast(num_sponsoring as int) AS num_sponsoring, CASE WHEN num % 9 = 0 THEN 'G000001' END AS sponsor, home_domain,
  CASE WHEN num % 14 <> 0 THEN {row:low_threshold=low_threshold;med_threshold=med_threshold;high_threshold=high_threshold} END AS thresholds,
  CASE WHEN num % 15 <> 0 THEN {row:auth_required=auth_required;auth_revocable=auth_revocable;auth_immutable=auth_immutable;auth_clawback_enabled=CASE WHEN auth_clawback_enabled THEN true END} END AS flags,
  CASE WHEN num % 4 = 0 THEN {list:{row:key=id;weight=master_weight}} WHEN num % 13 = 0 THEN {list:{row:key='Sx';weight=other_weight}} ELSE {list:{row:key='Sx';weight=other_weight};{row:key=id;weight=master_weight};{row:key='Sy';weight=1}} END AS signers,
  {list:{row:asset_type='credit_alphanum4';asset_code=concat('C', {str:num % 25});asset_issuer=concat('G', lpad({str:num % 10}, 6, '0'));balance=CASE WHEN num % 12 = 0 THEN '0.0000000' ELSE {str:balance} END;"limit"=CASE WHEN num % 6 = 0 THEN '922337203685.4775807' ELSE '20000' END;buying_liabilities={str:num % 30};selling_liabilities='1.5';is_authorized=num % 3 = 0;is_authorized_to_maintain_liabilities=num % 2 = 0;liquidity_pool_id=cast(NULL as string)};
   {row:asset_type='liquidity_pool_shares';asset_code=cast(NULL as string);asset_issuer=cast(NULL as string);balance={str:num % 7};"limit"='9';buying_liabilities='0';selling_liabilities='0';is_authorized=true;is_authorized_to_maintain_liabilities=true;liquidity_pool_id=md5({str:num % 200 + 1})};
   {row:asset_type='native';asset_code=cast(NULL as string);asset_issuer=cast(NULL as string);balance={str:balance};"limit"=cast(NULL as string);buying_liabilities='0';selling_liabilities='0';is_authorized=true;is_authorized_to_maintain_liabilities=true;liquidity_pool_id=cast(NULL as string)}} AS balances FROM (SELECT *, cast(substr(id, 2) as bigint) AS num FROM accounts)""",
}


def render(sql: str, dialect: str) -> str:
    """Fill in {name:argument,...}; arguments may hold other ones. Those of rows (name=value) and lists end at semicolons."""
    f = DIALECT[dialect]
    sql = sql.replace("{cases}", " ".join(f"WHEN {n} THEN '{key}'" for n, key in enumerate(CONTRACTS)))
    pattern = re.compile(r"\{(\w+):([^{}]*)\}")
    while m := pattern.search(sql):
        sql = sql[: m.start()] + f[m[1]](*m[2].split(";" if m[1] in ("row", "list", "collect", "iso", "str") else ",")) + sql[m.end() :]
    return re.sub(r'"(from|to|into|limit)"', r"`\1`", sql) if dialect == "spark" else sql


def needed(names) -> list[str]:
    """The views and those below them, in order of definition."""
    out: set[str] = set()

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            out.add(name)
            for other in VIEWS:
                if re.search(rf"\b(FROM|JOIN) {other}\b", VIEWS[name]):
                    add(other)

    for n in names:
        add(n)
    return [v for v in VIEWS if v in out]


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names as common table expressions."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} AS ({render(VIEWS[v], 'duck')})" for v in needed(names)]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    return "WITH " + ",\n".join(parts) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)


class Tables:
    """The views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, **views: DataFrame) -> Tables:
        """The same tables, with these views as given (stored ones, say); the views above are made up of them."""
        out = Tables(self.spark, self.folder)
        out.__dict__.update(views)
        return out

    def with_stored_operations(self) -> Tables:
        """For queries that read several views of the operations, which cost a shuffle of all their rows to make up:
        they are made up once. Left out are columns that no view reads."""
        operations = self.operations
        names = operations.columns  # one of which comes twice
        read = [c for i, c in enumerate(names) if names.index(c) == i and (not c.startswith("l_") or any(re.search(rf"\b{c}\b", sql) for v, sql in VIEWS.items() if v != "operations"))]
        once = operations.toDF(*[c if names.index(c) == i else f"{c}_{i}" for i, c in enumerate(names)])
        return self.given(operations=stored(once.select(*read), "operations"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sql = render(VIEWS[name], "spark")
        below = {t: getattr(self, t) for t in (*BASE, *VIEWS) if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
        sql = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in below else m[0], sql)
        return self.spark.sql(sql, **below)
