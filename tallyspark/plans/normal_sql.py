"""The normalised tables in DuckDB's SQL, written from the raw records' semantics, for the queries' oracles.

NP payments, NT trades, NO offers, NA assets, NR pool reserves, NE indexed effects, NF effects, NC contract events,
NL ledgers, NX transactions, NU accounts, ND native balance changes, NI payments by inspected account.
"""

from __future__ import annotations



def is_contract(c: str) -> str:
    """Whether a text is a contract's id: its form, and its checksum bit by bit."""
    digit = f"(CASE WHEN ascii({c}[i // 5 + 1]) >= 65 THEN ascii({c}[i // 5 + 1]) - 65 ELSE ascii({c}[i // 5 + 1]) - 24 END)"
    bits = lambda low, high: f"list_concat([0::BIGINT], list_transform(range({low}, {high}), lambda i: CAST(({digit} >> (4 - i % 5)) & 1 AS BIGINT)))"
    crc = f"list_reduce({bits(0, 264)}, lambda a, b: CASE WHEN (a // 32768 + b) % 2 = 1 THEN xor(a * 2 % 65536, 4129) ELSE a * 2 % 65536 END)"
    told = f"list_reduce({bits(264, 280)}, lambda a, b: a * 2 + b)"
    return f"coalesce(CASE WHEN regexp_full_match({c}, 'C[A-D][A-Z2-7]{{54}}') THEN {crc} = {told} // 256 + {told} % 256 * 256 END, false)"


_TIME = "CAST(epoch(try_strptime({}, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT)"
_MONEY = "CAST(TRY_CAST({} AS DECIMAL(19,7)) AS DECIMAL(38,7))"
_ZERO = "CAST(coalesce(TRY_CAST({} AS DECIMAL(19,7)), 0) AS DECIMAL(38,7))"
_RATIO = "CASE WHEN TRY_CAST({1} AS DECIMAL(20,0)) <> 0 THEN CAST(TRY_CAST({0} AS DECIMAL(20,0)) AS DOUBLE) / CAST(TRY_CAST({1} AS DECIMAL(20,0)) AS DOUBLE) END"
_ASSET = "CASE WHEN {0} = 'native' THEN 'native' ELSE concat_ws(':', nullif({1}, ''), nullif({2}, '')) END"
_SNAKE = "lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ")"


_PART = {p: _first(f"destination_asset_{p}", f"asset_{p}") for p in ("type", "code", "issuer")}
NP = f"""(SELECT {_first('id', 'paging_token')} AS id, coalesce(nullif(type, ''), 'payment') AS type, ledger, nullif(transaction_hash, '') AS transaction_hash, {_TIME.format('created_at')} AS created_at,
 {_first('from_muxed', '"from"', 'funder', 'source_account')} AS source, {_first('to_muxed', '"to"', 'account', 'into_muxed', '"into"')} AS destination,
 CASE WHEN coalesce(nullif(type, ''), 'payment') <> 'account_merge' THEN {_MONEY.format(_first('amount', 'destination_amount', 'starting_balance'))} END AS amount,
 CASE WHEN {_PART['type']} = 'native' THEN 'native' ELSE concat_ws(':', {_PART['code']}, {_PART['issuer']}) END AS asset FROM raw_payments)"""

NT = f"""(SELECT * EXCLUDE (rational), coalesce(rational, CASE WHEN base_amount > 0 THEN CAST(counter_amount AS DOUBLE) / CAST(base_amount AS DOUBLE) END, 0.0) AS price, TRY_CAST(operation_id AS BIGINT) // 4294967296 AS ledger FROM (
 SELECT coalesce(id, paging_token) AS id, regexp_replace(coalesce(id, paging_token), '^(.+)-[^-]*$', '\\1') AS operation_id, {_TIME.format('ledger_close_time')} AS close_time,
 {_ASSET.format('base_asset_type', 'base_asset_code', 'base_asset_issuer')} AS base_asset, {_ASSET.format('counter_asset_type', 'counter_asset_code', 'counter_asset_issuer')} AS counter_asset,
 {_ZERO.format('base_amount')} AS base_amount, {_ZERO.format('counter_amount')} AS counter_amount, {_RATIO.format('price.n', 'price.d')} AS rational,
 coalesce(base_account, base_liquidity_pool_id) AS base_party, coalesce(counter_account, counter_liquidity_pool_id) AS counter_party, coalesce(base_is_seller, false) AS base_is_seller,
 coalesce(trade_type, 'orderbook') AS venue FROM raw_trades))"""

NO = f"""(SELECT *, selling || '/' || buying AS pair, round(CAST(amount AS DOUBLE) * price, 7) AS buying_amount FROM (
 SELECT coalesce(id, paging_token) AS id, seller, {_ASSET.format('selling.asset_type', 'selling.asset_code', 'selling.asset_issuer')} AS selling, {_ASSET.format('buying.asset_type', 'buying.asset_code', 'buying.asset_issuer')} AS buying,
 {_ZERO.format('amount')} AS amount, coalesce({_RATIO.format('price_r.n', 'price_r.d')}, TRY_CAST(price AS DOUBLE)) AS price, last_modified_ledger, {_TIME.format('last_modified_time')} AS last_modified_time FROM raw_offers))"""

NA = f"""(SELECT concat_ws(':', coalesce(asset_code, 'Unknown'), coalesce(asset_issuer, 'Unknown')) AS asset, coalesce(asset_type, 'Unknown') AS asset_type, coalesce(asset_code, 'Unknown') AS asset_code, coalesce(asset_issuer, 'Unknown') AS asset_issuer,
 CASE WHEN accounts IS NOT NULL THEN coalesce(accounts.authorized, 0) + coalesce(accounts.authorized_to_maintain_liabilities, 0) + coalesce(accounts.unauthorized, 0) ELSE coalesce(num_accounts, 0) END AS holders,
 coalesce(accounts.authorized, num_accounts, 0) AS authorized, coalesce(accounts.authorized_to_maintain_liabilities, 0) AS maintain, coalesce(accounts.unauthorized, 0) AS unauthorized,
 {_ZERO.format('balances.authorized')} AS authorized_balance, {_ZERO.format('balances.authorized_to_maintain_liabilities')} AS maintain_balance, {_ZERO.format('balances.unauthorized')} AS unauthorized_balance,
 coalesce(num_claimable_balances, 0) AS claimable_balances, {_ZERO.format('claimable_balances_amount')} AS claimable_amount, coalesce(num_liquidity_pools, 0) AS pools, {_ZERO.format('liquidity_pools_amount')} AS pools_amount,
 coalesce(num_contracts, 0) AS contracts, {_ZERO.format('contracts_amount')} AS contracts_amount, coalesce(flags.auth_required, false) AS auth_required, coalesce(flags.auth_revocable, false) AS auth_revocable,
 coalesce(flags.auth_immutable, false) AS auth_immutable, coalesce(flags.auth_clawback_enabled, false) AS auth_clawback_enabled FROM raw_assets)"""

NR = f"""(SELECT id, type, fee_percent, participants, total_shares, last_modified_ledger, place, CASE WHEN place IS NULL THEN NULL WHEN a = 'native' THEN 'native' WHEN instr(a, ':') > 0 THEN 'issued' ELSE 'unknown' END AS kind,
 CASE WHEN place IS NOT NULL THEN coalesce(nullif(a, ''), 'Unknown') END AS asset, CASE WHEN place IS NOT NULL THEN coalesce(CASE WHEN a = 'native' THEN 'XLM' ELSE nullif(split_part(a, ':', 1), '') END, 'Unknown') END AS code,
 CASE WHEN instr(a, ':') > 0 THEN nullif(substr(a, instr(a, ':') + 1), '') END AS issuer, CASE WHEN place IS NOT NULL THEN {_ZERO.format('m')} END AS amount FROM (
 SELECT id, coalesce(type, 'Unknown') AS type, CAST(coalesce(fee_bp, 0) / 100.0 AS DOUBLE) AS fee_percent, coalesce(total_trustlines, 0) AS participants, {_ZERO.format('total_shares')} AS total_shares, last_modified_ledger,
 CAST(i AS INTEGER) AS place, reserves[i + 1].asset AS a, reserves[i + 1].amount AS m FROM raw_pools, (SELECT unnest([NULL, 0, 1]) AS i) WHERE CASE WHEN reserves IS NULL THEN i IS NULL ELSE i IS NOT NULL END))"""

NE = """(SELECT *, toid // 4294967296 AS id_ledger, (toid // 4096) % 1048576 AS tx_order, toid % 4096 AS op_index, CASE WHEN toid IS NOT NULL THEN CAST(split_part(id, '-', 2) AS BIGINT) END AS effect_index
 FROM (SELECT *, CASE WHEN regexp_matches(id, '^\\d+-\\d+$') THEN try_cast(split_part(id, '-', 1) AS BIGINT) END AS toid FROM effects))"""

CATEGORY = """CASE WHEN type LIKE '%sponsorship%' THEN 'Sponsorship' WHEN type LIKE 'signer\\_%' ESCAPE '\\' THEN 'Signers' WHEN type LIKE 'trustline\\_%' ESCAPE '\\' THEN 'Trustlines'
 WHEN type LIKE 'claimable\\_balance\\_%' ESCAPE '\\' THEN 'Claimable balances' WHEN type LIKE 'liquidity\\_pool\\_%' ESCAPE '\\' THEN 'Liquidity pools' WHEN type LIKE 'offer\\_%' ESCAPE '\\' OR type = 'trade' THEN 'DEX offers & trades'
 WHEN type LIKE 'data\\_%' ESCAPE '\\' THEN 'Data entries' WHEN type LIKE 'contract\\_%' ESCAPE '\\' THEN 'Smart contracts' WHEN type LIKE 'account\\_%' ESCAPE '\\' OR type = 'sequence_bumped' THEN 'Account balances & settings' ELSE 'Other' END"""
NF = f"""(SELECT id, ledger, type, subject, asset, amount, {CATEGORY} AS category, created_at FROM (SELECT id, CASE WHEN regexp_matches(id, '^\\d+-\\d+$') THEN try_cast(split_part(id, '-', 1) AS BIGINT) END // 4294967296 AS ledger, coalesce(nullif(type, ''), 'unknown') AS type,
 coalesce(nullif(account, ''), nullif(trustor, ''), nullif(seller, ''), nullif(contract, ''), 'pool:' || nullif(liquidity_pool.id, ''), '(none)') AS subject,
 CASE WHEN asset_type = 'native' THEN 'native' WHEN nullif(asset_code, '') IS NOT NULL THEN concat_ws(':', asset_code, nullif(asset_issuer, '')) END AS asset,
 coalesce({_MONEY.format('amount')}, {_MONEY.format('starting_balance')}) AS amount, {_TIME.format('created_at')} AS created_at FROM raw_effects))"""

NC = f"""(SELECT id, coalesce(type, 'contract') AS type, coalesce(ledger, 0) AS ledger, tx_hash, CASE WHEN {is_contract('contract_id')} THEN contract_id ELSE '' END AS contract_id,
 coalesce(CASE WHEN topic[1].xdr_type = 'scvSymbol' THEN topic[1].value END, '(unnamed)') AS name, coalesce(list_transform(topic, lambda x: x.value), []) AS topics, coalesce(value.xdr_type, 'void') AS value_type,
 coalesce(in_successful_contract_call, true) AS successful, paging_token FROM raw_contract_events)"""

NL = f"""(SELECT sequence, coalesce(hash, id) AS hash, prev_hash, CAST(coalesce(successful_transaction_count, 0) AS BIGINT) AS successful_transaction_count, CAST(coalesce(failed_transaction_count, 0) AS BIGINT) AS failed_transaction_count,
 CAST(coalesce(operation_count, 0) AS BIGINT) AS operation_count, CAST(coalesce(tx_set_operation_count, operation_count, 0) AS BIGINT) AS tx_set_operation_count, {_TIME.format('closed_at')} AS closed_at,
 coalesce(base_fee_in_stroops, 100) AS base_fee, coalesce(base_reserve_in_stroops, 5000000) AS base_reserve, {_ZERO.format('total_coins')} AS total_coins, {_ZERO.format('fee_pool')} AS fee_pool,
 coalesce(max_tx_set_size, 0) AS max_tx_set_size, coalesce(protocol_version, 0) AS protocol_version FROM raw_ledgers)"""

NX = f"""(SELECT hash, coalesce(ledger_attr, ledger) AS ledger, {_TIME.format('created_at')} AS created_at, source_account, CASE WHEN coalesce(successful, false) THEN 'success' ELSE 'failed' END AS status,
 TRY_CAST(source_account_sequence AS BIGINT) AS source_sequence, fee_account, TRY_CAST(fee_charged AS BIGINT) AS fee_charged, TRY_CAST(max_fee AS BIGINT) AS max_fee, CAST(operation_count AS BIGINT) AS operation_count,
 coalesce(memo_type, 'none') AS memo_type, CASE WHEN coalesce(memo_type, '') <> 'none' THEN nullif(memo, '') END AS memo,
 coalesce({_SNAKE.format("coalesce(nullif(result_code, ''), nullif(result_codes.transaction, ''))")}, CASE WHEN coalesce(successful, false) THEN 'tx_success' ELSE 'tx_failed' END) AS result_code,
 list_transform(result_codes.operations, lambda x: {_SNAKE.format('x')}) AS operation_codes, inner_transaction.hash AS inner_hash, TRY_CAST(inner_transaction.max_fee AS BIGINT) AS inner_max_fee,
 min_time, max_time, min_ledger, max_ledger FROM raw_transactions)"""

NU = f"""(SELECT id, TRY_CAST(sequence AS BIGINT) AS sequence, {_ZERO.format("list_filter(balances, lambda b: b.asset_type = 'native')[1].balance")} AS native_balance, CAST(coalesce(subentry_count, 0) AS BIGINT) AS subentry_count,
 CAST(coalesce(num_sponsored, 0) AS BIGINT) AS num_sponsored, CAST(coalesce(num_sponsoring, 0) AS BIGINT) AS num_sponsoring, nullif(sponsor, '') AS sponsor, nullif(home_domain, '') AS home_domain,
 coalesce(thresholds.low_threshold, 0) AS low_threshold, coalesce(thresholds.med_threshold, 0) AS med_threshold, coalesce(thresholds.high_threshold, 0) AS high_threshold,
 coalesce(flags.auth_required, false) AS auth_required, coalesce(flags.auth_revocable, false) AS auth_revocable, coalesce(flags.auth_immutable, false) AS auth_immutable, coalesce(flags.auth_clawback_enabled, false) AS auth_clawback_enabled,
 coalesce(list_filter(signers, lambda s: s.key = id)[1].weight, 0) AS primary_weight, CAST(len(list_filter(signers, lambda s: s.key <> id AND s.weight > 0)) AS BIGINT) AS cosigners,
 CAST(len(list_filter(signers, lambda s: s.key <> id)) AS BIGINT) AS other_signers, CAST(coalesce(list_sum(list_transform(signers, lambda s: s.weight)), 0) AS INTEGER) AS total_weight FROM raw_accounts)"""

ND = """(SELECT *, CAST(CASE WHEN type = 'account_created' THEN starting_balance WHEN type = 'account_credited' AND coalesce(asset_type, 'native') = 'native' THEN amount WHEN type = 'account_debited' AND coalesce(asset_type, 'native') = 'native' THEN -amount END AS DECIMAL(38,7)) AS delta FROM effects)"""

_DIRECTION = "CASE WHEN source = inspected AND destination = inspected THEN 'self' WHEN destination = inspected THEN 'incoming' WHEN source = inspected THEN 'outgoing' ELSE 'related' END"
NI = f"(SELECT *, {_DIRECTION} AS direction FROM (SELECT *, source AS inspected FROM {NP} UNION ALL SELECT *, destination FROM {NP} WHERE destination IS DISTINCT FROM source) WHERE inspected IS NOT NULL)"
