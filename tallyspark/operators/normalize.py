"""Raw resource tables, as declared in sources.tables, to normalised ones; each is one projection.

Text that should be a number and is none gives null, or the default where one is named; no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MONEY, asset_key, effect_category, epoch, first_text, is_contract, money, price_of, ratio, toid
from .trees import fold, unfold


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _money_or_zero(c: Column) -> Column:
    return F.coalesce(money(c), F.lit(0)).cast(MONEY)


def normalize_payments(raw: DataFrame) -> DataFrame:
    """source, destination, amount (merges have none) and asset of payment-like operations. Empty text counts as missing.
    The amount prefers `amount`, each part of the asset prefers the destination's; a missing type is a payment."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("payment"))
    part = lambda name: first_text(f"destination_asset_{name}", f"asset_{name}")
    return raw.select(
        first_text("id", "paging_token").alias("id"),
        kind.alias("type"),
        "ledger",
        first_text("transaction_hash").alias("transaction_hash"),
        epoch(F.col("created_at")).alias("created_at"),
        first_text("from_muxed", "from", "funder", "source_account").alias("source"),
        first_text("to_muxed", "to", "account", "into_muxed", "into").alias("destination"),
        F.when(kind != "account_merge", money(first_text("amount", "destination_amount", "starting_balance"))).alias("amount"),
        asset_key(part("type"), part("code"), part("issuer")).alias("asset"),
    )


def normalize_trades(raw: DataFrame) -> DataFrame:
    """Null, unlike empty text, counts as missing. The ledger is that of the operation id."""
    key = F.coalesce("id", "paging_token")
    operation = F.regexp_replace(key, "^(.+)-[^-]*$", "$1")
    base, counter = _money_or_zero(F.col("base_amount")), _money_or_zero(F.col("counter_amount"))
    asset = lambda side: asset_key(*(F.col(f"{side}_asset_{part}") for part in ("type", "code", "issuer")))
    return raw.select(
        key.alias("id"),
        operation.alias("operation_id"),
        F.shiftright(operation.try_cast("bigint"), 32).alias("ledger"),
        epoch(F.col("ledger_close_time")).alias("close_time"),
        asset("base").alias("base_asset"),
        asset("counter").alias("counter_asset"),
        base.alias("base_amount"),
        counter.alias("counter_amount"),
        price_of(ratio(F.col("price.n"), F.col("price.d")), base, counter).alias("price"),
        F.coalesce("base_account", "base_liquidity_pool_id").alias("base_party"),
        F.coalesce("counter_account", "counter_liquidity_pool_id").alias("counter_party"),
        F.coalesce("base_is_seller", F.lit(False)).alias("base_is_seller"),
        F.coalesce("trade_type", F.lit("orderbook")).alias("venue"),
    )


def normalize_offers(raw: DataFrame) -> DataFrame:
    """The rational price, else the decimal one; the buying amount has 7 places."""
    asset = lambda side: asset_key(*(F.col(f"{side}.asset_{part}") for part in ("type", "code", "issuer")))
    price = F.coalesce(ratio(F.col("price_r.n"), F.col("price_r.d")), F.col("price").try_cast("double"))
    out = raw.select(
        F.coalesce("id", "paging_token").alias("id"), "seller", asset("selling").alias("selling"), asset("buying").alias("buying"),
        _money_or_zero(F.col("amount")).alias("amount"), price.alias("price"), "last_modified_ledger", epoch(F.col("last_modified_time")).alias("last_modified_time"),
    )
    return out.withColumns({"pair": F.concat_ws("/", "selling", "buying"), "buying_amount": F.round(F.col("amount").cast("double") * F.col("price"), 7)})


def normalize_pools(raw: DataFrame) -> DataFrame:
    """One row a reserve (a pool without any has one with null place): asset split at its first colon."""
    r = raw.select(
        "id", F.coalesce("type", F.lit("Unknown")).alias("type"), (_or_zero(F.col("fee_bp")) / 100.0).cast("double").alias("fee_percent"), _or_zero(F.col("total_trustlines")).alias("participants"),
        _money_or_zero(F.col("total_shares")).alias("total_shares"), "last_modified_ledger", F.posexplode_outer("reserves").alias("place", "r"),
    )
    asset, colon = F.nullif("r.asset", F.lit("")), F.instr("r.asset", ":")
    kind = F.when(asset == "native", "native").when(colon > 0, "issued").otherwise("unknown")
    code = F.when(asset == "native", "XLM").when(asset.isNotNull(), F.nullif(F.substring_index("r.asset", ":", 1), F.lit("")))
    there = F.col("place").isNotNull()
    return r.select(
        *r.columns[:-1], F.when(there, kind).alias("kind"), F.when(there, F.coalesce(asset, F.lit("Unknown"))).alias("asset"), F.when(there, F.coalesce(code, F.lit("Unknown"))).alias("code"),
        F.when(colon > 0, F.nullif(F.expr("substring(r.asset, instr(r.asset, ':') + 1)"), F.lit(""))).alias("issuer"), F.when(there, _money_or_zero(F.col("r.amount"))).alias("amount"),
    )


def normalize_assets(raw: DataFrame) -> DataFrame:
    """Holders are the sum of the three groups when these are there, else the legacy count, which also stands in for a
    missing authorized group."""
    group = lambda name: F.col(f"accounts.{name}")
    groups = ("authorized", "authorized_to_maintain_liabilities", "unauthorized")
    total = sum((_or_zero(group(g)) for g in groups), F.lit(0).cast("long"))
    legacy = _or_zero(F.col("num_accounts"))
    code, issuer = (F.coalesce(f"asset_{c}", F.lit("Unknown")) for c in ("code", "issuer"))
    return raw.select(
        F.concat_ws(":", code, issuer).alias("asset"), F.coalesce("asset_type", F.lit("Unknown")).alias("asset_type"), code.alias("asset_code"), issuer.alias("asset_issuer"),
        F.when(F.col("accounts").isNotNull(), total).otherwise(legacy).alias("holders"), F.coalesce(group("authorized"), legacy).alias("authorized"),
        _or_zero(group(groups[1])).alias("maintain"), _or_zero(group("unauthorized")).alias("unauthorized"),
        *[_money_or_zero(F.col(f"balances.{g}")).alias(f"{n}_balance") for g, n in zip(groups, ("authorized", "maintain", "unauthorized"))],
        _or_zero(F.col("num_claimable_balances")).alias("claimable_balances"), _money_or_zero(F.col("claimable_balances_amount")).alias("claimable_amount"),
        _or_zero(F.col("num_liquidity_pools")).alias("pools"), _money_or_zero(F.col("liquidity_pools_amount")).alias("pools_amount"),
        _or_zero(F.col("num_contracts")).alias("contracts"), _money_or_zero(F.col("contracts_amount")).alias("contracts_amount"),
        *[F.coalesce(f"flags.{f}", F.lit(False)).alias(f) for f in FLAGS],
    )


# Flags of an account and their bits.
FLAGS = {"auth_required": 1, "auth_revocable": 2, "auth_immutable": 4, "auth_clawback_enabled": 8}


def normalize_ledgers(raw: DataFrame) -> DataFrame:
    count = lambda c: _or_zero(F.col(c)).cast("long").alias(c)
    return raw.select(
        "sequence", F.coalesce("hash", "id").alias("hash"), "prev_hash", count("successful_transaction_count"), count("failed_transaction_count"), count("operation_count"),
        F.coalesce("tx_set_operation_count", "operation_count", F.lit(0)).cast("long").alias("tx_set_operation_count"), epoch(F.col("closed_at")).alias("closed_at"),
        F.coalesce("base_fee_in_stroops", F.lit(100)).alias("base_fee"), F.coalesce("base_reserve_in_stroops", F.lit(5_000_000)).alias("base_reserve"),
        _money_or_zero(F.col("total_coins")).alias("total_coins"), _money_or_zero(F.col("fee_pool")).alias("fee_pool"), _or_zero(F.col("max_tx_set_size")).alias("max_tx_set_size"), _or_zero(F.col("protocol_version")).alias("protocol_version"),
    )


def snake(code: Column) -> Column:
    """txBadSeq as tx_bad_seq."""
    return F.lower(F.regexp_replace(code, "([a-z0-9])([A-Z])", "$1_$2"))


def normalize_transactions(raw: DataFrame) -> DataFrame:
    """A missing result code follows from success; without success given, a transaction counts as failed."""
    ok = F.coalesce("successful", F.lit(False))
    code = snake(F.coalesce(first_text("result_code"), F.nullif("result_codes.transaction", F.lit(""))))
    whole = lambda c: F.col(c).try_cast("bigint")
    return raw.select(
        "hash", F.coalesce("ledger_attr", "ledger").alias("ledger"), epoch(F.col("created_at")).alias("created_at"), "source_account", F.when(ok, "success").otherwise("failed").alias("status"),
        whole("source_account_sequence").alias("source_sequence"), "fee_account", whole("fee_charged").alias("fee_charged"), whole("max_fee").alias("max_fee"), F.col("operation_count").cast("long").alias("operation_count"),
        F.coalesce("memo_type", F.lit("none")).alias("memo_type"), F.when(F.coalesce("memo_type", F.lit("")) != "none", F.nullif("memo", F.lit(""))).alias("memo"),
        F.coalesce(code, F.when(ok, "tx_success").otherwise("tx_failed")).alias("result_code"), F.transform("result_codes.operations", snake).alias("operation_codes"),
        F.col("inner_transaction.hash").alias("inner_hash"), F.col("inner_transaction.max_fee").try_cast("bigint").alias("inner_max_fee"), "min_time", "max_time", "min_ledger", "max_ledger",
    )


def contract_id(c: Column) -> Column:
    """The id, blank where it is none."""
    return F.when(is_contract(c), c).otherwise("")


def normalize_contract_events(raw: DataFrame) -> DataFrame:
    """The name is the first topic's value if that is a symbol; an event without one is `(unnamed)`. Success is assumed
    unless denied."""
    first = F.get("topic", F.lit(0))
    name = F.when(first["xdr_type"] == "scvSymbol", first["value"])
    return raw.select(
        "id", F.coalesce("type", F.lit("contract")).alias("type"), _or_zero(F.col("ledger")).alias("ledger"), "tx_hash", contract_id(F.col("contract_id")).alias("contract_id"),
        F.coalesce(name, F.lit("(unnamed)")).alias("name"), F.coalesce(F.transform("topic", lambda t: t["value"]), F.array().cast("array<string>")).alias("topics"),
        F.coalesce("value.xdr_type", F.lit("void")).alias("value_type"), F.coalesce("in_successful_contract_call", F.lit(True)).alias("successful"), "paging_token",
    )


def index_effects(effects: DataFrame) -> DataFrame:
    """Ledger, transaction and operation order and effect index from the id; null where it does not decode."""
    t = toid(F.col("id"))
    return effects.withColumn("toid", t).select(
        *effects.columns, "toid", F.shiftright("toid", 32).alias("id_ledger"), F.shiftright("toid", 12).bitwiseAND(F.lit(0xFFFFF)).alias("tx_order"),
        F.col("toid").bitwiseAND(F.lit(0xFFF)).alias("op_index"), F.when(F.col("toid").isNotNull(), F.substring_index("id", "-", -1).try_cast("bigint")).alias("effect_index"),
    )


def normalize_effects(raw: DataFrame) -> DataFrame:
    """The subject is the first party named, a pool as `pool:` and its id, or `(none)`; the asset is null where none is
    named; the ledger is that of the id."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown"))
    pool = F.concat(F.lit("pool:"), F.nullif("liquidity_pool.id", F.lit("")))
    named = asset_key(F.col("asset_type"), F.col("asset_code"), F.col("asset_issuer"))
    asset = F.when((F.col("asset_type") == "native") | F.nullif("asset_code", F.lit("")).isNotNull(), named)
    return raw.select(
        "id", F.shiftright(toid(F.col("id")), 32).alias("ledger"), kind.alias("type"), F.coalesce(first_text("account", "trustor", "seller", "contract"), pool, F.lit("(none)")).alias("subject"),
        asset.alias("asset"), F.coalesce(money(F.col("amount")), money(F.col("starting_balance"))).alias("amount"), effect_category(kind).alias("category"), epoch(F.col("created_at")).alias("created_at"),
    )


# Types of contract values by what they decode to.
WHOLE, WIDE = ("scvU32", "scvI32"), ("scvU64", "scvI64", "scvU128", "scvI128", "scvU256", "scvI256", "scvTimepoint", "scvDuration")
TEXTS = ("scvSymbol", "scvString", "scvAddress")


def _values(nodes: DataFrame) -> DataFrame:
    """What a typed value (kind, value, payload) decodes to by itself, as JSON text: small integers as numbers, wide ones
    as strings, bytes as hex text; null where it is not what its type says or is of another type. Its parts are the
    elements of a vector, or keys and values of a map in turn."""
    kind, value = F.col("kind"), F.col("value")
    text = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    number = value.rlike(r"^-?\d+$")
    json = (
        F.when(kind.isin("void", "scvVoid"), "null")
        .when(kind == "scvBool", F.when(value.isin("true", "false"), value))
        .when(kind.isin(*WHOLE), F.when(number, value))
        .when(kind.isin(*WIDE), F.when(number, F.concat(F.lit('"'), value, F.lit('"'))))
        .when(kind == "scvBytes", F.concat(F.lit('"0x'), F.lower(F.hex(F.try_to_binary(value, F.lit("base64")))), F.lit('"')))
        .when(kind.isin(*TEXTS) & value.isNotNull(), text)
    )
    items = F.try_variant_get("payload", "$", "array<variant>")
    pair = lambda x: F.array(F.try_variant_get(x, "$.key", "variant"), F.try_variant_get(x, "$.val", "variant"))
    parts = F.when(kind == "scvVec", items).when(kind == "scvMap", F.flatten(F.transform(items, pair)))
    return nodes.withColumns({"json": json, "parts": parts}).drop("value", "payload")


def _inner_values(nodes: DataFrame) -> DataFrame:
    """Nodes of {type, value}."""
    get = lambda path, kind: F.try_variant_get("node", path, kind)
    return _values(nodes.withColumns({"kind": get("$.type", "string"), "value": get("$.value", "string"), "payload": get("$.value", "variant")}).drop("node"))


def _put_together(nodes: DataFrame) -> DataFrame:
    """Vectors and maps out of what their parts decode to (kids); null if one does not."""
    texts = F.transform("kids", lambda k: k["json"])
    key = lambda k: F.when(k.startswith('"'), k).otherwise(F.concat(F.lit('"'), F.replace(k, F.lit('"'), F.lit('\\"')), F.lit('"')))
    entries = F.transform(F.filter(F.transform("kids", lambda k, i: F.struct(i.alias("i"), k["json"].alias("key"))), lambda e: e["i"] % 2 == 0), lambda e: F.concat(key(e["key"]), F.lit(":"), F.get("kids", e["i"] + 1)["json"]))
    whole = F.when(F.col("kind") == "scvVec", F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))
    made = F.when(~F.exists(texts, F.isnull), whole)
    return nodes.withColumn("json", F.when(F.col("parts").isNull(), F.col("json")).otherwise(made))


KNOWN = ("void", "scvVoid", "scvBool", "scvBytes", "scvVec", "scvMap", *WHOLE, *WIDE, *TEXTS)


def decode_values(typed: DataFrame) -> DataFrame:
    """typed with its kind and value (text; vectors and maps as JSON of typed values, nested to any depth) replaced by
    json, JSON-safe text, which is null where something is not what its type says, or of an unknown type."""
    roots = _values(typed.withColumn("payload", F.try_parse_json("value")))
    return fold(unfold(roots, _inner_values, []), _put_together, {"json": "string"})


def decode_event_values(events: DataFrame) -> DataFrame:
    """Each event's value (xdr_type, value) as JSON-safe text, with whether it decoded and why not."""
    out = decode_values(events.select("id", F.coalesce("value.xdr_type", F.lit("void")).alias("kind"), F.col("value.value").alias("value")))
    error = F.when(F.col("json").isNotNull(), None).when(F.col("kind").isin(*KNOWN), F.concat(F.lit("not a value of type "), "kind")).otherwise(F.concat(F.lit("unsupported type "), "kind"))
    return out.select("id", F.col("kind").alias("xdr_type"), F.col("json").alias("value"), F.col("json").isNotNull().alias("decoded"), error.alias("error"))


def decode_report(decoded: DataFrame) -> DataFrame:
    """(xdr_type, n, failed) of decoded values: how many of each type there are, and how many did not decode."""
    return decoded.groupBy("xdr_type").agg(F.count("*").alias("n"), F.count_if(~F.col("decoded")).alias("failed"))


def decode_event_topics(events: DataFrame) -> DataFrame:
    """(id, place, xdr_type, value, decoded): every topic of an event, in order, decoded by its type."""
    topics = events.select("id", F.posexplode("topic").alias("topic_place", "t"))
    out = decode_values(topics.select("id", "topic_place", F.coalesce("t.xdr_type", F.lit("void")).alias("kind"), F.col("t.value").alias("value")))
    return out.select("id", F.col("topic_place").alias("place"), F.col("kind").alias("xdr_type"), F.col("json").alias("value"), F.col("json").isNotNull().alias("decoded"))


def normalize_accounts(raw: DataFrame) -> DataFrame:
    """The native balance out of `balances`, counters with 0 for null, thresholds, flags, the own key's weight, the
    number of other signers and the weight of all."""
    native = F.get(F.filter("balances", lambda b: b["asset_type"] == "native"), F.lit(0))["balance"]
    own = F.get(F.filter("signers", lambda s: s["key"] == F.col("id")), F.lit(0))["weight"]
    counters = [_or_zero(F.col(c)).cast("long").alias(c) for c in ("subentry_count", "num_sponsored", "num_sponsoring")]
    others = F.filter("signers", lambda s: s["key"] != F.col("id"))
    every = F.aggregate("signers", F.lit(0), lambda acc, s: acc + _or_zero(s["weight"]))
    return raw.select(
        "id", F.col("sequence").try_cast("bigint").alias("sequence"), _money_or_zero(native.cast("string")).alias("native_balance"), *counters, F.nullif("sponsor", F.lit("")).alias("sponsor"), F.nullif("home_domain", F.lit("")).alias("home_domain"),
        *[_or_zero(F.col(f"thresholds.{t}")).alias(t) for t in ("low_threshold", "med_threshold", "high_threshold")], *[F.coalesce(f"flags.{f}", F.lit(False)).alias(f) for f in FLAGS],
        _or_zero(own).alias("primary_weight"), _or_zero(F.size(F.filter(others, lambda s: s["weight"] > 0))).cast("long").alias("cosigners"), F.greatest(F.lit(0), F.size(others)).cast("long").alias("other_signers"), F.coalesce(every, F.lit(0)).alias("total_weight"),
    )


def normalize_trustlines(raw: DataFrame) -> DataFrame:
    """One row a balance line of issued assets out of accounts."""
    line = raw.select("id", F.explode("balances").alias("b")).where("coalesce(b.asset_type, '') not in ('native', 'liquidity_pool_shares')")
    amount = lambda c: _money_or_zero(F.col(f"b.{c}")).alias(c)
    return line.select(
        F.col("id").alias("account"), "b.asset_code", "b.asset_issuer", amount("balance"), amount("limit"), amount("buying_liabilities"), amount("selling_liabilities"),
        F.coalesce("b.is_authorized", F.lit(False)).alias("is_authorized"), F.coalesce("b.is_authorized_to_maintain_liabilities", F.lit(False)).alias("is_authorized_to_maintain_liabilities"),
    )


def explode_account_data(accounts: DataFrame) -> DataFrame:
    """One row a key of `data_attr`, its base64 value decoded; null where it is empty or no base64."""
    value = F.nullif(F.col("encoded"), F.lit(""))
    return accounts.select("id", F.explode("data_attr").alias("name", "encoded")).select("id", "name", F.decode(F.try_to_binary(value, F.lit("base64")), "UTF-8").alias("value"))
