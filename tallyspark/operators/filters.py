"""Filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import asset_key, is_contract, toid

# Which criterion each resource can be filtered by.
SUPPORT = {
    "account": ("transactions", "operations", "payments", "effects"),
    "ledger": ("transactions", "operations", "payments", "effects"),
    "transaction": ("operations", "payments", "effects"),
    "operation": ("effects",),
    "liquidity_pool": ("transactions", "operations", "effects"),
    "claimable_balance": ("transactions", "operations", "payments", "effects"),
    "asset_pair": ("trades",),
    "include_failed": ("transactions", "operations"),
}
#: The columns that an account is looked for in; those that a table lacks are left out.
ACCOUNTS = ("source_account", "account", "source", "destination", "from", "to", "funder", "into", "trustor", "seller")
#: How many bits of an operation's number follow those of its ledger and of its transaction.
LEDGER_BITS, TX_BITS = 32, 12


def filter_resource(df: DataFrame, resource: str, include_failed: bool | None = None, operations: DataFrame | None = None, effects: DataFrame | None = None, **criteria) -> DataFrame:
    """Rows of a raw resource that meet every criterion: a value, or a one-column DataFrame of values (a watch list); for
    asset_pair two assets, `native` or CODE:ISSUER, whose trades are meant in either orientation. What the support matrix
    rules out is an error.

    A row meets `account` if any of its parties does. A ledger, transaction or operation is a range of the numbers that
    ids begin with: a single value reaches the scan as plain bounds of the id. Pools and claimable balances are named by
    effects only, so operations and transactions are found through those (give `effects`); transactions, whose records
    have no number, through `operations`. What is found that way is asked for first when it is the one range that a
    single transaction spans; everything else is a semi join.

    Failed transactions and their operations are left out unless asked for, where success is known."""
    asked = [*criteria, *(["include_failed"] if include_failed is not None else [])]
    for name in asked:
        if resource not in SUPPORT.get(name, ()):
            raise ValueError(f"{resource} cannot be filtered by {name}")
    success = next((c for c in ("successful", "transaction_successful") if c in df.columns), None)
    if not include_failed and success:
        df = df.where(F.col(success))
    for name, wanted in criteria.items():
        df = _BY[name](df, resource, wanted, {"operations": operations, "effects": effects})
    return df


def _given(tables: dict, name: str, why: str) -> DataFrame:
    if tables[name] is None:
        raise ValueError(f"{why} is found through {name}, which are not given")
    return tables[name]


def _by_values(df: DataFrame, columns: list[str], wanted) -> DataFrame:
    """Rows one of whose columns is wanted."""
    if not columns:
        raise ValueError("this table has no column for it")
    if not isinstance(wanted, DataFrame):
        return df.where(reduce(lambda x, y: x | y, [F.coalesce(F.col(f"`{c}`") == wanted, F.lit(False)) for c in columns]) if len(columns) > 1 else F.col(f"`{columns[0]}`") == wanted)
    if len(columns) == 1:
        return df.join(wanted.toDF("_wanted").distinct(), F.col(f"`{columns[0]}`") == F.col("_wanted"), "left_semi")
    # each row meets each watched value once: rows with several parties are put together again
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_party", F.explode(F.array_distinct(F.array(*[f"`{c}`" for c in columns]))))
    return rows.join(wanted.toDF("_party").distinct(), "_party", "left_semi").dropDuplicates(["_row"]).drop("_row", "_party")


def number_of(resource: str) -> Column:
    """The number of the operation that a record belongs to: its id, or what its id begins with."""
    return toid(F.col("id")) if resource == "effects" else F.coalesce(F.nullif("id", F.lit("")), "paging_token").try_cast("bigint")


def id_range(resource: str, low: int, high: int) -> Column:
    """Records whose operation's number is in [low, high], as bounds of the id's text: effects' ids are of one width,
    other ids have no leading zeros, so that numbers of one length stand in the order of their texts."""
    if resource == "effects":
        return (F.col("id") >= f"{low:019d}-") & (F.col("id") < f"{high:019d}.") & toid(F.col("id")).between(low, high)
    key = F.coalesce(F.nullif("id", F.lit("")), "paging_token") if resource == "payments" else F.col("id")
    lengths = range(len(str(max(low, 0))), len(str(max(high, 0))) + 1)
    parts = [(key >= str(max(low, 10 ** (n - 1) if n > 1 else 0))) & (key <= str(min(high, 10**n - 1))) & (F.length(key) == n) for n in lengths]
    return reduce(lambda x, y: x | y, parts)


def _by_number(df: DataFrame, resource: str, wanted, bits: int) -> DataFrame:
    """Records whose operation's number without its last bits is wanted."""
    if not isinstance(wanted, DataFrame):
        return df.where(id_range(resource, int(wanted) << bits, ((int(wanted) + 1) << bits) - 1))
    keys = wanted.toDF("_number").select(F.col("_number").cast("bigint")).distinct()
    return df.withColumn("_number", F.shiftright(number_of(resource), bits)).join(keys, "_number", "left_semi").drop("_number")


def _by_account(df, resource, wanted, tables):
    return _by_values(df, [c for c in ACCOUNTS if c in df.columns], wanted)


def _by_ledger(df, resource, wanted, tables):
    if resource not in ("transactions", "payments"):
        return _by_number(df, resource, wanted, LEDGER_BITS)
    # what the record says, or else what its other column or its number says
    first, second = ("ledger_attr", F.col("ledger")) if resource == "transactions" else ("ledger", F.shiftright(number_of(resource), LEDGER_BITS))
    if isinstance(wanted, DataFrame):
        keys = wanted.toDF("_ledger").select(F.col("_ledger").cast("bigint")).distinct()
        return df.withColumn("_ledger", F.coalesce(first, second)).join(keys, "_ledger", "left_semi").drop("_ledger")
    return df.where((F.col(first) == wanted) | (F.col(first).isNull() & (second == wanted)))


def _by_transaction(df, resource, wanted, tables):
    if resource != "effects":
        return _by_values(df, ["transaction_hash"], wanted)
    mine = _by_values(_given(tables, "operations", "a transaction's range of effects"), ["transaction_hash"], wanted)
    numbers = mine.select(F.shiftright(number_of("operations"), TX_BITS).alias("n")).where("n is not null").distinct()
    if isinstance(wanted, DataFrame):
        return _by_number(df, resource, numbers, TX_BITS)
    one = numbers.first()  # a transaction has one number
    return _by_number(df, resource, one.n, TX_BITS) if one else df.where(F.lit(False))


def _by_operation(df, resource, wanted, tables):
    return _by_number(df, resource, wanted, 0)


def _through_effects(named):
    """A filter on what effects name: the effects themselves, their operations, or the transactions of those."""

    def by(df, resource, wanted, tables):
        own = lambda e: named(e).alias("_named")
        if resource == "effects":
            return _by_values(df.withColumn("_named", own(df)), ["_named"], wanted).drop("_named") if isinstance(wanted, DataFrame) else df.where(named(df) == wanted)
        effects = _given(tables, "effects", "it")
        numbers = _by_values(effects.select("id", own(effects)), ["_named"], wanted).select(toid(F.col("id")).alias("n")).where("n is not null").distinct()
        if resource != "transactions":
            return _by_number(df, resource, numbers, 0)
        hashes = _by_number(_given(tables, "operations", "an effect's transaction"), "operations", numbers, 0).select(F.col("transaction_hash").alias("_hash")).distinct()
        return df.join(hashes, F.col("hash") == F.col("_hash"), "left_semi")

    return by


def _by_pair(df, resource, wanted, tables):
    base, counter = (asset_key(F.col(f"{side}_asset_type"), F.col(f"{side}_asset_code"), F.col(f"{side}_asset_issuer")) for side in ("base", "counter"))
    a, b = wanted
    # codes as well, which a scan can use
    code = lambda side, x: F.col(f"{side}_asset_type") == "native" if x == "native" else F.col(f"{side}_asset_code") == x.partition(":")[0]
    return df.where((code("base", a) & code("counter", b) & (base == a) & (counter == b)) | (code("base", b) & code("counter", a) & (base == b) & (counter == a)))


_BY = {
    "account": _by_account, "ledger": _by_ledger, "transaction": _by_transaction, "operation": _by_operation, "asset_pair": _by_pair,
    "liquidity_pool": _through_effects(lambda e: e["liquidity_pool"]["id"]), "claimable_balance": _through_effects(lambda e: e["balance_id"]),
}


def trades_for_pair(trades: DataFrame, base: str, counter: str) -> DataFrame:
    """Trades of a pair in either orientation, turned to (base, counter)."""
    as_is = (F.col("base_asset") == base) & (F.col("counter_asset") == counter)
    flipped = (F.col("base_asset") == counter) & (F.col("counter_asset") == base)
    pick = lambda a, b: F.when(as_is, F.col(a)).otherwise(F.col(b))
    return trades.where(as_is | flipped).select(
        "id", pick("base_amount", "counter_amount").alias("base_amount"), pick("counter_amount", "base_amount").alias("counter_amount"),
        F.when(as_is, F.col("price")).otherwise(F.coalesce(F.try_divide(F.lit(1.0), "price"), F.lit(0.0))).alias("price"),
    )


def filter_offers(offers: DataFrame, selling: str | None = None, buying: str | None = None) -> DataFrame:
    out = offers if selling is None else offers.where(F.col("selling") == selling)
    return out if buying is None else out.where(F.col("buying") == buying)


def filter_assets(assets: DataFrame, code: str | None = None, issuer: str | None = None) -> DataFrame:
    out = assets if code is None else assets.where(F.col("asset_code") == code)
    return out if issuer is None else out.where(F.col("asset_issuer") == issuer)


def ledger_range(latest: int, start: int | None = None, end: int | None = None, lookback: int = 17_280) -> tuple[int, int]:
    """First and last ledger asked for, both within 1 and the latest, the first not after the last."""
    latest = max(1, latest)
    last = latest if end is None else min(max(1, end), latest)
    first = max(1, latest - lookback) if start is None else max(1, start)
    return min(first, last), last


def recent_ledgers(df: DataFrame, start: int | None = None, end: int | None = None, lookback: int = 17_280, column: str = "ledger") -> DataFrame:
    """Rows of a range of ledgers, by default the last `lookback` ones up to the newest. The newest is asked for first (one
    number), so that the range is plain numbers, which the scan can use; a stream has no newest one and is refused."""
    if df.isStreaming:
        raise ValueError("a stream has no newest ledger; give read_contract_events or a filter its bounds")
    latest = df.agg(F.max(column)).first()[0]
    first, last = ledger_range(latest or 1, start, end, lookback)
    return df.where(F.col(column).between(first, last))


# The columns by which an effect is related to an account.
PARTIES = ("account", "source_account", "created_account", "destination", "trustor", "seller")


def effects_for_accounts(effects: DataFrame, accounts: DataFrame, key: str, columns=PARTIES) -> DataFrame:
    """Effects that name a watched account in any of the columns, once each; key tells effects apart."""
    parties = F.explode(F.array_distinct(F.array(*[F.trim(c) for c in columns]))).alias("id")
    watched = accounts.toDF("id").where("id <> ''").distinct()
    hit = effects.select(key, parties).join(watched, "id", "left_semi").select(key).distinct()
    return effects.join(hit, key, "left_semi")


def native_balance_effects(effects: DataFrame) -> DataFrame:
    """Effects that move a native balance, with their signed delta."""
    native = F.coalesce("asset_type", F.lit("native")) == "native"
    delta = (
        F.when(F.col("type") == "account_created", F.col("starting_balance"))
        .when((F.col("type") == "account_credited") & native, F.col("amount"))
        .when((F.col("type") == "account_debited") & native, -F.col("amount"))
    )
    return effects.withColumn("delta", delta.cast("decimal(38,7)")).where("delta is not null")


def balances_for_claimants(claimables: DataFrame, claimants: DataFrame) -> DataFrame:
    return claimables.join(claimants.toDF("destination").distinct(), "destination", "left_semi")


def filter_direction(payments: DataFrame, mode: str = "all") -> DataFrame:
    """self always passes, related only under all."""
    return payments if mode == "all" else payments.where(F.col("direction").isin(mode, "self"))


def page(df: DataFrame, key: str, cursor, n: int, descending: bool = False) -> DataFrame:
    """n rows after the cursor in key order, and whether more follow."""
    c = F.col(key)
    rows = df.where((c < cursor) if descending else (c > cursor)).orderBy(c.desc() if descending else c).limit(n + 1)
    ranked = rows.select("*", F.count("*").over(_all()).alias("_n"), F.row_number().over(_all().orderBy(c.desc() if descending else c)).alias("_r"))
    return ranked.where(F.col("_r") <= n).withColumn("truncated", F.col("_n") > n).drop("_n", "_r")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over at most n + 1 rows


# The forms that identifiers must have.
FORMS = {"hash": "^[0-9a-fA-F]{64}$", "pool": "^[0-9a-fA-F]{64}$", "asset_code": "^[A-Za-z0-9]{1,12}$"}
LAST_LEDGER = 2**31 - 1


def identifier_rules(**columns: str) -> dict:
    """Rules of audit_identifiers out of column names by form: hash, pool, asset_code, contract (with its checksum) or
    ledger."""
    rule = lambda form, c: F.col(c).between(1, LAST_LEDGER) if form == "ledger" else is_contract(F.col(c)) if form == "contract" else F.col(c).rlike(FORMS[form])
    return {form: rule(form, c) for form, c in columns.items()}


def audit_identifiers(df: DataFrame, rules: dict) -> DataFrame:
    """(rule, violations): rows that break each rule, in one pass; nulls break it."""
    one = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return one.select(F.inline(pairs))


def classify_time_bounds(txs: DataFrame, now: int) -> DataFrame:
    """bounds, and the seconds until they open (not yet valid) and close (valid, with an upper bound). A transaction is
    still valid at its last second; an upper bound of 0 is none."""
    low, high = F.coalesce("min_time", F.lit(0)), F.coalesce("max_time", F.lit(0))
    state = (
        F.when((low < 0) | (high < 0) | ((high > 0) & (high <= low)), "invalid")
        .when(low > now, "not_yet_valid")
        .when((high > 0) & (high < now), "expired")
        .when(high == 0, "open_ended")
        .otherwise("valid")
    )
    out = txs.withColumn("bounds", state)
    return out.withColumns({"opens_in": F.when(F.col("bounds") == "not_yet_valid", low - now), "closes_in": F.when(F.col("bounds").isin("valid", "not_yet_valid") & (high > 0), high - now)})


def time_bound_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("bounds").agg(F.count("*").alias("n"), F.min("closes_in").alias("soonest_close"))


def lookup(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each request with the table's columns and a found flag."""
    return requests.distinct().join(table.withColumn("_hit", F.lit(True)), key, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")
