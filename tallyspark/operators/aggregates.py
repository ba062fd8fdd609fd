"""Summaries. Results that would be count maps are long tables (key, count)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import MONEY, direction
from ..sources.tables import stored
from .normalize import FLAGS
from .trees import fold, unfold


def _money(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def trade_summary(trades: DataFrame, by=("base_asset", "counter_asset")) -> DataFrame:
    """VWAP is counter over base volume, 0 without base volume; the mean price is unweighted. Over everything (by
    nothing) there is one row, of zeros and null times if there are no trades."""
    out = trades.groupBy(*by).agg(
        F.count("*").alias("trades"), _money("base_amount").alias("base_volume"), _money("counter_amount").alias("counter_volume"),
        F.round(F.coalesce(F.avg("price"), F.lit(0.0)), 6).alias("mean_price"), F.coalesce(F.max("price"), F.lit(0.0)).alias("high"), F.coalesce(F.min("price"), F.lit(0.0)).alias("low"),
        F.min("close_time").alias("first_time"), F.max("close_time").alias("last_time"), F.count_if(F.col("venue") == "orderbook").alias("orderbook_trades"), F.count_if(F.col("venue") == "liquidity_pool").alias("pool_trades"),
    )
    vwap = F.when(F.col("base_volume") == 0, 0.0).otherwise(F.round(F.col("counter_volume").cast("double") / F.nullif("base_volume", F.lit(0)).cast("double"), 6))
    return out.withColumn("vwap", vwap)


def with_direction(payments: DataFrame) -> DataFrame:
    """One row for each account that a payment touches, with the direction from its side."""
    each = payments.withColumn("inspected", F.explode(F.array_distinct(F.array("source", "destination"))))
    return each.where("inspected is not null").withColumn("direction", direction(F.col("inspected"), F.col("source"), F.col("destination")))


def payment_summary(payments: DataFrame) -> DataFrame:
    count = lambda d: F.count_if(F.col("direction") == d).alias(d if d != "self" else "self_payments")
    return with_direction(payments).groupBy("inspected").agg(F.count("*").alias("total"), count("incoming"), count("outgoing"), count("self"), count("related"))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def ledger_effects_summary(effects: DataFrame) -> DataFrame:
    """By ledger; distinct transactions are (ledger, order). One pass: what is told apart are the effects of one ledger,
    whose number the protocol bounds."""
    distinct = lambda c, name: F.size(F.collect_set(c)).cast("long").alias(name)
    return effects.groupBy("ledger").agg(
        F.count("*").alias("effects"), distinct("type", "types"), distinct("account", "accounts"),
        distinct(F.when(F.col("toid").isNotNull(), F.struct("id_ledger", "tx_order")), "transactions"), distinct("toid", "operations"),
    )


def effects_overview(by_ledger: DataFrame) -> DataFrame:
    """Ledgers seen, and their effects and transactions, out of ledger_effects_summary."""
    return by_ledger.agg(F.count("*").alias("ledgers"), F.coalesce(F.sum("effects"), F.lit(0)).alias("effects"), F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"))


def _one_row(*parts: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def distinct_count(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row: how many values of key there are, by grouping first (several distinct counts in one aggregation would
    multiply its rows)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.count("*").alias(name))


def effects_by(effects: DataFrame, key: str) -> DataFrame:
    return effects.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    n = counts(df, key)
    total = n.agg(F.sum("n").alias("_total"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.round(100.0 * F.col("n") / F.col("_total"), 1)).drop("_total")  # one row


def contract_event_summary(events: DataFrame) -> DataFrame:
    """Count maps by name and by type, and the total, in one pass of grouping sets."""
    first = F.min(F.when(F.col("ledger") > 0, F.col("ledger")))
    last = F.max(F.when(F.col("ledger") > 0, F.col("ledger")))
    out = events.groupingSets([["name"], ["type"], []], "name", "type").agg(
        F.count("*").alias("n"), first.alias("first_ledger"), last.alias("last_ledger"), F.count_if(~F.col("successful")).alias("failed"), F.grouping_id().alias("_g")
    )
    return out.select(F.when(F.col("_g") == 1, "name").when(F.col("_g") == 2, "type").otherwise("total").alias("grouped_by"), F.coalesce("name", "type", F.lit("")).alias("value"), "n", "first_ledger", "last_ledger", "failed")


def contract_event_totals(events: DataFrame) -> DataFrame:
    """One row: events, contracts (blank ids apart), transactions, failed, first and last ledger above 0. Totals are by
    contract first, so that each id is checked once an event."""
    seen = F.when(F.col("ledger") > 0, F.col("ledger"))
    each = events.groupBy("contract_id").agg(F.count("*").alias("n"), F.count_if(~F.col("successful")).alias("bad"), F.min(seen).alias("low"), F.max(seen).alias("high"))
    summed = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    total = each.agg(summed("n", "events"), summed("bad", "failed"), F.min("low").alias("first_ledger"), F.max("high").alias("last_ledger"), F.count_if(F.col("contract_id") != "").alias("contracts"))
    return _one_row(total, distinct_count(events.where("tx_hash <> ''"), "tx_hash", "transactions"))


def most_active(df: DataFrame, key: str, k: int, order: str | None = None) -> DataFrame:
    """The k most frequent keys that are neither null nor blank; ties to the first seen (order column) or the smallest."""
    tie = F.min(order) if order else F.min(key)
    named = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return named.groupBy(key).agg(F.count("*").alias("n"), tie.alias("_tie")).orderBy(F.desc("n"), "_tie", key).limit(k).drop("_tie")


def offer_book_summary(offers: DataFrame) -> DataFrame:
    return _one_row(offers.agg(F.count("*").alias("offers")), distinct_count(offers, "seller", "sellers"), distinct_count(offers, "pair", "pairs"))


def offer_totals(offers: DataFrame, by=()) -> DataFrame:
    """What is sold and (approximately) bought of each asset, in all or by further columns such as the seller."""
    sell = offers.groupBy(*by, F.col("selling").alias("asset")).agg(F.lit("selling").alias("side"), F.sum("amount").cast(MONEY).alias("total"))
    buy = offers.groupBy(*by, F.col("buying").alias("asset")).agg(F.lit("buying").alias("side"), F.sum(F.col("buying_amount").cast(MONEY)).cast(MONEY).alias("total"))
    return sell.unionByName(buy)


def best_prices(offers: DataFrame) -> DataFrame:
    """(base, counter, best_ask, best_bid, spread) of each pair, in counter for one of base: the least price of offers
    that sell base, and the largest that those who sell counter would pay. Prices that are not positive are left out."""
    least = offers.where("price > 0").groupBy("selling", "buying").agg(F.min("price").alias("least"))
    asks = least.select(F.col("selling").alias("base"), F.col("buying").alias("counter"), F.col("least").alias("best_ask"))
    bids = least.select(F.col("buying").alias("base"), F.col("selling").alias("counter"), (1 / F.col("least")).alias("best_bid"))
    return asks.join(bids, ["base", "counter"], "full").withColumn("spread", F.round(F.col("best_ask") - F.col("best_bid"), 7))


def order_book_depth(offers: DataFrame) -> DataFrame:
    """Cumulative amount by price level of each pair."""
    levels = offers.groupBy("selling", "buying", "price").agg(F.sum("amount").cast(MONEY).alias("amount"))
    w = Window.partitionBy("selling", "buying").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumn("depth", F.sum("amount").over(w).cast(MONEY))


def pool_summary(reserves: DataFrame, by=()) -> DataFrame:
    """Pools, their reserve entries and participants, in all or by type; reserves have one row a reserve, or one with a
    null place."""
    head = F.coalesce("place", F.lit(0)) == 0
    return reserves.groupBy(*by).agg(F.count_if(head).alias("pools"), F.count("place").alias("reserve_entries"), F.coalesce(F.sum(F.when(head, F.col("participants"))), F.lit(0)).alias("participants"))


def pool_inventory(reserves: DataFrame) -> DataFrame:
    held = reserves.where("place is not null")
    return held.groupBy("kind", "code", "issuer").agg(F.sum("amount").cast(MONEY).alias("amount"), F.count("*").alias("n"))


def pool_positions(reserves: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, pool, asset, shares, amount): what each holder's shares are worth of every reserve, pro rata. Lines of
    pool shares are among the raw balances of accounts; a pool without shares gives 0."""
    line = accounts.select("id", F.explode("balances").alias("b")).where("b.asset_type = 'liquidity_pool_shares'")
    shares = line.select(F.col("id").alias("account"), F.col("b.liquidity_pool_id").alias("pool"), F.coalesce(F.col("b.balance").try_cast("decimal(19,7)"), F.lit(0)).cast("decimal(19,7)").alias("shares"))
    pools = reserves.where("place is not null").select(F.col("id").alias("pool"), "asset", F.col("amount").alias("_amount"), "total_shares")
    part = F.coalesce(F.col("shares").cast("double") / F.nullif("total_shares", F.lit(0)).cast("double"), F.lit(0.0))
    return shares.join(pools, "pool").select("account", "pool", "asset", "shares", F.round(F.col("_amount").cast("double") * part, 6).alias("amount"))


def pool_price_bounds(reserves: DataFrame, bps: int = 200) -> DataFrame:
    """(id, spot, min_price, max_price) of pools of two reserves: second for one of the first, and that price less and
    more so many hundredths of a per cent."""
    side = lambda i: F.max(F.when(F.col("place") == i, F.col("amount"))).cast("double")
    spot = reserves.groupBy("id").agg((side(1) / F.nullif(side(0), F.lit(0.0))).alias("spot")).where("spot is not null")
    return price_bounds(spot, bps)


def price_bounds(df: DataFrame, bps: int = 200) -> DataFrame:
    """df (with spot) with min_price and max_price, of 7 places."""
    delta = F.col("spot") * (bps / 10_000)
    return df.withColumns({"min_price": F.round(F.col("spot") - delta, 7), "max_price": F.round(F.col("spot") + delta, 7)})


def asset_summary(assets: DataFrame) -> DataFrame:
    total = assets.agg(F.count("*").alias("records"), F.coalesce(F.sum("holders"), F.lit(0)).alias("holders"), F.coalesce(F.sum("claimable_balances"), F.lit(0)).alias("claimable_balances"))
    return _one_row(total, distinct_count(assets, "asset_code", "codes"), distinct_count(assets, "asset_issuer", "issuers"))


def ambiguous_codes(assets: DataFrame) -> DataFrame:
    return assets.groupBy("asset_code").agg(F.countDistinct("asset_issuer").alias("issuers")).where("issuers > 1")


# Where units of an asset can be.
PLACES = ("authorized", "maintain", "unauthorized", "claimable", "pool")


def asset_stats(trustlines: DataFrame, claimables: DataFrame, reserves: DataFrame) -> DataFrame:
    """By asset: entries and amounts on trustlines of each authorisation, in claimable balances and in pools, and all of
    it as supply. One aggregation over the three inputs; native is not issued and stays out."""
    state = F.when(F.col("is_authorized"), "authorized").when(F.col("is_authorized_to_maintain_liabilities"), "maintain").otherwise("unauthorized")
    amount = lambda c: F.col(c).cast(MONEY).alias("amount")
    lines = trustlines.select(F.concat_ws(":", "asset_code", "asset_issuer").alias("asset"), state.alias("place"), amount("balance"))
    claims = claimables.select("asset", F.lit("claimable").alias("place"), amount("amount"))
    pools = reserves.where("place is not null").select("asset", F.lit("pool").alias("place"), amount("amount"))
    every = lines.unionByName(claims).unionByName(pools).where("asset <> 'native'")
    at = lambda p: F.col("place") == p
    return every.groupBy("asset").agg(
        *[F.count_if(at(p)).alias(f"{p}_count") for p in PLACES],
        *[F.coalesce(F.sum(F.when(at(p), F.col("amount"))), F.lit(0)).cast(MONEY).alias(f"{p}_amount") for p in PLACES],
        _money("amount").alias("supply"),
    )


def fee_stats(transactions: DataFrame, ledgers: DataFrame, width: int = 1000) -> DataFrame:
    """By bucket of ledgers: percentiles out of the histogram of fees (the fees are few, the transactions many), the base
    fee of its newest ledger, the share of capacity that was used, and the larger of base fee and p90 as recommended."""
    hist = transactions.groupBy(F.floor(F.col("ledger") / width).alias("bucket"), F.col("fee_charged").alias("fee")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("bucket").orderBy("fee").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("bucket")))
    q = lambda p: F.min(F.when(F.col("cum") * 100 >= F.col("total") * p, F.col("fee"))).alias(f"p{p}")
    fees = ranked.groupBy("bucket").agg(F.min("fee").alias("min_fee"), F.max_by("fee", F.struct("n", -F.col("fee"))).alias("mode_fee"), *map(q, (50, 90, 95, 99)))
    used = F.round(F.sum("operation_count").cast("double") / F.nullif(F.sum("max_tx_set_size"), F.lit(0)).cast("double"), 4)
    load = ledgers.groupBy(F.floor(F.col("sequence") / width).alias("bucket")).agg(F.max_by("base_fee", "sequence").alias("base_fee"), used.alias("capacity_usage"))
    out = fees.join(load, "bucket", "left").withColumn("base_fee", F.coalesce("base_fee", F.lit(100)))
    return out.withColumn("recommended", F.greatest("base_fee", "p90"))


def fee_estimates(stats: DataFrame, op_counts=(1, 2, 10)) -> DataFrame:
    """Tiers of which none is below the one before, times the operation counts (a short list, each at least 1)."""
    if any(n < 1 for n in op_counts):
        raise ValueError("a transaction has at least one operation")
    low = F.greatest("base_fee", "p50")
    recommended = F.greatest(low, F.col("p90"))
    tiers = stats.select("bucket", low.alias("low"), recommended.alias("recommended"), F.greatest(recommended, F.col("p99")).alias("high"))
    n = F.explode(F.array(*[F.lit(x).cast("bigint") for x in op_counts])).alias("operations")
    return tiers.select("*", n).select("bucket", "operations", *[(F.col(c) * F.col("operations")).alias(c) for c in ("low", "recommended", "high")])


def failing_operations(transactions: DataFrame) -> DataFrame:
    """Failed transactions with the place (from 0) and code of their first operation that did not succeed; null where all
    did, or none is known."""
    codes = F.filter(F.transform("operation_codes", lambda c, i: F.struct(i.alias("at"), c.alias("code"))), lambda x: x["code"] != "op_success")
    first = F.get(codes, F.lit(0))
    return transactions.where("status = 'failed'").select("hash", "result_code", first["at"].alias("failing_index"), first["code"].alias("failing_code"))


def operation_code_counts(transactions: DataFrame) -> DataFrame:
    """Operations of failed transactions by code."""
    return counts(transactions.where("status = 'failed'").select(F.explode("operation_codes").alias("code")), "code")


# The address fields of an operation.
ADDRESSES = ("source_account", "funder", "account", "to", "from", "into")


def counterparties(operations: DataFrame) -> DataFrame:
    """(account, counterparty, n): by how many operations each source account is tied to each other address in them."""
    others = F.array_distinct(F.array(*[F.nullif(c, F.lit("")) for c in ADDRESSES]))
    each = operations.select(F.col("source_account").alias("account"), F.explode(others).alias("counterparty"))
    return counts(each.where("account <> '' and counterparty is not null and counterparty <> account"), "account", "counterparty")


def reserve_requirements(accounts: DataFrame) -> DataFrame:
    """Formula A, clamping net entries at 0; half a unit an entry."""
    net = F.greatest(F.lit(0), F.col("subentry_count") - F.col("num_sponsored") + F.col("num_sponsoring"))
    reserve = ((F.lit(2) + net) * F.lit(5_000_000)).cast("bigint")
    out = accounts.select("id", "balance", reserve.alias("reserve_stroops"))
    return out.withColumn("available", (F.col("balance") - F.col("reserve_stroops").cast("decimal(19,7)") / 10_000_000).cast(MONEY)).withColumn("below", F.col("available") <= 0)


def reserve_totals(requirements: DataFrame) -> DataFrame:
    return requirements.agg(F.count("*").alias("accounts"), F.count_if("below").alias("at_or_below"), F.coalesce(F.sum("reserve_stroops"), F.lit(0)).alias("reserve_stroops"), _money("available").alias("available"))


def reserve_impact(accounts: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Formula B, which may reach 0, and the unsponsored estimate, in the base reserve of the newest ledger (one row)."""
    reserve = ledgers.agg(F.coalesce(F.max_by("base_reserve", "sequence"), F.lit(5_000_000)).alias("base_reserve"))
    b = F.greatest(F.lit(0), 2 + F.col("subentry_count") + F.col("num_sponsoring") - F.col("num_sponsored"))
    with_, without = b.cast("bigint"), (2 + F.col("subentry_count")).cast("bigint")
    each = accounts.crossJoin(F.broadcast(reserve)).select("id", with_.alias("entries_b"), without.alias("entries_unsponsored"), "num_sponsoring", "num_sponsored", "base_reserve")
    stroops = lambda c, name: (F.col(c) * F.col("base_reserve")).alias(name)
    return each.select("id", "entries_b", "entries_unsponsored", stroops("num_sponsoring", "responsibility"), stroops("num_sponsored", "relief"), stroops("entries_b", "minimum"), stroops("entries_unsponsored", "minimum_unsponsored"))


def flag_audit(accounts: DataFrame) -> DataFrame:
    """Of each account: its flags as a number, whether all are off, whether it is locked (nobody can sign), and what an
    audit would note, as short codes. Takes primary_weight and other_signers as normalize_accounts gives them."""
    on = F.col
    mask = sum((F.when(on(c), bit).otherwise(0) for c, bit in FLAGS.items()), F.lit(0))
    no_master = on("primary_weight") == 0
    locked = no_master & (on("other_signers") == 0)
    noted = (
        (on("auth_immutable"), "immutable"),
        (on("auth_required") & on("auth_revocable"), "gated_and_freezable"),
        (on("auth_revocable") & ~on("auth_required"), "freezable"),
        (on("auth_required") & ~on("auth_revocable"), "gated"),
        (on("auth_clawback_enabled"), "clawback"),
        (on("auth_clawback_enabled") & ~on("auth_revocable"), "clawback_without_revocable"),
        (no_master & (on("other_signers") > 0), "master_disabled"),
        (locked, "locked"),
        (on("auth_immutable") & no_master, "locked_issuer"),
    )
    findings = F.array_compact(F.array(*[F.when(c, name) for c, name in noted]))
    return accounts.select("id", mask.cast("int").alias("mask"), (mask == 0).alias("defaults"), locked.alias("locked"), findings.alias("findings"))


def finding_counts(audit: DataFrame) -> DataFrame:
    return counts(audit.select(F.explode("findings").alias("finding")), "finding")


LEVELS = ("low", "med", "high")


def signing_power(accounts: DataFrame) -> DataFrame:
    """Which levels the own key alone and all signers together can meet, and whether nobody can sign at all."""
    meets = lambda who, weight: [(F.col(weight) >= F.greatest(F.lit(1), F.col(f"{n}_threshold"))).alias(f"{who}_{n}") for n in LEVELS]
    return accounts.select("id", *meets("master", "primary_weight"), *meets("all", "total_weight"), (F.col("total_weight") == 0).alias("locked"))


def signing_counts(power: DataFrame) -> DataFrame:
    """(level, master, all): how many accounts can meet each level."""
    one = power.agg(*[F.count_if(f"{who}_{n}").alias(f"{who}_{n}") for who in ("master", "all") for n in LEVELS])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"master_{n}").alias("master"), F.col(f"all_{n}").alias("all")) for n in LEVELS])))


def trustline_headroom(trustlines: DataFrame) -> DataFrame:
    unlimited = F.col("limit") == F.lit("922337203685.4775807").cast("decimal(19,7)")
    return trustlines.select("account", "asset_code", (F.col("limit") - F.col("balance") - F.col("buying_liabilities")).cast(MONEY).alias("headroom"), unlimited.alias("unlimited"), (F.col("balance") == 0).alias("removable"))


def headroom_totals(headroom: DataFrame) -> DataFrame:
    """By asset code: lines, unlimited and removable ones, and the headroom of the limited ones."""
    return headroom.groupBy("asset_code").agg(F.count("*").alias("lines"), F.count_if("unlimited").alias("unlimited"), F.count_if("removable").alias("removable"), _money(F.when(~F.col("unlimited"), F.col("headroom"))).alias("headroom"))


def claimable_summary(claimables: DataFrame) -> DataFrame:
    return claimables.groupBy("destination", "asset", "predicate").agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("amount"))


def _predicates(nodes: DataFrame) -> DataFrame:
    """What a claim predicate (a VARIANT node) says by itself: its word, text and whether it holds (with now and created),
    and its parts. What is no predicate is `unknown`."""
    at = lambda path, kind="string": F.try_variant_get("node", path, kind)
    word = (
        F.when(at("$.unconditional", "boolean").isNotNull(), "unconditional").when(at("$.before_absolute_time").isNotNull(), "before_absolute_time").when(at("$.before_relative_time").isNotNull(), "before_relative_time")
        .when(at("$.not", "variant").isNotNull(), "not").when(at("$.and", "array<variant>").isNotNull(), "and").when(at("$.or", "array<variant>").isNotNull(), "or").otherwise("unknown")
    )
    time = F.when(F.col("word") == "before_absolute_time", at("$.before_absolute_time")).when(F.col("word") == "before_relative_time", at("$.before_relative_time"))
    parts = F.when(F.col("word") == "not", F.array(at("$.not", "variant"))).when(F.col("word") == "and", at("$.and", "array<variant>")).when(F.col("word") == "or", at("$.or", "array<variant>"))
    start = F.when(F.col("word") == "before_relative_time", F.col("created")).otherwise(0)
    holds = F.when(F.col("word") == "unconditional", at("$.unconditional", "boolean")).otherwise(F.col("now") < F.try_add(start.cast("bigint"), F.col("time").try_cast("bigint")))
    out = nodes.withColumn("word", word).withColumn("time", time).withColumns({"parts": parts, "holds": holds})
    return out.withColumn("text", F.when(F.col("time").isNotNull(), F.concat("word", F.lit("("), "time", F.lit(")"))).otherwise(F.col("word"))).drop("node", "time")


def _judged(nodes: DataFrame) -> DataFrame:
    """Predicates with those that they are made of (kids: text, holds)."""
    texts = F.array_join(F.transform("kids", lambda k: k["text"]), ", ")
    word = F.col("word")
    holds = F.when(word == "not", ~F.get("kids", F.lit(0))["holds"]).when(word == "and", F.forall("kids", lambda k: k["holds"])).when(word == "or", F.exists("kids", lambda k: k["holds"])).otherwise(F.col("holds"))
    return nodes.withColumns({"text": F.when(word.isin("not", "and", "or"), F.concat(word, F.lit("("), texts, F.lit(")"))).otherwise(F.col("text")), "holds": holds})


def claimable_at(claimables: DataFrame, now: int, created: str) -> DataFrame:
    """(id, destination, predicate, claimable): every claimant's predicate tree (JSON text in the raw claimants), of any
    depth, written out, and whether it lets them claim at a time in seconds; null where that depends on something unknown.
    created is the column of the creation time."""
    each = claimables.select("id", F.col(created).alias("created"), F.lit(now).alias("now"), F.inline("claimants"))
    roots = _predicates(each.withColumn("node", F.try_parse_json("predicate")).drop("predicate"))
    done = fold(unfold(roots, _predicates, ["now", "created"]), _judged, {"text": "string", "holds": "boolean"})
    return done.select("id", "destination", F.col("text").alias("predicate"), F.col("holds").alias("claimable"))


def batch_profile(operations: DataFrame) -> DataFrame:
    return operations.groupBy("transaction_hash").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("transactions"))


def muxed_deposits(payments: DataFrame) -> DataFrame:
    return payments.groupBy("to", "muxed_id").agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("amount"))


def memo_deposits(payments: DataFrame, transactions: DataFrame) -> DataFrame:
    """Payments and their amount by destination and the memo of their transaction; those without a memo are apart."""
    memos = transactions.select(F.col("hash").alias("transaction_hash"), "memo_type", "memo").dropDuplicates(["transaction_hash"])
    return payments.join(memos, "transaction_hash", "left").groupBy("destination", "memo_type", "memo").agg(F.count("*").alias("n"), _money("amount").alias("amount"))


def exact_quantiles(df: DataFrame, key: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """(key, percent, value): the least of a key's whole numbers that at least so many percent do not exceed (as
    percentile_disc has it), over any number of rows a key.

    Rows are counted by (key, value) before they are shuffled. Then the value is narrowed down 16 bits at a time: of the
    ranges of one prefix, at most 65,536, the one that holds the rank is kept, so nothing holds a key's values together."""
    counted = stored(df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).cast("bigint").alias("_value")).agg(F.count("*").alias("_n")), "counted")
    each = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    targets = counted.groupBy("_key").agg(F.sum("_n").alias("_all")).select("_key", each, "_all")
    targets = targets.select("_key", "percent", F.greatest(F.lit(1), F.ceil(F.col("_all") * F.col("percent") / 100)).alias("_rank"), F.lit(0).cast("bigint").alias("_prefix"))
    for low in (48, 32, 16, 0):
        above = F.shiftright("_value", low + 16) if low < 48 else F.lit(0)
        ranges = counted.groupBy("_key", above.cast("bigint").alias("_prefix"), F.shiftright("_value", low).alias("_range")).agg(F.sum("_n").alias("_n"))
        met = targets.join(ranges, ["_key", "_prefix"])
        upto = F.sum("_n").over(Window.partitionBy("_key", "percent", "_prefix").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
        holds = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
        targets = met.withColumn("_upto", upto).where(holds).select("_key", "percent", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), F.col("_range").alias("_prefix"))
    return targets.select(F.col("_key").alias(key), "percent", F.col("_prefix").alias(value))


def simulation_profile(sims: DataFrame, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    total = lambda c: F.sum(c).alias(c)
    keys = lambda c: F.sum(F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))).alias(f"{c}_keys")
    sums = sims.groupBy("contract_id").agg(
        F.count("*").alias("n"), status("success"), status("error"), status("restore"), total("instructions"), total("read_bytes"), total("write_bytes"), keys("read_only"), keys("read_write")
    )
    fees = exact_quantiles(sims.select("contract_id", F.col("min_resource_fee").try_cast("bigint").alias("fee")), "contract_id", "fee", percents)
    fees = fees.groupBy(F.col("contract_id").alias("_contract")).agg(*[F.max(F.when(F.col("percent") == p, F.col("fee"))).alias(f"fee_p{p}") for p in percents])
    return sums.join(fees, F.col("contract_id").eqNullSafe(F.col("_contract")), "left").drop("_contract")


def failure_summary(transactions: DataFrame) -> DataFrame:
    """(result_code, n) of the failed ones."""
    return counts(transactions.where("status = 'failed'"), "result_code")


def state_changes(sims: DataFrame) -> DataFrame:
    kind = F.when(F.col("before_value").isNull() & F.col("after_value").isNull(), "none").when(F.col("before_value").isNull(), "created").when(F.col("after_value").isNull(), "removed").otherwise("updated")
    return sims.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# The texts that tell failures apart, by rule set, in the order of testing: (class, any of these texts, and
# any of these too).
RULE_SETS = {
    "preflight": (
        ("contract_missing", ("missing value for key", "no contract", "invalid contract"), ()),
        ("method_missing", ("unknown method", "function not found", "missingvalue"), ()),
        ("argument", ("argument", "type mismatch", "unexpectedtype"), ()),
        ("authorization", ("auth",), ("missing", "required", "invalid")),
        ("expired", ("expired", "ttl", "archived"), ()),
    ),
    "bounds": (
        ("too_late", ("tx_too_late", "txtoolate"), ()),
        ("too_early", ("tx_too_early", "txtooearly"), ()),
        ("no_result", ("timeout", "try_again_later", "expired", "not found"), ()),
    ),
    "multi_contract": (
        ("contract_id", ("invalid contract id", "invalid contract"), ()),
        ("method_missing", ("missing",), ("function",)),
        ("method_missing", ("unknown method", "no such method", "function not found"), ()),
        ("authorization", ("auth", "unauthorized", "signature"), ()),
        ("reverted", ("trap", "revert", "panic", "host invocation failed", "contract error"), ()),
        ("expired", ("expired", "ttl", "archived"), ()),
    ),
    "simulation": (
        ("host_validation", ("hostvalidationerror",), ()),
        ("contract_missing", ("contractnotfound", "does not exist"), ()),
        ("method_missing", ("nonexistent_method", "symbolnotfound"), ()),
    ),
}


def triage_errors(log: DataFrame, rules, column: str = "message", fallback: str = "unknown") -> DataFrame:
    """Rows by the class of the first rule that their text meets; rules as in RULE_SETS, case aside."""
    text, out = F.lower(F.coalesce(column, F.lit(""))), None
    any_of = lambda parts: reduce(lambda a, b: a | b, [text.contains(p) for p in parts])
    for name, some, also in rules:
        met = any_of(some) & any_of(also) if also else any_of(some)
        out = (F if out is None else out).when(met, name)
    return log.groupBy(out.otherwise(fallback).alias("class")).agg(F.count("*").alias("n"))


def ttl_report(entries: DataFrame, latest: int, soon: int = 17_280, seconds: int = 5) -> DataFrame:
    """By contract, tier and state: entries, and the least time left in ledgers and in seconds."""
    left = F.col("live_until_ledger") - latest
    state = F.when(left <= 0, "expired").when(left < soon, "expiring").otherwise("healthy")
    return entries.groupBy("contract_id", "durability", state.alias("state")).agg(F.count("*").alias("n"), F.min(left).alias("least_left"), (F.greatest(F.lit(0), F.min(left)) * seconds).alias("least_seconds"))


def archive_status(entries: DataFrame, sims: DataFrame, latest: int) -> DataFrame:
    """By contract and state: archived where the entry's last ledger is past, or where a simulation that asks for a restore
    has its key in its footprint (one that gives no footprint means all of its contract), else accessible; unknown without
    a last ledger."""
    asked = sims.where("status = 'restore'")
    keys = F.explode(F.concat(*[F.coalesce(c, F.array().cast(sims.schema[c].dataType)) for c in ("read_only", "read_write")])).alias("k")
    named = asked.select(keys).select(F.col("k.contract").alias("contract_id"), "k.key", "k.durability").distinct().withColumn("_key", F.lit(True))
    whole = asked.where("read_only is null and read_write is null").select("contract_id").distinct().withColumn("_whole", F.lit(True))
    past = F.col("live_until_ledger") < latest
    state = F.when(F.coalesce("_key", "_whole", F.lit(False)) | F.coalesce(past, F.lit(False)), "archived").when(past.isNull(), "unknown").otherwise("accessible")
    both = entries.join(named, ["contract_id", "key", "durability"], "left").join(whole, "contract_id", "left")
    return both.groupBy("contract_id", state.alias("state")).agg(F.count("*").alias("n"))


def sponsorships(effects: DataFrame) -> DataFrame:
    """(sponsor, entry, n): entries that accounts have begun to sponsor, by what they are."""
    made = effects.where(F.col("type").endswith("_sponsorship_created"))
    return counts(made.withColumn("entry", F.regexp_replace("type", "_sponsorship_created$", "")), "sponsor", "entry")


def auth_entries(sims: DataFrame, latest: int) -> DataFrame:
    left = F.when(F.col("credential") == "address", F.col("expiration_ledger") - latest)
    return sims.groupBy("credential", "signed", F.coalesce(left < 0, F.lit(False)).alias("expired")).agg(F.count("*").alias("n"), F.max(F.floor(left * 5 / 60)).cast("bigint").alias("most_minutes"))


def ledger_profile(ledgers: DataFrame, width: int = 100) -> DataFrame:
    """By bucket: totals, failure rate, base fee and reserve of the newest ledger in whole units, protocols seen."""
    ok, bad = F.sum("successful_transaction_count"), F.sum("failed_transaction_count")
    units = lambda c: (F.max_by(c, "sequence").cast("decimal(19,7)") / 10_000_000).cast("decimal(19,7)").alias(c)
    return ledgers.groupBy(F.floor(F.col("sequence") / width).alias("bucket")).agg(
        ok.alias("ok"), bad.alias("failed"), F.sum("operation_count").alias("operations"), F.round(bad.cast("double") / F.nullif(ok + bad, F.lit(0)).cast("double"), 6).alias("failure_rate"),
        units("base_fee"), units("base_reserve"), F.array_join(F.array_sort(F.collect_set("protocol_version")), ",").alias("protocols"),
    )


def operation_types(operations: DataFrame) -> DataFrame:
    """Operations by account and type, and by type over all accounts (null account)."""
    each = counts(operations, "source_account", "type")
    overall = each.groupBy("type").agg(F.sum("n").alias("n"))
    return each.unionByName(overall.withColumn("source_account", F.lit(None).cast("string")))


def storage_summary(probe: DataFrame) -> DataFrame:
    """By tier, of probed keys: found, missing, and found with a value that is no JSON."""
    bad = F.col("found") & F.col("value").isNotNull() & F.try_parse_json("value").isNull()
    return probe.groupBy("durability").agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"), F.count_if(bad).alias("undecodable"))


def coverage(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Of each resource, given with its ledger column: oldest and newest ledger, and how many between are missing."""
    parts = [df.select(F.lit(name).alias("resource"), F.col(c).cast("long").alias("s")).where("s is not null") for name, (df, c) in tables.items()]
    seen = reduce(DataFrame.unionByName, parts).distinct()
    return seen.groupBy("resource").agg(F.min("s").alias("oldest"), F.max("s").alias("newest"), (F.max("s") - F.min("s") + 1 - F.count("*")).alias("missing"))


def ordered_counts(df: DataFrame, key: str) -> DataFrame:
    """The most frequent first, ties by name."""
    return counts(df, key).orderBy(F.desc("n"), key)


def newest(df: DataFrame, order: str, n: int, most: int = 200) -> DataFrame:
    """The n newest rows, n held within 1 and most."""
    return df.orderBy(F.desc(order)).limit(max(1, min(n, most)))


def union_payment_kinds(*operations: DataFrame) -> DataFrame:
    """Payment-like operations of several kinds in one table; columns that a kind lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), operations)


def effects_per_operation(effects: DataFrame, operations: DataFrame) -> DataFrame:
    """Per ledger with operations: operations, effects, their ratio, and operations without effects. effects carry toid,
    the id of their operation."""
    per = effects.where("toid is not null").groupBy("toid").agg(F.count("*").alias("n"))
    each = operations.select("id", "ledger").join(per, F.col("id") == F.col("toid"), "left")
    out = each.groupBy("ledger").agg(F.count("*").alias("operations"), F.coalesce(F.sum("n"), F.lit(0)).alias("effects"), F.count_if(F.col("n").isNull()).alias("without_effects"))
    return out.withColumn("effects_per_operation", F.col("effects") / F.col("operations"))


def invocation_summary(results: DataFrame) -> DataFrame:
    """Total, succeeded and failed invocations; zeros without any."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(~F.col("status").eqNullSafe("success")).alias("failed"))


def flatten_invocations(auth: DataFrame) -> DataFrame:
    """One row a call of every entry's `invocation` tree (a VARIANT of contract, function, args, sub), of any depth."""

    def calls(nodes: DataFrame) -> DataFrame:
        get = lambda path, kind: F.try_variant_get("node", path, kind)
        return nodes.withColumns({"contract": get("$.contract", "string"), "function": get("$.function", "string"), "args": get("$.args", "bigint"), "parts": get("$.sub", "array<variant>")}).drop("node")

    roots = auth.select("id", F.try_variant_get("invocation", "$.contract", "string").alias("root"), F.col("invocation").alias("node"))
    return unfold(calls(roots), calls, ["id", "root"]).all().select("id", "depth", "root", "contract", "function", "args")


def invocation_trees(calls: DataFrame) -> DataFrame:
    """Calls and depth of each entry's tree."""
    return calls.groupBy("id").agg(F.count("*").alias("calls"), F.max("depth").alias("deepest"))


def footprint_keys(sims: DataFrame) -> DataFrame:
    """Footprint keys by access, type and durability."""
    access = lambda c: F.transform(c, lambda k: F.struct(F.lit(c).alias("access"), k["key_type"].alias("key_type"), k["durability"].alias("durability"), k["key"].alias("key")))
    keys = sims.select(F.inline(F.concat(F.coalesce(access("read_only"), F.array()), F.coalesce(access("read_write"), F.array()))))
    return keys.groupBy("access", "key_type", "durability").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def diagnostics(sims: DataFrame) -> DataFrame:
    """Diagnostic events by type and contract: successful and failed."""
    events = sims.select(F.inline("events"))
    return events.groupBy("type", "contract").agg(F.count_if("ok").alias("ok"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))
