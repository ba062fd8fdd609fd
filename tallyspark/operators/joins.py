"""Enrichment and comparison joins. Sides are joined on equal keys; Spark picks the strategy from their sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import toid
from ..sources.tables import stored


def attach_ledgers(payments: DataFrame, transactions: DataFrame) -> DataFrame:
    """Ledger by transaction hash; an existing value wins, misses stay null."""
    known = transactions.groupBy(F.col("hash").alias("transaction_hash")).agg(F.max("ledger").alias("_ledger"))
    return payments.join(known, "transaction_hash", "left").withColumn("ledger", F.coalesce("ledger", "_ledger")).drop("_ledger")


def attach_trade_tx(trades: DataFrame, operations: DataFrame) -> DataFrame:
    ops = operations.select(F.col("id").cast("string").alias("operation_id"), "transaction_hash")
    return trades.join(ops, "operation_id", "left")


def intent_vs_outcome(operations: DataFrame, effects: DataFrame) -> DataFrame:
    """Operations against effects of each ledger and transaction order."""
    a = operations.groupBy("ledger", "tx_order").agg(F.count("*").alias("operations"))
    b = effects.groupBy(F.col("id_ledger").alias("ledger"), "tx_order").agg(F.count("*").alias("effects"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, ["ledger", "tx_order"], "full").select("ledger", "tx_order", zero("operations"), zero("effects"))


def silent_operations(operations: DataFrame, effects: DataFrame, ledgers: DataFrame) -> DataFrame:
    """By ledger: operations without an effect, operations there are and those that the header counts; a ledger whose
    header is missing has null there."""
    heard = effects.select(F.col("toid").alias("id"), F.lit(True).alias("_heard")).where("id is not null").distinct()
    each = operations.select("id", "ledger").join(heard, "id", "left").groupBy("ledger").agg(F.count_if(F.col("_heard").isNull()).alias("silent"), F.count("*").alias("operations"))
    header = ledgers.select(F.col("sequence").alias("ledger"), F.col("operation_count").alias("header_operations"))
    return each.where("silent > 0").join(header, "ledger", "left")


# Result codes, with our own explanations.
EXPLANATIONS = {
    "tx_failed": "At least one operation did not succeed, so none took effect.",
    "tx_bad_seq": "The sequence number is not the next one of the source account.",
    "tx_bad_auth": "Signatures are missing, wrong or too light for the thresholds.",
    "tx_insufficient_balance": "The source account could not pay the fee and keep its reserve.",
    "tx_insufficient_fee": "The fee offered was below what the network asked for.",
    "tx_no_source_account": "There is no such source account.",
    "tx_too_early": "It arrived before its time bounds open.",
    "tx_too_late": "It arrived after its time bounds close.",
    "op_underfunded": "The account holds less than the operation needs.",
    "op_no_destination": "The receiving account does not exist and has to be created first.",
    "op_low_reserve": "It would leave the account below its reserve.",
    "op_no_trust": "The receiver has no trustline for this asset.",
    "op_line_full": "The receiver's trustline would go over its limit.",
    "op_not_authorized": "The issuer has not authorised the trustline.",
    "op_bad_auth": "The operation's own source account did not sign well enough.",
    "op_no_issuer": "The account that should issue the asset does not exist.",
    "op_src_no_trust": "The sender has no trustline for this asset.",
    "op_cross_self": "The offer would trade against another one of the same account.",
}
# Effect types by what they happened to, with our own wording of what happened.
_CHANGES = {"created": "was added", "removed": "was taken away", "updated": "was changed"}
_ENTRIES = {"account": "an account", "signer": "a signer", "trustline": "a trustline", "offer": "an offer", "data": "a data entry", "claimable_balance": "a claimable balance", "liquidity_pool": "a liquidity pool"}
_OTHER = {
    "account_credited": "an account received funds",
    "account_debited": "an account gave up funds",
    "account_thresholds_updated": "an account's signing thresholds were changed",
    "account_home_domain_updated": "an account's home domain was changed",
    "account_flags_updated": "an issuer's flags were changed",
    "sequence_bumped": "an account's sequence number was raised",
    "trustline_authorized": "an issuer allowed a holder to use its asset",
    "trustline_deauthorized": "an issuer withdrew a holder's authorisation",
    "trustline_flags_updated": "a trustline's authorisation flags were changed",
    "trade": "two offers met and assets were exchanged",
    "claimable_balance_claimed": "a claimable balance was taken by a claimant",
    "claimable_balance_claimant_created": "an account may from now on claim a balance",
    "claimable_balance_clawed_back": "an issuer took a claimable balance back",
    "liquidity_pool_deposited": "assets went into a liquidity pool",
    "liquidity_pool_withdrew": "assets came out of a liquidity pool",
    "liquidity_pool_trade": "assets were exchanged with a liquidity pool",
    "liquidity_pool_revoked": "pool shares were turned into claimable balances",
    "contract_credited": "a contract received funds",
    "contract_debited": "a contract gave up funds",
}
_NOT_SO = ("account_updated", "claimable_balance_removed", "claimable_balance_updated", "liquidity_pool_updated")
EFFECTS = {f"{e}_{c}": f"{what} {did}" for e, what in _ENTRIES.items() for c, did in _CHANGES.items() if f"{e}_{c}" not in _NOT_SO} | _OTHER
FALLBACK = "No explanation available."


def explain_codes(df: DataFrame, column: str = "result_code", explanations: dict[str, str] = EXPLANATIONS, fallback: str = FALLBACK) -> DataFrame:
    """df with explanation: that of the code in lower case without outer spaces, or the fallback."""
    dim = df.sparkSession.createDataFrame(list(explanations.items()), "_code string, explanation string")
    return df.join(F.broadcast(dim), F.lower(F.trim(column)) == F.col("_code"), "left").drop("_code").fillna({"explanation": fallback})


LAST_SEQUENCE = 2**32 - 1


def _bound(c: str) -> Column:
    """A bound as a whole number of 32 bits; null counts as 0."""
    return F.least(F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)), F.lit(LAST_SEQUENCE))


def admissible_ledgers(txs: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Earliest and number of ledgers in [min_ledger, max_ledger] of every transaction, 0 where there is none; with an
    open upper bound (0 or null) only the lower one counts.

    However wide a range is, it costs two look-ups: how many ledgers there are from its lower bound on, less those from
    behind its upper one."""
    return _within(txs.select("hash", _bound("min_ledger").alias("low"), F.when(F.col("max_ledger") > 0, _bound("max_ledger")).alias("high")), ledgers)


def admissible_ledgers_and_times(txs: DataFrame, ledgers: DataFrame) -> DataFrame:
    """As admissible_ledgers, for ledgers that also close within [min_time, max_time] (seconds; 0 or null: open). Close
    times ascend with sequences, so bounds of time are looked up as bounds of sequence: the first ledger that closes at or
    after min_time, and the one before the first that closes after max_time."""
    own = txs.select("hash", _bound("min_ledger").alias("low"), F.when(F.col("max_ledger") > 0, _bound("max_ledger")).alias("high"), _bound("min_time").alias("since"), F.when(F.col("max_time") > 0, _bound("max_time") + 1).alias("after"))
    asked = own.select(F.col("since").alias("at")).unionByName(own.where("after is not null").select(F.col("after").alias("at"))).distinct()
    on = _from_on(asked, ledgers, "closed_at").select("at", "earliest")
    own = own.join(on.select(F.col("at").alias("since"), F.col("earliest").alias("opens")), "since").join(on.select(F.col("at").alias("after"), F.col("earliest").alias("closes")), "after", "left")
    # without a ledger that closes late enough, nothing is above the lower bound
    low = F.greatest("low", F.coalesce("opens", F.lit(LAST_SEQUENCE)))
    return _within(own.select("hash", low.alias("low"), F.least("high", F.col("closes") - 1).alias("high")), ledgers)


def _within(bounds: DataFrame, ledgers: DataFrame) -> DataFrame:
    """(hash, earliest, ledgers) of bounds (hash, low, high), high being null where open."""
    bounds = bounds.withColumn("behind", F.col("high") + 1)
    asked = bounds.select(F.col("low").alias("at")).unionByName(bounds.where("behind is not null").select(F.col("behind").alias("at"))).distinct()
    on = _from_on(asked, ledgers)
    out = bounds.join(on.select(F.col("at").alias("low"), "earliest", "ledgers"), "low").join(on.select(F.col("at").alias("behind"), F.col("ledgers").alias("later")), "behind", "left")
    some = F.col("earliest") <= F.coalesce("high", F.lit(LAST_SEQUENCE))
    return out.select("hash", F.when(some, F.col("earliest")).alias("earliest"), F.when(some, F.col("ledgers") - F.coalesce("later", F.lit(0))).otherwise(0).alias("ledgers"))


def _from_on(asked: DataFrame, ledgers: DataFrame, by: str = "sequence") -> DataFrame:
    """Earliest sequence and number of ledgers from each of asked (at) on: those of its stretch of 65,536, and of later
    stretches. What ledgers are ordered by (sequences or seconds) has 32 bits, so a stretch has at most that many points
    and the window over stretches as many rows."""
    points = ledgers.groupBy(F.col(by).cast("long").alias("at")).agg(F.count("*").alias("n"), F.min("sequence").alias("seen"))
    points = points.unionByName(asked.select("at", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("seen")))
    points = points.groupBy("at").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"), F.max(F.when(F.col("n") == 0, True)).alias("asked")).withColumn("stretch", F.floor(F.col("at") / 65536))
    here = Window.partitionBy("stretch").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = points.groupBy("stretch").agg(F.sum("n").alias("_n"), F.min("seen").alias("_first"))
    later = later.select("stretch", F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_n"), F.min("_first").over(after).alias("_first"))
    own = points.select("at", "stretch", "asked", F.sum("n").over(here).alias("n"), F.min("seen").over(here).alias("first")).where("asked")
    return own.join(later, "stretch").select("at", F.coalesce("first", "_first").alias("earliest"), (F.col("n") + F.col("_n")).alias("ledgers"))


def trustline_state(requests: DataFrame, trustlines: DataFrame, issuers: DataFrame) -> DataFrame:
    """Authorisation of each (account, asset_code, asset_issuer) asked for, with the issuer's flags; null flags where the
    issuer is not there."""
    keys = ["account", "asset_code", "asset_issuer"]
    line = F.coalesce("_line", F.lit(False))
    state = (
        F.when(~line, "NOT_FOUND")
        .when(F.col("is_authorized"), "AUTHORIZED")
        .when(F.col("is_authorized_to_maintain_liabilities"), "MAINTAIN_LIABILITIES")
        .otherwise("UNAUTHORIZED")
    )
    lines = trustlines.select(*keys, "is_authorized", "is_authorized_to_maintain_liabilities", F.lit(True).alias("_line"))
    flags = issuers.select(F.col("id").alias("asset_issuer"), "auth_required", "auth_revocable", "auth_clawback_enabled")
    return requests.join(lines, keys, "left").join(flags, "asset_issuer", "left").select(*keys, state.alias("state"), "auth_required", "auth_revocable", "auth_clawback_enabled")


def probe_storage(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key in both tiers, found or not. The matrix is keys times two."""
    tiers = F.explode(F.array(F.lit("persistent"), F.lit("temporary"))).alias("durability")
    hit = entries.select("contract_id", "key", "durability", "value", F.lit(True).alias("_hit"))
    return keys.select("contract_id", "key", tiers).join(hit, ["contract_id", "key", "durability"], "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def claimable_lifecycle(effects: DataFrame) -> DataFrame:
    """Ledgers in which each created balance was created, claimed and clawed back, its age at its end in ledgers, and
    whether it is still open, in one pass over the effects."""
    at = lambda kind, name: F.min(F.when(F.col("type") == f"claimable_balance_{kind}", F.col("ledger"))).alias(name)
    out = effects.where("balance_id is not null").groupBy("balance_id").agg(at("created", "created"), at("claimed", "claimed"), at("clawed_back", "clawed_back")).where("created is not null")
    end = F.coalesce("claimed", "clawed_back")
    return out.withColumn("age", end - F.col("created")).withColumn("still_open", end.isNull())


def created_balance_ids(effects: DataFrame) -> DataFrame:
    """The first created balance of each transaction, in the order of effects; null for transactions without one. Effects
    whose id does not decode belong to none."""
    own = effects.select(F.shiftright(toid(F.col("id")), 12).alias("tx"), "id", F.when(F.col("type") == "claimable_balance_created", F.col("balance_id")).alias("balance_id")).where("tx is not null")
    return own.groupBy("tx").agg(F.min_by("balance_id", F.when(F.col("balance_id").isNotNull(), F.col("id"))).alias("balance_id"))


def created_balances_by_tx(effects: DataFrame) -> DataFrame:
    """Every created balance with its transaction (toid >> 12), and each transaction without one with a null balance.

    Balances of effects with a malformed id have a null transaction."""
    own = effects.select(F.shiftright(toid(F.col("id")), 12).alias("tx"), "type", "balance_id")
    created = own.where("type = 'claimable_balance_created'").select("tx", "balance_id")
    misses = own.where("tx is not null").select("tx").distinct().join(created.select("tx").distinct(), "tx", "left_anti")
    return created.unionByName(misses.withColumn("balance_id", F.lit(None).cast("string")))


def diff_snapshots(before: DataFrame, after: DataFrame, key: str, attributes: list[str], amounts: list[str] = []) -> DataFrame:
    """(key, attribute, before, after, change, delta) for every key of either side: set, changed, removed or same; the
    delta of an amount counts a missing side as 0."""
    a, b = (df.select(key, *[F.col(c).alias(f"_{side}_{c}") for c in (*attributes, *amounts)]) for side, df in (("a", before), ("b", after)))

    def one(c: str) -> Column:
        old, new = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        delta = F.coalesce(new, F.lit(0)).cast("decimal(38,7)") - F.coalesce(old, F.lit(0)).cast("decimal(38,7)") if c in amounts else F.lit(None)
        return F.struct(F.lit(c).alias("attribute"), old.cast("string").alias("before"), new.cast("string").alias("after"), delta.cast("decimal(38,7)").alias("delta"))

    each = a.join(b, key, "full").select(key, F.inline(F.array(*map(one, (*attributes, *amounts)))))
    old, new = F.col("before"), F.col("after")
    change = F.when(old.isNull() & new.isNotNull(), "set").when(old.isNotNull() & new.isNull(), "removed").when(old != new, "changed").otherwise("same")
    return each.withColumn("change", change)


def fee_bump_audit(txs: DataFrame) -> DataFrame:
    """Outer transactions with their inner one: fee step and who paid."""
    inner = txs.select(F.col("hash").alias("inner_hash"), F.col("fee_charged").alias("inner_fee"), F.col("source_account").alias("inner_source"))
    out = txs.where("inner_hash is not null").join(inner, "inner_hash")
    return out.select("hash", "inner_hash", (F.col("fee_charged") - F.col("inner_fee")).alias("escalation"), (F.col("fee_account") != F.col("inner_source")).alias("payer_differs"))


def quote_paths(edges: DataFrame, requests: DataFrame, hops: int = 3) -> DataFrame:
    """(src, target, rate): the best rate for each request (src, target) over at most `hops` edges (src, dst, rate), each
    the amount of dst that one of src buys, no asset twice.

    Edges are first cut to the best of each pair. All targets of a source are found together. Of the walks of two edges
    between the same ends the best `hops` are kept: what is still to come holds fewer assets than that, so it leaves one
    of them free. Longer walks are kept by the set of their assets."""
    best = stored(edges.where("src <> dst").groupBy("src", "dst").agg(F.max("rate").alias("rate")), "edges")
    sources = stored(requests.select("src").distinct(), "sources")
    step = best.select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("rate").alias("_rate"))
    walk = sources.join(best, "src").withColumn("seen", F.array("src", "dst"))
    found = [walk.select("src", "dst", "rate")]
    ends = Window.partitionBy("src", "dst").orderBy(F.desc("rate"), "seen")
    for hop in range(2, hops + 1):
        on = walk.join(step, "dst").where(~F.array_contains("seen", F.col("_to")))
        walk = on.select("src", F.col("_to").alias("dst"), (F.col("rate") * F.col("_rate")).alias("rate"), F.array_append("seen", F.col("_to")).alias("seen"))
        if hop == hops:
            found.append(walk.select("src", "dst", "rate"))
            break
        if hop == 2:
            walk = walk.withColumn("_n", F.row_number().over(ends)).where(F.col("_n") <= hops).drop("_n")
        else:
            walk = walk.groupBy("src", "dst", F.array_sort("seen").alias("seen")).agg(F.max("rate").alias("rate"))
        walk = stored(walk, "walk")
        found.append(walk.select("src", "dst", "rate"))
    rates = reduce(DataFrame.unionByName, found).groupBy("src", F.col("dst").alias("target")).agg(F.max("rate").alias("rate"))
    return requests.select("src", "target").distinct().join(rates, ["src", "target"])


def strict_receive(edges: DataFrame, requests: DataFrame, hops: int = 3) -> DataFrame:
    """(src, target, receive, send_max) with the least amount of src that buys `receive` of target and whether that is
    within send_max; requests without a path have null and false."""
    found = quote_paths(edges, requests, hops)
    out = requests.join(found, ["src", "target"], "left").withColumn("spend", F.round(F.col("receive").cast("double") / F.col("rate"), 7))
    return out.withColumn("within", F.coalesce(F.col("spend") <= F.col("send_max").cast("double"), F.lit(False))).drop("rate")


def strict_send(edges: DataFrame, requests: DataFrame, hops: int = 3) -> DataFrame:
    """(src, target, send) with the most that it buys of target; null without a path."""
    found = quote_paths(edges, requests, hops)
    return requests.join(found, ["src", "target"], "left").withColumn("received", F.round(F.col("send").cast("double") * F.col("rate"), 7)).drop("rate")


def traded_pairs(trades: DataFrame) -> DataFrame:
    """Both orientations of every pair of assets that was traded, as requests of quote_paths."""
    both = F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("target")) for a, b in (("base_asset", "counter_asset"), ("counter_asset", "base_asset"))])).alias("p")
    return trades.select(both).select("p.src", "p.target").where("src <> target").distinct()


def ledger_chain(ledgers: DataFrame) -> DataFrame:
    """Each ledger's close interval in seconds and problem: its predecessor is missing (gap) or has another hash (hash)."""
    before = ledgers.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("_hash"), F.col("closed_at").alias("_closed"))
    problem = F.when(F.col("_hash").isNull(), "gap").when(~F.col("_hash").eqNullSafe(F.col("prev_hash")), "hash")
    return ledgers.join(before, "sequence", "left").select("sequence", problem.alias("problem"), (F.col("closed_at") - F.col("_closed")).alias("interval"))


# What an account's configuration is held against.
CONFIGURED = ("low_threshold", "med_threshold", "high_threshold", "primary_weight")


def config_drift(accounts: DataFrame, expected: DataFrame, key: str, columns=CONFIGURED) -> DataFrame:
    """(id, setting, actual, expected) where they differ; expected has a row of the columns for each value of key."""
    want = expected.select(key, *[F.col(c).alias(f"_want_{c}") for c in columns])
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("setting"), F.col(c).alias("actual"), F.col(f"_want_{c}").alias("expected")) for c in columns]))
    return accounts.join(want, key).select("id", each).where(~F.col("actual").eqNullSafe(F.col("expected")))


def attach_operation_refs(changes: DataFrame, operations: DataFrame) -> DataFrame:
    """Transaction hash and ledger of the operation that an effect id names; null if it is not there."""
    refs = operations.select(F.col("id").alias("operation_id"), "transaction_hash", "ledger")
    return changes.withColumn("operation_id", toid(F.col("id"))).join(refs, "operation_id", "left")


def account_relationships(accounts: DataFrame, trustlines: DataFrame, effects: DataFrame, payments: DataFrame) -> DataFrame:
    """(account, kind, other, n): co-signers, issuers held, sponsors and payment counterparties. One row a
    relationship rather than an array an account, as a busy account's counterparties fit no row."""
    rel = lambda df, a, kind, o: df.select(F.col(a).alias("account"), F.lit(kind).alias("kind"), F.col(o).alias("other"))
    signers = accounts.select("id", F.explode("signers").alias("s")).select("id", F.col("s.key").alias("key"))
    every = [
        rel(signers, "id", "signer", "key"),
        rel(trustlines, "account", "issuer", "asset_issuer"),
        rel(effects, "account", "sponsor", "sponsor"),
        rel(payments, "source", "counterparty", "destination"),
        rel(payments, "destination", "counterparty", "source"),
    ]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out.where("account <> other").groupBy("account", "kind", "other").agg(F.count("*").alias("n"))


def check_effect_scopes(ledger_effects: DataFrame, transaction_effects: DataFrame) -> DataFrame:
    """Effects (ledger, id) that the ledger scope has more or fewer of than its transactions together; none if they agree.
    One aggregation over both, signed by scope."""
    both = ledger_effects.select("ledger", "id", F.lit(1).alias("n")).unionByName(transaction_effects.select("ledger", "id", F.lit(-1).alias("n")))
    return both.groupBy("ledger", "id").agg(F.sum("n").alias("surplus")).where("surplus <> 0")


def diff_storage(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per (contract_id, key, durability): changed, identical, or unavailable where a snapshot has no value."""
    keys = ["contract_id", "key", "durability"]
    both = before.select(*keys, F.col("value").alias("before")).join(after.select(*keys, F.col("value").alias("after")), keys, "full")
    state = F.when(F.col("before").isNull() | F.col("after").isNull(), "unavailable").when(F.col("before") == F.col("after"), "identical").otherwise("changed")
    return both.withColumn("state", state)
