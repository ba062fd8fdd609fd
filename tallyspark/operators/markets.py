"""Payment paths through offers and pools whose prices depend on the amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY
from ..sources.tables import stored

_LEVELS = "array<struct<price:double,before_in:double,before_out:double,into:double,out:double>>"


def book_markets(offers: DataFrame) -> DataFrame:
    """Order books as markets: a taker pays with what the offers buy (src) and gets what they sell (dst), from the cheapest
    level on. One pair's price levels must fit a row."""
    good = offers.where((F.col("price") > 0) & (F.col("amount") > 0) & (F.col("selling") != F.col("buying")))
    levels = good.groupBy("selling", "buying", "price").agg(F.sum("amount").cast(MONEY).alias("out"))
    levels = levels.withColumn("into", F.round(F.col("out").cast("double") * F.col("price"), 7).cast(MONEY))
    before = Window.partitionBy("selling", "buying").orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("double")
    levels = levels.select("selling", "buying", "price", total("into").alias("before_in"), total("out").alias("before_out"), F.col("into").cast("double").alias("into"), F.col("out").cast("double").alias("out"))
    book = levels.groupBy(F.col("buying").alias("src"), F.col("selling").alias("dst")).agg(F.sort_array(F.collect_list(F.struct("price", "before_in", "before_out", "into", "out"))).alias("levels"))
    none = F.lit(None).cast("double")
    return book.select("src", "dst", F.lit("book").alias("market"), "levels", none.alias("reserve_in"), none.alias("reserve_out"), none.alias("keep"))


def pool_markets(reserves: DataFrame, asset: str = "asset") -> DataFrame:
    """Constant-product pools of two known assets as markets, one in each direction; the fee is taken from what goes in."""
    at = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    known = reserves.where(F.col("place").isNotNull() & (F.col("kind") != "unknown"))
    pools = known.groupBy("id").agg(at(0, asset).alias("a"), at(0, "amount").alias("x"), at(1, asset).alias("b"), at(1, "amount").alias("y"), F.max("fee_percent").alias("fee"), F.count("*").alias("n"))
    pools = pools.where((F.col("n") == 2) & (F.col("x") > 0) & (F.col("y") > 0) & (F.col("a") != F.col("b")))
    way = lambda a, x, b, y: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(x).cast("double").alias("reserve_in"), F.col(y).cast("double").alias("reserve_out"))
    ways = pools.select(F.col("id").alias("market"), (1 - F.col("fee") / 100).alias("keep"), F.explode(F.array(way("a", "x", "b", "y"), way("b", "y", "a", "x"))).alias("w"))
    return ways.select("w.src", "w.dst", "market", F.lit(None).cast(_LEVELS).alias("levels"), "w.reserve_in", "w.reserve_out", "keep")


def amount_out(x: Column, level: Column) -> Column:
    """What x buys; level is that of the book in which x ends. Null where the book does not hold enough."""
    paid = x * F.col("keep")
    book = F.when(x <= level["before_in"] + level["into"], level["before_out"] + (x - level["before_in"]) / level["price"])
    return F.when(F.col("levels").isNotNull(), book).otherwise(F.col("reserve_out") * paid / (F.col("reserve_in") + paid))


def amount_in(y: Column, level: Column) -> Column:
    """The least that buys y; null where the market does not hold enough."""
    book = F.when(y <= level["before_out"] + level["out"], level["before_in"] + (y - level["before_out"]) * level["price"])
    pool = F.when(y < F.col("reserve_out"), F.col("reserve_in") * y / (F.col("reserve_out") - y) / F.col("keep"))
    return F.when(F.col("levels").isNotNull(), book).otherwise(pool)


def _routes(markets: DataFrame, requests: DataFrame, hops: int, receive: bool) -> DataFrame:
    """(request, amount, path) of the best path of each request (request, src, target, amount); those without one are
    missing.

    Amounts are carried market by market, from the source forwards or from the target backwards. Backwards the least
    amount at an asset is the best one, whatever follows. Forwards the most is not: it may be more than a later book holds.
    There all amounts are kept until one hop is left; then two at each asset are enough, the most of all and the most
    that the book to the target holds (pools hold any). No asset comes twice in a path."""
    here, there = ("dst", "src") if receive else ("src", "dst")
    begin, goal = ("target", "src") if receive else ("src", "target")
    markets = stored(markets, "markets")
    labels = requests.where("src <> target and amount > 0").select("request", F.col(begin).alias("at"), F.col(goal).alias("goal"), F.col("amount").cast("double").alias("amount"), F.array(begin).alias("path"))
    level = F.try_element_at(F.filter("levels", lambda lv: lv["before_out" if receive else "before_in"] < F.col("amount")), F.lit(-1))
    best = lambda rows: (F.min if receive else F.max)(F.when(rows, F.struct("amount", "path")))
    found = None
    for hop in range(1, hops + 1):
        on = (F.col("at") == F.col(here)) & ((F.col(there) == F.col("goal")) if hop == hops else ~F.array_contains("path", F.col(there)))
        step = labels.join(markets, on).withColumn("level", level)
        step = step.withColumn("amount", (amount_in if receive else amount_out)(F.col("amount"), F.col("level")))
        path = F.concat(F.array(there), "path") if receive else F.array_append("path", F.col(there))
        step = step.where("amount > 0").select("request", F.col(there).alias("at"), "goal", "amount", path.alias("path"))
        keys = ["request", "at", "goal"]
        if receive:
            # for more than three hops by the assets passed too, which the rest may not come to again
            apart = [F.array_sort("path").alias("seen")] if 1 < hop and hops > 3 else []
            step = step.groupBy(*keys, *apart).agg(best(F.lit(True)).alias("b")).select(*keys, "b.*")
        elif hop == hops - 1:
            last = F.element_at("levels", -1)
            held = markets.where("levels is not null").select(F.col("src").alias("at"), F.col("dst").alias("goal"), (last["before_in"] + last["into"]).alias("held"))
            step = step.join(held, ["at", "goal"], "left")
            step = step.groupBy(*keys).agg(best(F.lit(True)).alias("most"), best(F.col("amount") <= F.col("held")).alias("fits"))
            step = step.select(*keys, F.explode(F.array_distinct(F.array_compact(F.array("most", "fits")))).alias("b")).select(*keys, "b.*")
        step = stored(step, "labels")
        ended = step.where("at = goal").select("request", "amount", "path")
        found = ended if found is None else found.unionByName(ended)
        labels = step.where("at <> goal")
    return found.groupBy("request").agg(best(F.lit(True)).alias("b")).select("request", "b.*")


def quote_send(markets: DataFrame, requests: DataFrame, hops: int = 3) -> DataFrame:
    """requests (request, src, target, amount) with received, the most of target that the whole amount of src buys, and
    its path; both null where there is no path of at most `hops` markets that holds enough. A request's key is unique."""
    best = _routes(markets, requests, hops, False).select("request", F.round("amount", 7).alias("received"), "path")
    return requests.join(best, "request", "left")


def quote_receive(markets: DataFrame, requests: DataFrame, hops: int = 3) -> DataFrame:
    """requests (request, src, target, amount, send_max) with spent, the least of src that buys the whole amount of target,
    its path, and whether it is within send_max."""
    best = _routes(markets, requests, hops, True).select("request", F.round("amount", 7).alias("spent"), "path")
    return requests.join(best, "request", "left").withColumn("within", F.coalesce(F.col("spent") <= F.col("send_max").cast("double"), F.lit(False)))
