"""Quotes for an amount, through books and pools, against all paths tried one by one."""

import itertools
import random

import pytest

from tallyspark.operators import markets as M

OFFERS = "selling string, buying string, price double, amount decimal(38,7)"
RESERVES = "id string, place int, kind string, asset string, amount decimal(38,7), fee_percent double"


def send(market, x):
    if isinstance(market, list):
        out = 0.0
        for price, amount in sorted(market):
            if x <= amount * price + 1e-9:
                return out + x / price
            x, out = x - amount * price, out + amount
        return None
    a, b, keep = market
    return b * x * keep / (a + x * keep)


def receive(market, y):
    if isinstance(market, list):
        spent = 0.0
        for price, amount in sorted(market):
            if y <= amount + 1e-9:
                return spent + y * price
            y, spent = y - amount, spent + amount * price
        return None
    a, b, keep = market
    return a * y / (b - y) / keep if y < b else None


def every_path(markets, src, target, amount, hops, step, better, backwards):
    names = sorted({x for pair in markets for x in pair})
    best = None
    for n in range(hops):
        for between in itertools.permutations([x for x in names if x not in (src, target)], n):
            path = [src, *between, target]
            legs = list(zip(path, path[1:]))
            for choice in itertools.product(*(markets.get(leg, []) for leg in legs)):
                v = amount
                for market in reversed(choice) if backwards else choice:
                    v = step(market, v) if v is not None else None
                if v is not None and v > 0 and (best is None or better(v, best)):
                    best = v
    return best


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_quotes_against_every_path(spark, hops):
    rnd = random.Random(11)
    assets = "ABCDE"
    offers = [(*rnd.sample(assets, 2), rnd.choice([0.25, 0.5, 1.0, 1.5, 3.0]), rnd.randrange(1, 40)) for _ in range(25)]
    pools = [(f"p{i}", *rnd.sample(assets, 2), rnd.randrange(20, 200), rnd.randrange(20, 200), rnd.choice([0.0, 0.3])) for i in range(5)]
    markets = {}
    for selling, buying, price, amount in offers:
        books = markets.setdefault((buying, selling), [[]])
        books[0].append((price, float(amount)))
    for _, a, b, x, y, fee in pools:
        markets.setdefault((a, b), []).append((float(x), float(y), 1 - fee / 100))
        markets.setdefault((b, a), []).append((float(y), float(x), 1 - fee / 100))
    reserves = [r for i, a, b, x, y, fee in pools for r in ((i, 0, "issued", a, x, fee), (i, 1, "issued", b, y, fee))]
    reserves += [("bad", 0, "issued", "A", 5, 0.0), ("odd", 0, "unknown", "A", 5, 0.0), ("odd", 1, "issued", "B", 5, 0.0), ("none", None, None, None, None, 0.0)]
    from decimal import Decimal

    df = M.book_markets(spark.createDataFrame([(*o[:3], Decimal(o[3])) for o in offers] + [("A", "A", 1.0, Decimal(9)), ("A", "B", None, Decimal(9))], OFFERS))
    df = df.unionByName(M.pool_markets(spark.createDataFrame([(*r[:4], None if r[4] is None else Decimal(r[4]), r[5]) for r in reserves], RESERVES)))
    asked = [(f"{a}{b}{x}", a, b, float(x), 30.0) for a, b in itertools.permutations(assets, 2) for x in (2, 30)] + [("self", "A", "A", 5.0, 1.0), ("far", "A", "Z", 5.0, 1.0)]
    requests = spark.createDataFrame(asked, "request string, src string, target string, amount double, send_max double")
    got = {r.request: r for r in M.quote_send(df, requests, hops).collect()}
    back = {r.request: r for r in M.quote_receive(df, requests, hops).collect()}
    assert len(got) == len(back) == len(asked)
    for name, a, b, x, most in asked:
        if name in ("self", "far"):
            assert got[name].received is None and back[name].spent is None and not back[name].within
            continue
        want = every_path(markets, a, b, x, hops, send, lambda v, best: v > best, False)
        assert got[name].received == (want if want is None else pytest.approx(want, abs=1e-6)), name
        assert got[name].path is None if want is None else (got[name].path[0], got[name].path[-1]) == (a, b) and len(set(got[name].path)) == len(got[name].path) <= hops + 1
        want = every_path(markets, a, b, x, hops, receive, lambda v, best: v < best, True)
        assert back[name].spent == (want if want is None else pytest.approx(want, abs=1e-6)), name
        assert back[name].within == (want is not None and want <= most + 1e-9)


def test_more_in_gets_worse_prices(spark):
    from decimal import Decimal

    book = M.book_markets(spark.createDataFrame([("X", "N", 1.0, Decimal(10)), ("X", "N", 2.0, Decimal(10))], OFFERS))
    asked = spark.createDataFrame([("a", "N", "X", 5.0), ("b", "N", "X", 20.0), ("c", "N", "X", 30.0), ("d", "N", "X", 30.1)], "request string, src string, target string, amount double")
    assert {r.request: r.received for r in M.quote_send(book, asked).collect()} == {"a": 5.0, "b": 15.0, "c": 20.0, "d": None}
