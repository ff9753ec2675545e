"""Order life cycles, clearing price, depth by level and book-state features."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions import market as M
from flowmill.functions.scalars import safe_ratio
from flowmill.operators import blocks as B
from flowmill.operators.joins import as_of

EPS = 1e-12


def order_lifecycle(orders: DataFrame, trades: DataFrame, cancels: DataFrame) -> DataFrame:
    """Status, traded and remaining quantity and average price of every order."""
    def leg(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col(f"{side}_order_id").alias("order_id"), "price", "quantity")

    # A trade whose two legs name the same order counts once.
    crossed = trades.where(F.col("sell_order_id") != F.col("buy_order_id"))
    traded = leg(trades, "buy").unionByName(leg(crossed, "sell")).groupBy("order_id").agg(
        F.sum("quantity").alias("traded_quantity"),
        F.sum(F.col("price") * F.col("quantity")).alias("__value"),
        F.count(F.lit(1)).alias("total_trades"),
    )
    gone = cancels.select("order_id").distinct().withColumn("__cancelled", F.lit(True))
    work = orders.join(traded, "order_id", "left").join(gone, "order_id", "left").withColumns({
        "traded_quantity": F.coalesce(F.col("traded_quantity"), F.lit(0)),
        "total_trades": F.coalesce(F.col("total_trades"), F.lit(0)),
    })
    left = F.col("initial_quantity") - F.col("traded_quantity")
    status = (
        F.when(F.col("__cancelled"), "cancelled")
        .when(left <= 0, "filled")
        .when(F.col("traded_quantity") > 0, "partial")
        .otherwise("open")
    )
    avg = F.coalesce(safe_ratio(F.col("__value"), F.col("traded_quantity")), F.lit(0.0))
    return work.withColumns({
        "status": status,
        "remaining_quantity": F.when(status == "filled", F.lit(0)).otherwise(left),
        "avg_trade_price": avg,
    }).drop("__value", "__cancelled")


def market_order_class(orders: DataFrame, trades: DataFrame) -> DataFrame:
    """Class of each market order from its own trades.

    0 = rests at its single price, 1 = swept several prices, -2 = cancelled remainder
    (with its quantity), -1 = no usable trade. Trades collapse to a few rows per order
    before the join; the number of distinct prices is only ever compared with one, so
    min and max decide it.
    """
    price = F.col("trade_price")
    facts = trades.groupBy("order_id", "bsflag", (F.col("trade_type") == "C").alias("cancel")).agg(
        F.max(F.struct("serial", "trade_volume")).alias("last"),
        F.min(price).alias("lowest"),
        F.min(F.when(price != 0, price)).alias("lo"),
        F.max(F.when(price != 0, price)).alias("hi"),
    )
    used = facts.join(orders.select("order_id", "side"), "order_id", "inner")
    used = used.where(F.col("cancel") | (F.col("bsflag") == F.col("side")))
    facts = used.groupBy("order_id").agg(
        F.max(F.when(F.col("cancel"), F.col("last"))).alias("__cancel"),
        F.max("last").alias("__last"),
        F.min("lowest").alias("__min"),
        F.min("lo").alias("__lo"),
        F.max("hi").alias("__hi"),
    )
    single = F.coalesce(F.col("__lo") == F.col("__hi"), F.lit(False))
    has_zero = F.col("__min") == 0
    code = (
        F.when(F.col("__min").isNull(), -1)
        .when(F.col("__cancel").isNotNull(), -2)
        .when(single, 0)
        .when(has_zero, -2)
        .otherwise(1)
    )
    quantity = F.coalesce(
        F.col("__cancel")["trade_volume"], F.when(has_zero & ~single, F.col("__last")["trade_volume"])
    )
    return orders.join(facts, "order_id", "left").select(
        "order_id", "side", code.alias("order_class"), quantity.alias("left_quantity")
    )


def clearing_price(orders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Call-auction price: largest executable volume, lowest price on ties.

    Orders collapse to one row per price level first; executable volume at a price is
    the smaller of all sells at or below it and all buys at or above it.
    """
    keys = list(keys)
    qty = F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(0)
    levels = orders.groupBy(*keys, "price").agg(
        F.sum(F.when(F.col("side") == "B", qty).otherwise(0)).alias("buy"),
        F.sum(F.when(F.col("side") == "S", qty).otherwise(0)).alias("sell"),
    )
    bids = orders.groupBy(*keys).agg(F.sum(F.when(F.col("side") == "B", qty).otherwise(0)).alias("__bids"))
    curve = B.running(levels, keys, ["price"], {"__buy": B.total(F.col("buy")), "__sell": B.total(F.col("sell"))})
    demand = F.col("__bids") - (F.col("__buy") - F.col("buy"))
    curve = curve.join(bids, keys, "inner").withColumn("volume", F.least(demand, F.col("__sell")))
    best = F.max(F.struct(F.col("volume"), (-F.col("price")).alias("neg")))
    out = curve.where(F.col("volume") > 0).groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, (-F.col("b")["neg"]).alias("clearing_price"), F.col("b")["volume"].alias("volume"))


def depth_at(
    orders: DataFrame, fills: DataFrame, cancels: DataFrame, cuts: Sequence, max_levels: int | None = None
) -> DataFrame:
    """Live quantity by price level at each cut time: ``(cut, symbol, side, level, price, quantity)``.

    ``orders``: order_id, symbol, side, price, quantity, time; ``fills``: order_id,
    quantity, time; ``cancels``: order_id, time. One signed change log, one grouped
    sum per order for all cuts together, then all levels per side or the best ``max_levels``.
    """
    log = (
        orders.select("order_id", F.col("time"), F.col("quantity").alias("change"), F.lit(False).alias("gone"))
        .unionByName(fills.select("order_id", "time", (-F.col("quantity")).alias("change"), F.lit(False).alias("gone")))
        .unionByName(cancels.select("order_id", "time", F.lit(0).cast("long").alias("change"), F.lit(True).alias("gone")))
    )
    cut_cols = [F.lit(c) for c in cuts]
    sums = []
    for i, c in enumerate(cut_cols):
        seen = F.col("time") <= c
        live = F.coalesce(F.sum(F.when(seen, F.col("change"))), F.lit(0))
        cancelled = F.coalesce(F.bool_or(seen & F.col("gone")), F.lit(False))
        sums.append(F.when(cancelled, 0).otherwise(live).alias(f"__q{i}"))
    per_order = log.groupBy("order_id").agg(*sums)
    work = orders.select("order_id", "symbol", "side", "price", F.col("time").alias("__placed")).join(
        per_order, "order_id", "inner"
    )
    slots = F.array(*[
        F.struct(c.alias("cut"), F.when(F.col("__placed") <= c, F.col(f"__q{i}")).otherwise(0).alias("q"))
        for i, c in enumerate(cut_cols)
    ])
    work = work.select("symbol", "side", "price", F.explode(slots).alias("s"))
    work = work.where(F.col("s")["q"] > 0)
    levels = work.groupBy(F.col("s")["cut"].alias("cut"), "symbol", "side", "price").agg(
        F.sum(F.col("s")["q"]).alias("quantity")
    )
    toward = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(Window.partitionBy("cut", "symbol", "side").orderBy(toward))
    levels = levels.withColumn("level", rank)
    return levels if max_levels is None else levels.where(F.col("level") <= max_levels)


def book_state(levels: DataFrame, keys: Sequence[str], tick: int = 100) -> DataFrame:
    """Top of book, 5/10-level depth, spread, imbalances and microprice from level rows."""
    def side(name: str) -> Column:
        return F.col("side") == name

    def depth(name: str, n: int) -> Column:
        return F.coalesce(F.sum(F.when(side(name) & (F.col("level") <= n), F.col("quantity"))), F.lit(0))

    def top(name: str) -> Column:
        return F.max(F.when(side(name) & (F.col("level") == 1), F.col("price")))

    out = levels.groupBy(*keys).agg(
        top("B").alias("bid1"), top("S").alias("ask1"),
        *[depth(s, n).alias(f"{p}_{c}") for s, p in (("B", "bid"), ("S", "ask"))
          for n, c in ((1, "qty_1"), (5, "depth_5"), (10, "depth_10"))],
    )
    return out.withColumns(state_measures(tick))


def imbalance(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask + EPS))


def state_measures(tick: int = 100) -> dict[str, Column]:
    """Measures of one book state given its flat columns."""
    bid, ask = F.col("bid1"), F.col("ask1")
    bq, aq = F.col("bid_qty_1"), F.col("ask_qty_1")
    valid = bid.isNotNull() & ask.isNotNull()
    micro = (ask * bq + bid * aq) / (bq + aq + EPS)
    return {
        "valid": valid,
        "spread_ticks": F.when(valid, F.rint((ask - bid) / tick).cast("long")),
        "imbalance_1": imbalance(bq, aq),
        "imbalance_5": imbalance(F.col("bid_depth_5"), F.col("ask_depth_5")),
        "imbalance_10": imbalance(F.col("bid_depth_10"), F.col("ask_depth_10")),
        "microprice_delta_ticks": F.when(valid & (bq + aq > 0), (micro - (bid + ask) / 2.0) / tick),
    }


STATE = (
    "bid1", "ask1", "bid_qty_1", "ask_qty_1", "bid_depth_5", "ask_depth_5", "bid_depth_10", "ask_depth_10",
)


def with_pre_state(events: DataFrame, keys: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """Attach the post state of the preceding event as struct ``pre``; null on the first event."""
    state = F.struct(*[F.col(c) for c in STATE])
    return B.running(events, keys, order, {"pre": B.previous(state)}, width=width)


def book_features(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], price: str, tick: int = 100,
    width: int | None = None,
) -> DataFrame:
    """Eight post-event features and the signed distance of the price from the previous midpoint."""
    work = with_pre_state(events, keys, order, width)
    m = state_measures(tick)
    pre, px = F.col("pre"), F.col(price).cast("double")
    middle = (pre["bid1"] + pre["ask1"]) / 2.0
    return work.select(
        *keys, *order,
        m["valid"].alias("book_valid_post"),
        m["spread_ticks"].alias("spread_ticks_post"),
        m["microprice_delta_ticks"].alias("microprice_delta_ticks_post"),
        m["imbalance_1"].alias("imbalance_l1_post"),
        m["imbalance_5"].alias("imbalance_l5_post"),
        m["imbalance_10"].alias("imbalance_l10_post"),
        F.log1p(F.col("bid_depth_5").cast("double")).alias("log_bid_depth_l5_post"),
        F.log1p(F.col("ask_depth_5").cast("double")).alias("log_ask_depth_l5_post"),
        F.when(px > 0, (px - middle) / tick).alias("event_price_distance_ticks_pre"),
    )


def _flow(before: Column, before_qty: Column, now: Column, now_qty: Column) -> Column:
    """Order-flow contribution of one quote: joins or improves minus leaves or worsens."""
    came = F.when(now >= before, now_qty).otherwise(0)
    went = F.when(now <= before, before_qty).otherwise(0)
    return F.when(before.isNotNull() & now.isNotNull(), (came - went).cast("double"))


def stock_day_atomic(events: DataFrame, keys: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """Per instrument and day: time-weighted spread and depth, normalised order-flow imbalance.

    A state lasts until the next event but not past the end of its continuous session.
    """
    keys = list(keys)
    state = F.struct(*[F.col(c) for c in STATE])
    work = events.withColumn("__ms", M.packed_to_ms("int_time"))
    work = B.running(
        work, keys, order, {"pre": B.previous(state), "__next": B.following(F.col("__ms"))}, width=width
    )
    end = M.session_end("__ms")
    lasting = F.least(F.coalesce(F.col("__next"), end), end) - F.col("__ms")
    dur = F.when(end.isNotNull() & (lasting > 0), lasting)
    bid, ask, pre = F.col("bid1"), F.col("ask1"), F.col("pre")
    middle = (bid + ask) / 2.0
    quoted = dur.isNotNull() & (middle > 0)
    buy = _flow(pre["bid1"], pre["bid_qty_1"], bid, F.col("bid_qty_1"))
    # Asks mirror bids: negating prices swaps "improves" and "worsens".
    sell = _flow(-pre["ask1"], pre["ask_qty_1"], -ask, F.col("ask_qty_1"))
    ofi = F.when(end.isNotNull(), buy - sell)
    depth = F.log1p((F.col("bid_depth_5") + F.col("ask_depth_5")).cast("double"))
    work = work.select(*keys, dur.alias("dur"), F.when(quoted, dur).alias("vdur"),
                       (10_000.0 * (ask - bid) / middle).alias("bps"), depth.alias("depth"), ofi.alias("ofi"))
    sums = work.groupBy(*keys).agg(
        F.sum(F.col("bps") * F.col("vdur")).alias("__s"), F.coalesce(F.sum("vdur"), F.lit(0)).alias("__v"),
        F.sum(F.col("depth") * F.col("dur")).alias("__d"), F.coalesce(F.sum("dur"), F.lit(0)).alias("__o"),
        F.sum("ofi").alias("__f"), F.sum(F.abs("ofi")).alias("__fa"),
        F.count(F.lit(1)).alias("n_events"), F.count("ofi").alias("n_ofi_events"),
    )
    flow = F.when(F.col("n_ofi_events") > 0, F.coalesce(safe_ratio(F.col("__f"), F.col("__fa")), F.lit(0.0)))
    return sums.select(
        *keys,
        safe_ratio(F.col("__s"), F.col("__v")).alias("stock_spread_bps"),
        safe_ratio(F.col("__d"), F.col("__o")).alias("stock_depth_l5_log"),
        flow.alias("stock_ofi_l1"),
        (F.col("__v") / 1000.0).alias("book_valid_seconds"),
        (F.col("__o") / 1000.0).alias("observed_seconds"),
        F.lit(M.CONTINUOUS_SECONDS).alias("continuous_session_seconds"),
        (F.col("__v") / 1000.0 / M.CONTINUOUS_SECONDS).alias("book_valid_ratio"),
        "n_events", "n_ofi_events",
    )


# Vendor name prefixes of level columns.
LEVEL_PREFIXES = {
    "bid_px": ("bid_price", "bp", "buy_price", "bidpx"),
    "bid_qty": ("bid_volume", "bid_vol", "bv", "buy_volume", "bidsz"),
    "ask_px": ("ask_price", "ap", "sell_price", "askpx", "offer_price"),
    "ask_qty": ("ask_volume", "ask_vol", "av", "sell_volume", "asksz"),
}


def level_arrays(df: DataFrame, n_levels: int | None = None) -> DataFrame:
    """Fold vendor level columns into four arrays, found by name and ordered by level number.

    A level column is a prefix, a separator or none, and a number; other columns stay as they are.
    ``n_levels`` keeps the best levels only.
    """
    arrays, used = {}, set()
    for target, prefixes in LEVEL_PREFIXES.items():
        pattern = re.compile(rf"(?:{'|'.join(prefixes)})[_. -]?(\d+)", re.IGNORECASE)
        found = {c: pattern.fullmatch(c) for c in df.columns}
        hits = sorted((c for c, m in found.items() if m), key=lambda c: (int(found[c][1]), c))
        used.update(hits)
        arrays[target] = F.array(*[F.col(c).cast("double") for c in hits[:n_levels]])
    rest = [c for c in df.columns if c not in used]
    return df.select(*rest, *[a.alias(n) for n, a in arrays.items()])


def reconcile_snapshots(
    rebuilt: DataFrame, reference: DataFrame, by: Sequence[str], time: str, n_levels: int = 10,
    price_tol: float = 1e-4, qty_rtol: float = 1e-6, tie: Sequence[str] = (),
) -> DataFrame:
    """Level-wise agreement of vendor snapshots with the last rebuilt book at or before them.

    Of several books at one time the one with the greatest ``tie`` columns counts; without them it is an error.
    """
    books = rebuilt.select(*by, *[F.col(c).alias(f"__k_{c}") for c in tie], F.col(time).alias("__bt"), *[F.col(c).alias(f"r_{c}") for c in LEVEL_PREFIXES])
    joined = as_of(reference, books, by, time, "__bt", [f"r_{c}" for c in LEVEL_PREFIXES], strict=False, tie=[f"__k_{c}" for c in tie])
    joined = joined.where(F.col("matched_time").isNotNull())

    def compare(side: str) -> Column:
        mine, theirs = F.col(f"r_{side}_px"), F.col(f"{side}_px")
        common = F.least(F.size(mine), F.size(theirs), F.lit(n_levels))
        def one(i: Column) -> Column:
            mq = F.coalesce(F.get(F.col(f"r_{side}_qty"), i), F.lit(0.0))
            tq = F.coalesce(F.get(F.col(f"{side}_qty"), i), F.lit(0.0))
            return F.struct(
                (i + 1).alias("level"),
                (F.abs(F.get(mine, i) - F.get(theirs, i)) <= price_tol).alias("price_ok"),
                (F.abs(mq - tq) <= 1.0 + qty_rtol * F.abs(tq)).alias("qty_ok"),
            )
        return F.when(common > 0, F.transform(F.sequence(F.lit(0), common - 1), one))

    both = F.concat(*[F.coalesce(compare(s), F.array().cast("array<struct<level:int,price_ok:boolean,qty_ok:boolean>>")) for s in ("bid", "ask")])
    rows = joined.select(F.explode(both).alias("c"))
    return rows.groupBy(F.col("c")["level"].alias("level")).agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.count_if(F.col("c")["price_ok"]).alias("n_price_match"),
        F.count_if(F.col("c")["qty_ok"]).alias("n_qty_match"),
        (F.count_if(F.col("c")["price_ok"]) / F.count(F.lit(1))).alias("price_match_rate"),
    )
