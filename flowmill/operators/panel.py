"""Daily panels: quotes from snapshots, factors, labels, market and board state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions import market as M
from flowmill.functions.scalars import any_of, clip, is_finite, safe_ratio, zero_fill
from flowmill.operators import blocks as B
from flowmill.operators.joins import finite_rows
from flowmill.session import staged

SCALE_FLOOR = 1e-12
# Days per year used by the two annualisations.
VOL_DAYS = 252
LEGACY_FLAGS = ("is_st", "is_halt", "is_new", "limit_locked")
FORBIDDEN_SCORING = ("label", "fwd_ret", "xs_ret", "target_return", "aux_target", "head_gain")


def quotes_from_snapshots(snaps: DataFrame) -> DataFrame:
    """End-of-day row per ticker and day: last cumulative values, prices only from traded snapshots."""
    at = F.struct("exch_time", "seq")
    traded = F.col("total_vol") > 0
    px = F.col("last_px")
    last = ("wind_code", "status", "pre_close_px", "last_px", "total_vol", "total_notional",
            "upper_limit_px", "lower_limit_px")
    return snaps.groupBy("date", "ticker").agg(
        *[F.max_by(c, at).alias(c) for c in last],
        F.min_by(F.when(traded, px), F.when(traded, at)).alias("open_px"),
        F.max(F.when(traded, px)).alias("high_px"),
        F.min(F.when(traded, px)).alias("low_px"),
    )


def quote_projection(eod: DataFrame) -> DataFrame:
    """Market, yuan prices, vwap, halt and limit-lock flags."""
    def yuan(name: str) -> Column:
        return F.col(name).cast("double") / M.PRICE_SCALE

    code = F.col("wind_code").cast("string")
    out = eod.select(
        "date",
        zero_fill("ticker").alias("symbol"),
        F.when(code.endswith(".SH"), "SH").when(code.endswith(".SZ"), "SZ").otherwise("UNK").alias("market"),
        *[yuan(f"{c}_px").alias(c) for c in ("open", "high", "low", "pre_close")],
        yuan("last_px").alias("close"),
        safe_ratio(F.col("total_notional").cast("double"), F.col("total_vol").cast("double")).alias("vwap"),
        yuan("upper_limit_px").alias("upper"),
        yuan("lower_limit_px").alias("lower"),
        F.col("total_vol").cast("double").alias("total_vol"),
        F.col("total_notional").cast("double").alias("total_notional"),
        (F.col("total_vol") <= 0).alias("is_halt"),
    )

    def pinned(limit: str) -> Column:
        bound = F.col(limit)
        return (F.col("low") >= bound * 0.9995) & (F.col("high") <= bound * 1.0005)

    return out.withColumns({
        "limit_locked": pinned("upper") | pinned("lower"), "is_st": F.lit(False), "is_new": F.lit(False),
    })


def momentum_factors(daily: DataFrame) -> DataFrame:
    """Intraday return, one-row momentum and reversal.

    The lag runs over one instrument's trading days, so its group is bounded by the calendar.
    """
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    ret = lambda px, base: F.when(base > 0, px / base - 1.0)
    out = daily.select(
        "date", "symbol",
        ret(F.col("close"), F.col("pre_close")).alias("factor_ret_oc"),
        ret(F.col("close"), before).alias("factor_mom_1"),
    )
    return out.withColumn("factor_rev_1", -F.col("factor_mom_1"))


def combine_factors(base: DataFrame, extra: DataFrame, columns: Sequence[str]) -> DataFrame:
    return base.join(extra.select("date", "symbol", *columns), ["date", "symbol"], "left")


def eligible_rows(df: DataFrame) -> DataFrame:
    """Keep rows known to be tradable at signal time; old panels fall back to the four flags."""
    if "eligible_at_signal" in df.columns:
        return df.where(F.coalesce(F.col("eligible_at_signal").try_cast("boolean"), F.lit(False)))
    flags = [F.coalesce(F.col(f).try_cast("boolean"), F.lit(False)) for f in LEGACY_FLAGS if f in df.columns]
    return df.where(~any_of(flags)) if flags else df


def day_labels(df: DataFrame, ret: str = "fwd_ret", min_names: int = 20, day: str = "date") -> DataFrame:
    """Cross-sectional targets per day: percentile label, demeaned return, robust z, head gain.

    Medians and ranks come from block-wise ranks, so a day of any width is spread over
    tasks. The label ranks the return itself, which orders like the demeaned return.
    """
    df = finite_rows(df.withColumn(ret, F.col(ret).try_cast("double")), [ret])
    ranks = B.value_ranks(df, [day], ret).where(F.col("n") >= min_names)
    stats = df.groupBy(day).agg(F.avg(ret).alias("__mean"), F.stddev_samp(ret).alias("__std"))
    middle = B.quantiles_of(ranks, [day], ret, [0.5]).select(day, F.col("quantile").alias("__median"))
    percentile = (F.col("lo") + (F.col("ties") - 1) / 2.0) / F.greatest(F.col("n") - 1, F.lit(1))
    ranks = ranks.select(day, ret, percentile.alias("label"))
    # Deviations from a median are free of float sums, but staging spares a second evaluation.
    df = staged(df.join(ranks, [day, ret]).join(stats, day).join(middle, day), "labels")
    off = F.col(ret) - F.col("__median")
    mad = B.quantiles(df.select(day, F.abs(off).alias("__dev")), [day], "__dev", [0.5])
    df = df.join(mad.select(day, F.col("quantile").alias("__mad")), day)
    scale = F.when(1.4826 * F.col("__mad") > SCALE_FLOOR, 1.4826 * F.col("__mad")).when(
        is_finite("__std") & (F.col("__std") > SCALE_FLOOR), F.col("__std")
    ).otherwise(1.0)
    return df.withColumns({
        "target_return": F.col(ret) - F.col("__mean"),
        "aux_target": clip(off / scale, -3.0, 3.0),
        "head_gain": F.pow(clip(F.col("label") - 0.5, 0.0, None) / 0.5, F.lit(2.0)),
    }).drop("__mean", "__std", "__median", "__mad")


def training_features(
    vectors: DataFrame, panel: DataFrame, factors: DataFrame | None = None, universe: DataFrame | None = None,
    min_names: int = 20,
) -> DataFrame:
    """Vectors with eligible panel rows, optional universe and factors, and the day's labels."""
    keys = ["date", "symbol"]
    df = vectors.join(panel, keys, "inner")
    if universe is not None:
        df = df.join(universe.select(*keys), keys, "left_semi")
    df = eligible_rows(df)
    if factors is not None:
        df = df.join(factors, keys, "left")
    df = day_labels(df, min_names=min_names)
    return df.select(*keys, "label", "target_return", "aux_target", "head_gain", *feature_columns(df))


def scoring_features(
    vectors: DataFrame, factors: DataFrame | None = None, universe: DataFrame | None = None, min_names: int = 1
) -> DataFrame:
    """Features without any future column."""
    keys = ["date", "symbol"]
    for frame in (vectors, factors):
        bad = forbidden_columns(frame) if frame is not None else []
        if bad:
            raise ValueError(f"scoring input holds future columns: {bad}")
    df = vectors if universe is None else vectors.join(universe.select(*keys), keys, "left_semi")
    if factors is not None:
        df = df.join(factors, keys, "left")
    wide = df.groupBy("date").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_names)
    return df.join(wide.select("date"), "date", "left_semi").select(*keys, *feature_columns(df))


def feature_columns(df: DataFrame, prefixes: Sequence[str] = ("emb_", "factor_")) -> list[str]:
    """Feature names by prefix, in prefix order and then table order."""
    return [c for p in prefixes for c in df.columns if c.startswith(p)]


def forbidden_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c in FORBIDDEN_SCORING or c.startswith("target_"))


def smooth_scores(scores: DataFrame, window: int, score: str = "score", out: str = "smooth_score") -> DataFrame:
    """Trailing mean over an instrument's last ``window`` rows (group bounded by the calendar)."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(window - 1), 0)
    return scores.withColumn(out, F.avg(score).over(w))


# --- market and board state ---------------------------------------------------


def regime_quotes(eod: DataFrame, amount: str = "total_notional") -> DataFrame:
    """Clean quotes with board and one-day return; null where a price is missing."""
    priced = is_finite("close") & is_finite("pre_close") & (F.col("close") > 0) & (F.col("pre_close") > 0)
    return eod.select(
        "date", zero_fill("symbol").alias("symbol"), F.upper("market").alias("market"),
        M.board_name("symbol", "market").alias("board"),
        F.when(priced, F.col("close") / F.col("pre_close") - 1.0).alias("ret_1d"),
        F.col(amount).try_cast("double").alias("amount"),
    )


def daily_state(quotes: DataFrame) -> DataFrame:
    """Per day: equal-weight return, breadth, total amount, and both coverages."""
    ret, amt = is_finite("ret_1d"), is_finite("amount") & (F.col("amount") >= 0)
    n = F.count(F.lit(1))
    return quotes.groupBy("date").agg(
        n.alias("n_names"),
        F.avg(F.when(ret, F.col("ret_1d"))).alias("market_return"),
        F.avg(F.when(ret, F.signum("ret_1d"))).alias("market_breadth"),
        F.sum(F.when(amt, F.col("amount"))).alias("total_amount"),
        (F.count_if(ret) / n).alias("return_coverage"),
        (F.count_if(amt) / n).alias("amount_coverage"),
    )


def board_state(quotes: DataFrame, min_names: int = 1) -> DataFrame:
    out = quotes.where(is_finite("ret_1d")).groupBy("date", "board").agg(
        F.avg("ret_1d").alias("board_return"), F.count(F.lit(1)).alias("n_names")
    )
    return out.where(F.col("n_names") >= min_names)


def _compound(c: str, w) -> Column:
    return F.product(1.0 + F.col(c)).over(w) - 1.0


def market_features(state: DataFrame, calendar: DataFrame) -> DataFrame:
    """5- and 20-day compound return, realised volatility, amount ratio; needs 20 calendar days.

    One row per trading day goes into the window, so its single partition is calendar-sized.
    """
    days = state.join(calendar, "date", "inner")
    back = lambda n: Window.orderBy("calendar_index").rangeBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(back(20)) == 20
    return days.withColumns({
        "market_return_5d": _compound("market_return", back(5)),
        "market_return_20d": _compound("market_return", back(20)),
        "market_realized_vol_20d": F.stddev_samp("market_return").over(back(20)) * float(VOL_DAYS) ** 0.5,
        "market_amount_ratio_20d": F.col("total_amount") / F.avg("total_amount").over(back(20)),
        "__full": full,
    }).where("__full").drop("__full")


def board_strength(boards: DataFrame, market: DataFrame, calendar: DataFrame) -> DataFrame:
    """Board 20-day compound return minus the market's; null unless all 20 days are present."""
    w = Window.partitionBy("board").orderBy("calendar_index").rangeBetween(-19, 0)
    b = boards.join(calendar, "date", "inner").withColumns({
        "__c": _compound("board_return", w), "__n": F.count(F.lit(1)).over(w)
    })
    out = b.join(market.select("date", "market_return_20d"), "date", "inner")
    value = F.when(F.col("__n") == 20, F.col("__c") - F.col("market_return_20d"))
    return out.select("date", "board", value.alias("board_relative_strength_20d"))


def regime_features(atomic: DataFrame, quotes: DataFrame, universe: DataFrame, calendar: DataFrame) -> DataFrame:
    """Market, board and per-instrument atomic features on every atomic row; nothing is dropped.

    Coverages count the members of the universe, whether they have a quote or not. What is missing is null and
    told apart: ``in_universe``, ``has_quote`` of the row, and ``has_history`` of the day (20 days of the calendar
    with a market return). ``regime_violations`` counts them.
    """
    keys = ["date", "symbol"]
    members = universe.select(*keys).distinct().join(quotes.withColumn("has_quote", F.lit(True)), keys, "left")
    members = staged(members.withColumns({"in_universe": F.lit(True), "has_quote": F.col("has_quote").isNotNull()}), "members")
    state = staged(daily_state(members), "state")
    market = market_features(state.where("market_return is not null and total_amount is not null"), calendar)
    strength = board_strength(board_state(members), market, calendar)
    windows = ("market_return_5d", "market_return_20d", "market_realized_vol_20d", "market_amount_ratio_20d")
    daily = state.drop("n_names").join(market.select("date", *windows, F.lit(True).alias("has_history")), "date", "left")
    out = atomic.join(members.select(*keys, "market", "board", "in_universe", "has_quote"), keys, "left").join(daily, "date", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("in_universe", "has_quote", "has_history")}
    return out.join(strength, ["date", "board"], "left").withColumns(flags | {"asof_date": F.col("date")})


def regime_violations(features: DataFrame, min_coverage: float) -> DataFrame:
    """Rows of ``regime_features`` outside the universe, without quote or history, or on a day of low coverage."""
    low = ~F.coalesce(F.least("return_coverage", "amount_coverage") >= min_coverage, F.lit(False))
    bad = {"in_universe": ~F.col("in_universe"), "has_quote": ~F.col("has_quote"), "has_history": ~F.col("has_history"), "coverage": low}
    counts = features.agg(*[F.count_if(e).alias(c) for c, e in bad.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("bad_rows")) for c in bad])))


def identity_conflicts(atomic: DataFrame, quotes: DataFrame) -> DataFrame:
    """Keys whose market or board disagrees with the quote of the same day, or that have none."""
    q = quotes.select("date", "symbol", F.col("market").alias("q_market"), F.col("board").alias("q_board"))
    out = atomic.join(q, ["date", "symbol"], "left")
    same = F.col("market").eqNullSafe(F.col("q_market")) & F.col("board").eqNullSafe(F.col("q_board"))
    return out.where(~same).select("date", "symbol", "market", "board", "q_market", "q_board")


def fit_normaliser(train: DataFrame, columns: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """One row per column: mean and population scale with a floor, from training rows only."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"s_{c}")]
    one = train.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("scale"))
        for c in columns
    ])
    return one.select(F.inline(rows))


def apply_normaliser(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise with frozen statistics; the statistics table has one row per column."""
    stats = {r["column"]: (r["mean"], r["scale"]) for r in fitted.collect()}
    return df.withColumns({c: (F.col(c) - stats[c][0]) / stats[c][1] for c in columns})


def zscore_by_day(df: DataFrame, column: str, out: str, floor: float = 1e-6, day: str = "date") -> DataFrame:
    df = B.with_group_stats(df, [day], __m=F.avg(column), __s=F.stddev_pop(column))
    return df.withColumn(out, (F.col(column) - F.col("__m")) / F.greatest(F.col("__s"), F.lit(floor))).drop("__m", "__s")
