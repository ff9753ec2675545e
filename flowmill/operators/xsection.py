"""Cross-sectional evaluation: rank correlation, quantile returns, top-K, exposures."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowmill.functions.scalars import finite_or_null, is_finite, safe_ratio
from flowmill.operators import blocks as B
from flowmill.operators.joins import finite_rows
from flowmill.session import staged

# Sharpe annualisation, minimum sample for it, Euler-Mascheroni constant.
TRADING_DAYS = 244
MIN_DAYS = 60
EULER_GAMMA = 0.5772156649015329


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation that is null, not an ANSI error, when one side does not vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_correlation(a: str, b: str) -> Column:
    """Pearson correlation of two integer columns, as Spearman's is one of doubled ranks: sums and differences are exact,
    so that the result does not depend on the order of the rows; null when one side does not vary."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    x, y, n = F.col(a), F.col(b), F.count(F.lit(1)).cast("decimal(20,0)")
    spread = lambda u, v: n * exact(u * v) - exact(u) * exact(v)
    both, own = spread(x, y), [spread(x, x), spread(y, y)]
    scale = F.sqrt(own[0].cast("double")) * F.sqrt(own[1].cast("double"))
    return F.when((own[0] > 0) & (own[1] > 0), both.cast("double") / scale)


def rank_ic(df: DataFrame, score: str = "score", ret: str = "fwd_ret", day: str = "date") -> DataFrame:
    """Daily Spearman correlation of score and return; null below three names or without variance.

    Both columns are ranked in one layout; ranks are doubled, so that the mean rank of ties is an integer.
    """
    if "eligible_at_signal" in df.columns:
        df = df.where(F.coalesce(F.col("eligible_at_signal"), F.lit(False)))
    df = finite_rows(df, [score, ret]).select(day, F.col(score).cast("double").alias("__x"), F.col(ret).cast("double").alias("__y"))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("v")) for i, c in enumerate(("__x", "__y"))]))
    ranks = staged(B.value_ranks(df.select(day, sides.alias("s")).select(day, "s.side", "s.v"), [day, "side"], "v"), "ranks")
    for i, (c, out) in enumerate((("__x", "__a"), ("__y", "__b"))):
        own = ranks.where(F.col("side") == i).select(day, F.col("v").alias(c), (2 * F.col("lo") + F.col("ties") + 1).alias(out))
        df = df.join(own, [day, c])
    corr = F.when(F.count(F.lit(1)) >= 3, rank_correlation("__a", "__b"))
    return df.groupBy(day).agg(corr.alias("ic"), F.count(F.lit(1)).alias("n_names"))


def ic_statistics(ics: DataFrame, hac_lags: int | None = None) -> DataFrame:
    """Mean, spread, ICIR, positive rate, t and Newey-West t of a daily series (calendar-sized)."""
    clean = ics.where(is_finite("ic")).select(
        "ic", F.row_number().over(Window.orderBy("date")).alias("i"), F.lit(1).alias("k")
    )
    base = clean.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg("ic").alias("mean_ic"),
        F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("std_ic"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"),
        F.coalesce(F.var_pop("ic"), F.lit(0.0)).alias("__g0"),
    )
    n = F.col("n_periods")
    auto = F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0)))
    lag = auto if hac_lags is None else F.least(F.lit(hac_lags), n - 1)
    base = base.withColumn("hac_lags", F.greatest(lag, F.lit(0)).cast("int"))
    lead = clean.join(base.select("k", "hac_lags", "mean_ic", "n_periods"), "k").where("hac_lags > 0")
    lead = lead.withColumn("o", F.explode(F.sequence(F.lit(1), F.col("hac_lags")))).withColumn("j", F.col("i") + F.col("o"))
    later = clean.select(F.col("i").alias("j"), F.col("ic").alias("ic2"))
    weight = 1.0 - F.col("o") / (F.col("hac_lags") + 1)
    cov = (F.col("ic") - F.col("mean_ic")) * (F.col("ic2") - F.col("mean_ic")) / F.col("n_periods")
    extra = lead.join(later, "j").groupBy("k").agg(F.sum(2.0 * weight * cov).alias("__x"))
    out = base.join(extra, "k", "left")
    lrv = F.greatest(F.col("__g0") + F.coalesce(F.col("__x"), F.lit(0.0)), F.lit(0.0))
    se = F.sqrt(lrv / n)
    some = F.col("std_ic") > 0
    return out.select(
        n, "mean_ic", "std_ic", F.when(some, F.col("mean_ic") / F.col("std_ic")).alias("icir"), "positive_rate",
        F.when(some, F.col("mean_ic") / (F.col("std_ic") / F.sqrt(n))).otherwise(0.0).alias("naive_t"),
        F.when(se > 0, F.col("mean_ic") / se).otherwise(0.0).alias("newey_west_t"), "hac_lags",
    )


def block_bootstrap(series: DataFrame, value: str, block: int = 5, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Moving-block bootstrap interval of the mean of a calendar-sized series ``(i, value)``.

    Block starts come from a digest of (seed, draw, slot), so a retried task draws the same blocks.
    """
    clean = series.where(is_finite(value)).select(
        (F.row_number().over(Window.orderBy("i")) - 1).alias("i"), F.col(value).alias("v")
    )
    n = clean.count()
    if n == 0:
        return clean.agg(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    size = max(min(block, n), 1)
    slots = math.ceil(n / size)
    spark = series.sparkSession
    text = F.concat_ws("|", F.lit(seed), F.col("draw"), F.col("slot"))
    start = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % (n - size + 1)
    drawn = (
        spark.range(draws * slots)
        .select(F.floor(F.col("id") / slots).alias("draw"), (F.col("id") % slots).alias("slot"))
        .withColumn("start", start)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        .where(F.col("slot") * size + F.col("k") < n)
        .select("draw", (F.col("start") + F.col("k")).alias("i"))
    )
    means = drawn.join(clean, "i").groupBy("draw").agg(F.avg("v").alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def quantile_returns(
    df: DataFrame, groups: int = 10, score: str = "score", ret: str = "fwd_ret", day: str = "date",
    only_eligible: bool = True, tie: str = "symbol_id",
) -> DataFrame:
    """Mean return per day and score group; group 0 holds the lowest scores.

    ``tie`` is a numeric instrument id that orders equal scores.
    """
    df = df.where(F.col(ret).isNotNull()) if only_eligible else df
    if only_eligible and "eligible_at_signal" in df.columns:
        df = df.where(F.coalesce(F.col("eligible_at_signal"), F.lit(False)))
    df = B.ordinal_rank(df.select(day, score, tie, ret), [day], [score, tie], "__r", "__n")
    group = F.least(F.floor((F.col("__r") - 1) * groups / F.col("__n")), F.lit(groups - 1)).cast("int")
    return df.groupBy(day, group.alias("group")).agg(
        F.count(F.lit(1)).alias("n_names"), F.avg(ret).alias("mean_return"), F.sum(ret).alias("sum_return"),
        F.count(ret).alias("n_returns"),
    )


def group_means(by_day: DataFrame) -> DataFrame:
    """Pooled mean return per score group over all days."""
    return by_day.groupBy("group").agg((F.sum("sum_return") / F.sum("n_returns")).alias("ret"))


def correlation_gate(df: DataFrame, signal: str, factors: Sequence[str], limit: float = 0.7) -> DataFrame:
    """Correlation of a signal with each known factor over finite pairs, and the verdict."""
    aggs = []
    for f in factors:
        pair = is_finite(signal) & is_finite(f)
        c = pearson(F.when(pair, F.col(signal).cast("double")), F.when(pair, F.col(f).cast("double")))
        aggs.append(F.when(F.count_if(pair) >= 3, finite_or_null(c)).alias(f))
    one = df.agg(*aggs)
    top = F.coalesce(F.greatest(*[F.abs(F.col(f)) for f in factors], F.lit(0.0)), F.lit(0.0))
    return one.select(*factors, top.alias("max_abs_corr"), (top <= limit).alias("passed"))


def deflated_sharpe_ratio(
    observed: float, n_trials: int, n_obs: int, variance: float, skew: float = 0.0, kurtosis: float = 3.0
) -> float:
    """Probability that the true Sharpe ratio exceeds the best of ``n_trials`` lucky ones."""
    if n_trials < 1 or n_obs < 2:
        return math.nan
    norm = NormalDist()
    quant = lambda q: norm.inv_cdf(q) if 0 < q < 1 else -math.inf
    z = (1 - EULER_GAMMA) * quant(1 - 1 / n_trials) + EULER_GAMMA * quant(1 - 1 / (n_trials * math.e))
    excess = (observed - math.sqrt(max(variance, 0.0)) * z) * math.sqrt(n_obs - 1)
    spread = 1 - skew * observed + (kurtosis - 1) / 4 * observed**2
    return norm.cdf(excess / math.sqrt(spread)) if spread > 0 else math.nan


def deflated_sharpe(returns: DataFrame, value: str, trials: DataFrame, trial_sharpe: str) -> DataFrame:
    """Deflated Sharpe of a return series against the spread of trial Sharpe ratios.

    Moments are one aggregate row; only that row reaches the driver.
    """
    m = returns.where(is_finite(value)).agg(
        F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.skewness(value).alias("sk"),
        (F.kurtosis(value) + 3).alias("ku"), F.count(F.lit(1)).alias("n"),
    )
    t = trials.agg(F.count(trial_sharpe).alias("k"), F.var_pop(trial_sharpe).alias("v"))
    a, b = m.first(), t.first()
    sharpe = a["m"] / a["s"]
    dsr = deflated_sharpe_ratio(sharpe, b["k"], a["n"], b["v"], a["sk"], a["ku"])
    return m.select(F.lit(sharpe).alias("sharpe"), F.col("n").alias("n_obs"), F.lit(b["k"]).alias("n_trials"), F.lit(dsr).alias("dsr"))


def score_distribution(scores: DataFrame, score: str = "score", day: str = "date") -> DataFrame:
    """Per-day distribution of a score with exact quantiles; flags constant days."""
    base = scores.groupBy(day).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"),
    )
    uniques = scores.groupBy(day, score).agg(F.lit(1).alias("u")).groupBy(day).agg(F.count("u").alias("unique_scores"))
    near = B.quantiles(scores.select(day, score), [day], score, [0.01, 0.25, 0.75, 0.99], "nearest")
    mid = B.quantiles(scores.select(day, score), [day], score, [0.5])
    names = ["p01", "p25", "p75", "p99"]
    near = near.groupBy(day).agg(*[F.max(F.when(F.col("p_index") == i, F.col("quantile"))).alias(n) for i, n in enumerate(names)])
    out = base.join(uniques, day).join(near, day).join(mid.select(day, F.col("quantile").alias("p50")), day)
    constant = (F.col("unique_scores") <= 1) | F.col("std").isNull() | (F.col("std") <= 1e-12)
    return out.withColumns({"unique_ratio": F.col("unique_scores") / F.col("rows"), "constant": constant})


def width_stats(df: DataFrame, day: str = "date") -> DataFrame:
    """Rows, days, date span and the narrowest, median and widest cross-section."""
    counts = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("days"), F.min(day).alias("date_min"),
        F.max(day).alias("date_max"), F.min("n").alias("names_min"), F.median("n").alias("names_median"),
        F.max("n").alias("names_max"),
    )


# --- top-K portfolios ---------------------------------------------------------


def day_index(df: DataFrame, day: str = "date") -> DataFrame:
    """Distinct days numbered from 1 (calendar-sized)."""
    return df.select(day).distinct().withColumn("d", F.row_number().over(Window.orderBy(day)))


def top_members(
    df: DataFrame, ks: Sequence[int], score: str = "score", tie: str = "symbol", day: str = "date", side: str = "long"
) -> DataFrame:
    """Members of the top (or bottom) K per day for every K at once.

    Spark prunes each task to its best ``max(ks)`` rows per day before the shuffle.
    """
    order = [F.col(score).desc_nulls_last(), F.col(tie)] if side == "long" else [F.col(score).asc_nulls_first(), F.col(tie).desc()]
    w = Window.partitionBy(day).orderBy(*order)
    top = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(ks))
    fits = F.filter(F.array(*[F.lit(k) for k in sorted(ks)]), lambda k: k >= F.col("rank"))
    return top.withColumn("top_k", F.explode(fits))


def _turnover(members: DataFrame, days: DataFrame) -> DataFrame:
    """Names that changed between adjacent days per (top_k, day)."""
    now = members.select("top_k", "d", "symbol", F.lit(1).alias("__now"))
    before = members.select("top_k", (F.col("d") + 1).alias("d"), "symbol", F.lit(1).alias("__was"))
    moved = now.join(before, ["top_k", "d", "symbol"], "full_outer")
    changed = F.col("__now").isNull() | F.col("__was").isNull()
    out = moved.groupBy("top_k", "d").agg(F.count_if(changed).alias("changed"))
    return out.join(days.select("d"), "d", "left_semi")


def topk_daily(
    df: DataFrame, ks: Sequence[int], cost_bps: Sequence[float] = (15.0,), long_short: bool = False,
    score: str = "score", ret: str = "fwd_ret", day: str = "date",
) -> DataFrame:
    """Daily net return and turnover for every (top_k, cost) pair from one ranking."""
    if "limit_locked" in df.columns:
        df = df.where(~F.coalesce(F.col("limit_locked").cast("boolean"), F.lit(False)))
    df = df.select(day, "symbol", score, ret)
    days = day_index(df, day)
    legs = {}
    for side in ("long", "short") if long_short else ("long",):
        members = top_members(df, ks, score, "symbol", day, side).join(days, day)
        mean = members.groupBy("top_k", "d", day).agg(F.coalesce(F.avg(ret), F.lit(0.0)).alias(f"{side}_ret"))
        legs[side] = mean.join(_turnover(members, days).withColumnRenamed("changed", f"{side}_changed"), ["top_k", "d"])
    out = legs["long"]
    gross, changed = F.col("long_ret"), F.col("long_changed")
    if long_short:
        out = out.join(legs["short"].drop(day), ["top_k", "d"])
        gross, changed = 0.5 * (gross - F.col("short_ret")), changed + F.col("short_changed")
    out = out.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in cost_bps])))
    turn = changed / F.greatest(2 * F.col("top_k"), F.lit(1))
    return out.select(
        "top_k", "cost_bps", day, "d", gross.alias("gross"), turn.alias("turnover"),
        (gross - turn * F.col("cost_bps") / 1e4).alias("ret"),
    )


def policy_grid(
    df: DataFrame, ks: Sequence[int], intervals: Sequence[int], smoothing: Sequence[int], cost_bps: Sequence[float] = (15.0,),
    score: str = "score", ret: str = "fwd_ret", day: str = "date",
) -> DataFrame:
    """Daily return and turnover of equal-weighted top-k holdings for every policy of the grid, from one ranking.

    ``smoothing`` w ranks by a name's mean score over its rows of the last w trading days (this one included; rows
    without a score do not count, a name without any is not ranked), ties by ``symbol``. ``interval`` h chooses anew on
    every h-th day from the first on and holds in between. A held name without a return on a day earns 0 there.
    Turnover is paid on the days of choice: names that changed over twice ``top_k``; entering counts.

    All windows share one sort per name. The ranking is cut at the largest k before it is shuffled, and each day's
    members are dealt to the intervals that choose on that day, so nothing is ranked twice.
    """
    if min([*ks, *intervals, *smoothing]) < 1:
        raise ValueError("ranks, intervals and windows start at 1")
    df = df.select(day, "symbol", score, ret)
    days = day_index(df, day)
    rows = df.join(F.broadcast(days), day)
    past = Window.partitionBy("symbol").orderBy("d")
    mean = lambda w: F.sum(score).over(past.rangeBetween(1 - w, 0)) / F.count(score).over(past.rangeBetween(1 - w, 0))
    guarded = lambda w: F.when(F.count(score).over(past.rangeBetween(1 - w, 0)) > 0, mean(w))
    rows = rows.withColumns({f"__m{w}": guarded(w) for w in smoothing})
    views = F.array(*[F.struct(F.lit(w).alias("smoothing"), F.col(f"__m{w}").alias("__mean")) for w in sorted(set(smoothing))])
    ranked = rows.select("d", "symbol", F.inline(views)).where("__mean is not null")
    place = F.row_number().over(Window.partitionBy("smoothing", "d").orderBy(F.desc("__mean"), "symbol"))
    top = ranked.withColumn("rank", place).where(F.col("rank") <= max(ks))
    top = top.withColumn("interval", F.explode(F.filter(F.array(*[F.lit(h) for h in sorted(set(intervals))]), lambda h: (F.col("d") - 1) % h == 0)))
    top = top.withColumn("top_k", F.explode(F.filter(F.array(*[F.lit(k) for k in sorted(set(ks))]), lambda k: k >= F.col("rank"))))
    policy = ["top_k", "interval", "smoothing"]
    chosen = staged(top.select(*policy, "d", "symbol"), "chosen")

    held = chosen.withColumn("d", F.explode(F.sequence(F.col("d"), F.col("d") + F.col("interval") - 1)))
    returns = df.join(F.broadcast(days), day).select("d", "symbol", F.col(ret).alias("__ret"))
    gross = held.join(days.select("d"), "d", "left_semi").join(returns, ["d", "symbol"], "left").groupBy(*policy, "d").agg(
        (F.sum(F.coalesce(F.col("__ret"), F.lit(0.0))) / F.count(F.lit(1))).alias("gross")
    )
    now = chosen.withColumn("__now", F.lit(1))
    before = chosen.withColumn("d", F.col("d") + F.col("interval")).withColumn("__was", F.lit(1))
    moved = now.join(before, [*policy, "d", "symbol"], "full_outer").groupBy(*policy, "d").agg(
        F.count_if(F.col("__now").isNull() | F.col("__was").isNull()).alias("__changed")
    )
    turnover = F.coalesce(F.col("__changed") / (2 * F.col("top_k")), F.lit(0.0))
    out = gross.join(moved, [*policy, "d"], "left").join(F.broadcast(days), "d")
    out = out.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in cost_bps]))).withColumn("turnover", turnover)
    return out.select(*policy, "cost_bps", day, "d", "gross", "turnover", (F.col("gross") - F.col("turnover") * F.col("cost_bps") / 1e4).alias("ret"))


def equity_curve(daily: DataFrame, keys: Sequence[str], value: str = "ret", day: str = "date") -> DataFrame:
    """Cumulative product, running peak and drawdown of daily series (calendar-sized per key)."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", F.product(1.0 + F.col(value)).over(w))
    out = out.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)


def return_summary(
    daily: DataFrame, keys: Sequence[str], value: str = "ret", day: str = "date", min_days: int = MIN_DAYS
) -> DataFrame:
    """Raw statistics for any length, annualised ones only for a long enough sample."""
    curve = equity_curve(daily.where(is_finite(value)), keys, value, day)
    v = F.col(value)
    out = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(v).alias("mean_daily_return"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("daily_vol"),
        F.avg((v > 0).cast("double")).alias("hit_rate"), F.min("drawdown").alias("max_drawdown"),
        F.max_by("equity", day).alias("__end"),
    )
    sharpe = F.coalesce(safe_ratio(F.col("mean_daily_return"), F.col("daily_vol")), F.lit(0.0))
    reliable = F.col("n_days") >= min_days
    usable = reliable & (F.col("daily_vol") > 0)
    return out.withColumns({
        "sharpe_daily": sharpe,
        "cum_return": F.col("__end") - 1.0,
        "reliable": reliable,
        "sharpe": F.when(usable, sharpe * math.sqrt(TRADING_DAYS)),
        "ann_return": F.when(usable, F.pow(F.col("__end"), F.lit(float(TRADING_DAYS)) / F.col("n_days")) - 1.0),
    }).drop("__end")


def backtest_topk(df: DataFrame, ks: Sequence[int], cost_bps: Sequence[float] = (15.0,), long_short: bool = False) -> DataFrame:
    """Summary per (top_k, cost): the memoryless parameter grid."""
    daily = topk_daily(df, ks, cost_bps, long_short)
    turn = daily.groupBy("top_k", "cost_bps").agg(F.avg("turnover").alias("mean_turnover"))
    return return_summary(daily, ["top_k", "cost_bps"]).join(turn, ["top_k", "cost_bps"])


def eligible_benchmark(df: DataFrame, ret: str = "fwd_ret", day: str = "date") -> DataFrame:
    ok = F.coalesce(F.col("eligible_at_signal"), F.lit(False)) & is_finite(ret)
    return df.where(ok).groupBy(day).agg(F.avg(ret).alias("benchmark_return"))


def active_returns(daily: DataFrame, benchmark: DataFrame, value: str = "ret", day: str = "date") -> DataFrame:
    out = daily.join(benchmark, day, "left")
    return out.withColumn("active_return", F.col(value) - F.col("benchmark_return"))


def head_metrics(df: DataFrame, cutoffs: Sequence[int], score: str = "score", ret: str = "fwd_ret", day: str = "date") -> DataFrame:
    """NDCG@K and top-K excess return (bps) per day and cutoff.

    The gain is the squared upper half of the return percentile. Only the best
    ``max(cutoffs)`` rows by score and by gain are ranked further.
    """
    df = B.average_rank(df.select(day, "symbol", score, ret), [day], ret, "__r", "__n")
    pct = (F.col("__r") - 1.0) / F.greatest(F.col("__n") - 1, F.lit(1))
    df = df.withColumn("gain", F.pow(F.greatest((pct - 0.5) / 0.5, F.lit(0.0)), F.lit(2.0)))
    means = df.groupBy(day).agg(F.avg(ret).alias("__mean"))
    discount = 1.0 / F.log2(F.col("rank") + 1.0)
    by_score = top_members(df, cutoffs, score, "symbol", day).groupBy(day, "top_k").agg(
        F.sum(F.col("gain") * discount).alias("dcg"), F.avg(ret).alias("__top")
    )
    by_gain = top_members(df, cutoffs, "gain", "symbol", day).groupBy(day, "top_k").agg(
        F.sum(F.col("gain") * discount).alias("ideal")
    )
    out = by_score.join(by_gain, [day, "top_k"]).join(means, day)
    return out.select(
        day, F.col("top_k").alias("cutoff"),
        F.coalesce(safe_ratio(F.col("dcg"), F.col("ideal")), F.lit(0.0)).alias("ndcg"),
        ((F.col("__top") - F.col("__mean")) * 1e4).alias("top_excess_bps"),
    )


def adjacent_turnover(scores: DataFrame, top_k: int, score: str = "score", day: str = "date") -> DataFrame:
    """Rank change and one-sided top-K turnover between adjacent days."""
    neg = scores.select(day, "symbol", score, (-F.col(score)).alias("__neg"))
    ranked = B.average_rank(neg, [day], "__neg", "__r", "__n")
    days = day_index(scores, day)
    ranked = ranked.join(days, day).select("d", day, "symbol", (F.col("__r") / F.col("__n")).alias("pct"))
    before = ranked.select((F.col("d") + 1).alias("d"), "symbol", F.col("pct").alias("was"))
    moves = ranked.join(before, ["d", "symbol"]).groupBy("d").agg(
        F.avg(F.abs(F.col("pct") - F.col("was"))).alias("mean_rank_change"), F.count(F.lit(1)).alias("n_common")
    )
    sizes = ranked.groupBy((F.col("d") + 1).alias("d")).agg(F.count(F.lit(1)).alias("n_before"))
    top = top_members(scores, [top_k], score, "symbol", day).join(days, day).select("d", "symbol")
    kept = top.join(top.select((F.col("d") + 1).alias("d"), "symbol"), ["d", "symbol"]).groupBy("d").agg(F.count(F.lit(1)).alias("kept"))
    prior = top.groupBy((F.col("d") + 1).alias("d")).agg(F.count(F.lit(1)).alias("prior"))
    out = days.where("d > 1").join(moves, "d", "left").join(sizes, "d").join(prior, "d").join(kept, "d", "left")
    return out.select(
        day, "mean_rank_change",
        (F.coalesce(F.col("n_common"), F.lit(0)) / F.col("n_before")).alias("common_coverage"),
        (1.0 - F.coalesce(F.col("kept"), F.lit(0)) / F.col("prior")).alias("top_k_turnover"),
    )


def ledger(
    holdings: DataFrame, buy_bps: float, sell_bps: float, stamp_bps: float = 0.0, day: str = "date",
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Daily accounting of a given holdings table ``(date, symbol, weight, fwd_ret)``.

    A name that leaves is sold at the weight it had, one that enters is bought at the weight it gets.
    Days of ``calendar`` without holdings are rows as well, and carry the sales of the day before.
    """
    days = day_index(holdings if calendar is None else calendar, day)
    held = holdings.join(days, day).select("d", "symbol", "weight", "fwd_ret")
    before = held.select((F.col("d") + 1).alias("d"), "symbol", F.lit(1).alias("__was"), F.col("weight").alias("__old"))
    both = days.join(held.withColumn("__now", F.lit(1)).join(before, ["d", "symbol"], "full_outer"), "d", "left")
    amount = lambda when, c: F.coalesce(F.sum(F.when(F.col(when).isNull(), F.col(c))), F.lit(0.0))
    out = both.groupBy("d", day).agg(
        F.coalesce(F.sum(F.col("weight") * F.when(is_finite("fwd_ret"), F.col("fwd_ret")).otherwise(0.0)), F.lit(0.0)).alias("gross_return"),
        F.count("__now").alias("n_holdings"),
        amount("__was", "weight").alias("buy_notional"),
        amount("__now", "__old").alias("sell_notional"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("__w"),
    )
    cost = (F.col("buy_notional") * buy_bps + F.col("sell_notional") * (sell_bps + stamp_bps)) / 1e4
    out = out.withColumns({
        "cost": cost, "net_return": F.col("gross_return") - cost,
        "turnover": 0.5 * (F.col("buy_notional") + F.col("sell_notional")),
        "cash_weight": F.greatest(1.0 - F.col("__w"), F.lit(0.0)),
    })
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("nav", F.product(1.0 + F.col("net_return")).over(w)).drop("d", "__w")


def ledger_summary(daily: DataFrame) -> DataFrame:
    """One row over a ``ledger``: days, return, spread, yearly Sharpe ratio, drawdown, mean turnover and total cost.

    The drawdown is against the highest value of a day so far; without days everything is 0.
    """
    peak = F.max("nav").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = daily.withColumn("__drawdown", F.col("nav") / peak - 1.0)
    out = rows.agg(
        F.count(F.lit(1)).alias("n_days"), (F.max_by("nav", "date") - 1.0).alias("cum_return"), F.avg("net_return").alias("mean_daily_return"),
        F.stddev_samp("net_return").alias("daily_vol"), F.min("__drawdown").alias("max_drawdown"), F.avg("turnover").alias("mean_turnover"),
        F.sum("cost").alias("total_cost"),
    )
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in out.columns[1:]})
    sharpe = safe_ratio(F.col("mean_daily_return"), F.col("daily_vol")) * math.sqrt(TRADING_DAYS)
    return out.withColumn("sharpe", F.when(F.col("daily_vol") > 0, sharpe).otherwise(0.0))


# --- exposures and neutralisation ---------------------------------------------


def portfolio_exposures(holdings: DataFrame, factors: DataFrame, columns: Sequence[str], day: str = "date") -> DataFrame:
    joined = holdings.select(day, "symbol", "weight").join(factors.select(day, "symbol", *columns), [day, "symbol"], "left")
    def exposure(c: str) -> Column:
        weight = F.sum(F.when(F.col(c).isNotNull(), F.col("weight")).otherwise(0.0))
        return F.try_divide(F.sum(F.col(c) * F.col("weight")), weight).alias(c)
    return joined.groupBy(day).agg(*[exposure(c) for c in columns])


def _solver():
    """Least-squares coefficients from a day's k x k cross products.

    Built inside a function, so it travels to workers by value.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(gram: pd.Series, moment: pd.Series) -> pd.Series:
        def one(g: np.ndarray, m: np.ndarray) -> np.ndarray:
            return np.linalg.lstsq(np.asarray(g).reshape(len(m), len(m)), np.asarray(m), rcond=None)[0]
        return pd.Series([one(g, m) for g, m in zip(gram, moment)])

    return solve


def residualise(df: DataFrame, factors: Sequence[str], ret: str = "fwd_ret", out: str = "neutralized_ret", day: str = "date") -> DataFrame:
    """Residual of a daily cross-sectional regression of the return on factor columns.

    Each day is reduced to its cross products (partial sums, any width), solved as a
    small system, and the coefficients are joined back.
    """
    k = len(factors)
    clean = finite_rows(df.select(day, "symbol", ret, *factors), [ret, *factors])
    # Centring per day first keeps the cross products well conditioned.
    names = [ret, *factors]
    clean = B.with_group_stats(clean, [day], **{f"__m{i}": F.avg(c) for i, c in enumerate(names)})
    clean = clean.withColumns({f"__c{i}": F.col(c) - F.col(f"__m{i}") for i, c in enumerate(names)})
    cross = [F.sum(F.col(f"__c{i}") * F.col(f"__c{j}")) for i in range(1, k + 1) for j in range(1, k + 1)]
    moment = [F.sum(F.col(f"__c{i}") * F.col("__c0")) for i in range(1, k + 1)]
    sums = clean.groupBy(day).agg(
        F.array(*cross).alias("g"), F.array(*moment).alias("m"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") > k + 1)
    beta = sums.select(day, _solver()("g", "m").alias("__beta"))
    fitted = sum((F.col("__beta")[i] * F.col(f"__c{i + 1}") for i in range(k)), F.lit(0.0))
    return clean.join(beta, day).select(day, "symbol", (F.col("__c0") - fitted).alias(out))


def stylised_facts(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, max_lag: int = 50) -> DataFrame:
    """Excess kurtosis and mean autocorrelation of the absolute centred value over lags 1..L.

    The sum over all lags is a difference of prefix sums, so one self join on the row
    number replaces L lagged copies. Keys with fewer than L + 2 finite values keep their count, with nulls.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count_if(is_finite(value)).alias("n_rows"))
    clean = finite_rows(df, [value]).select(*keys, *order, F.col(value).alias("r"))
    clean = B.with_group_stats(clean, keys, n=F.count(F.lit(1)), __m=F.avg("r"), __k=F.kurtosis("r"))
    clean = clean.where(F.col("n") >= max_lag + 2).withColumn("a", F.abs(F.col("r") - F.col("__m")))
    clean = B.with_group_stats(clean, keys, __ma=F.avg("a")).withColumn("a", F.col("a") - F.col("__ma"))
    pre = B.running(clean, keys, list(order), {"i": B.number(), "s": B.total(F.col("a"))})
    ahead = pre.select(*keys, (F.col("i") - max_lag).alias("i"), F.col("s").alias("s_ahead"))
    total = pre.groupBy(*keys).agg(F.sum("a").alias("s_all"), F.sum(F.col("a") * F.col("a")).alias("den"))
    out = pre.join(ahead, [*keys, "i"], "left").join(total, keys)
    reach = F.coalesce(F.col("s_ahead"), F.col("s_all")) - F.col("s")
    acf = F.sum(F.col("a") * reach) / (F.first("den") * max_lag)
    facts = out.groupBy(*keys).agg(
        finite_or_null(F.first("__k")).alias("excess_kurtosis"),
        F.when(F.first("den") > 0, acf).otherwise(0.0).alias("vol_clustering_acf"),
    )
    return sizes.join(facts, keys, "left")


def linear_scores(df: DataFrame, columns: Sequence[str], weights: Sequence[float], out: str = "score") -> DataFrame:
    """Score with a frozen linear model; the feature set must match the weights exactly."""
    have = [c for c in df.columns if c.startswith(("emb_", "factor_"))]
    if have != list(columns):
        raise ValueError("feature columns differ from the frozen order")
    total = sum((F.col(c) * float(w) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    return df.select("date", "symbol", total.alias(out))


def full_coverage(scores: DataFrame, panel: DataFrame, keys: Sequence[str] = ("date", "symbol")) -> DataFrame:
    """Score keys found in the panel against all score keys, one row."""
    hit = scores.select(*keys).join(panel.select(*keys).distinct().withColumn("__p", F.lit(1)), list(keys), "left")
    return hit.agg(
        F.count(F.lit(1)).alias("n_scores"), F.count("__p").alias("n_covered"),
        (F.count("__p") == F.count(F.lit(1))).alias("complete"),
    )
