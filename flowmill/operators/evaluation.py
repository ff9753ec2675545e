"""Evaluation of scores as a set of tables and one long table of metrics, written side by side and read back by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowmill.functions.scalars import is_finite
from flowmill.operators import xsection as X
from flowmill.session import staged

TABLES = (
    "daily_ic", "quantile_returns", "daily_head_metrics", "topk_grid", "benchmark_daily", "portfolio_daily", "holdings", "trades",
)
# Fixed value: trading days of a year.
YEAR_DAYS = 244


def top_holdings(df: DataFrame, top_k: int, score: str = "score", ret: str = "fwd_ret", day: str = "date") -> DataFrame:
    """Equal weights of each day's ``top_k`` names (fewer where a day has fewer) that are not locked at their limit."""
    if "limit_locked" in df.columns:
        df = df.where(~F.coalesce(F.col("limit_locked").cast("boolean"), F.lit(False)))
    days = X.day_index(df, day)
    top = staged(X.top_members(df.select(day, "symbol", score, ret), [top_k], score, "symbol", day).join(days, day), "members")
    size = top.groupBy(day).agg(F.count(F.lit(1)).alias("__n"))
    return top.join(size, day).select(day, "d", "symbol", (1.0 / F.col("__n")).alias("weight"), F.col(ret).alias("ret"))


def weight_changes(holdings: DataFrame, day: str = "date") -> DataFrame:
    """What is bought and sold between adjacent days: ``date, d, symbol, side, change``; all of the first day is bought."""
    days = holdings.select(day, "d").distinct()
    now = holdings.select("d", "symbol", F.col("weight").alias("__now"))
    was = holdings.select((F.col("d") + 1).alias("d"), "symbol", F.col("weight").alias("__was"))
    moved = now.join(was, ["d", "symbol"], "full_outer")
    change = F.coalesce("__now", F.lit(0.0)) - F.coalesce("__was", F.lit(0.0))
    out = moved.select("d", "symbol", change.alias("change")).where("change <> 0").join(days, "d")
    return out.select(day, "d", "symbol", F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"), "change")


def evaluate(
    df: DataFrame, ks: Sequence[int], costs: Sequence[float], groups: int, cutoffs: Sequence[int], top_k: int, cost: float,
) -> dict[str, DataFrame]:
    """The tables of ``TABLES`` for rows ``date, symbol, symbol_id, score, fwd_ret, eligible_at_signal``; written before."""
    ranked = df.where(F.coalesce(F.col("eligible_at_signal"), F.lit(False)) & is_finite("fwd_ret"))
    benchmark = staged(X.eligible_benchmark(df), "benchmark")
    holdings = staged(top_holdings(df, top_k), "holdings")
    return {
        "daily_ic": X.rank_ic(df), "quantile_returns": X.quantile_returns(df, groups), "daily_head_metrics": X.head_metrics(ranked, cutoffs),
        "topk_grid": X.backtest_topk(df, ks, costs), "benchmark_daily": benchmark,
        "portfolio_daily": X.active_returns(X.topk_daily(df, [top_k], [cost]), benchmark), "holdings": holdings, "trades": weight_changes(holdings),
    }


def _long(section: str, one: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(section, metric, value)`` of aggregates over a table."""
    row = one.agg(*[e.cast("double").alias(n) for n, e in values.items()])
    cells = [F.struct(F.lit(section).alias("section"), F.lit(n).alias("metric"), F.col(n).alias("value")) for n in values]
    return row.select(F.inline(F.array(*cells)))


def metrics(df: DataFrame, tables: dict[str, DataFrame], cutoffs: Sequence[int]) -> DataFrame:
    """``(section, metric, value)``: coverage of the labels, information coefficient, head of the ranking, benchmark,
    portfolio and its return above the benchmark. A value that is not defined is null."""
    eligible, labelled = F.coalesce(F.col("eligible_at_signal"), F.lit(False)), F.coalesce(is_finite("fwd_ret"), F.lit(False))
    both = F.count_if(eligible & labelled)
    out = _long("coverage", df, {
        "score_rows": F.count(F.lit(1)), "signal_days": F.count_distinct("date"), "eligible_rows": F.count_if(eligible), "label_rows": both,
        "label_coverage": F.try_divide(both, F.count_if(eligible)),
    })
    ic = X.ic_statistics(tables["daily_ic"])
    out = out.unionByName(_long("ic", ic, {c: F.max(c) for c in ic.columns}))
    at = lambda c, k: F.avg(F.when(F.col("cutoff") == k, F.col(c)))
    head = {f"{c}_{k}": at(c, k) for c in ("ndcg", "top_excess_bps") for k in cutoffs}
    out = out.unionByName(_long("head_ranking", tables["daily_head_metrics"], head))
    series = lambda c: {"n_days": F.count(c), "mean_daily_return": F.avg(c), "daily_vol": F.stddev_samp(c), "hit_rate": F.avg((F.col(c) > 0).cast("double"))}
    out = out.unionByName(_long("benchmark", tables["benchmark_daily"], series("benchmark_return")))
    daily = tables["portfolio_daily"]
    out = out.unionByName(_long("portfolio", daily, {**series("ret"), "mean_turnover": F.avg("turnover")}))
    active = F.col("active_return")
    return out.unionByName(_long("active", daily, {
        "mean_daily_return": F.avg(active), "tracking_error": F.stddev_samp(active),
        "information_ratio": F.try_divide(F.avg(active), F.stddev_samp(active)) * YEAR_DAYS ** 0.5,
    }))


def write_evaluation(
    df: DataFrame, path: str, ks: Sequence[int], costs: Sequence[float] = (0.0, 15.0, 30.0), groups: int = 10,
    cutoffs: Sequence[int] = (10, 30), top_k: int = 10, cost: float = 15.0,
) -> None:
    """Write every table, then the metrics taken from the written ones; an evaluation counts once it has its metrics."""
    spark = df.sparkSession
    for name, table in evaluate(df, ks, costs, groups, cutoffs, top_k, cost).items():
        table.write.option("compression", "zstd").parquet(f"{path}/{name}")
    written = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    metrics(df, written, cutoffs).coalesce(1).write.parquet(f"{path}/metrics")


def read_evaluation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables and the metrics by name; an unfinished evaluation is an error."""
    try:
        whole = spark.read.parquet(f"{path}/metrics")
    except AnalysisException as e:
        raise ValueError(f"{path} holds no finished evaluation") from e
    return {**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES}, "metrics": whole}
