"""Vector tables: pooling, cross-asset context, clock alignment, wide and array forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from flowmill.functions import market as M
from flowmill.functions.scalars import dot
from flowmill.operators import blocks as B

# Names and order of the pooled windows, bounds in milliseconds of the day.
POOL_WINDOWS = (
    "mean_all", "last_256", "last_1024", "open_call", "continuous_am", "continuous_pm", "close_call", "close_30m",
)
SELECTED_OUTPUTS = ("mean_all", "last_256", "continuous_pm", "close_30m")
_MINUTE = M.MINUTE_MS
TIME_WINDOWS = {
    "open_call": (M.OPEN_CALL_START, M.AM_START),
    "continuous_am": (M.AM_START, M.AM_END + _MINUTE),
    "continuous_pm": (M.PM_START, M.PM_AUCTION),
    "close_call": (M.PM_AUCTION, M.PM_END + _MINUTE),
    "close_30m": ((14 * 60 + 30) * _MINUTE, M.PM_END + _MINUTE),
}
TAILS = {"last_256": 256, "last_1024": 1024}


def _vector(c: str) -> Column:
    return array_to_vector(F.col(c).cast("array<double>"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str, out: str) -> DataFrame:
    """Element-wise mean per group and the row count; partial sums of whole vectors, no explode."""
    v = df.select(*keys, _vector(vec).alias("__v"))
    return v.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(F.col("__v"))).alias(out), F.count(F.lit(1)).alias("n_rows")
    )


def from_end(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, width: int | None = None) -> DataFrame:
    """Add the 1-based position counted from the last row of each group."""
    ranked = B.running(df, keys, order, {"__rn": B.number()}, width=width)
    ranked = B.with_group_stats(ranked, keys, __n=F.count(F.lit(1)))
    return ranked.withColumn(out, F.col("__n") - F.col("__rn") + 1).drop("__rn", "__n")


def pool(df: DataFrame, keys: Sequence[str], order: Sequence[str], vec: str, method: str = "mean", last_k: int = 256) -> DataFrame:
    """One vector per group: mean, last row, or mean of the last k rows."""
    if method == "mean":
        return mean_vectors(df, keys, vec, "pooled")
    if method == "last":
        at = F.struct(*[F.col(c) for c in order])
        return df.groupBy(*keys).agg(
            F.max_by(F.col(vec).cast("array<double>"), at).alias("pooled"), F.lit(1).cast("long").alias("n_rows")
        )
    if method == "lastk_mean":
        tail = from_end(df.select(*keys, *order, vec), keys, order, "__end").where(F.col("__end") <= last_k)
        return mean_vectors(tail, keys, vec, "pooled")
    raise ValueError(f"unknown pooling method {method!r}")


def pool_windows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], vec: str, ms: str, width: int,
    outputs: Sequence[str] = POOL_WINDOWS, with_count: bool = False, tails: dict[str, int] | None = None,
) -> DataFrame:
    """Ordered concatenation of window means per group; an empty window contributes zeros.

    A row is copied once per window it belongs to (at most six), then every
    ``(group, window)`` is a partial vector sum.
    """
    unknown = set(outputs) - set(POOL_WINDOWS)
    if unknown or not outputs:
        raise ValueError(f"unknown pooling outputs {sorted(unknown)}")
    tails = tails or TAILS
    work = from_end(df.select(*keys, *order, vec, ms), keys, order, "__end")
    t = F.col(ms)
    member = {"mean_all": F.lit(True)}
    member |= {n: F.col("__end") <= k for n, k in tails.items()}
    member |= {n: (t >= a) & (t < b) for n, (a, b) in TIME_WINDOWS.items()}
    needed = [*dict.fromkeys([*outputs, "mean_all"])]
    tags = F.filter(F.array(*[F.when(member[n], F.lit(n)) for n in needed]), lambda x: x.isNotNull())
    means = mean_vectors(work.withColumn("__win", F.explode(tags)), [*keys, "__win"], vec, "__m")
    zeros = F.array_repeat(F.lit(0.0), width)
    parts = [F.max(F.when(F.col("__win") == n, F.col("__m"))).alias(f"__p{i}") for i, n in enumerate(outputs)]
    total = F.max(F.when(F.col("__win") == "mean_all", F.col("n_rows"))).alias("n_events")
    wide = means.groupBy(*keys).agg(*parts, total)
    pieces = [F.coalesce(F.col(f"__p{i}"), zeros) for i in range(len(outputs))]
    if with_count:
        pieces.append(F.array(F.col("n_events").cast("double")))
    return wide.select(*keys, F.concat(*pieces).alias("pooled"), "n_events")


def cross_context(df: DataFrame, time: str, vec: str, industry: str, active: str = "active") -> DataFrame:
    """Market mean, industry leave-one-out mean, both differences, and whether a peer exists.

    Sums per time and per (time, industry) are joined back; the row itself is then
    subtracted, so no pair of rows is ever formed. Inactive rows get zeros.
    """
    def zeros(v: Column) -> Column:
        return F.transform(v, lambda x: F.lit(0.0))

    own = F.col("__own")
    df = df.withColumn("__own", F.col(vec).cast("array<double>"))
    live = df.where(F.col(active))
    market = mean_vectors(live, [time], "__own", "__market").drop("n_rows")
    peers = mean_vectors(live.where(F.col(industry) >= 0), [time, industry], "__own", "__imean")
    out = df.join(market, time, "left").join(peers.withColumnRenamed("n_rows", "__peers"), [time, industry], "left")
    has = F.coalesce(F.col(active) & (F.col(industry) >= 0) & (F.col("__peers") > 1), F.lit(False))
    n = F.col("__peers")
    loo = F.zip_with("__imean", "__own", lambda m, x: (m * n - x) / (n - 1))
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    out = out.withColumns({
        "has_peer": has,
        "market": F.when(F.col(active), F.col("__market")).otherwise(zeros(own)),
        "industry_mean": F.when(has, loo).otherwise(zeros(own)),
    })
    return out.withColumns({
        "own_minus_market": F.when(F.col(active), minus(own, F.col("market"))).otherwise(zeros(own)),
        "own_minus_industry": F.when(has, minus(own, F.col("industry_mean"))).otherwise(zeros(own)),
    }).drop("__own", "__market", "__imean", "__peers")


def concat_context(df: DataFrame, vec: str, out: str) -> DataFrame:
    parts = [F.col(vec).cast("array<double>"), *[F.col(c) for c in ("market", "industry_mean", "own_minus_market", "own_minus_industry")]]
    return df.withColumn(out, F.concat(*parts))


def align_to_clock(df: DataFrame, keys: Sequence[str], interval: str, vec: str, minutes: int = 5) -> DataFrame:
    """One row per group and clock interval of the day; missing ones are inactive with a null vector.

    The grid of a day is fixed (49 intervals of five minutes), so each group expands by
    a constant, not by the other side of a join.
    """
    last = 2 * (120 // minutes)
    grid = df.select(*keys).distinct().withColumn(interval, F.explode(F.sequence(F.lit(0), F.lit(last))))
    out = grid.join(df.select(*keys, interval, vec), [*keys, interval], "left")
    return out.withColumn("active", F.col(vec).isNotNull())


def to_wide(df: DataFrame, vec: str, width: int, prefix: str = "emb_") -> DataFrame:
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, *[F.col(vec)[i].cast("double").alias(f"{prefix}{i}") for i in range(width)])


def to_array(df: DataFrame, out: str, prefix: str = "emb_") -> DataFrame:
    """Fold ``emb_0..emb_n`` into one array; a gap in the numbering is an error."""
    cols = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    if cols != [f"{prefix}{i}" for i in range(len(cols))]:
        raise ValueError(f"vector columns are not contiguous: {cols}")
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols])).drop(*cols)


def score_vectors(df: DataFrame, vec: str, weights: Sequence[float], out: str = "score") -> DataFrame:
    return df.withColumn(out, dot(F.col(vec), F.array(*[F.lit(float(w)) for w in weights])))
