"""Date splits, cross-validation folds, deterministic samples and event windows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions.scalars import all_of, is_finite, key_digest
from flowmill.operators import blocks as B


# --- date splits (calendar-sized tables) --------------------------------------


def split_by_date(df: DataFrame, train_end: str, val_end: str, day: str = "date") -> DataFrame:
    d = F.col(day)
    return df.withColumn("split", F.when(d <= train_end, "train").when(d <= val_end, "val").otherwise("test"))


def split_counts(df: DataFrame, day: str = "date") -> DataFrame:
    per_day = df.groupBy("split", day).agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_days"), F.min(day).alias("date_min"), F.max(day).alias("date_max")
    )


def share_boundaries(calendar: DataFrame, train: float = 0.70, val: float = 0.85) -> tuple[str, str]:
    """Last training and validation day when days are split by share."""
    n = calendar.count()
    if n < 3:
        raise ValueError("need at least three days")
    a = max(0, int(n * train) - 1)
    b = max(a + 1, int(n * val) - 1)
    ends = {r["calendar_index"]: r["date"] for r in calendar.where(F.col("calendar_index").isin(a, b)).collect()}
    return ends[a], ends[b]


def tail_split(calendar: DataFrame, val_days: int, purge_days: int, min_train: int) -> DataFrame:
    """Role per day: the tail validates, a purge band before it is dropped; too few days = all train."""
    n = calendar.count()
    i = F.col("calendar_index")
    if n < min_train + purge_days + val_days:
        return calendar.withColumn("role", F.lit("train"))
    role = F.when(i >= n - val_days, "val").when(i >= n - val_days - purge_days, "purge").otherwise("train")
    return calendar.withColumn("role", role)


def purged_folds(
    calendar: DataFrame, n_groups: int = 6, n_test: int = 2, purge: int = 5, embargo: int = 2
) -> DataFrame:
    """Combinatorial purged folds as ``(fold, date, role)``; role is train, test or blocked.

    Test groups are contiguous, so the purge and embargo days around one are a range.
    The fold list is a small literal; days times folds is the result itself.
    """
    n = calendar.count()
    if n < n_groups:
        raise ValueError(f"need at least {n_groups} days, got {n}")
    edge = [g * n // n_groups for g in range(n_groups + 1)]
    i = F.col("calendar_index")

    def role(groups: tuple[int, ...]) -> Column:
        test = F.lit(False)
        near = F.lit(False)
        for g in groups:
            test = test | ((i >= edge[g]) & (i < edge[g + 1]))
            near = near | ((i >= edge[g] - purge) & (i < edge[g + 1] + purge + embargo))
        return F.when(test, "test").when(near, "blocked").otherwise("train")

    folds = [F.struct(F.lit(k).alias("fold"), role(c).alias("role")) for k, c in enumerate(combinations(range(n_groups), n_test))]
    return calendar.select("date", F.explode(F.array(*folds)).alias("f")).select("f.fold", "date", "f.role")


def date_plan(
    calendar: DataFrame, benchmark: tuple[int, int, int], cutoff: str, adapt_train: int, adapt_val: int, adapt_purge: int
) -> DataFrame:
    """Labelled dates of the benchmark track and the adaptation track, ``(track, label, date)``."""
    train, val, test = benchmark
    n = calendar.count()
    if n < train + val + test:
        raise ValueError(f"benchmark needs {train + val + test} days, found {n}")
    known = calendar.where(F.col("date") <= cutoff).count()
    core = adapt_train - adapt_val - adapt_purge
    if known < adapt_train or core < 1:
        raise ValueError(f"adaptation needs {adapt_train} days up to {cutoff}, found {known}")
    i, j = F.col("calendar_index"), F.col("calendar_index") - (known - adapt_train)
    bench = F.when(i < train, "train").when(i < train + val, "validation").when(i < train + val + test, "test").otherwise("locked_oos")
    adapt = (
        F.when(i >= known, "shadow_oos").when(j < 0, None).when(j < core, "development_train")
        .when(j < core + adapt_purge, "purge").otherwise("validation")
    )
    tracks = F.array(
        F.struct(F.lit("benchmark").alias("track"), bench.alias("label")),
        F.struct(F.lit("adaptation").alias("track"), adapt.alias("label")),
    )
    out = calendar.select("date", F.explode(tracks).alias("t")).select("t.track", "t.label", "date")
    return out.where(F.col("label").isNotNull())


def known_labels(panel: DataFrame, oos_start: str, horizon: Sequence[str], ret: str = "fwd_ret") -> DataFrame:
    """Training rows whose signal day and every label day lie strictly before the OOS start."""
    early = [F.coalesce(F.col(c).cast("string") < oos_start, F.lit(False)) for c in ("date", *horizon)]
    return panel.where(is_finite(F.col(ret).try_cast("double")) & all_of(early))


def evenly_spaced_days(calendar: DataFrame, max_days: int) -> DataFrame:
    """Up to ``max_days`` representative days, first and last included; 0 keeps all."""
    n = calendar.count()
    if max_days == 0 or n <= max_days:
        return calendar.select("date")
    if max_days == 1:
        picks = [n // 2]
    else:
        picks = sorted({k * (n - 1) // (max_days - 1) for k in range(max_days)})
    return calendar.where(F.col("calendar_index").isin(picks)).select("date")


def head_per_split(df: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """First ``ceil(limit / 3)`` rows of each split in a fixed order, ``limit`` rows in all."""
    per = max(1, -(-limit // 3))
    rank = F.row_number().over(Window.partitionBy("split").orderBy(*order))
    seq = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    top = df.withColumn("__r", rank).where(F.col("__r") <= per)
    return top.orderBy(seq, "__r").limit(limit).drop("__r")


# --- windows over event counts -------------------------------------------------


def event_windows(groups: DataFrame, rows: str, context: int, stride: int, min_len: int) -> DataFrame:
    """``(start, length)`` windows every ``stride`` rows, short tails below ``min_len`` dropped."""
    if min(context, stride, min_len) < 1:
        raise ValueError("context, stride and min_len must be positive")
    n = F.col(rows)
    starts = groups.where(n > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(stride).cast("long"))))
    out = starts.withColumn("length", F.least(F.lit(context).cast("long"), n - F.col("start")))
    return out.where(F.col("length") >= min_len)


def causal_windows(groups: DataFrame, rows: str, context: int, stride: int) -> DataFrame:
    """Overlapping windows ``(start, end, emit_start)`` in which every row is emitted once."""
    if not 1 <= stride <= context:
        raise ValueError("stride must be between 1 and context")
    n = F.col(rows)
    if stride == context:
        count = F.ceil(n / context)
    else:
        count = F.ceil(F.greatest(n - context, F.lit(0)) / stride) + 1
    out = groups.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))
    start = F.col("k") * stride
    before = F.least((F.col("k") - 1) * stride + context, n)
    emit = F.when(F.col("k") == 0, 0).otherwise(before - start) if stride != context else F.lit(0)
    return out.withColumns({
        "start": start, "end": F.least(start + context, n), "emit_start": emit.cast("long"),
    }).drop("k")


def padded_windows(
    events: DataFrame, keys: Sequence[str], position: str, token: str, context: int, stride: int, min_len: int, pad: int = 0
) -> DataFrame:
    """One row per window: token array padded to ``context`` and its mask.

    An event joins the windows that cover its position (about ``context / stride`` of
    them); a window collects at most ``context`` rows.
    """
    p = F.col(position)
    first = F.greatest(F.ceil((p - context + 1) / stride), F.lit(0)).cast("long")
    last = F.floor(p / stride).cast("long")
    spread = events.where(first <= last).withColumn("__k", F.explode(F.sequence(first, last)))
    got = spread.groupBy(*keys, (F.col("__k") * stride).alias("start")).agg(
        F.array_sort(F.collect_list(F.struct(p.alias("p"), F.col(token).alias("t")))).alias("rows")
    )
    got = got.withColumn("length", F.size("rows")).where(F.col("length") >= min_len)
    fill = F.lit(context) - F.col("length")
    return got.select(
        *keys, "start", "length",
        F.concat(F.transform("rows", lambda r: r["t"]), F.array_repeat(F.lit(pad).cast("long"), fill)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(True), F.col("length")), F.array_repeat(F.lit(False), fill)).alias("mask"),
    )


# --- samples ------------------------------------------------------------------


def value_buckets(df: DataFrame, value: str, n_buckets: int, out: str) -> DataFrame:
    """Bucket by nearest-rank boundaries; a non-finite value is ``unknown``."""
    names = ["low", "mid", "high"] if n_buckets == 3 else [f"q{i + 1}_of_{n_buckets}" for i in range(n_buckets)]
    clean = df.where(is_finite(value)).select(F.col(value).cast("double").alias("v"))
    ranks = B.value_ranks(clean, [], "v")
    n = F.col("n")
    at = [F.least(F.ceil(n * q / n_buckets) - 1, n - 1) for q in range(1, n_buckets)]
    hit = [F.max(F.when((k >= F.col("lo")) & (k < F.col("lo") + F.col("ties")), F.col("v"))) for k in at]
    bounds = list(ranks.agg(*hit).first()) if hit else []
    if any(b is None for b in bounds):
        return df.withColumn(out, F.lit("unknown"))
    number = sum((F.when(F.col(value) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    label = F.element_at(F.array(*[F.lit(x) for x in names]), number + 1)
    return df.withColumn(out, F.when(is_finite(value), label).otherwise("unknown"))


def balanced_sample(
    df: DataFrame, strata: Sequence[str], identity: Sequence[str], max_rows: int, per_stratum: int | None = None, seed: int = 42
) -> DataFrame:
    """Round-robin over strata: every stratum gives its k-th row before any gives its (k+1)-th.

    Rows and strata are ordered by digests, so the sample does not depend on input
    order. ``max_rows`` is the sample size, taken with Spark's distributed top-n.
    """
    work = df.withColumns({
        "__pr": key_digest(F.lit(seed), *identity), "__ps": key_digest(F.lit(seed), F.lit("stratum"), *strata),
    })
    # no stratum gives more than the whole sample; Spark prunes each task to that many rows before the shuffle
    most = max_rows if per_stratum is None else min(per_stratum, max_rows)
    ranked = work.withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy("__pr")).cast("long"))
    return ranked.where(F.col("round") <= most).orderBy("round", "__ps").limit(max_rows).drop("__pr", "__ps")


def epoch_assignment(windows: DataFrame, shard: str, window: str, epoch: int, ranks: int, seed: int = 0) -> DataFrame:
    """Shuffled window order of one epoch, clustered by shard, dealt to ranks in equal runs.

    Positions past the end repeat from the start, so every rank gets the same count.
    """
    work = windows.withColumns({
        "__hs": key_digest(F.lit(seed + epoch), F.lit("shard"), shard),
        "__hw": key_digest(F.lit(seed + epoch), F.lit("window"), shard, window),
    })
    work = B.running(work, [], ["__hs", "__hw"], {"__n": B.number()}).drop("__hs", "__hw")
    n = windows.count()
    per = -(-n // ranks)
    total = per * ranks
    pos = F.explode(F.sequence(F.col("__n") - 1, F.lit(total - 1).cast("long"), F.lit(max(n, 1)).cast("long")))
    out = work.withColumn("position", pos).drop("__n")
    return out.withColumns({"rank": F.floor(F.col("position") / per), "slot": F.col("position") % per})


# --- keep-first / keep-last ------------------------------------------------------


def keep_by(df: DataFrame, keys: Sequence[str], precedence: Column) -> DataFrame:
    """One row per key: the one with the highest precedence; a partial aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), precedence).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return keep_by(
        old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1))), keys, F.col("__g")
    ).drop("__g")
