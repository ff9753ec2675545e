"""Data-quality checks: named predicates counted in one pass, and table profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowmill.functions.scalars import is_finite, is_iso_date
from flowmill.operators.joins import duplicate_keys


@dataclass(frozen=True)
class Check:
    """A row predicate that must hold; ``severity`` is ``error`` or ``warning``."""

    check_id: str
    holds: Column
    severity: str = "error"


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``(check_id, severity, status, bad_rows, total_rows)`` for all checks from one scan."""
    bad = [F.count_if(~F.coalesce(c.holds, F.lit(False))).alias(f"b{i}") for i, c in enumerate(checks)]
    one = df.agg(F.count(F.lit(1)).alias("total_rows"), *bad)
    rows = F.array(*[
        F.struct(
            F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"),
            F.when(F.col(f"b{i}") == 0, "pass").otherwise("warn" if c.severity == "warning" else "fail").alias("status"),
            F.col(f"b{i}").alias("bad_rows"), F.col("total_rows").alias("total_rows"),
        )
        for i, c in enumerate(checks)
    ])
    return one.select(F.inline(rows))


def require(report: DataFrame) -> None:
    """Strict mode: raise when any check failed (a report has one row per check)."""
    failed = [r["check_id"] for r in report.where(F.col("status") == "fail").collect()]
    if failed:
        raise ValueError(f"checks failed: {failed}")


def unique_check(df: DataFrame, keys: Sequence[str], check_id: str) -> DataFrame:
    """Uniqueness as a report row; the duplicate count is one partial aggregate."""
    dup = duplicate_keys(df, keys).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("bad_rows"))
    return dup.select(
        F.lit(check_id).alias("check_id"), F.lit("error").alias("severity"),
        F.when(F.col("bad_rows") == 0, "pass").otherwise("fail").alias("status"), "bad_rows",
    )


def finite_gate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite cells per feature column, from one scan."""
    one = df.agg(*[F.count_if(~is_finite(F.col(c).try_cast("double"))).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bad_rows")) for c in columns])
    return one.select(F.inline(rows))


def score_checks(scores: DataFrame) -> list[Check]:
    if set(scores.columns) != {"date", "symbol", "score"}:
        raise ValueError(f"score table must hold exactly date, symbol, score; got {scores.columns}")
    return [
        Check("valid_date", is_iso_date("date")),
        Check("valid_symbol", F.col("symbol").rlike(r"^\d{6}$")),
        Check("finite_score", is_finite("score")),
    ]


def validate_scores(scores: DataFrame) -> DataFrame:
    """The score table sorted by key, after every row and the key passed."""
    require(run_checks(scores, score_checks(scores)))
    require(unique_check(scores, ["date", "symbol"], "unique_key"))
    return scores.select("date", "symbol", F.col("score").cast("double").alias("score")).orderBy("date", "symbol")


def universe_checks() -> list[Check]:
    policy = F.col("universe_policy")
    return [
        Check("key_present", F.col("date").isNotNull() & F.col("symbol").isNotNull()),
        Check("iso_date", is_iso_date("date")),
        Check("iso_asof", is_iso_date("asof_date")),
        Check("asof_not_after_date", F.col("asof_date") <= F.col("date")),
        Check("policy_present", policy.isNotNull() & (F.trim(policy) != "")),
    ]


def single_value(df: DataFrame, columns: Sequence[str], check_id: str) -> DataFrame:
    """Exactly one distinct combination; the distinct set is counted, not collected."""
    n = df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("n_values"))
    return n.select(F.lit(check_id).alias("check_id"), F.when(F.col("n_values") == 1, "pass").otherwise("fail").alias("status"), "n_values")


def width_alignment(train: DataFrame, score: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Ratio of the median daily widths of two universes against the allowed band."""
    def median_width(df: DataFrame, name: str) -> DataFrame:
        w = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
        return w.agg(F.median("n").alias(name)).withColumn("__k", F.lit(1))

    both = median_width(train, "train_median").join(median_width(score, "score_median"), "__k").drop("__k")
    ratio = F.col("train_median") / F.col("score_median")
    return both.withColumns({"ratio": ratio, "aligned": (ratio >= 1 - tolerance) & (ratio <= 1 + tolerance)})


def execution_checks(entry_lag: int, exit_lag: int, n_days: int) -> list[Check]:
    sig, ent, ext = (F.col(f"{c}_calendar_index") for c in ("signal", "entry", "exit"))
    return [
        Check("entry_lag", (sig >= 0) & (ent - sig == entry_lag)),
        Check("exit_lag", ext - sig == exit_lag),
        Check("inside_calendar", (ent < n_days) & (ext < n_days)),
        Check("entry_after_signal", F.col("entry_date") > F.col("date")),
        Check("exit_not_before_entry", F.col("exit_date") >= F.col("entry_date")),
    ]


def ambiguous_dates(panel: DataFrame) -> DataFrame:
    """Signal dates mapped to more than one calendar position."""
    cols = ["date", "entry_date", "exit_date", "signal_calendar_index", "entry_calendar_index", "exit_calendar_index"]
    return duplicate_keys(panel.select(*cols).distinct(), ["date"])


def calendar_recheck(panel: DataFrame, calendar: DataFrame, entry_lag: int, exit_lag: int) -> DataFrame:
    """Compare the panel's date mapping with an independent calendar, per mismatch kind."""
    maps = panel.select("date", "entry_date", "exit_date", "signal_calendar_index").distinct()
    day = calendar.select("date", F.col("calendar_index").alias("__i"))
    out = maps.join(day, "date", "left")
    for leg, lag in (("entry", entry_lag), ("exit", exit_lag)):
        at = calendar.select((F.col("calendar_index") - lag).alias("__i"), F.col("date").alias(f"__{leg}"))
        out = out.join(at, "__i", "left")
    return out.agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.count_if(~F.col("__i").eqNullSafe(F.col("signal_calendar_index"))).alias("index_mismatch"),
        F.count_if(~F.col("__entry").eqNullSafe(F.col("entry_date"))).alias("entry_mismatch"),
        F.count_if(~F.col("__exit").eqNullSafe(F.col("exit_date"))).alias("exit_mismatch"),
    )


def atomic_checks() -> list[Check]:
    features = ("stock_spread_bps", "stock_depth_l5_log", "stock_ofi_l1")
    finite = [Check(f"finite_{c}", F.col(c).isNull() | is_finite(c)) for c in features]
    return [
        Check("key_present", F.col("date").isNotNull() & F.col("symbol").isNotNull()),
        Check("iso_date", is_iso_date("date")),
        Check("seconds_in_range", (F.col("book_valid_seconds") >= 0) & (F.col("observed_seconds") >= 0)),
        Check("ratio_in_range", F.col("book_valid_ratio").between(0, 1)),
        Check("event_counts", (F.col("n_events") >= 1) & (F.col("n_ofi_events") >= 0)),
        *finite,
    ]


def asof_feature_checks(features: Sequence[str], lags: dict[str, int]) -> list[Check]:
    """As-of rule per feature: lag 0 may equal the signal day, a positive lag must be earlier."""
    out = []
    for c in features:
        own = F.col(f"{c}__asof_date")
        out.append(Check(f"asof_{c}", own < F.col("date") if lags.get(c, 0) > 0 else own <= F.col("date")))
        out.append(Check(f"finite_{c}", is_finite(c)))
    return out


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and null count per column, from one scan."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(c).cast("double").alias(f"a{i}"), F.max(c).cast("double").alias(f"z{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max"), F.col(f"n{i}").alias("nulls"))
        for i, c in enumerate(columns)
    ])
    return df.agg(*aggs).select(F.inline(rows))


def table_profile(df: DataFrame, keys: Sequence[str], day: str, numeric: Sequence[str]) -> DataFrame:
    """Rows, unique keys, null keys, day span and non-finite cells of a keyed table."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi"),
        *[F.count_if(~is_finite(F.col(c).try_cast("double"))).alias(f"bad_{c}") for c in numeric],
    )
    missing = ~(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    return per_key.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_keys"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_key_rows"),
        F.min("lo").alias("date_min"), F.max("hi").alias("date_max"),
        *[F.sum(f"bad_{c}").alias(f"bad_{c}") for c in numeric],
    )


def same_columns(a: DataFrame, b: DataFrame, prefix: str = "emb_") -> list[str]:
    """Vector columns on which two tables differ in name, order or type; empty means compatible."""
    left = [(n, t) for n, t in a.dtypes if n.startswith(prefix)]
    right = [(n, t) for n, t in b.dtypes if n.startswith(prefix)]
    gaps = [n for i, (n, _) in enumerate(left) if n != f"{prefix}{i}"]
    return gaps or sorted({n for n, _ in set(left) ^ set(right)}) or ([] if left == right else [n for n, _ in left])


def vocab_checks(spark: SparkSession, fields: DataFrame) -> DataFrame:
    """Self-consistency of fitted bins: edges increase, one count per bin, counts sum up."""
    edges, occ = F.col("edges"), F.col("occupancy")
    steps = F.when(
        F.size(edges) > 1,
        F.forall(F.sequence(F.lit(1), F.greatest(F.size(edges) - 1, F.lit(1))), lambda i: F.get(edges, i) > F.get(edges, i - 1)),
    ).otherwise(True)
    total = F.aggregate(occ, F.lit(0).cast("long"), lambda a, x: a + x)
    return run_checks(fields, [
        Check("edges_increasing", steps),
        Check("one_count_per_bin", F.size(occ) == F.size(edges) + 1),
        Check("counts_sum_to_observed", total == F.col("n_observed")),
        Check("bins_within_request", F.size(occ) <= F.col("requested")),
    ])
