"""As-of, calendar, coverage and reconciliation joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions.scalars import all_of, any_of, is_finite, zero_fill
from flowmill.operators import blocks as B


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; partial counts collapse copies."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def normalise_keys(df: DataFrame) -> DataFrame:
    """String date and zero-filled symbol; a null key fails the job."""
    def strict(c: Column, name: str) -> Column:
        return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"null key {name}")).cast("string")).alias(name)

    rest = [c for c in df.columns if c not in ("date", "symbol")]
    return df.select(
        strict(F.col("date").cast("string"), "date"), strict(zero_fill("symbol"), "symbol"), *rest
    )


def as_of(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    strict: bool = True,
    matched_time: str = "matched_time",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row (strictly before by default).

    ``right`` has one row per key and time: null keys or times fail the job, and so do repeated ones
    unless ``tie`` names the columns whose greatest values decide.

    Both sides go through one union ordered by time; the side rank decides ties and
    with them the strictness. The carried value crosses blocks, so a key of any size
    is spread over many tasks.
    """
    by = list(by)
    query_rank, history_rank = (0, 1) if strict else (1, 0)
    payload = [c for c in left.columns if c not in by]
    history = F.struct(*[F.col(v) for v in values], F.col(right_time).alias(matched_time))
    q = left.select(
        *by, F.col(left_time).alias("__t"), F.lit(query_rank).alias("__side"),
        F.struct(*payload).alias("__left"),
    )
    at = F.col(right_time)
    chosen = F.max_by(history, F.struct(*[F.col(c) for c in tie])) if tie else F.first(history)
    h = right.groupBy(*by, at.alias("__t")).agg(chosen.alias("__right"), F.count(F.lit(1)).alias("__n"))
    refused = F.when(any_of([F.col(c).isNull() for c in (*by, "__t")]), F.lit("null key or time in the history"))
    if not tie:
        refused = refused.when(F.col("__n") > 1, F.lit("repeated key and time in the history"))
    sound = F.when(refused.isNull(), F.col("__right")).otherwise(F.raise_error(refused))
    h = h.select(*by, "__t", F.lit(history_rank).alias("__side"), sound.alias("__right"))
    both = q.unionByName(h, allowMissingColumns=True)
    both = B.running(both, by, ["__t", "__side"], {"__hit": B.latest(F.col("__right"))})
    hits = both.where(F.col("__side") == query_rank)
    return hits.select(*by, "__left.*", *[F.col("__hit")[v].alias(v) for v in (*values, matched_time)])


def as_of_audit(joined: DataFrame, prediction: str, effective: str) -> DataFrame:
    """Rows matched, rows whose effective time is not strictly earlier, latest effective time."""
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(effective).alias("n_matched"),
        F.count_if(F.col(effective) >= F.col(prediction)).alias("n_leaks"),
        F.max(effective).alias("max_effective"),
    )


# --- calendar joins -----------------------------------------------------------


@dataclass(frozen=True)
class ReturnSpec:
    name: str
    entry_lag: int
    exit_lag: int
    entry_price: str
    exit_price: str

    def __post_init__(self) -> None:
        if self.entry_lag < 0 or self.exit_lag < self.entry_lag:
            raise ValueError("exit lag must not precede the entry lag")
        if self.entry_lag == self.exit_lag and self.entry_price == self.exit_price:
            raise ValueError("a same-day return needs two different prices")


# The published return definitions.
RETURN_SPECS = {
    s.name: s
    for s in (
        ReturnSpec("close_t_close_t1", 0, 1, "close", "close"),
        ReturnSpec("vwap_t_vwap_t1", 0, 1, "vwap", "vwap"),
        ReturnSpec("open_t1_close_t1", 1, 1, "open", "close"),
        ReturnSpec("vwap_t1_vwap_t2", 1, 2, "vwap", "vwap"),
    )
}


def forward_return(daily: DataFrame, calendar: DataFrame, price: str = "vwap") -> DataFrame:
    """Return to the next *calendar* day of the same instrument; null when it did not trade then."""
    ahead = calendar.select(
        F.col("date"), F.lead("date").over(Window.orderBy("calendar_index")).alias("next_date")
    )
    later = daily.select("symbol", F.col("date").alias("next_date"), F.col(price).alias("__next"))
    out = daily.join(ahead, "date", "left").join(later, ["symbol", "next_date"], "left")
    ret = F.when(F.col("__next").isNotNull() & (F.col(price) > 0), F.col("__next") / F.col(price) - 1.0)
    return out.withColumn("fwd_ret", ret).drop("__next")


def calendar_shift(calendar: DataFrame, lag: int, date_as: str, index_as: str) -> DataFrame:
    """``calendar_index`` of a signal day to the day ``lag`` trading days later."""
    return calendar.select(
        (F.col("calendar_index") - lag).alias("signal_calendar_index"),
        F.col("date").alias(date_as), F.col("calendar_index").alias(index_as),
    )


def execution_panel(daily: DataFrame, calendar: DataFrame, spec: ReturnSpec) -> DataFrame:
    """Signal rows with entry and exit days, fillability, contract columns and the return."""
    sig = daily.select(
        "date", "symbol", "market",
        *[F.col(f).alias(f"{f}_at_signal") for f in ("is_st", "is_new", "is_halt", "limit_locked")],
    )
    blocked = [F.coalesce(F.col(f"{f}_at_signal"), F.lit(True)) for f in ("is_st", "is_new", "is_halt")]
    sig = sig.withColumn("eligible_at_signal", ~(blocked[0] | blocked[1] | blocked[2]))
    days = calendar.withColumnRenamed("calendar_index", "signal_calendar_index")
    out = sig.join(days, "date", "inner")
    for leg, lag, price in (("entry", spec.entry_lag, spec.entry_price), ("exit", spec.exit_lag, spec.exit_price)):
        shifted = calendar_shift(calendar, lag, f"{leg}_date", f"{leg}_calendar_index")
        quotes = daily.select(
            F.col("date").alias(f"{leg}_date"), "symbol", F.col(price).cast("double").alias(f"{leg}_px"),
            F.col("is_halt").alias("__halt"), F.col("limit_locked").alias("__lock"),
        )
        px = F.col(f"{leg}_px")
        free = ~F.coalesce(F.col("__halt"), F.lit(True)) & ~F.coalesce(F.col("__lock"), F.lit(True))
        out = (
            out.join(shifted, "signal_calendar_index", "left")
            .join(quotes, ["symbol", f"{leg}_date"], "left")
            .withColumn(f"{leg}_fillable", F.coalesce((px > 0) & free, F.lit(False)))
            .drop("__halt", "__lock")
        )
    ret = F.when(
        F.col("entry_px").isNotNull() & F.col("exit_px").isNotNull() & (F.col("entry_px") > 0),
        F.col("exit_px") / F.col("entry_px") - 1.0,
    )
    return out.withColumns({
        "return_spec": F.lit(spec.name),
        "entry_day_lag": F.lit(spec.entry_lag),
        "exit_day_lag": F.lit(spec.exit_lag),
        "entry_price_field": F.lit(spec.entry_price),
        "exit_price_field": F.lit(spec.exit_price),
        "signal_availability": F.lit("after_close"),
        "fwd_ret": ret,
    })


# --- coverage -----------------------------------------------------------------


def _key_sides(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key of two sets once, with ``__a`` and ``__b`` for the sets that hold it.

    One grouping of both sets: nothing is sorted, and a row is only its key and two flags. Tasks are dealt by the number
    of input splits, as the size of a shuffle says little of packed keys: a task's memory does not grow with the input.
    A key with a null matches nothing on the other side, so it is grouped by side.
    """
    side = lambda df, own: df.select(*keys, F.lit(own).alias("__a"), F.lit(not own).alias("__b"))
    whole = F.when(all_of([F.col(k).isNotNull() for k in keys]), F.lit(None)).otherwise(F.col("__a"))
    both = side(a, True).unionByName(side(b, False)).withColumn("__own", whole)
    both = both.repartition(4 * max(1, both.rdd.getNumPartitions()), *keys)
    return both.groupBy(*keys, "__own").agg(F.bool_or("__a").alias("__a"), F.bool_or("__b").alias("__b")).drop("__own")


def daily_coverage(expected: DataFrame, actual: DataFrame, keys: Sequence[str], day: str = "date") -> DataFrame:
    """Expected, matched, missing and extra keys per day, from one grouping of both key sets."""
    e, x = F.col("__a"), F.col("__b")
    return _key_sides(expected, actual, keys).groupBy(day).agg(
        F.count_if(e).alias("expected_rows"),
        F.count_if(e & x).alias("matched_rows"),
        F.count_if(e & ~x).alias("missing_rows"),
        F.count_if(~e & x).alias("extra_rows"),
        F.coalesce(F.count_if(e & x) / F.nullif(F.count_if(e), F.lit(0)), F.lit(0.0)).alias("coverage"),
    )


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key counts of two sets and of their intersection."""
    return _key_sides(a, b, keys).agg(
        F.count_if("__a").alias("n_left"), F.count_if("__b").alias("n_right"), F.count_if(F.col("__a") & F.col("__b")).alias("n_common"),
    )


def attach_complete(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that fails when any key finds no (complete) match."""
    out = left.join(right.select(*keys, *columns), list(keys), "left")
    whole = all_of([F.col(c).isNotNull() for c in columns])
    first = columns[0]
    kind = dict(out.dtypes)[first]
    checked = F.when(whole, F.col(first)).otherwise(
        F.raise_error(F.concat(F.lit("no match for key "), F.concat_ws("|", *keys))).cast(kind)
    )
    return out.withColumn(first, checked)


# --- reconciliation -----------------------------------------------------------


def _flagged(real: DataFrame, simulated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each real row with the number of simulated rows of the same key (0 = missing).

    Counting instead of pairing keeps a repeated key from multiplying rows.
    """
    counts = simulated.groupBy(*keys).agg(F.count(F.lit(1)).alias("__sim"))
    return real.join(counts, list(keys), "left").withColumn("__sim", F.coalesce(F.col("__sim"), F.lit(0)))


def reconcile_trades(
    real: DataFrame, simulated: DataFrame, keys: Sequence[str], serial: str = "serial", time: str = "int_time"
) -> DataFrame:
    """Missing and extra trades, the first mismatch and the matches before it, as one row."""
    keys = list(keys)
    flagged = _flagged(real, simulated, keys)
    missing = F.col("__sim") == 0
    gaps = flagged.agg(
        F.count(F.lit(1)).alias("n_real"),
        F.count_if(missing).alias("n_missing"),
        F.min(F.when(missing, F.struct(F.col(serial), F.col(time)))).alias("__first"),
    )
    extra = simulated.join(real.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("n_extra"))
    total = simulated.agg(F.count(F.lit(1)).alias("n_sim"))
    # One row each; the constant key joins them without a cross join.
    one = lambda df: df.withColumn("__k", F.lit(1))
    summary = one(gaps).join(one(extra), "__k").join(one(total), "__k")
    bound = one(flagged.where(~missing).select(F.col(serial).alias("__s"), "__sim")).join(
        F.broadcast(one(gaps).select("__k", F.col("__first")[serial].alias("__fs"))), "__k"
    )
    before = one(bound.agg(
        F.coalesce(F.sum(F.when(F.col("__s") < F.col("__fs"), F.col("__sim"))), F.lit(0)).alias("n_matched_before")
    ))
    kind = F.when(F.col("n_missing") > 0, "missing").when(F.col("n_extra") > 0, "extra").otherwise("none")
    return summary.join(before, "__k").select(
        "n_real", "n_sim", "n_missing", "n_extra", kind.alias("first_kind"),
        F.col("__first")[serial].alias("first_serial"), F.col("__first")[time].alias("first_time"),
        "n_matched_before",
    )


def mismatch_buckets(
    real: DataFrame, simulated: DataFrame, keys: Sequence[str], time: str = "int_time",
    sim_time: str = "trade_time", bucket_seconds: int = 60,
) -> DataFrame:
    """Real, missing and extra trades per time bucket of the day."""
    keys = list(keys)

    def bucket(c: str) -> Column:
        hms = F.floor(F.col(c) / 1000).cast("long")
        sec = F.floor(hms / 10000) * 3600 + F.floor(hms % 10000 / 100) * 60 + hms % 100
        start = (F.floor(sec / bucket_seconds) * bucket_seconds).cast("long")
        parts = (F.floor(start / 3600), F.floor(start % 3600 / 60), start % 60)
        return F.concat_ws(":", *[F.lpad(p.cast("long").cast("string"), 2, "0") for p in parts])

    flagged = _flagged(real, simulated, keys).select(
        bucket(time).alias("time_bucket"), F.col("__sim").alias("n_matched"),
        F.when(F.col("__sim") == 0, 1).otherwise(0).alias("n_missing"), F.lit(0).alias("n_extra"),
    )
    extra = simulated.join(real.select(*keys).distinct(), keys, "left_anti").select(
        bucket(sim_time).alias("time_bucket"), F.lit(0).alias("n_matched"), F.lit(0).alias("n_missing"),
        F.lit(1).alias("n_extra"),
    )
    return flagged.unionByName(extra).groupBy("time_bucket").agg(
        F.sum(F.col("n_matched") + F.col("n_missing")).alias("n_real"),
        F.sum("n_missing").cast("long").alias("n_missing"), F.sum("n_extra").cast("long").alias("n_extra"),
    )


def multiset_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strict comparison: rows whose multiplicity differs between the two tables."""
    columns = list(columns)
    count = F.count(F.lit(1))
    left = a.groupBy(*columns).agg(count.alias("n_left"))
    right = b.groupBy(*columns).agg(count.alias("n_right"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = left.join(right, columns, "full_outer").select(*columns, zero("n_left"), zero("n_right"))
    return both.where(F.col("n_left") != F.col("n_right"))


def reconcile_cancels(real: DataFrame, recorded: DataFrame) -> DataFrame:
    """Cancels per ``(order_id, cancel_time)``: both, only real, only recorded."""
    keys = ["order_id", "cancel_time"]
    a = real.select(*keys).dropna().distinct().withColumn("__r", F.lit(1))
    b = recorded.select(*keys).dropna().distinct().withColumn("__c", F.lit(1))
    status = F.when(F.col("__c").isNull(), "missing").when(F.col("__r").isNull(), "extra").otherwise("matched")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def cancel_time_mismatch(real: DataFrame, recorded: DataFrame) -> DataFrame:
    """Orders known to both sides whose cancel times differ, with the number of unequal time pairs.

    The pair count follows from the two set sizes and the size of their intersection,
    so no pair is formed.
    """
    by_order = reconcile_cancels(real, recorded).groupBy("order_id").agg(
        F.count_if(F.col("status") != "extra").alias("n_real"),
        F.count_if(F.col("status") != "missing").alias("n_recorded"),
        F.count_if(F.col("status") == "matched").alias("__same"),
        F.min(F.when(F.col("status") != "extra", F.col("cancel_time"))).alias("first_real"),
        F.min(F.when(F.col("status") != "missing", F.col("cancel_time"))).alias("first_recorded"),
    )
    pairs = F.col("n_real") * F.col("n_recorded") - F.col("__same")
    return by_order.withColumn("n_pairs", pairs).where(F.col("n_pairs") > 0).drop("__same")


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(all_of([is_finite(c) for c in columns]))
