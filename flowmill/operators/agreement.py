"""Do tables agree? Amounts matched one to one within a tolerance, and key sets compared all at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions.scalars import all_of
from flowmill.session import staged

# --- one-to-one matching within a tolerance ------------------------------------


def before_cut(df: DataFrame, time: str, cut_time: int | None) -> DataFrame:
    """Rows earlier than ``cut_time``; a time that is null or no number is not earlier."""
    return df if cut_time is None else df.where(F.col(time).try_cast("long") < F.lit(cut_time))


def _amounts(df: DataFrame, keys: Sequence[str], value: str, out: str, n: str) -> DataFrame:
    """One row per key and distinct value, so that equal rows are never paired with each other."""
    amount = F.col(value)
    if dict(df.dtypes)[value] in ("float", "double"):
        amount = F.when(~F.isnan(amount), amount)
    return df.groupBy(*keys, amount.alias(out)).agg(F.count(F.lit(1)).alias(n))


def _joined(a: DataFrame, b: DataFrame, same: Mapping[str, str], how: str, extra: Column | None = None) -> DataFrame:
    """Join on columns that may be null; ``same`` names a column of ``a`` and its counterpart in ``b``."""
    on = all_of([F.col(x).eqNullSafe(F.col(y)) for x, y in same.items()])
    return a.join(b, on if extra is None else on & extra, how)


def match_within(real: DataFrame, simulated: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Rows of two tables matched one to one where the keys are equal and the values differ by at most ``tolerance``.

    The closest pair is matched first, then the closest of what is left, and so on; of equally close pairs the one with
    the smaller real value, then the smaller simulated value. Result: ``keys``, ``real_value``, ``sim_value``, ``n``
    (rows) and ``status``: matched, missing (only real) or extra (only simulated).

    Null keys equal each other; a null or NaN value only matches a null or NaN. Equal rows are counted, not paired, and
    what agrees exactly leaves first. The rest meets in bands twice as wide as the tolerance, where a value can reach
    into one neighbour at most. Two values that are each other's closest choose each other in one round; a round is one
    pass over the pairs that are left, and there is always such a pair.
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    keys = list(keys)
    mirror = {k: f"__{k}" for k in keys}
    a = _amounts(real, keys, value, "real_value", "nr")
    b = _amounts(simulated, keys, value, "sim_value", "ns").withColumnsRenamed(mirror)
    same = _joined(a, b, {**mirror, "real_value": "sim_value"}, "full")
    # A key is taken from the side that has the row; both sides may hold a null there.
    has_real = F.col("nr").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = staged(same.select(
        *[F.when(has_real, F.col(k)).otherwise(F.col(mirror[k])).alias(k) for k in keys], "real_value", "sim_value", zero("nr"), zero("ns"),
    ), "amounts")
    exact = F.least("nr", "ns")
    pairs = [counts.where(exact > 0).select(*keys, "real_value", "sim_value", exact.alias("n"))]
    left_real = counts.where("nr > ns").select(*keys, "real_value", (F.col("nr") - F.col("ns")).alias("nr"))
    left_sim = counts.where("ns > nr").select(*keys, "sim_value", (F.col("ns") - F.col("nr")).alias("ns"))

    if tolerance > 0:
        reach = tolerance * (1 + 1e-9)
        band = lambda c: F.floor(c / (2 * reach)).cast("long")
        x, y = F.col("real_value"), F.col("sim_value")
        near = left_real.where(x.isNotNull()).withColumn("__band", F.explode(F.sequence(band(x - reach), band(x + reach))))
        other = left_sim.where(y.isNotNull()).withColumn("__other", band(y)).withColumnsRenamed(mirror)
        distance = F.abs(x - y)
        edges = _joined(near, other, {**mirror, "__band": "__other"}, "inner", distance <= F.lit(tolerance))
        edges = staged(edges.select(*keys, "real_value", "sim_value", "nr", "ns", distance.alias("distance")), "edges")
        while not edges.isEmpty():
            edges, taken = _round(edges, keys)
            pairs.append(taken)

    matched = reduce(DataFrame.unionByName, pairs)
    return (
        matched.withColumn("status", F.lit("matched"))
        .unionByName(_rest(left_real, _beyond_exact(pairs), keys, "real_value", "nr", "missing"), allowMissingColumns=True)
        .unionByName(_rest(left_sim, _beyond_exact(pairs), keys, "sim_value", "ns", "extra"), allowMissingColumns=True)
    )


def _beyond_exact(pairs: Sequence[DataFrame]) -> DataFrame | None:
    """What the rounds matched beyond the exact agreement."""
    return reduce(DataFrame.unionByName, pairs[1:]) if len(pairs) > 1 else None


def _round(edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Match the pairs that are each other's closest; the pairs left with their remaining counts, and the matches."""
    by_real, by_sim = Window.partitionBy(*keys, "real_value"), Window.partitionBy(*keys, "sim_value")
    first = F.struct("distance", "real_value", "sim_value")
    chosen = edges.withColumn("__r", F.min(first).over(by_real)).withColumn("__s", F.min(first).over(by_sim))
    mutual = (F.col("__r") == first) & (F.col("__s") == first)
    chosen = chosen.withColumn("n", F.when(mutual, F.least("nr", "ns")).otherwise(0))
    used = {"nr": F.col("nr") - F.max("n").over(by_real), "ns": F.col("ns") - F.max("n").over(by_sim)}
    done = staged(chosen.withColumns(used).select(*edges.columns, "n").where("n > 0 or (nr > 0 and ns > 0)"), "round")
    return done.where("nr > 0 and ns > 0").drop("n"), done.where("n > 0").select(*keys, "real_value", "sim_value", "n")


def _rest(left: DataFrame, matched: DataFrame | None, keys: Sequence[str], value: str, n: str, status: str) -> DataFrame:
    rest = left.withColumnRenamed(n, "n")
    if matched is not None:
        rest = rest.unionByName(matched.select(*keys, value, (-F.col("n")).alias("n")))
        rest = rest.groupBy(*keys, value).agg(F.sum("n").alias("n")).where("n > 0")
    return rest.withColumn("status", F.lit(status))


# --- several key sets at once ---------------------------------------------------


def key_sources(sets: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """``keys`` with ``mask`` (bit i: the key occurs in the i-th set) and ``repeated`` (bit i: more than once there).

    One aggregate over the union of all sets, however many there are; copies collapse before the shuffle. Null keys
    equal each other.
    """
    if not 0 < len(sets) <= 62:
        raise ValueError("between one and 62 sets can be compared")
    keys = list(keys)
    rows = reduce(DataFrame.union, [df.select(*keys, F.lit(1 << i).cast("long").alias("__bit")) for i, df in enumerate(sets.values())])
    per_set = rows.groupBy(*keys, "__bit").agg(F.count(F.lit(1)).alias("__n"))
    return per_set.groupBy(*keys).agg(
        F.bit_or("__bit").alias("mask"), F.bit_or(F.when(F.col("__n") > 1, F.col("__bit")).otherwise(0)).alias("repeated"),
    )


class Rule:
    """A status for keys that occur in all of ``present`` and in none of ``absent``."""

    def __init__(self, status: str, present: Sequence[str] = (), absent: Sequence[str] = (), passes: bool = False):
        self.status, self.present, self.absent, self.passes = status, tuple(present), tuple(absent), passes

    def holds(self, names: Sequence[str], mask: Column) -> Column:
        bits = lambda wanted: sum(1 << names.index(w) for w in wanted)  # noqa: E731  an unknown name is an error
        return (mask.bitwiseAND(F.lit(bits(self.present))) == bits(self.present)) & (mask.bitwiseAND(F.lit(bits(self.absent))) == 0)


def key_agreement(sets: Mapping[str, DataFrame], keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Every combination of sets in which keys occur: ``mask``, ``present`` (their names), ``n_keys``, ``n_repeated``
    (keys that some set holds twice), ``status`` of the first rule that holds (else ``unruled``) and ``verdict``.

    A combination passes if its rule does and no set repeats one of its keys.
    """
    names = list(sets)
    mask = F.col("mask")
    status, passes = F.lit("unruled"), F.lit(False)
    for rule in reversed(rules):
        held = rule.holds(names, mask)
        status = F.when(held, rule.status).otherwise(status)
        passes = F.when(held, rule.passes).otherwise(passes)
    counts = key_sources(sets, keys).groupBy("mask").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("repeated") != 0).alias("n_repeated"))
    present = F.concat_ws(",", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(names)])
    return counts.select(
        "mask", present.alias("present"), "n_keys", "n_repeated", status.alias("status"),
        F.when(passes & (F.col("n_repeated") == 0), "pass").otherwise("fail").alias("verdict"),
    )


def exact_horizon(days: DataFrame, calendar: DataFrame, exit_lag: int, day: str = "date") -> DataFrame:
    """The given days whose exit day, ``exit_lag`` trading days later, is on the calendar; each once."""
    later = calendar.select((F.col("calendar_index") - exit_lag).alias("calendar_index"))
    return days.select(day).distinct().join(calendar.join(later, "calendar_index", "left_semi").select(day), day, "left_semi")


def period_preflight(
    embedded: DataFrame, universe: DataFrame, calendar: DataFrame, keys: Sequence[str], exit_lag: int, min_names: int, day: str = "date"
) -> DataFrame:
    """May this period be trained or scored? One row per check: ``check_id``, ``bad``, ``worst``, ``status``.

    ``repeated_keys``: keys that either side holds twice. ``lost_days``: embedded days without any embedded member of
    the universe. ``narrow_days``: days with fewer than ``min_names`` such members (``worst`` is the fewest).
    ``off_calendar``: days that are not trading days. ``cut_horizon``: trading days whose exit day lies behind the
    calendar. ``no_days``: 1 when nothing is embedded.
    """
    sources = key_sources({"embedded": embedded, "universe": universe}, keys)
    per_day = sources.groupBy(day).agg(
        F.count_if(F.col("repeated") != 0).alias("repeated"), F.count_if(F.col("mask") == 3).alias("kept"),
        F.count_if(F.col("mask").bitwiseAND(F.lit(1)) != 0).alias("embedded"),
    )
    listed = calendar.select(day, F.lit(True).alias("__listed"))
    whole = exact_horizon(calendar, calendar, exit_lag, day).withColumn("__whole", F.lit(True))
    days = per_day.join(listed, day, "left").join(whole, day, "left")
    signal = F.col("embedded") > 0
    n = lambda c: F.count_if(signal & c)
    kept = F.col("kept")
    no = lambda c: F.col(c).isNull()
    facts = days.agg(
        F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated_keys"), n(kept == 0).alias("lost_days"), n(kept < min_names).alias("narrow_days"),
        n(no("__listed")).alias("off_calendar"), n(~no("__listed") & no("__whole")).alias("cut_horizon"),
        F.when(F.count_if(signal) == 0, 1).otherwise(0).cast("long").alias("no_days"), F.min(F.when(signal, kept)).alias("__fewest"),
    )
    checks = ["repeated_keys", "lost_days", "narrow_days", "off_calendar", "cut_horizon", "no_days"]
    rows = F.array(*[
        F.struct(F.lit(c).alias("check_id"), F.col(c).alias("bad"), (F.col("__fewest") if c == "narrow_days" else F.lit(None).cast("long")).alias("worst"))
        for c in checks
    ])
    return facts.select(F.inline(rows)).withColumn("status", F.when(F.col("bad") > 0, "fail").otherwise("pass"))
