"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here each key
is cut into *blocks* along its ordering column: running values are computed per
``(key, block)``, one summary row per ``(key, block)`` is carried across blocks,
and the two are joined. Block boundaries are global quantiles of the ordering
column, so no ``(key, block)`` holds more than about ``1/blocks`` of all rows, no
matter how the rows are spread over keys. Boundaries only steer the layout: the
results do not depend on them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "__block"
ROWS_PER_BLOCK = 1_000_000
_MAX_BLOCKS = 4096


def block_count(df: DataFrame, blocks: int | None = None) -> int:
    if blocks is None:
        blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(blocks, _MAX_BLOCKS))


def _bucket(df: DataFrame, column: str, points: list[float], out: str) -> DataFrame:
    if not points:
        return df.withColumn(out, F.lit(0.0))
    edges = [float("-inf"), *points, float("inf")]
    return Bucketizer(splits=edges, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)


def add_blocks(
    df: DataFrame, order: Sequence[str], blocks: int | None = None, width: int | None = None
) -> DataFrame:
    """Add the block id, a non-decreasing function of the ordering columns.

    For a dense position per key (row index, event ordinal) pass ``width``: blocks of
    that many rows need no pass over the data. Otherwise boundaries are quantiles.

    The first ordering column must be numeric or a timestamp and free of nulls. A
    value so frequent that it fills whole blocks by itself is cut further along
    the second ordering column when that one is numeric too.
    """
    lead = order[0]
    if width is not None:
        return df.withColumn(BLOCK, F.floor(F.col(lead) / width).cast("long"))
    n = block_count(df, blocks)
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in _NUMERIC}
    tie = order[1] if len(order) > 1 and order[1] in numeric else None
    names = [lead] + ([tie] if tie else [])
    work = df.withColumns({f"__o{i}": _as_double(df, c) for i, c in enumerate(names)})
    probs = [i / n for i in range(1, n)]
    cuts = work.approxQuantile([f"__o{i}" for i in range(len(names))], probs, 1.0 / (4 * n)) if probs else []
    first = sorted(set(cuts[0])) if cuts else []
    work = _bucket(work, "__o0", first, "__b0")
    block = F.col("__b0").cast("long")
    heavy = [v for v, k in Counter(cuts[0]).items() if k > 1] if cuts else []
    if tie and heavy:
        second = sorted(set(cuts[1]))
        work = _bucket(work, "__o1", second, "__b1")
        width = len(second) + 2
        # A heavy value is the lower edge of its bucket, so its slices come first.
        inner = F.when(F.col("__o0").isin(*heavy), F.col("__b1").cast("long")).otherwise(F.lit(width - 1))
        block = block * width + inner
    return work.withColumn(BLOCK, block).drop("__o0", "__o1", "__b0", "__b1")


_NUMERIC = {"byte", "short", "integer", "long", "float", "double", "decimal", "timestamp", "timestamp_ntz", "date"}


def _as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    c = F.col(name)
    return (c.cast("timestamp") if kind in ("timestamp_ntz", "date") else c).cast("double")


@dataclass(frozen=True)
class Running:
    kind: str
    expr: Column | None = None


def number() -> Running:
    """Row number from 1."""
    return Running("number")


def total(expr: Column) -> Running:
    """Running sum including the current row."""
    return Running("total", expr)


def highest(expr: Column) -> Running:
    """Running maximum including the current row."""
    return Running("highest", expr)


def latest(expr: Column) -> Running:
    """Last non-null value up to and including the current row."""
    return Running("latest", expr)


def earlier(expr: Column) -> Running:
    """Last non-null value before the current row."""
    return Running("earlier", expr)


def previous(expr: Column) -> Running:
    """Value on the preceding row, null on the first."""
    return Running("previous", expr)


def following(expr: Column) -> Running:
    """Value on the next row, null on the last."""
    return Running("following", expr)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, Running],
    blocks: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """Add running columns per key without ever holding a whole key in one task."""
    keys, order = list(keys), list(order)
    work = df if BLOCK in df.columns else add_blocks(df, order, blocks, width)
    group = [*keys, BLOCK]
    inside = Window.partitionBy(*group).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(BLOCK) if keys else Window.orderBy(BLOCK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[F.col(c) for c in order])

    local: dict[str, Column] = {}
    summary: list[Column] = []
    carry: dict[str, Column] = {}
    final: dict[str, Column] = {}
    for i, (name, spec) in enumerate(specs.items()):
        loc, tot, car = f"__l{i}", f"__t{i}", f"__c{i}"
        e = spec.expr
        if spec.kind == "number":
            local[loc] = F.row_number().over(inside).cast("long")
            summary.append(F.count(F.lit(1)).alias(tot))
            carry[car] = F.sum(tot).over(before)
            final[name] = F.col(loc) + F.coalesce(F.col(car), F.lit(0).cast("long"))
        elif spec.kind == "total":
            local[loc] = F.sum(e).over(upto)
            summary.append(F.sum(e).alias(tot))
            carry[car] = F.sum(tot).over(before)
            final[name] = F.coalesce(F.col(loc) + F.col(car), F.col(loc), F.col(car))
        elif spec.kind == "highest":
            local[loc] = F.max(e).over(upto)
            summary.append(F.max(e).alias(tot))
            carry[car] = F.max(tot).over(before)
            final[name] = F.greatest(F.col(loc), F.col(car))
        elif spec.kind in ("latest", "earlier"):
            seen = upto if spec.kind == "latest" else inside.rowsBetween(Window.unboundedPreceding, -1)
            local[loc] = F.last(e, ignorenulls=True).over(seen)
            summary.append(F.max(F.when(e.isNotNull(), F.struct(at.alias("at"), e.alias("v")))).alias(tot))
            carry[car] = F.last(tot, ignorenulls=True).over(before)
            final[name] = F.coalesce(F.col(loc), F.col(car)["v"])
        elif spec.kind in ("previous", "following"):
            step = F.lag if spec.kind == "previous" else F.lead
            pick = F.max if spec.kind == "previous" else F.min
            # The wrapping struct tells "no such row in this block" from a null value.
            local[loc] = step(F.struct(e.alias("v")), 1).over(inside)
            summary.append(pick(F.struct(at.alias("at"), e.alias("v"))).alias(tot))
            carry[car] = step(F.col(tot), 1).over(across)
            final[name] = F.when(F.col(loc).isNotNull(), F.col(loc)["v"]).otherwise(F.col(car)["v"])
        else:
            raise ValueError(f"unknown running kind {spec.kind!r}")

    carried = (
        work.groupBy(*group).agg(*summary).withColumns(carry).select(*group, *carry)
    )
    out = work.withColumns(local).join(carried, group, "left")
    return out.withColumns(final).drop(*local, *carry, BLOCK)


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None
) -> DataFrame:
    """One row per distinct ``(keys, value)``: ``lo`` rows lie below it, ``ties`` equal it,
    ``n`` is the size of the group. Ties collapse before the shuffle."""
    keys = list(keys)
    work = add_blocks(df.select(*keys, value), [value], blocks)
    counts = work.groupBy(*keys, value, BLOCK).agg(F.count(F.lit(1)).alias("ties"))
    counts = running(counts, keys, [value], {"__upto": total(F.col("ties"))})
    if keys:
        out = counts.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "inner")
    else:
        out = counts.withColumn("n", F.lit(df.count()))
    return out.select(*keys, value, (F.col("__upto") - F.col("ties")).alias("lo"), "ties", "n")


def ranks_of_counts(counts: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """``value_ranks`` of a table that holds each distinct ``(keys, value)`` once with its number of rows ``ties``.

    ``counts`` is read several times: write it first.
    """
    keys = list(keys)
    upto = running(counts.select(*keys, value, "ties"), keys, [value], {"__upto": total(F.col("ties"))}, blocks)
    sizes = counts.groupBy(*keys).agg(F.sum("ties").alias("n"))
    return upto.join(sizes, keys, "inner").select(*keys, value, (F.col("__upto") - F.col("ties")).alias("lo"), "ties", "n")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, size: str | None = None) -> DataFrame:
    """Add the 1-based average rank of ``value`` inside its group (ties share the mean)."""
    ranks = value_ranks(df, keys, value).select(
        *keys, value,
        (F.col("lo") + (F.col("ties") + 1) / 2.0).alias(out),
        *([F.col("n").alias(size)] if size else []),
    )
    return df.join(ranks, [*keys, value], "inner")


def ordinal_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, size: str | None = None
) -> DataFrame:
    """Add the 1-based row number by ``order``; ``order[0]`` must be numeric and non-null."""
    ranked = running(df, keys, order, {out: number()})
    if size:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
        ranked = ranked.join(sizes, list(keys), "inner")
    return ranked


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], method: str = "linear"
) -> DataFrame:
    """Exact quantiles per group as rows ``(keys, p_index, p, quantile)``.

    ``linear`` interpolates between order statistics, ``nearest`` takes the order
    statistic at ``round((n - 1) * p)``. Works on ranks of distinct values, so a
    group is never collected.
    """
    return quantiles_of(value_ranks(df, list(keys), value), keys, value, probs, method)


def quantiles_of(
    ranks: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], method: str = "linear"
) -> DataFrame:
    """Quantiles from an existing result of ``value_ranks``."""
    ends = order_statistics(ranks, keys, value, probs, method)
    quantile = F.col("low")
    if method == "linear":
        quantile = F.col("low") + (F.col("high") - F.col("low")) * F.col("frac")
    return ends.select(*keys, "p_index", "p", quantile.cast("double").alias("quantile"))


def order_statistics(
    ranks: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], method: str = "linear"
) -> DataFrame:
    """The two values a quantile lies between, as rows ``(keys, p_index, p, frac, low, high)``.

    A monotone change of the values (clipping) changes ``low`` and ``high`` alike, so the quantiles of changed
    values need no second ranking.
    """
    keys = list(keys)
    wanted = F.array(*[
        F.struct(F.lit(i).alias("p_index"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)
    ])
    pos = lambda s: s["p"] * (F.col("n") - 1)
    lower = (lambda s: F.floor(pos(s))) if method == "linear" else (lambda s: F.rint(pos(s)).cast("long"))
    upper = (lambda s: F.ceil(pos(s))) if method == "linear" else lower
    inside = lambda k: (k >= F.col("lo")) & (k < F.col("lo") + F.col("ties"))
    # Few rows hold a wanted position: a binary search over the probabilities finds the
    # candidates, and only those are compared exactly.
    span = F.greatest(F.col("n") - 1, F.lit(1))
    ranks = ranks.withColumns({"__a": (F.col("lo") - 1.5) / span, "__b": (F.col("lo") + F.col("ties") + 0.5) / span})
    cuts = [float("-inf"), *sorted({float(p) for p in probs}), float("inf")]
    ranks = Bucketizer(
        splitsArray=[cuts, cuts], inputCols=["__a", "__b"], outputCols=["__ia", "__ib"], handleInvalid="keep"
    ).transform(ranks).where(F.col("__ib") > F.col("__ia"))
    hits = ranks.withColumn("__p", F.explode(F.filter(wanted, lambda s: inside(lower(s)) | inside(upper(s)))))
    s = F.col("__p")
    return hits.groupBy(*keys, s["p_index"].alias("p_index")).agg(
        F.first(s["p"]).alias("p"),
        F.first(pos(s) - F.floor(pos(s))).alias("frac"),
        F.max(F.when(inside(lower(s)), F.col(value))).alias("low"),
        F.max(F.when(inside(upper(s)), F.col(value))).alias("high"),
    )


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Join group aggregates back; partial aggregation first, no whole-group window."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return df.join(stats, keys, "inner")
