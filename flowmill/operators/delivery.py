"""Scores delivered with a manifest, and a delivery verified against it before it is used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from flowmill.functions.scalars import is_finite
from flowmill.operators.gates import report
from flowmill.sources import inventory

CHECKS = ("rows", "days", "range", "keys", "content", "duplicate_key", "not_finite")


_HALF = 30  # a lane has two halves of so many bits, whose sums over a group of rows are longs


def _halves(name: str, lane: Column) -> dict[str, Column]:
    return {f"{name}h": F.shiftright(lane, _HALF), f"{name}l": lane.bitwiseAND(F.lit((1 << _HALF) - 1))}


def _digest(n: Column, sums: Sequence[Column]) -> Column:
    """SHA-256 of the number of rows and the exact sums of the halves."""
    wide = [F.coalesce(F.sum(s.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for s in sums]
    return F.sha2(F.concat_ws("|", F.coalesce(F.sum(n), F.lit(0)).cast("string"), *wide), 256)


def _lanes(prefix: str, told: Sequence[Column]) -> dict[str, Column]:
    """Halves of seeded hashes of columns, null told from every value."""
    parts = [x for c in told for x in (c.isNull(), c)]
    lanes = [F.shiftrightunsigned(F.xxhash64(F.lit(i), *parts), 64 - 2 * _HALF) for i in range(inventory.LANES)]
    return {k: x for i, lane in enumerate(lanes) for k, x in _halves(f"{prefix}{i}", lane).items()}


def _contents(rows: DataFrame, copy: str, names: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """By copy: rows, days, ends, values that are not finite, and the digests of all keys and of all rows from seeded hashes.

    A row is hashed once and counts for each copy as often as it is there.
    """
    day, told = keys[0], [F.col(k) for k in keys]
    of_keys, of_rows = _lanes("__k", told), _lanes("__c", [*told, F.col(value).cast("string")])
    odd = ~F.coalesce(is_finite(value), F.lit(False))
    laned = rows.select(day, value, odd.alias("__odd"), *[f"__n{i}" for i in range(len(names))], *[x.alias(k) for k, x in (of_keys | of_rows).items()])
    aggs = []
    for i in range(len(names)):
        n, there = F.col(f"__n{i}"), F.when(F.col(f"__n{i}") > 0, F.col(value))
        aggs += [
            F.sum(n).alias(f"n{i}"), F.min(there).alias(f"least{i}"), F.max(there).alias(f"most{i}"), F.sum(F.when(F.col("__odd"), n).otherwise(0)).alias(f"odd{i}"),
            *[F.sum(F.col(k) * n).alias(f"{k}_{i}") for k in (*of_keys, *of_rows)],
        ]
    days = laned.groupBy(day).agg(*aggs)
    cells = []
    for i, name in enumerate(names):
        n, own = F.col(f"n{i}"), F.when(F.col(f"n{i}") > 0, F.col(day))
        whole = lambda of: _digest(n, [F.col(f"{k}_{i}") for k in of])  # noqa: B023, E731  used at once
        cells.append(F.struct(
            F.lit(name).alias(copy), F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"), F.count(own).alias("n_days"), F.min(own).alias("day_min"), F.max(own).alias("day_max"),
            F.min(f"least{i}").alias("value_min"), F.max(f"most{i}").alias("value_max"), F.coalesce(F.sum(f"odd{i}"), F.lit(0)).alias("not_finite"),
            whole(of_keys).alias("keys_sha256"), whole(of_rows).alias("content_sha256"),
        ))
    return days.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _repeated(rows: DataFrame, copy: str, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """By copy: rows whose key is there more than once.

    One group a key for all copies; tasks go with the input's splits, so that their memory does not grow with it.
    """
    times = [f"__n{i}" for i in range(len(names))]
    dealt = rows.select(*keys, *times).repartition(16 * max(1, rows.rdd.getNumPartitions()), *keys)
    grouped = dealt.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in times])
    sums = grouped.agg(*[F.coalesce(F.sum(F.when(F.col(n) > 1, F.col(n))), F.lit(0)).alias(n) for n in times])
    cells = [F.struct(F.lit(name).alias(copy), F.col(n).alias("duplicate_key")) for name, n in zip(names, times, strict=True)]
    return sums.select(F.inline(F.array(*cells)))


def facts(rows: DataFrame, copy: str, names: Sequence[str], keys: Sequence[str] = ("date", "symbol"), value: str = "score") -> DataFrame:
    """One row for each copy in ``names``, also without rows; ``keys[0]`` is the day.

    Column ``copy`` names the copy of a row, or is a struct that has for each of ``names`` how often the row is in that
    copy. The digests are sums over all rows: their order does not matter, a repeated row counts each time.
    """
    told = isinstance(rows.schema[copy].dataType, StructType)
    often = [F.coalesce(F.col(copy)[n].cast("long"), F.lit(0)) if told else F.coalesce((F.col(copy) == n).cast("long"), F.lit(0)) for n in names]
    rows = rows.select(*keys, value, *[n.cast("long").alias(f"__n{i}") for i, n in enumerate(often)])
    return F.broadcast(_repeated(rows, copy, names, keys)).join(_contents(rows, copy, names, keys, value), copy)


def deliver(scores: DataFrame, path: str, keys: Sequence[str] = ("date", "symbol"), value: str = "score") -> None:
    """Write ``keys`` and ``value``, then the manifest taken from the written rows; a delivery counts once it has one."""
    scores.select(*keys, value).write.option("compression", "zstd").parquet(f"{path}/scores")
    written = scores.sparkSession.read.parquet(f"{path}/scores").withColumn("__copy", F.lit(""))
    facts(written, "__copy", [""], keys, value).drop("__copy", "duplicate_key", "not_finite").coalesce(1).write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        raise ValueError(f"{path} has no manifest") from e


def verify(spark: SparkSession, path: str, keys: Sequence[str] = ("date", "symbol"), value: str = "score", rows: DataFrame | None = None) -> DataFrame:
    """Report of a delivered table (``rows``, or those below ``path``) against the manifest below ``path``; see ``verify_copies``."""
    if rows is None:
        _manifest(spark, path)
        rows = spark.read.parquet(f"{path}/scores")
    return verify_copies(spark, path, rows.withColumn("__copy", F.lit("")), "__copy", [""], keys, value).drop("__copy")


def verify_copies(
    spark: SparkSession, path: str, rows: DataFrame, copy: str, names: Sequence[str], keys: Sequence[str] = ("date", "symbol"), value: str = "score"
) -> DataFrame:
    """Reports of the copies ``names`` of a delivery, in column ``copy`` of ``rows`` (see ``facts``), against the manifest below ``path``.

    ``rows`` and ``days`` count how many more or fewer there are; ``range`` the ends of day and value that moved;
    ``keys`` and ``content`` are 1 where the digest is another one; ``duplicate_key`` and ``not_finite`` count rows.
    A copy without rows is reported too. All copies are read in two scans.
    """
    said = _manifest(spark, path)
    both = facts(rows, copy, names, keys, value).join(F.broadcast(said.select([F.col(c).alias(f"said_{c}") for c in said.columns])), F.lit(True))
    ends = ("day_min", "day_max", "value_min", "value_max")
    off = lambda c: (~F.col(c).eqNullSafe(F.col(f"said_{c}"))).cast("long")
    compared = both.select(
        copy, F.abs(F.col("n_rows") - F.col("said_n_rows")).alias("rows"), F.abs(F.col("n_days") - F.col("said_n_days")).alias("days"),
        sum((off(c) for c in ends[1:]), off(ends[0])).alias("range"), off("keys_sha256").alias("keys"), off("content_sha256").alias("content"),
        "duplicate_key", "not_finite",
    )
    return report(compared, CHECKS, [copy])
