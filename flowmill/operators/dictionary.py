"""Category dictionaries as tables: dense ids for any number of values, grown without renumbering, encoded by join."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowmill.session import staged
from flowmill.streaming.store import StateTable

FREQUENT, LONGEST = 1 << 16, 256  # values that every task holds when rows are encoded, and their most characters


def numbered(values: DataFrame, column: str, out: str, start: int = 0) -> DataFrame:
    """Dense ids from ``start`` in ascending order of ``column``, whose values are distinct and not null.

    In two phases: the values are written sorted, so each file holds a range, in order of the files' names; a row's
    number is the sum of the sizes of the files before plus its place in its own. The written files fix the ranges, so
    a repeated task numbers as the first one did. One task sees one file, or one row per file.
    """
    table = staged(values.orderBy(column), "sorted")
    placed = table.withColumn("__file", F.col("_metadata.file_name"))
    sizes = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"), F.min(column).alias("__first"))
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__file").orderBy(column))
    return placed.join(F.broadcast(offsets), "__file").select(*values.columns, (F.col("__before") + place - 1 + start).alias(out))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value`` (string) and ``n`` of the values that are not null."""
    value = F.col(column).cast("string").alias("value")
    return df.select(value).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


class Dictionary:
    """A versioned dimension table ``value, id, n, since`` below ``path``, shared by all who encode.

    ``n`` counts the rows a value was seen in, ``since`` is the version that brought it. A new version keeps every id
    and numbers its new values behind them, in ascending order. A version counts once it is whole; versions take turns
    in a few folders, so a reader of the last one is not disturbed while the next is written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, StateTable(spark, os.path.join(path, "dictionary"))

    @property
    def version(self) -> int:
        """The last whole version, -1 before the first."""
        return self.versions.last()

    def table(self, version: int | None = None) -> DataFrame | None:
        return self.versions.version(self.version if version is None else version)

    def grow(self, df: DataFrame, column: str) -> int:
        """Count the rows of ``df`` and number its new values; the new version. Rows given twice count twice, ids stay."""
        last = self.version
        counts = value_counts(df, column)
        if last < 0:
            whole = numbered(counts, "value", "id").withColumn("since", F.lit(0).cast("long"))
        else:
            counts = staged(counts, "counts")
            old = self.table(last)
            size = old.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("size")).first()["size"]
            fresh = numbered(counts.join(old.select("value"), "value", "left_anti"), "value", "id", size)
            known = old.join(counts.withColumnRenamed("n", "__n"), "value", "left")
            known = known.withColumn("n", F.col("n") + F.coalesce("__n", F.lit(0))).drop("__n")
            whole = known.unionByName(fresh.withColumn("since", F.lit(last + 1).cast("long")))
        self.versions.write(whole.select("value", "id", "n", "since"), last + 1)
        return last + 1


def encode(df: DataFrame, column: str, table: DataFrame, out: str, unknown: int, missing: int, offset: int = 0) -> DataFrame:
    """Add ``out``: the value's id plus ``offset``, ``unknown`` where ``table`` (value, id, n) lacks it, ``missing`` for null.

    Up to ``FREQUENT`` entries of at most ``LONGEST`` characters go to every task and rows are not moved. Of another
    table the most frequent such entries do; only rows with another value are shuffled to meet the rest, where no short
    known value holds many rows and adaptive execution splits a value that does.
    """
    length = F.length("value")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    wide = size["n"] > FREQUENT or (size["longest"] or 0) > LONGEST
    known = table.select(F.col("value").alias("__value"), F.col("id").alias("__id"), "n")
    top = known.where(F.length("__value") <= LONGEST).orderBy(F.desc("n"), "__id").limit(FREQUENT) if wide else known
    value = F.col(column).cast("string")
    rows = df.join(F.broadcast(top.drop("n")), value == F.col("__value"), "left").drop("__value")

    def coded(rows: DataFrame) -> DataFrame:
        code = F.when(value.isNull(), missing).otherwise(F.coalesce(F.col("__id") + offset, F.lit(unknown)))
        return rows.withColumn(out, code.cast("long")).select(*[c for c in df.columns if c != out], out)

    if not wide:
        return coded(rows)
    open_: Column = F.col("__id").isNull() & value.isNotNull()
    rest = rows.where(open_).drop("__id").join(known.drop("n"), value == F.col("__value"), "left").drop("__value")
    return coded(rows.where(~open_)).unionByName(coded(rest))
