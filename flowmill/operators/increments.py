"""Vocabularies that are fitted day by day: value counts per day are kept, and a fit merges days without reading rows again."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowmill.functions.scalars import is_finite
from flowmill.operators import vocab as V
from flowmill.session import staged
from flowmill.sources.io import write_partitioned

_SCHEMA = "field string, x double, value string, n long, day string"


def day_counts(df: DataFrame, specs: Sequence[V.FieldSpec], day: str) -> DataFrame:
    """``(day, field, x, value, n)`` of one scan, summed in each task before the shuffle.

    ``x`` is a numeric field's value, ``value`` a category; both are null for the missing ones among the rows a field
    applies to. The field ``''`` counts all rows, so a day without any applicable row is known as well.
    """
    x = lambda s: F.when(is_finite(s.source), F.col(s.source).cast("double")) if s.numeric else F.lit(None).cast("double")
    text = lambda s: F.lit(None).cast("string") if s.numeric else F.col(s.source).cast("string")
    cells = [F.when(s.applies(), F.struct(F.lit(s.name).alias("field"), x(s).alias("x"), text(s).alias("value"))) for s in specs]
    mark = F.struct(F.lit("").alias("field"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("string").alias("value"))
    days = F.coalesce(F.col(day).cast("string"), F.raise_error(F.lit("a row without a day")).cast("string"))
    long = df.select(days.alias("day"), F.explode(F.array(mark, *cells)).alias("c")).where("c is not null")
    return long.groupBy("day", "c.field", "c.x", "c.value").agg(F.count(F.lit(1)).alias("n")).select("field", "x", "value", "n", "day")


class DayCounts:
    """Value counts by day below ``path``; ``specs`` are those of every fit.

    A day is always given whole: what was counted for it before is replaced, so a repeated run or a corrected day
    counts once. The table holds each day's distinct values, sorted by field and value, in that day's folder, so a fit
    on some days opens no other folder. One writer at a time; readers start after it.
    """

    def __init__(self, spark: SparkSession, path: str, specs: Sequence[V.FieldSpec]):
        self.spark, self.path, self.specs = spark, path, tuple(specs)
        if any(not s.name for s in self.specs):
            raise ValueError("a field needs a name")

    def add(self, df: DataFrame, day: str = "date") -> None:
        write_partitioned(day_counts(df, self.specs, day), self.path, ["day"], ["field", "x"])

    def table(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The counts of the days from ``first`` to ``last``, both included."""
        out = self.spark.read.schema(_SCHEMA).parquet(self.path)
        if first is not None:
            out = out.where(F.col("day") >= first)
        return out if last is None else out.where(F.col("day") <= last)

    def moments(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """One row per day and numeric field: ``n_observed, n_missing, mean, m2, min_value, max_value``.

        ``m2`` is the sum of squared distances from the day's mean, taken after the mean is known.
        """
        names = [s.name for s in self.specs if s.numeric]
        rows = self.table(first, last).where(F.col("field").isin(*names))
        seen = F.when(F.col("x").isNotNull(), F.col("n"))
        whole = rows.groupBy("day", "field").agg(
            F.coalesce(F.sum(seen), F.lit(0)).alias("n_observed"), (F.sum("n") - F.coalesce(F.sum(seen), F.lit(0))).alias("n_missing"),
            (F.sum(seen * F.col("x")) / F.sum(seen)).alias("mean"), F.min("x").alias("min_value"), F.max("x").alias("max_value"),
        )
        off = rows.where("x is not null").join(whole.select("day", "field", "mean"), ["day", "field"])
        spread = off.groupBy("day", "field").agg(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)).alias("m2"))
        return whole.join(spread, ["day", "field"], "left").withColumn("m2", F.coalesce("m2", F.lit(0.0)))

    def stats(self, first: str | None = None, last: str | None = None) -> dict[str, dict]:
        """What ``vocab.field_stats`` says of all rows of the days, from one row per day and field on the driver."""
        parts = defaultdict(list)
        for r in self.moments(first, last).collect():
            parts[r["field"]].append(r)
        return {s.name: merged_moments(parts[s.name]) for s in self.specs if s.numeric}

    def fit(self, first: str | None = None, last: str | None = None, normaliser_clip: float = 5.0) -> V.Vocab:
        """The vocabulary ``fit_vocab`` gives for all rows of the days; no row is read again."""
        rows = self.table(first, last)
        binned = {s.name: (s.n_bins, s.two_sided) for s in self.specs if s.binned}
        numeric = [s.name for s in self.specs if s.numeric]
        edges: dict[str, list[float]] = {n: [] for n in numeric}
        by_bin: dict[str, dict[int, int]] = {n: {} for n in numeric}
        if numeric:
            values = rows.where(F.col("field").isin(*numeric) & F.col("x").isNotNull())
            counts = staged(values.groupBy("field", "x").agg(F.sum("n").alias("ties")), "counts")
            edges.update(V.edges_of_counts(counts, binned))
            bins = V.add_bins(counts, {f"b_{n}": (F.when(F.col("field") == n, F.col("x")), edges[n]) for n in numeric})
            placed = bins.groupBy("field", F.coalesce(*[F.col(f"b_{n}") for n in numeric]).alias("bin")).agg(F.sum("ties").alias("n"))
            for r in placed.collect():
                by_bin[r["field"]][r["bin"]] = r["n"]
        texts = [s.name for s in self.specs if not s.numeric]
        categories = rows.where(F.col("field").isin(*texts)).groupBy("field", "value").agg(F.sum("n").alias("n")).collect() if texts else []
        days = [r["day"] for r in rows.where("field = ''").select("day").distinct().collect()]
        return V.assembled(self.specs, self.stats(first, last) if numeric else {}, edges, by_bin, categories, days, normaliser_clip)


def merged_moments(parts: Sequence) -> dict:
    """One field's moments from those of its days: exact counts and range, mean and spread by exactly rounded sums.

    The result does not depend on the order of the days. A field without an observed value has mean 0 and std 1.
    """
    seen = [r for r in parts if r["n_observed"]]
    n = sum(r["n_observed"] for r in seen)
    mean = math.fsum(r["n_observed"] * r["mean"] for r in seen) / n if n else 0.0
    between = math.fsum(r["n_observed"] * (r["mean"] - mean) ** 2 for r in seen)
    std = math.sqrt((math.fsum(r["m2"] for r in seen) + between) / n) if n else 0.0
    return {
        "n_observed": n, "n_missing": sum(r["n_missing"] for r in parts), "mean": mean, "std": std if std > 0 else 1.0,
        "min_value": min((r["min_value"] for r in seen), default=None), "max_value": max((r["max_value"] for r in seen), default=None),
    }


def save_vocab(spark: SparkSession, vocab: V.Vocab, path: str) -> None:
    """A frozen vocabulary as a one-row table, replaced as a whole."""
    spark.range(1).select(F.lit(vocab.to_json()).alias("vocabulary")).write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> V.Vocab:
    return V.Vocab.from_json(spark.read.schema("vocabulary string").parquet(path).first()["vocabulary"])
