"""Readers and writers: day layouts, relaxed unions, sinks, inventories."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowmill.functions.scalars import is_iso_date, zero_fill


def parse_date(value: str) -> date:
    """A day in either spelling, ``YYYY-MM-DD`` or ``YYYY.MM.DD``."""
    for pattern in ("%Y-%m-%d", "%Y.%m.%d"):
        try:
            return datetime.strptime(value, pattern).date()
        except ValueError:
            continue
    raise ValueError(f"unsupported date {value!r}")


def day_key(day: str, partition: str, root: str = "", name: str = "all.parquet") -> str:
    """Daily object key ``YYYY.MM/YYYY.MM.DD/default/<partition>/<name>`` below ``root``."""
    d = parse_date(day)
    tail = f"{d:%Y.%m}/{d:%Y.%m.%d}/default/{partition}/{name}"
    return f"{root.rstrip('/')}/{tail}" if root else tail


def message_prefix(day: str, mic: str, kind: str, root: str, dataset: str) -> str:
    """Hive-style prefix ``DATASET=../DATE=../MIC=../TYPE=../`` of one day and exchange."""
    return f"{root.rstrip('/')}/DATASET={dataset}/DATE={parse_date(day):%Y-%m-%d}/MIC={mic}/TYPE={kind}/"


def symbol_keys(prefix: str, market: str, symbols: Iterable[str]) -> list[str]:
    """Per-instrument file names such as ``SH600000.parquet``."""
    if market.upper() not in {"SH", "SZ"}:
        raise ValueError("market must be SH or SZ")
    base = f"{prefix.rstrip('/')}/" if prefix else ""
    return [f"{base}{market.upper()}{s.zfill(6)}.parquet" for s in symbols]


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; absent columns become null and number types widen."""
    if not frames:
        raise FileNotFoundError("nothing to read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_keys(
    spark: SparkSession,
    families: Sequence[Sequence[str]],
    symbols: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    symbol: str = "symbol",
) -> DataFrame:
    """Read parquet keys, one scan per schema family, with pushed symbol filter and projection.

    A symbol column of strings or integers is compared as stored, so the filter reaches the scan;
    only other types pay for a cast.
    """
    wanted = [s.zfill(6) for s in symbols]
    frames = []
    for keys in families:
        df = spark.read.parquet(*keys)
        if wanted:
            stored = dict(df.dtypes).get(symbol)
            if stored in ("tinyint", "smallint", "int", "bigint"):
                df = df.where(F.col(symbol).isin(*[int(s) for s in wanted if s.isdecimal()]))
            else:
                df = df.where((F.col(symbol) if stored == "string" else zero_fill(symbol)).isin(*wanted))
        if columns is not None:
            df = df.select(*[c for c in columns if c in df.columns])
        frames.append(df)
    return union_relaxed(frames)


def read_tree(spark: SparkSession, root: str, pattern: str = "*.parquet", schema=None) -> DataFrame:
    """Read every matching file below a folder; csv needs an explicit schema."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if pattern.endswith(".csv"):
        if schema is None:
            raise ValueError("csv trees need a schema; inference would read the data twice")
        return reader.option("header", "true").schema(schema).csv(root)
    return reader.parquet(root)


def read_named(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Read what matches by name directly below a folder; a table may be one file or a folder of parts with any names."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{pattern}")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Trading calendar from text, one day per line, blank lines and ``#`` comments skipped.

    A calendar holds one row per trading day, so the index window is small.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("date"))
    lines = lines.where((F.col("date") != "") & ~F.col("date").startswith("#"))
    return index_calendar(lines)


def index_calendar(days: DataFrame) -> DataFrame:
    """Distinct days with their zero-based position; fails on a non-ISO day."""
    day = F.when(is_iso_date("date"), F.col("date")).otherwise(
        F.raise_error(F.concat(F.lit("not an ISO date: "), F.col("date"))).cast("string")
    )
    return days.select(day.alias("date")).distinct().select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("calendar_index")
    )


def calendar_digest(calendar: DataFrame) -> DataFrame:
    """SHA-256 of the ordered day list, newline-terminated; a calendar is bounded by its days."""
    joined = F.concat(F.array_join(F.sort_array(F.collect_list("date")), "\n"), F.lit("\n"))
    return calendar.agg(F.count(F.lit(1)).alias("n_days"), F.sha2(joined, 256).alias("calendar_sha256"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Idempotent daily sink: zstd parquet, dynamic partition overwrite.

    The rebalance hint lets adaptive execution split a large day over several writers
    and merge small ones; ``maxRecordsPerFile`` bounds every file.
    """
    out = df.hint("rebalance", *by)
    if sort:
        out = out.sortWithinPartitions(*by, *sort)
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", 20_000_000)
        .partitionBy(*by)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_records(trades: DataFrame, cancels: DataFrame, orders: DataFrame, root: str) -> None:
    """All records as CSV: ``trades`` as they are, ``cancels`` (order_id, cancel_time) with what their order says.

    ``orders`` holds each order_id once with side, price, quantity and order_time; a cancel without an order keeps
    empty fields. Both exports are folders of files with a header each.
    """
    told = cancels.join(orders.select("order_id", "side", "price", "quantity", "order_time"), "order_id", "left")
    write_csv(trades, f"{root}/trades")
    write_csv(told.select("order_id", "side", "price", "quantity", "order_time", "cancel_time"), f"{root}/cancels")


def file_rows(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Row count per file. Only file metadata is read when no column is needed."""
    return _rows_by_path(read_tree(spark, root, pattern))


def _rows_by_path(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))


def table_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One row: ``file`` (the table's name) and its rows over all parts; a table without rows counts 0."""
    parts = _rows_by_path(read_named(spark, root, name))
    return parts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("file"), "n_rows")


def key_set_digest(df: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Digest of the distinct key set per group that needs no sorted list in one place."""
    joined = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    piece = F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")
    return (
        df.select(*group, *[k for k in keys if k not in group]).distinct()
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n_keys"), F.bit_xor(piece).alias("set_digest"))
    )
