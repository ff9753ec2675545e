"""Gates: planted faults are counted where they belong, clean data pass, a refusal names what failed."""

import pytest
from pyspark.sql import functions as F

from flowmill.operators import gates as G
from flowmill.session import new_path
from flowmill.sources import io

QUOTE = "date string, symbol string, market string"


def bad(report):
    rows = report.collect()
    assert all((r["bad_rows"] == 0) == (r["status"] == "pass") for r in rows)
    return {r["check"]: r["bad_rows"] for r in rows}


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([("2024-01-02", 0), ("2024-01-03", 1)], "date string, calendar_index long")


def test_quote_rejections(spark, calendar):
    clean = [("2024-01-02", "000001", "SZ"), ("2024-01-03", "000001", "sz"), ("2024-01-02", "600000", "SH")]
    rows = [*clean, clean[0], ("2024-01-02", None, "SZ"), ("2024-01-02", None, "SZ"), (None, "000002", "SH"), ("2024-01-03", "830001", "BJ"),
            ("2024-01-03", "830002", None), ("2024-01-06", "000001", "SZ"), ("2024-01-06", "000001", "XX")]
    report = G.quote_rejections(spark.createDataFrame(rows, QUOTE), calendar)
    assert bad(report) == {"missing_key": 3, "duplicate_key": 4, "foreign_market": 3, "off_calendar": 2}
    with pytest.raises(ValueError, match="duplicate_key: 4, foreign_market: 3, missing_key: 3, off_calendar: 2"):
        G.require(report)
    fine = G.quote_rejections(spark.createDataFrame(clean, QUOTE), calendar)
    G.require(fine)
    assert G.verdict(fine).first().asDict() == {"n_checks": 4, "n_failed": 0, "verdict": "ready", "failed": ""}
    assert G.verdict(report).first()["failed"] == "duplicate_key,foreign_market,missing_key,off_calendar"
    assert set(bad(G.quote_rejections(spark.createDataFrame([], QUOTE), calendar)).values()) == {0}


def test_regime_gates(spark):
    schema = "date string, symbol string, x double, book_valid_ratio double, in_universe boolean, has_quote boolean, has_history boolean, return_coverage double, amount_coverage double"
    good = ("d", "000001", 1.0, 0.9, True, True, True, 1.0, 0.95)
    rows = [good, ("d", "000002", None, 0.9, True, True, True, 1.0, 0.5), ("d", "000003", float("nan"), None, True, False, True, 1.0, None),
            ("d", "000004", 2.0, 0.1, False, True, False, 0.9, 0.9), ("d", "000004", 2.0, 0.5, True, True, True, 0.9, 0.9)]
    own = "date string, symbol string, market string, board string"
    atomic = spark.createDataFrame([("d", "000001", "SZ", "MAIN"), ("d", "000002", "SZ", "SME"), ("d", "000003", "SZ", "MAIN"), ("d", "000004", "SH", "MAIN")], own)
    quotes = spark.createDataFrame([("d", "000001", "SZ", "MAIN"), ("d", "000002", "SZ", "MAIN"), ("d", "000004", "SZ", "MAIN")], own)
    gates = lambda r, a: bad(G.regime_gates(spark.createDataFrame(r, schema), a, quotes, ["x"], 0.9, 0.5))
    want = {"in_universe": 1, "has_quote": 1, "has_history": 1, "coverage": 2, "features": 2, "book_valid_ratio": 2, "duplicate_key": 2, "identity": 2}
    assert gates(rows, atomic) == want
    assert set(gates([good], atomic.limit(1)).values()) == {0} == set(gates([], atomic.where("false")).values())


def test_manifest_against_live_files(spark):
    path, keys = new_path(spark, "archive"), ["market", "date"]
    i = F.col("id")
    rows = spark.range(800).select(F.when(i % 2 == 0, "SH").otherwise("SZ").alias("market"), F.concat(F.lit("2024-01-0"), (1 + i % 8).cast("string")).alias("date"), i, (i * 2).alias("v"))
    io.write_partitioned(rows, path, keys)
    stored = "id long, v long, market string, date string"
    live = lambda p=path: G.live_shards(spark.read.schema(stored).parquet(p), keys, ["id", "v"])
    listed = live().withColumns({"market": F.regexp_extract("path", "market=([A-Z]+)", 1), "date": F.regexp_extract("path", "date=(.+)", 1), "vocab_sha256": F.lit("h")})
    statuses = lambda m, found=None: {r["path"]: r["status"] for r in G.manifest_status(m, found or live(), keys, "h").collect()}
    assert len(statuses(listed)) == 8 and set(statuses(listed).values()) == {"ok"}

    later = new_path(spark, "archive")  # the same rows in more files, one row changed, one shard gone
    changed = rows.withColumn("v", F.col("v") + F.when(i == 3, 1).otherwise(0)).where("date <> '2024-01-08'")
    changed.repartition(3).write.partitionBy(*keys).parquet(later)
    date = F.col("date")
    faulty = listed.where(date != "2024-01-01").withColumns({
        "n_rows": F.col("n_rows") + F.when(date == "2024-01-02", 1).otherwise(0),
        "path": F.when(date == "2024-01-03", F.lit("market=SH/date=2024-01-05")).otherwise(F.col("path")),
        "vocab_sha256": F.when(date == "2024-01-06", F.lit(None)).otherwise(F.lit("h")),
    })
    faulty = faulty.unionByName(faulty.where(date == "2024-01-07"))
    found = {(r["date"], r["path"], r["status"]) for r in G.manifest_status(faulty, live(later), keys, "h").collect()}
    at = lambda m, d: f"market={m}/date=2024-01-0{d}"
    assert found == {
        (None, at("SH", 1), "not_listed"), ("2024-01-02", at("SZ", 2), "rows_differ"), ("2024-01-03", at("SH", 5), "path_wrong"), (None, at("SH", 3), "not_listed"),
        ("2024-01-04", at("SZ", 4), "content_differs"), ("2024-01-05", at("SH", 5), "ok"), ("2024-01-06", at("SZ", 6), "other_vocabulary"),
        ("2024-01-07", at("SH", 7), "listed_twice"), ("2024-01-08", at("SZ", 8), "file_missing"),
    }
    report = bad(G.manifest_report(G.manifest_status(faulty, live(later), keys, "h")))
    assert report == {"not_listed": 2, "listed_twice": 1, "path_wrong": 1, "other_vocabulary": 1, "file_missing": 1, "rows_differ": 1, "content_differs": 1}
