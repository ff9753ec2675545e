"""Deliveries: clean ones pass, every kind of damage shows in its own check, none passes without a manifest."""

import pytest
from pyspark.sql import functions as F

from flowmill.operators import delivery as D, gates as G
from flowmill.session import new_path


@pytest.fixture(scope="module")
def delivered(spark):
    rows = [(f"2024-01-0{d}", f"00000{s}", d + s / 10) for d in range(1, 6) for s in range(9)]
    path = new_path(spark, "delivery")
    D.deliver(spark.createDataFrame(rows, "date string, symbol string, score double").withColumn("more", F.lit(1)), path)
    return path


def bad(spark, path, rows=None):
    return {r["check"]: r["bad_rows"] for r in D.verify(spark, path, rows=rows).collect() if r["status"] != "pass"}


def test_a_clean_delivery_passes_in_any_order(spark, delivered):
    rows = spark.read.parquet(f"{delivered}/scores")
    assert rows.columns == ["date", "symbol", "score"]
    report = D.verify(spark, delivered)
    assert [r["check"] for r in report.collect()] == list(D.CHECKS)
    G.require(report)
    assert bad(spark, delivered, rows.orderBy("score").repartition(7)) == {}


def test_damage_shows_where_it_is(spark, delivered):
    rows = spark.read.parquet(f"{delivered}/scores")
    hit = (F.col("date") == "2024-01-03") & (F.col("symbol") == "000004")
    assert bad(spark, delivered, rows.where(~hit)) == {"rows": 1, "keys": 1, "content": 1}
    assert bad(spark, delivered, rows.withColumn("score", F.when(hit, 3.25).otherwise(F.col("score")))) == {"content": 1}
    assert bad(spark, delivered, rows.withColumn("score", F.when(~hit, F.col("score")))) == {"content": 1, "not_finite": 1}
    assert bad(spark, delivered, rows.unionByName(rows.where(hit))) == {"rows": 1, "keys": 1, "content": 1, "duplicate_key": 2}
    assert bad(spark, delivered, rows.where(~hit).unionByName(rows.where(hit).withColumn("symbol", F.lit("99")))) == {"keys": 1, "content": 1}
    assert bad(spark, delivered, rows.where("date < '2024-01-05'")) == {"rows": 9, "days": 1, "range": 2, "keys": 1, "content": 1}
    assert bad(spark, delivered, rows.where("false")) == {"rows": 45, "days": 5, "range": 4, "keys": 1, "content": 1}


def test_a_refusal_names_the_checks(spark, delivered):
    short = D.verify(spark, delivered, rows=spark.read.parquet(f"{delivered}/scores").where("symbol <> '000001'"))
    with pytest.raises(ValueError, match="refused, content: 1, keys: 1, rows: 5"):
        G.require(short)
    with pytest.raises(ValueError, match="no manifest"):
        D.verify(spark, new_path(spark, "nothing"))


def test_an_empty_delivery(spark):
    path = new_path(spark, "delivery")
    D.deliver(spark.createDataFrame([], "date string, symbol string, score double"), path)
    assert bad(spark, path) == {}


def test_copies_are_verified_together(spark, delivered):
    rows = spark.read.parquet(f"{delivered}/scores")
    zero = rows.withColumn("score", F.when(F.col("symbol") == "000000", F.lit(-0.0)).otherwise(F.col("score")))
    parts = {"whole": rows, "short": rows.where("date < '2024-01-05'"), "none": rows.where("false"), "zero": zero}
    copies = None
    for name, part in parts.items():
        own = part.withColumn("copy", F.lit(name))
        copies = own if copies is None else copies.unionByName(own)
    out = D.verify_copies(spark, delivered, copies, "copy", list(parts))
    got = {}
    for r in out.collect():
        got.setdefault(r["copy"], {})[r["check"]] = r["bad_rows"]
    assert set(got) == set(parts) and all(set(v) == set(D.CHECKS) for v in got.values())
    for name, part in parts.items():
        assert {c: n for c, n in got[name].items() if n} == bad(spark, delivered, part)
    # the copies' rows are read twice, however many copies there are
    read = D.verify_copies(spark, delivered, rows.withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))), "copy", ["a", "b", "c"])
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Relation [date") <= 2


def test_copies_told_by_counts_hash_a_row_once(spark, delivered):
    rows = spark.read.parquet(f"{delivered}/scores")
    hit = F.col("symbol") == "000002"
    named = rows.withColumn("copy", F.lit("whole")).unionByName(rows.where(~hit).withColumn("copy", F.lit("short")))
    named = named.unionByName(rows.withColumn("copy", F.lit("twice"))).unionByName(rows.where(hit).withColumn("copy", F.lit("twice")))
    counts = F.struct(F.lit(1).alias("whole"), (~hit).cast("int").alias("short"), F.when(hit, 2).otherwise(1).alias("twice"), F.lit(None).cast("int").alias("none"))
    names = ["whole", "short", "twice", "none"]
    told = rows.withColumn("copy", counts)
    reports = [{tuple(r) for r in D.verify_copies(spark, delivered, x, "copy", names).collect()} for x in (named, told)]
    assert reports[0] == reports[1] and len(reports[0]) == len(names) * len(D.CHECKS)
    # no row is dealt or hashed once for each copy, and no digest is parsed from text
    plan = D.verify_copies(spark, delivered, told, "copy", names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "conv(" not in plan
