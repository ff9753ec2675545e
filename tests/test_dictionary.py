"""Dictionaries: dense, sorted, grown without renumbering, the same for any partitioning; encoding of hot and rare values."""

import pytest
from pyspark.sql import functions as F

from flowmill.operators import dictionary as D, vocab as V
from flowmill.session import new_path


def rows(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")


def held(df):
    return {r["value"]: (r["id"], r["n"], r["since"]) for r in df.collect()}


def test_a_million_values_are_numbered_in_order(spark):
    n = 1_000_000
    values = spark.range(n).select(F.format_string("%07d", "id").alias("value")).repartition(16, "value")
    out = D.numbered(values, "value", "id", 5)
    wrong = out.where(F.col("value").cast("long") + 5 != F.col("id")).count()
    assert wrong == 0 and out.count() == n


def test_versions_keep_ids(spark):
    path = new_path(spark, "dictionary")
    d = D.Dictionary(spark, path)
    assert d.version == -1 and d.table(-1) is None
    assert d.grow(rows(spark, "m", "c", "m", None, "x"), "v") == 0
    assert held(d.table()) == {"c": (0, 1, 0), "m": (1, 2, 0), "x": (2, 1, 0)}
    again = D.Dictionary(spark, path)  # as another process finds it
    assert again.grow(rows(spark, "b", "m", "", "z", "b"), "v") == 1
    want = {"c": (0, 1, 0), "m": (1, 3, 0), "x": (2, 1, 0), "": (3, 1, 1), "b": (4, 2, 1), "z": (5, 1, 1)}
    assert held(again.table()) == want == held(d.table())
    assert held(d.table(0)) == {"c": (0, 1, 0), "m": (1, 2, 0), "x": (2, 1, 0)}
    assert d.grow(rows(spark, None), "v") == 2 and held(d.table()) == want
    assert d.grow(rows(spark), "v") == 3 and held(d.table()) == want


def test_an_empty_start(spark):
    d = D.Dictionary(spark, new_path(spark, "dictionary"))
    assert d.grow(rows(spark, None), "v") == 0 and held(d.table()) == {}
    assert [r["t"] for r in D.encode(rows(spark, "a", None), "v", d.table(), "t", 1, 2, 6).orderBy("i").collect()] == [1, 2]
    d.grow(rows(spark, "b"), "v")
    assert held(d.table()) == {"b": (0, 1, 1)}


@pytest.mark.parametrize("frequent", [1, 3, 1 << 16])
def test_encoding_is_the_same_however_many_values_are_frequent(spark, monkeypatch, frequent):
    monkeypatch.setattr(D, "FREQUENT", frequent)
    table = spark.createDataFrame([("a", 0, 9), ("b", 1, 100), ("", 2, 1), ("d", 3, 5)], "value string, id long, n long")
    df = rows(spark, "b", "a", None, "", "zz", "d", "b", "zz").withColumnRenamed("v", "n")  # a name the table has too
    out = D.encode(df, "n", table, "t", 1, 2, 6)
    assert out.columns == ["i", "n", "t"]
    assert [r["t"] for r in out.orderBy("i").collect()] == [7, 6, 2, 8, 1, 9, 7, 1]


def test_category_codes_by_sorted_order(spark):
    out = V.category_codes(rows(spark, "q", None, "a", "q", ""), "v", "code")
    assert out.dtypes[-1] == ("code", "int")
    assert [r["code"] for r in out.orderBy("i").collect()] == [2, -1, 1, 2, 0]
    numbers = spark.createDataFrame([(0, 10.5), (1, 9.0), (2, None), (3, 9.0), (4, -1.0)], "i long, value double")
    assert [r["code"] for r in V.category_codes(numbers, "value", "code").orderBy("i").collect()] == [2, 1, -1, 1, 0]


def test_long_values_are_joined(spark):
    long = "x" * 1000
    table = spark.createDataFrame([("a", 0, 1), (long, 1, 50)], "value string, id long, n long")
    assert [r["t"] for r in D.encode(rows(spark, long, "a", "y"), "v", table, "t", -1, -1).orderBy("i").collect()] == [1, 0, -1]
