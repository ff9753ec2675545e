"""Content inventories: additive, order-free, and able to find a planted change."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flowmill.session import new_path
from flowmill.sources import inventory as I

COLUMNS = ["i", "s"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).select(F.concat(F.lit("f"), F.col("id") % 40).alias("file"), F.col("id").alias("i"), F.concat(F.lit("v"), F.col("id") % 9).alias("s"))


def nodes(df, digits=2):
    return I.write(I.tree(I.leaves(df, "file", COLUMNS, digits)), new_path(df.sparkSession, "inventory"))


def digests(df):
    return {(r["level"], r["node"]): r["digest"] for r in df.collect()}


def test_layout_order_and_parts_do_not_matter(spark, rows):
    want = digests(nodes(rows))
    assert digests(nodes(rows.repartition(7, "s"))) == want
    parts = [I.leaves(rows.where(F.col("i") % 3 == k), "file", COLUMNS) for k in range(3)]
    assert digests(I.tree(parts[0].unionByName(parts[1]).unionByName(parts[2]))) == want
    coarse = {k: v for k, v in digests(nodes(rows, digits=1)).items() if k[0] < I.LEAF}
    assert coarse == {k: v for k, v in want.items() if k[0] < I.LEAF}
    root = nodes(rows).where(f"level = {I.ROOT}").first()
    assert (root["n_files"], root["n_rows"], root["node"], root["parent"]) == (40, 5000, "", None)


def test_file_digest_by_hand(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("a", 22, "")], "file string, i long, s string")
    lanes = [0] * 4
    for text in ("1:1-", "1:1-", "2:220:"):
        d = hashlib.sha256(text.encode()).hexdigest()
        lanes = [x + int(d[15 * k : 15 * k + 15], 16) for k, x in enumerate(lanes)]
    want = hashlib.sha256("|".join(map(str, ["a", 3, *lanes])).encode()).hexdigest()
    assert digests(nodes(df))[I.FILE, "a"] == want


def test_a_changed_row_is_found_by_descent(spark, rows):
    before, other = nodes(rows), rows.withColumn("s", F.when(F.col("i") == 777, "changed").otherwise(F.col("s")))
    found = I.differences(before, nodes(other)).collect()
    assert [r["node"] for r in found if r["level"] == I.FILE] == ["f17"] and {r["status"] for r in found if r["level"] < I.LEAF} == {"changed"}
    assert sum(r["level"] == I.FOLDER for r in found) == 1 and 1 <= sum(r["level"] == I.LEAF for r in found) <= 2
    where = I.changed_rows(rows, other, I.differences(before, nodes(other)), "file", COLUMNS).collect()
    assert sorted((r["file"], r["n_before"], r["n_after"]) for r in where) == [("f17", 0, 1), ("f17", 1, 0)]
    assert I.differences(before, nodes(rows.repartition(3))).count() == 0


def test_added_removed_and_repeated_rows(spark, rows):
    twice = rows.unionByName(rows.where("i = 5")).unionByName(rows.where("i = 5"))  # an even number of repeats
    assert {(r["node"], r["status"], r["n_after"] - r["n_before"]) for r in I.differences(nodes(rows), nodes(twice)).where(f"level = {I.FILE}").collect()} == {("f5", "changed", 2)}
    moved = rows.withColumn("file", F.when(F.col("file") == "f3", "new").otherwise(F.col("file")))
    found = I.differences(nodes(rows), nodes(moved)).where(f"level = {I.FILE}").collect()
    assert {(r["node"], r["status"], r["n_before"], r["n_after"]) for r in found} == {("f3", "removed", 125, None), ("new", "added", None, 125)}
    assert nodes(rows.limit(0)).count() == 0 and I.differences(nodes(rows.limit(0)), nodes(rows)).where("status = 'added'").count() > 40


def test_rows_and_names_of_tables_that_are_folders(spark, tmp_path):
    from flowmill.sources import io

    spark.range(12).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).selectExpr("cast(id as string) other").coalesce(1).write.parquet(f"{tmp_path}/notes.parquet")
    spark.range(5).where("id < 0").write.parquet(f"{tmp_path}/empty.parquet")
    single = next((tmp_path / "notes.parquet").glob("part-*.parquet"))
    (tmp_path / "labels.parquet").write_bytes(single.read_bytes())
    tables = ["events.parquet", "notes.parquet", "empty.parquet", "labels.parquet"]
    got = io.union_relaxed([io.table_rows(spark, str(tmp_path), t) for t in tables])
    assert [tuple(r) for r in got.collect()] == [("events.parquet", 12), ("notes.parquet", 5), ("empty.parquet", 0), ("labels.parquet", 5)]
    assert io.read_named(spark, str(tmp_path), "events*.parquet").count() == 12
