"""Streams that resume: batches against the whole table, a process that dies between two batches, expiring state."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.operators import events as E
from flowmill.session import new_path
from flowmill.streaming import streams as L
from flowmill.streaming.store import StateTable, StreamStore

SCHEMA = "key string, i long, price double, qty double, trade boolean, ms double"


def random_events(n=240, seed=5):
    """Three keys, one of them rare; a clock that sometimes steps back or leaps; prices that are no prices."""
    rng = np.random.default_rng(seed)
    clock = np.cumsum(rng.choice([0.0, 10.0, 900.0, -300.0, 4e6], n, p=[0.2, 0.4, 0.3, 0.08, 0.02]))
    price = [None if u < 0.05 else float("nan") if u < 0.08 else -1.0 if u < 0.1 else 100 + float(x) for u, x in zip(rng.random(n), rng.normal(size=n), strict=True)]
    keys = rng.choice(["a", "b", "c"], n, p=[0.7, 0.27, 0.03])
    return [(str(k), i, p, float(q), bool(t), float(c)) for i, (k, p, q, t, c) in enumerate(zip(keys, price, rng.integers(0, 9, n), rng.random(n) < 0.4, clock, strict=True))]


def vwap(store):
    return L.event_vwap(store, ["key"], "i", "price", "qty", F.col("trade"), "ms", 1000.0)


def whole(df):
    out = E.ew_vwap(df, ["key"], ["i"], "price", "qty", F.col("trade"), "ms", 1000.0)
    return {r["i"]: r["mid"] for r in out.collect()}


@pytest.mark.parametrize("cuts", [[80, 160], [1, 239], []])
def test_every_event_has_the_value_of_the_whole_table(spark, cuts):
    rows = random_events()
    store = StreamStore(spark)
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    L.replay(spark, [spark.createDataFrame(p, SCHEMA) for p in parts], vwap(store))
    got = {r["i"]: r["mid"] for r in store.log("events").all().collect()}
    want = whole(spark.createDataFrame(rows, SCHEMA))
    assert set(got) == set(want) and sum(v is None for v in want.values()) < 20
    assert all((v is None) == (want[i] is None) and (v is None or v == pytest.approx(want[i], rel=1e-9)) for i, v in got.items())


def test_late_events_are_kept_aside_and_idle_keys_start_anew(spark):
    start = lambda store: L.event_vwap(store, ["key"], "i", "price", "qty", F.col("trade"), "ms", 1000.0, idle_ms=5000.0)
    parts = [
        [("a", 1, 10.0, 1.0, True, 0.0), ("b", 2, 50.0, 1.0, True, 9000.0)],
        [("a", 3, None, 0.0, False, 9100.0), ("b", 2, 7.0, 1.0, True, 9200.0), ("b", 4, None, 0.0, False, 9300.0)],
    ]
    store = StreamStore(spark)
    L.replay(spark, [spark.createDataFrame(p, SCHEMA) for p in parts], start(store))
    assert {r["i"]: r["mid"] for r in store.log("events").all().collect()} == {1: 10.0, 2: 50.0, 3: None, 4: 50.0}
    assert [(r["i"], r["price"]) for r in store.log("late").all().collect()] == [(2, 7.0)]


RUN = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from flowmill.session import build_session
from flowmill.streaming import store as S, streams as L
from tests.test_streams import vwap

root, arrivals, dies = sys.argv[1:]
spark = build_session("resumed", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
if dies == "yes":
    plain = S.StateTable.write

    def write(self, df, batch):
        if batch == 1:  # the rows are there, their mark and the batch's commit are not
            df.write.mode("overwrite").parquet(self.path + "/rows/slot=1")
            os._exit(7)
        plain(self, df, batch)

    S.StateTable.write = write
for name in sorted(os.listdir(arrivals)):
    own = spark.read.parquet(os.path.join(arrivals, name))
    if not os.path.exists(os.path.join(root, "seen", name)):
        own.write.mode("append").parquet(os.path.join(root, "in"))
        own.limit(0).write.parquet(os.path.join(root, "seen", name))
    stream = lambda: spark.readStream.schema(own.schema).parquet(os.path.join(root, "in"))
    day = lambda df: df.groupBy("date").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n"))
    L.new_day_scores(S.StreamStore(spark, root + "/days"), root + "/scores", day, ["i"])(
        stream().withColumn("date", F.concat(F.lit("2024-01-0"), (1 + F.floor(F.col("i") / 100)).cast("string")))
    ).awaitTermination()
    vwap(S.StreamStore(spark, root + "/vwap"))(stream()).awaitTermination()
spark.stop()
"""


def test_another_process_goes_on_after_one_that_died(spark, tmp_path):
    rows = random_events(seed=9)
    for k, (a, b) in enumerate([(0, 90), (90, 150), (150, 240)]):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "arrivals" / f"{k}"))
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = str(tmp_path / "root")
    for dies, code in (("yes", 7), ("no", 0)):
        run = subprocess.run([sys.executable, "-c", RUN.format(repo=repo), root, str(tmp_path / "arrivals"), dies], cwd=repo, capture_output=True, text=True, timeout=600)
        assert run.returncode == code, run.stderr[-3000:]
    got = {r["i"]: r["mid"] for r in StreamStore(spark, f"{root}/vwap").log("events").all().collect()}
    want = whole(spark.createDataFrame(rows, SCHEMA))
    assert got == {i: v if v is None else pytest.approx(v, rel=1e-9) for i, v in want.items()}
    scores = {str(r["date"]): (r["qty"], r["n"]) for r in spark.read.parquet(f"{root}/scores").collect()}
    assert scores == {f"2024-01-0{d + 1}": (sum(r[3] for r in rows[100 * d : 100 * d + 100]), min(100, 240 - 100 * d)) for d in range(3)}


def test_old_versions_expire_and_foreign_ones_are_errors(spark):
    table = StateTable(spark, new_path(spark, "state"))
    assert table.last() == -1 and table.latest() is None and table.version(-1) is None
    for batch in range(6):
        table.write(spark.createDataFrame([(batch,)], "v int"), batch)
    assert table.last() == 5 and table.latest().first()["v"] == 5 and table.version(4).first()["v"] == 4
    assert sorted(os.listdir(f"{table.path}/rows")) == ["slot=0", "slot=1", "slot=2"]
    for gone in (2, 6):
        with pytest.raises(RuntimeError):
            table.version(gone)


def test_closed_days_keep_their_score_and_their_late_rows_apart(spark):
    rows = [[(1, "2024-01-01", 1.0), (2, "2024-01-05", 2.0)], [(3, "2024-01-01", 8.0), (4, "2024-01-04", 4.0), (5, None, 5.0)], [(6, None, 7.0)]]
    store, out = StreamStore(spark), new_path(spark, "closed")
    score = lambda df: df.groupBy("date").agg(F.sum("value").alias("score"))
    L.replay(spark, [spark.createDataFrame(x, "event_id long, date string, value double") for x in rows], L.new_day_scores(store, out, score, ["event_id"], closed_after=2))
    got = {r["date"] and str(r["date"]): r["score"] for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-05": 2.0, "2024-01-04": 4.0, None: 12.0}
    assert [r["event_id"] for r in store.log("late").all().collect()] == [3]


def test_a_batch_reads_the_earlier_rows_of_its_own_days_only(spark, capsys):
    store, out = StreamStore(spark), new_path(spark, "pruned")
    seen = []
    score = lambda df: (seen.append(df._jdf.queryExecution().toString()), df.groupBy("date").agg(F.count(F.lit(1)).alias("n")))[1]
    rows = [[(i, f"2024-01-0{d}") for i in range(3 * d, 3 * d + 3)] for d in (1, 2, 3)]
    L.replay(spark, [spark.createDataFrame(x, "event_id long, date string") for x in rows], L.new_day_scores(store, out, score, ["event_id"]))
    assert len(seen) == 3 and "PartitionFilters" in seen[-1] and "2024-01-03" in seen[-1] and "2024-01-01" not in seen[-1]
