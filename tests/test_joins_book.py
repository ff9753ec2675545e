import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowmill.operators import book as K, joins as J


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_equals_pandas_on_a_hot_key(spark, strict):
    rng = np.random.default_rng(1)
    n = 500
    left = pd.DataFrame({"s": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 9, n)), "t": rng.integers(0, 200, n), "id": range(n)})
    right = pd.DataFrame({"s": rng.integers(0, 9, 300), "e": rng.integers(0, 200, 300)}).drop_duplicates()
    right["v"] = range(len(right))
    got = J.as_of(spark.createDataFrame(left), spark.createDataFrame(right), ["s"], "t", "e", ["v"], strict).toPandas().sort_values("id")
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("e"), left_on="t", right_on="e", by="s", allow_exact_matches=not strict).sort_values("id")
    np.testing.assert_array_equal(got["v"].to_numpy(dtype=float), want["v"].to_numpy(dtype=float))
    np.testing.assert_array_equal(got["matched_time"].to_numpy(dtype=float), want["e"].to_numpy(dtype=float))


def test_industry_change_at_prediction_time_is_not_used(spark):
    left = spark.createDataFrame([("A", 935), ("B", 935), ("A", 940)], "s string, t long")
    hist = spark.createDataFrame([("A", 900, 10), ("A", 940, 99), ("B", 900, 10)], "s string, e long, ind long")
    out = J.as_of(left, hist, ["s"], "t", "e", ["ind"])
    assert {(r["s"], r["t"]): r["ind"] for r in out.collect()} == {("A", 935): 10, ("B", 935): 10, ("A", 940): 10}
    assert J.as_of_audit(out, "t", "matched_time").first()["n_leaks"] == 0
    loose = J.as_of(left, hist, ["s"], "t", "e", ["ind"], strict=False)
    assert J.as_of_audit(loose, "t", "matched_time").first()["n_leaks"] == 1


def quotes(spark):
    days = ["2026-01-05", "2026-01-06", "2026-01-07", "2026-01-08"]
    rows = [(d, s, "SZ", 10.0 + o + i, 10.0 + o + i, False, False, False, s == "000001" and d == "2026-01-06")
            for i, d in enumerate(days) for o, s in enumerate(["000001", "000002"])]
    df = spark.createDataFrame(rows, "date string, symbol string, market string, close double, vwap double, is_st boolean, is_new boolean, is_halt boolean, limit_locked boolean")
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date string, calendar_index long")
    return df, cal


def test_execution_panel_case(spark):
    df, cal = quotes(spark)
    rows = {(r["date"], r["symbol"]): r for r in J.execution_panel(df, cal, J.RETURN_SPECS["vwap_t1_vwap_t2"]).collect()}
    r = rows[("2026-01-05", "000001")]
    assert (r["entry_date"], r["exit_date"]) == ("2026-01-06", "2026-01-07")
    assert r["fwd_ret"] == pytest.approx(12 / 11 - 1) and not r["entry_fillable"] and r["exit_fillable"]
    assert rows[("2026-01-08", "000002")]["entry_date"] is None


def test_forward_return_does_not_jump_over_a_missing_day(spark):
    df, cal = quotes(spark)
    gap = df.where(~((F.col("symbol") == "000002") & (F.col("date") == "2026-01-06")))
    rows = {(r["date"], r["symbol"]): r["fwd_ret"] for r in J.forward_return(gap, cal).collect()}
    assert rows[("2026-01-05", "000002")] is None and rows[("2026-01-05", "000001")] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        J.ReturnSpec("bad", 1, 0, "vwap", "vwap")


def test_repeated_trade_keys_do_not_multiply(spark):
    real = spark.createDataFrame([(1, 1, 1, 93000000), (1, 1, 2, 93000000), (2, 2, 3, 93001000), (1, 1, 4, 93002000)], "buy_id long, sell_id long, serial long, int_time long")
    sim = spark.createDataFrame([(1, 1), (1, 1), (9, 9)], "buy_id long, sell_id long").withColumn("trade_time", F.lit(93003000))
    r = J.reconcile_trades(real, sim, ["buy_id", "sell_id"]).first().asDict()
    # Two real rows before serial 3, each matched by two simulated rows.
    assert r == {"n_real": 4, "n_sim": 3, "n_missing": 1, "n_extra": 1, "first_kind": "missing", "first_serial": 3, "first_time": 93001000, "n_matched_before": 4}
    b = {x["time_bucket"]: x for x in J.mismatch_buckets(real, sim, ["buy_id", "sell_id"], bucket_seconds=1).collect()}
    assert b["09:30:00"]["n_real"] == 4 and b["09:30:01"]["n_missing"] == 1 and b["09:30:03"]["n_extra"] == 1


def test_attach_complete_fails_on_a_gap(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(1, 5.0)], "k long, v double")
    with pytest.raises(PySparkException):
        J.attach_complete(a, b, ["k"], ["v"]).collect()
    with pytest.raises(PySparkException):
        J.normalise_keys(spark.createDataFrame([("2024-01-01", None)], "date string, symbol string")).collect()


def test_clearing_price_equals_brute_force(spark):
    orders = [("B", p, p % 17 + 1) for p in range(100, 220)] + [("S", p, p % 13 + 1) for p in range(100, 220)]
    df = spark.createDataFrame([("x", *o) for o in orders], "k string, side string, price long, quantity long")
    best = max(((min(sum(q for s, p, q in orders if s == "B" and p >= c), sum(q for s, p, q in orders if s == "S" and p <= c)), -c) for c in range(100, 220)))
    r = K.clearing_price(df, ["k"]).first()
    assert (r["volume"], -r["clearing_price"]) == best


def test_lifecycle_statuses(spark):
    orders = spark.createDataFrame([(i, 10) for i in range(1, 6)], "order_id long, initial_quantity long")
    trades = spark.createDataFrame([(1, 2, 100, 10), (3, 4, 50, 4), (3, 3, 70, 1)], "buy_order_id long, sell_order_id long, price long, quantity long")
    cancels = spark.createDataFrame([(4,)], "order_id long")
    got = {r["order_id"]: (r["status"], r["traded_quantity"], r["remaining_quantity"]) for r in K.order_lifecycle(orders, trades, cancels).collect()}
    assert got == {1: ("filled", 10, 0), 2: ("filled", 10, 0), 3: ("partial", 5, 5), 4: ("cancelled", 4, 6), 5: ("open", 0, 10)}


def test_market_order_classes(spark):
    orders = spark.createDataFrame([(i, "B") for i in range(1, 7)], "order_id long, side string")
    t = [(1, 1, "F", 100, 5, "B"), (1, 2, "F", 100, 5, "B"), (2, 1, "F", 100, 5, "B"), (2, 2, "F", 101, 5, "B"),
         (3, 1, "F", 100, 5, "B"), (3, 2, "C", 0, 7, "S"), (4, 1, "F", 100, 5, "S"),
         (5, 1, "F", 100, 5, "B"), (5, 2, "F", 101, 5, "B"), (5, 3, "F", 0, 3, "B")]
    trades = spark.createDataFrame(t, "order_id long, serial long, trade_type string, trade_price long, trade_volume long, bsflag string")
    got = {r["order_id"]: (r["order_class"], r["left_quantity"]) for r in K.market_order_class(orders, trades).collect()}
    assert got == {1: (0, None), 2: (1, None), 3: (-2, 7), 4: (-1, None), 5: (-2, 3), 6: (-1, None)}


def test_book_state_case(spark):
    levels = [("B", 1, 10000, 100), ("B", 2, 9900, 200), ("S", 1, 10100, 300), ("S", 2, 10200, 100)]
    df = spark.createDataFrame([("k", *x) for x in levels], "k string, side string, level int, price long, quantity long")
    r = K.book_state(df, ["k"]).first()
    assert (r["bid1"], r["ask1"], r["spread_ticks"], r["bid_depth_5"], r["ask_depth_10"]) == (10000, 10100, 1, 300, 400)
    assert r["imbalance_1"] == pytest.approx(-0.5) and r["microprice_delta_ticks"] == pytest.approx(-0.25)


def test_time_weighted_depth_case(spark):
    rows = [("d", "s", 0, 93000000, 9900, 10100, 100, 200, 100, 200, 100, 200), ("d", "s", 1, 112959000, 9900, 10100, 100, 300, 100, 300, 100, 300)]
    df = spark.createDataFrame(rows, "date string, symbol string, event_idx long, int_time long, bid1 long, ask1 long, bid_qty_1 long, ask_qty_1 long, bid_depth_5 long, ask_depth_5 long, bid_depth_10 long, ask_depth_10 long")
    r = K.stock_day_atomic(df, ["date", "symbol"], ["event_idx"]).first()
    assert r["observed_seconds"] == 7200 and r["n_ofi_events"] == 1
    assert r["stock_depth_l5_log"] == pytest.approx((7199 * math.log(301) + math.log(401)) / 7200)


def test_snapshot_levels(spark):
    ref = spark.createDataFrame([("s", 5, [10.0, 9.0], [100.0, 50.0], [11.0], [10.0]), ("s", 1, [1.0], [1.0], [1.0], [1.0])], "s string, t long, bid_px array<double>, bid_qty array<double>, ask_px array<double>, ask_qty array<double>")
    reb = spark.createDataFrame([("s", 4, [10.0, 8.0], [100.0, 60.0], [11.0], [10.5])], ref.schema)
    got = {r["level"]: (r["n_compared"], r["n_price_match"], r["n_qty_match"]) for r in K.reconcile_snapshots(reb, ref, ["s"], "t").collect()}
    assert got == {1: (2, 2, 2), 2: (1, 0, 0)}


def test_as_of_history_has_one_row_per_key_and_time(spark):
    left = spark.createDataFrame([("A", 5)], "s string, t long")
    twice = spark.createDataFrame([("A", 1, 10, 1), ("A", 1, 11, 2)], "s string, e long, v long, n long")
    with pytest.raises(PySparkException, match="repeated key"):
        J.as_of(left, twice, ["s"], "t", "e", ["v"]).collect()
    assert J.as_of(left, twice, ["s"], "t", "e", ["v"], tie=["n"]).first()["v"] == 11
    unkeyed = spark.createDataFrame([(None, 1, 10)], "s string, e long, v long")
    with pytest.raises(PySparkException, match="null key"):
        J.as_of(left, unkeyed, ["s"], "t", "e", ["v"]).collect()


def test_level_arrays_keep_every_level_and_leave_other_columns(spark):
    names = [f"ap{i}" for i in range(1, 13)] + ["avg_price", "av_1"]
    out = K.level_arrays(spark.createDataFrame([tuple(range(1, 15))], names)).first()
    assert out["ask_px"] == [float(i) for i in range(1, 13)] and out["ask_qty"] == [14.0] and out["avg_price"] == 13


def test_coverage_groups_both_sets_once(spark):
    a = spark.createDataFrame([("d1", 1), ("d1", 1), ("d1", 2), (None, 3), ("d2", None)], "date string, key long")
    b = spark.createDataFrame([("d1", 1), ("d1", 9), (None, 3), ("d2", None), ("d2", None)], "date string, key long")
    out = J.daily_coverage(a, b, ["date", "key"])
    assert {r["date"]: tuple(r)[1:] for r in out.collect()} == {"d1": (2, 1, 1, 1, 0.5), "d2": (1, 0, 1, 1, 0.0), None: (1, 0, 1, 1, 0.0)}
    assert tuple(J.key_overlap(a, b, ["date", "key"]).first()) == (4, 4, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # no side is sorted or joined, and the number of tasks goes with the input's splits
    assert "Join" not in plan and "Sort" not in plan and "REPARTITION_BY_NUM" in plan


def test_coverage_of_nothing(spark):
    none = spark.createDataFrame([], "date string, key long").where("false")
    assert J.daily_coverage(none, none, ["date", "key"]).collect() == []
    assert tuple(J.key_overlap(none, none, ["date", "key"]).first()) == (0, 0, 0)
