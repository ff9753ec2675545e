"""The evaluation set: weights and trades by hand, metrics from the written tables, unfinished sets are refused."""

import math

import pytest

from flowmill.operators import evaluation as E, xsection as X
from flowmill.session import new_path
from flowmill.sources import io


def panel(spark, rows):
    return spark.createDataFrame(rows, "date string, symbol string, symbol_id long, score double, fwd_ret double, eligible_at_signal boolean, limit_locked boolean")


def days(spark):
    rows = []
    for d in range(6):
        for s in range(8):
            lab = None if (d, s) == (5, 7) else 0.01 * ((s * 3 + d * 5) % 7 - 3)
            rows.append((f"2024-01-0{d + 1}", f"00000{s}", s, float((s + d) % 8), lab, s != 0, (d, s) == (2, 5)))
    return panel(spark, rows)


def test_weights_and_trades(spark):
    rows = [("a", "x", 1, 3.0, 0.1, True, False), ("a", "y", 2, 2.0, 0.1, True, False), ("a", "z", 3, 1.0, 0.1, True, None),
            ("b", "x", 1, 1.0, 0.1, True, False), ("b", "z", 3, 2.0, 0.1, True, False), ("b", "y", 2, 9.0, 0.1, True, True), ("c", "z", 3, 2.0, None, False, False)]
    held = E.top_holdings(panel(spark, rows), 2)
    assert {(r["date"], r["symbol"], r["weight"]) for r in held.collect()} == {
        ("a", "x", 0.5), ("a", "y", 0.5), ("b", "z", 0.5), ("b", "x", 0.5), ("c", "z", 1.0)}
    trades = {(r["date"], r["symbol"], r["side"], r["change"]) for r in E.weight_changes(held).collect()}
    assert trades == {("a", "x", "buy", 0.5), ("a", "y", "buy", 0.5), ("b", "y", "sell", -0.5), ("b", "z", "buy", 0.5),
                      ("c", "x", "sell", -0.5), ("c", "z", "buy", 0.5)}


def test_metrics_come_from_the_written_tables(spark):
    df, path = days(spark), new_path(spark, "evaluation")
    with pytest.raises(ValueError, match="no finished evaluation"):
        E.read_evaluation(spark, path)
    E.write_evaluation(df, path, [2, 3], cutoffs=(3,), top_k=3)
    back = E.read_evaluation(spark, path)
    assert set(back) == {*E.TABLES, "metrics"}
    m = {(r["section"], r["metric"]): r["value"] for r in back["metrics"].collect()}
    assert (m["coverage", "score_rows"], m["coverage", "signal_days"], m["coverage", "eligible_rows"], m["coverage", "label_rows"]) == (48, 6, 42, 41)
    assert m["coverage", "label_coverage"] == pytest.approx(41 / 42)
    daily = back["portfolio_daily"].orderBy("date").toPandas()
    assert m["active", "mean_daily_return"] == pytest.approx((daily.ret - daily.benchmark_return).mean())
    error = (daily.ret - daily.benchmark_return).std()
    assert m["active", "information_ratio"] == pytest.approx((daily.ret - daily.benchmark_return).mean() / error * math.sqrt(244))
    assert m["portfolio", "mean_turnover"] == pytest.approx(daily.turnover.mean()) and m["ic", "n_periods"] == 6
    assert m["head_ranking", "ndcg_3"] == pytest.approx(back["daily_head_metrics"].toPandas().ndcg.mean())
    turned = back["trades"].groupBy("date").sum("change").toPandas().set_index("date")["sum(change)"]
    assert turned["2024-01-01"] == pytest.approx(1.0) and turned.drop("2024-01-01").abs().max() < 1e-12


def test_no_rows(spark):
    path = new_path(spark, "evaluation")
    E.write_evaluation(days(spark).where("false"), path, [2], cutoffs=(3,), top_k=2)
    m = {(r["section"], r["metric"]): r["value"] for r in E.read_evaluation(spark, path)["metrics"].collect()}
    assert m["coverage", "score_rows"] == 0 and m["active", "information_ratio"] is None and m["ic", "mean_ic"] is None


def test_ledger_summary(spark):
    rows = [("a", "x", 1.0, 0.1), ("b", "x", 1.0, -0.2), ("c", "y", 0.5, 0.3)]
    hold = spark.createDataFrame(rows, "date string, symbol string, weight double, fwd_ret double")
    daily = X.ledger(hold, 10.0, 20.0)
    one = X.ledger_summary(daily).first()
    day = daily.orderBy("date").toPandas()
    assert one["n_days"] == 3 and one["cum_return"] == pytest.approx(day.nav.iloc[-1] - 1) and one["total_cost"] == pytest.approx(0.001 + 0.0005 + 0.002)
    assert one["max_drawdown"] == pytest.approx((day.nav / day.nav.cummax() - 1).min())
    assert one["sharpe"] == pytest.approx(day.net_return.mean() / day.net_return.std() * math.sqrt(X.TRADING_DAYS))
    none = X.ledger_summary(daily.where("false")).first()
    assert set(none.asDict().values()) == {0}


def test_exported_cancels_keep_unknown_orders(spark):
    trades = spark.createDataFrame([(1, 'a "b", c')], "id long, note string")
    orders = spark.createDataFrame([(7, "B", 10, 5, "t0")], "order_id long, side string, price long, quantity long, order_time string")
    cancels = spark.createDataFrame([(7, "t1"), (8, "t2")], "order_id long, cancel_time string")
    path = new_path(spark, "records")
    io.export_records(trades, cancels, orders, path)
    back = io.read_tree(spark, f"{path}/cancels", "*.csv", "order_id long, side string, price long, quantity long, order_time string, cancel_time string")
    assert sorted(map(tuple, back.collect())) == [(7, "B", 10, 5, "t0", "t1"), (8, None, None, None, None, "t2")]
    assert io.read_tree(spark, f"{path}/trades", "*.csv", trades.schema).first()["id"] == 1
