import itertools
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.operators import checks as C, panel as P, splits as S, xsection as X
from flowmill.session import new_path, shared_dir
from flowmill.sources import io
from flowmill.streaming import streams as L
from flowmill.streaming.store import StreamStore


def cross(spark, days=4, names=25, seed=0, perfect=False):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for s in range(names):
            r = float(rng.normal() / 50)
            rows.append((f"2024-01-{d + 1:02d}", f"{s:06d}", s, r if perfect else round(float(rng.normal()), 1), r, s % 6 != 0))
    return spark.createDataFrame(rows, "date string, symbol string, symbol_id long, score double, fwd_ret double, eligible_at_signal boolean")


def test_perfect_score_has_ic_one(spark):
    df = cross(spark, perfect=True)
    assert [r["ic"] for r in X.rank_ic(df).collect()] == pytest.approx([1.0] * 4)
    groups = X.group_means(X.quantile_returns(df, 5)).orderBy("group").toPandas()["ret"]
    assert groups.is_monotonic_increasing
    assert {r["ndcg"] for r in X.head_metrics(df, [5]).withColumn("ndcg", F.round("ndcg", 9)).collect()} == {1.0}


def test_rank_correlation_is_exact(spark):
    """A correlation of zero is zero in any layout; others equal the fraction of integer sums."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, 500) / 7.0
    y = np.where(rng.random(500) < 0.5, x, rng.normal(size=500))
    rows = [("even", float(i), float(abs(i))) for i in range(-6, 7)] + [("mixed", float(a), float(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "date string, score double, fwd_ret double")
    ranks = [np.array([2 * (v < u).sum() + (v == u).sum() + 1 for u in v], dtype=object) for v in (x, y)]
    n, (a, b) = len(x), ranks
    want = float(n * (a @ b) - a.sum() * b.sum()) / (float(n * (a @ a) - a.sum() ** 2) ** 0.5 * float(n * (b @ b) - b.sum() ** 2) ** 0.5)
    for parts in (1, 3, 11):
        got = {r["date"]: r["ic"] for r in X.rank_ic(df.repartition(parts)).collect()}
        assert got == {"even": 0.0, "mixed": pytest.approx(want, rel=1e-14)}


def test_ic_is_null_for_thin_or_constant_days(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", float("nan"), 1.0)], "date string, score double, fwd_ret double")
    assert {r["date"]: r["ic"] for r in X.rank_ic(df).collect()} == {"a": None, "b": None}


def test_newey_west_against_numpy(spark):
    v = np.random.default_rng(3).normal(0.02, 0.1, 120)
    df = spark.createDataFrame([(f"{i:04d}", float(x)) for i, x in enumerate(v)], "date string, ic double")
    r = X.ic_statistics(df).first()
    n, m, c = v.size, v.mean(), v - v.mean()
    lag = int(4 * (n / 100) ** (2 / 9))
    lrv = c @ c / n + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
    assert r["hac_lags"] == lag and r["newey_west_t"] == pytest.approx(m / math.sqrt(lrv / n))
    assert r["icir"] == pytest.approx(m / v.std(ddof=1))


def test_bootstrap_brackets_the_mean_and_repeats(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.random.default_rng(1).normal(1, 0.1, 40))], "i long, v double")
    a, b = (X.block_bootstrap(df, "v", draws=200).first() for _ in range(2))
    assert a == b and a["low"] < 1.0 < a["high"]


def test_deflated_sharpe_closed_form():
    assert X.deflated_sharpe_ratio(0.2, 2, 100, 0.0) > 0.9
    assert math.isnan(X.deflated_sharpe_ratio(0.2, 0, 100, 0.1))
    few, many = (X.deflated_sharpe_ratio(0.15, n, 250, 0.01) for n in (2, 200))
    assert 0 <= many < few <= 1


@pytest.mark.parametrize("long_short", [False, True])
def test_backtest_equals_a_day_loop(spark, long_short):
    df = cross(spark, days=6)
    pdf = df.toPandas()
    k, want, prev = 5, [], (set(), set())
    for _, day in pdf.groupby("date"):
        day = day.sort_values(["score", "symbol"], ascending=[False, True])
        top, low = day.head(k), day.tail(k) if long_short else day.head(0)
        gross = 0.5 * (top.fwd_ret.mean() - low.fwd_ret.mean()) if long_short else top.fwd_ret.mean()
        now = (set(top.symbol), set(low.symbol))
        turn = sum(len(a ^ b) for a, b in zip(now, prev)) / (2 * k)
        want.append(gross - turn * 15 / 1e4)
        prev = now
    got = X.topk_daily(df, [k], long_short=long_short).orderBy("date").toPandas()["ret"]
    np.testing.assert_allclose(got, want, atol=1e-12)
    s = X.backtest_topk(df, [k], long_short=long_short).first()
    eq = np.cumprod(1 + np.array(want))
    assert s["cum_return"] == pytest.approx(eq[-1] - 1) and s["sharpe"] is None and not s["reliable"]
    assert s["max_drawdown"] == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())


def test_residuals_equal_lstsq(spark):
    df = cross(spark, days=2).withColumn("f2", F.pow("score", F.lit(2.0)))
    got = X.residualise(df, ["score", "f2"]).toPandas().sort_values(["date", "symbol"])["neutralized_ret"]
    want = []
    for _, day in df.toPandas().sort_values(["date", "symbol"]).groupby("date"):
        a = np.column_stack([np.ones(len(day)), day.score, day.f2])
        want += list(day.fwd_ret - a @ np.linalg.lstsq(a, day.fwd_ret, rcond=None)[0])
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_eligibility_rules(spark):
    df = spark.createDataFrame([(1, "true"), (2, "true"), (3, "false"), (4, None), (5, "true")], "i long, eligible_at_signal string")
    assert [r["i"] for r in P.eligible_rows(df).orderBy("i").collect()] == [1, 2, 5]
    old = spark.createDataFrame([(1, False, None), (2, True, False)], "i long, is_st boolean, is_halt boolean")
    assert [r["i"] for r in P.eligible_rows(old).collect()] == [1]


def test_labels_drop_non_finite_returns_and_match_numpy(spark):
    df = cross(spark, days=1, names=40).unionByName(
        spark.createDataFrame([("2024-01-01", "x", 0, 0.0, v, True) for v in (None, float("nan"), float("inf"), float("-inf"))], cross(spark, 1, 1).schema))
    got = P.day_labels(df, min_names=20).toPandas().sort_values("symbol_id")
    assert len(got) == 40
    x = got["fwd_ret"].to_numpy()
    xs = x - x.mean()
    mad = np.median(np.abs(xs - np.median(xs)))
    np.testing.assert_allclose(got["aux_target"], np.clip((xs - np.median(xs)) / (1.4826 * mad), -3, 3), atol=1e-9)
    np.testing.assert_allclose(got["label"], x.argsort().argsort() / 39)


def test_scoring_rejects_future_columns(spark):
    df = spark.createDataFrame([("d", "s", 1.0, 2.0)], "date string, symbol string, emb_0 double, target_x double")
    with pytest.raises(ValueError):
        P.scoring_features(df)
    assert P.forbidden_columns(df) == ["target_x"]
    with pytest.raises(ValueError):
        X.linear_scores(df.drop("target_x"), ["emb_1"], [1.0])


def calendar(spark, n):
    return spark.createDataFrame([(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", i) for i in range(n)], "date string, calendar_index long")


def test_regime_windows_need_twenty_days(spark):
    cal = calendar(spark, 25)
    state = cal.select("date", F.lit(0.01).alias("market_return"), F.lit(10.0).alias("total_amount"), F.lit(0.0).alias("market_breadth"))
    rows = P.market_features(state, cal).collect()
    assert len(rows) == 6 and rows[0]["market_return_20d"] == pytest.approx(1.01**20 - 1)
    gap = state.where(F.col("date") != cal.collect()[12]["date"])
    assert P.market_features(gap, cal).count() == 0


def test_regime_rows_without_quote_or_history_stay(spark):
    cal = calendar(spark, 25)
    keys = cal.select("date", F.explode(F.array(F.lit("600001"), F.lit("600002"), F.lit("600003"))).alias("symbol"))
    quotes = keys.where("symbol <> '600003'").select(
        "date", "symbol", F.lit("SH").alias("market"), F.lit("MAIN").alias("board"), F.lit(0.01).alias("ret_1d"), F.lit(10.0).alias("amount")
    )
    atomic = keys.unionByName(keys.limit(1).withColumn("symbol", F.lit("999999"))).withColumn("x", F.lit(1))
    out = P.regime_features(atomic, quotes, keys, cal).cache()
    rows = out.collect()
    assert len(rows) == 76 and {round(r["return_coverage"], 6) for r in rows} == {round(2 / 3, 6)}
    assert sum(r["market_return_20d"] is None for r in rows) == 19 * 3 + 1
    assert {r["symbol"] for r in rows if not r["has_quote"]} == {"600003", "999999"}
    bad = {r["check"]: r["bad_rows"] for r in P.regime_violations(out, 0.9).collect()}
    assert bad == {"in_universe": 1, "has_quote": 26, "has_history": 58, "coverage": 76}


def test_purged_folds_brute_force(spark):
    n, g, purge, embargo = 29, 5, 2, 1
    edge = [k * n // g for k in range(g + 1)]
    got = {}
    for r in S.purged_folds(calendar(spark, n), g, 2, purge, embargo).collect():
        got.setdefault(r["fold"], {})[r["date"]] = r["role"]
    days = [r["date"] for r in calendar(spark, n).collect()]
    for fold, combo in enumerate(itertools.combinations(range(g), 2)):
        test = {i for k in combo for i in range(edge[k], edge[k + 1])}
        near = {i + s for i in test for s in range(-purge, purge + embargo + 1)}
        want = {d: "test" if i in test else "blocked" if i in near else "train" for i, d in enumerate(days)}
        assert got[fold] == want


def test_causal_windows_emit_every_row_once(spark):
    for context, stride in ((4, 4), (5, 2), (3, 1)):
        df = spark.createDataFrame([(n,) for n in range(0, 16)], "n long")
        seen = {}
        for r in S.causal_windows(df, "n", context, stride).orderBy("n", "start").collect():
            seen.setdefault(r["n"], []).extend(range(r["start"] + r["emit_start"], r["end"]))
        assert seen == {n: list(range(n)) for n in range(1, 16)}


def test_tail_split_shares_and_spacing(spark):
    cal = calendar(spark, 20)
    roles = [r["role"] for r in S.tail_split(cal, 3, 2, 10).orderBy("date").collect()]
    assert roles == ["train"] * 15 + ["purge"] * 2 + ["val"] * 3
    assert {r["role"] for r in S.tail_split(cal, 3, 2, 30).collect()} == {"train"}
    days = [r["date"] for r in cal.collect()]
    assert S.share_boundaries(cal) == (days[13], days[16])
    assert {r["date"] for r in S.evenly_spaced_days(cal, 3).collect()} == {days[0], days[9], days[19]}
    with pytest.raises(ValueError):
        S.date_plan(cal, (10, 10, 10), days[-1], 5, 1, 1)


def test_balanced_sample_and_epoch_are_order_free(spark):
    df = spark.range(300).select(F.when(F.col("id") < 200, "a").when(F.col("id") < 290, "b").otherwise("c").alias("s"), "id")
    pick = lambda d: sorted(r["id"] for r in S.balanced_sample(d, ["s"], ["id"], 45).collect())
    assert pick(df) == pick(df.repartition(7))
    sizes = S.balanced_sample(df, ["s"], ["id"], 45).groupBy("s").count().toPandas().set_index("s")["count"].to_dict()
    assert sizes["c"] == 10 and abs(sizes["a"] - sizes["b"]) <= 1
    out = S.epoch_assignment(df, "s", "id", epoch=1, ranks=7).toPandas()
    assert sorted(out["position"]) == list(range(301)) and set(out.groupby("rank").size()) == {43}
    assert (out.sort_values("position").head(300)["s"] != out.sort_values("position").head(300)["s"].shift()).sum() == 3


def test_padded_windows(spark):
    df = spark.range(10).select(F.lit("k").alias("k"), F.col("id").alias("p"), (F.col("id") + 100).alias("t"))
    rows = S.padded_windows(df, ["k"], "p", "t", 4, 3, 2).orderBy("start").collect()
    assert [(r["start"], r["tokens"]) for r in rows] == [(0, [100, 101, 102, 103]), (3, [103, 104, 105, 106]), (6, [106, 107, 108, 109])]
    assert S.event_windows(spark.createDataFrame([(10,)], "n long"), "n", 4, 3, 2).count() == 3


def test_checks_report_and_raise(spark):
    good = spark.createDataFrame([("2024-01-01", "000001", 0.5)], "date string, symbol string, score double")
    assert C.validate_scores(good).count() == 1
    for bad in ([("2024-02-30", "000001", 0.5)], [("2024-01-01", "1", 0.5)], [("2024-01-01", "000001", float("nan"))], [("2024-01-01", "000001", 0.5)] * 2):
        with pytest.raises(ValueError):
            C.validate_scores(spark.createDataFrame(bad, good.schema))
    with pytest.raises(ValueError):
        C.validate_scores(good.withColumn("label", F.lit(1)))
    report = C.run_checks(good, [C.Check("w", F.col("score") > 1, "warning")]).first()
    assert report["status"] == "warn" and report["bad_rows"] == 1


def test_paths_and_calendar(spark):
    assert io.day_key("2024.03.05", "2", "root") == "root/2024.03/2024.03.05/default/2/all.parquet"
    assert io.symbol_keys("p", "sh", ["1"]) == ["p/SH000001.parquet"]
    assert io.message_prefix("2024-03-05", "XSHE", "order", "r/", "x") == "r/DATASET=x/DATE=2024-03-05/MIC=XSHE/TYPE=order/"
    for call in (lambda: io.parse_date("05/03/2024"), lambda: io.symbol_keys("p", "HK", ["1"]), lambda: io.read_tree(spark, "/tmp", "*.csv")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(FileNotFoundError):
        io.union_relaxed([])


def test_dynamic_overwrite_keeps_other_days(spark):
    path = new_path(spark, "sink")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "day string, v long")
    io.write_partitioned(df, path, ["day"], ["v"])
    io.write_partitioned(df.where("day = 'b'").withColumn("v", F.lit(9).cast("long")), path, ["day"], ["v"])
    assert {(r["day"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 9)}


def fake_session(master, **conf):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k, default)), sparkContext=context)


def test_a_day_split_over_batches_is_scored_from_all_rows(spark):
    rows = [(i, f"2024-01-0{1 + i // 4}", "a", float(i)) for i in range(12)]
    parts = [rows[:6], rows[6:], rows[4:6]]  # the second day is split, and a part of it arrives again
    arrivals = [spark.createDataFrame(x, "event_id long, date string, symbol string, value double") for x in parts]
    out = new_path(spark, "split-day")
    score = lambda df: df.groupBy("date", "symbol").agg(F.sum("value").alias("score"), F.count(F.lit(1)).alias("n"))
    L.replay(spark, arrivals, L.new_day_scores(StreamStore(spark), out, score, ["event_id"]))
    got = {str(r["date"]): (r["score"], r["n"]) for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": (6.0, 4), "2024-01-02": (22.0, 4), "2024-01-03": (38.0, 4)}


def test_shared_folder_comes_from_the_session():
    named = fake_session("spark://host", **{"spark.checkpoint.dir": "s3a://shared/ckpt"})
    assert shared_dir(named) == "s3a://shared/ckpt" and new_path(named, "x").startswith("s3a://shared/ckpt/flowmill/app-spark://host/x-")
    with pytest.raises(RuntimeError):
        shared_dir(fake_session("spark://host"))
    local = fake_session("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_ledger_trades_at_the_weights_of_the_names(spark):
    held = spark.createDataFrame(
        [(1, "A", 0.5, 0.0), (1, "B", 0.5, 0.0), (2, "C", 0.7, 0.0), (2, "D", 0.3, 0.0)], "date int, symbol string, weight double, fwd_ret double"
    )
    days = spark.createDataFrame([(1,), (2,), (3,)], "date int")
    out = X.ledger(held, 10.0, 10.0, calendar=days).orderBy("date").collect()
    assert [(round(r["buy_notional"], 9), round(r["sell_notional"], 9), r["n_holdings"]) for r in out] == [(1.0, 0.0, 2), (1.0, 1.0, 2), (0.0, 1.0, 0)]
    assert out[2]["cash_weight"] == 1.0 and abs(out[2]["cost"] - 1e-3) < 1e-12


def test_stylised_facts_keep_short_keys(spark):
    rows = [("long", i, float(i * i % 7)) for i in range(30)] + [("short", i, float(i)) for i in range(3)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "symbol string, i int, r double")
    out = {r["symbol"]: r for r in X.stylised_facts(df, ["symbol"], ["i"], "r", 5).collect()}
    assert out["long"]["vol_clustering_acf"] is not None
    assert (out["short"]["n_rows"], out["none"]["n_rows"]) == (3, 0) and out["short"]["excess_kurtosis"] is None
