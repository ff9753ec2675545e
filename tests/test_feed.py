import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowmill.functions import market as M
from flowmill.functions.scalars import is_finite, is_iso_date, parse_day, zero_fill
from flowmill.operators import blocks as B, events as E

RAW = "symbol string, market string, date string, type string, int_time long, local_time long, serial long, trade_type string, order_type string, bsflag string, trade_price long, order_price long, trade_volume long, order_volume long, orderorino long, buy_id long, sell_id long"


def raw(spark, rows):
    """rows: (type, int_time, local_time, serial)"""
    data = [("1", "SZ", "2026-01-05", k, t, lt, s, "F", "A", "B", 100, 100, 100, 100, 0, 0, 0) for k, t, lt, s in rows]
    return spark.createDataFrame(data, RAW)


def test_trade_precedes_order_on_ties_and_versions_differ(spark):
    rows = [("T", 93000000, 40, 1), ("T", 93000000, 10, 2), ("T", 93000001, 30, 3), ("O", 93000000, 20, 1), ("O", 93000002, 5, 4)]
    def order(version):
        out = E.event_stream(raw(spark, rows), version).orderBy("event_idx").collect()
        return [(r["type"], r["int_time"], r["serial"]) for r in out]
    assert order(E.ORDER_EXCHANGE_V2) == [
        ("T", 93000000, 1), ("O", 93000000, 1), ("T", 93000000, 2), ("T", 93000001, 3), ("O", 93000002, 4)]
    assert [r[2] for r in order(E.ORDER_LOCAL_V1)] == [4, 2, 1, 3, 1]
    with pytest.raises(ValueError):
        E.order_columns("other")


def test_standardize_defaults_and_long_symbols(spark):
    df = spark.createDataFrame([("1234567", 5), (None, 6)], "symbol string, serial long")
    got = E.standardize(df, is_trade=False).orderBy("serial").collect()
    assert got[0]["symbol"] == "123456" and got[0]["order_type"] == "O" and got[0]["trade_price"] == 0
    assert E.standardize(df, is_trade=True).first()["order_type"] == "0"


def test_scalars(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(is_finite("x")).collect()] == [True, False, False, False]
    df = spark.createDataFrame([("1",), ("1234567",)], "s string")
    assert [r[0] for r in df.select(zero_fill("s")).collect()] == ["000001", "1234567"]
    df = spark.createDataFrame([("2024-02-30",), ("2024-01-31",), ("2024.01.31",), ("x",), (None,)], "d string")
    assert [r[0] for r in df.select(is_iso_date("d")).collect()] == [False, True, False, False, False]
    assert [str(r[0]) for r in df.select(parse_day("d")).collect()] == ["None", "2024-01-31", "2024-01-31", "None", "None"]


def test_clock_grid_golden(spark):
    times = [92000000, 93000000, 93500000, 113000000, 120000000, 130000000, 150000000]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    got = [r[0] for r in df.select(M.clock_interval(M.packed_to_ms("t"))).collect()]
    assert got == [0, 1, 2, 24, -1, 25, 48]
    with pytest.raises(ValueError):
        M.clock_interval("t", 7)


def test_boards_and_time_text(spark):
    rows = [("688001", "SH", "STAR"), ("600000", "SH", "MAIN"), ("300750", "SZ", "CHINEXT"), ("2001", "SZ", "SME"),
            ("1", "SZ", "MAIN"), ("920001", "SZ", "BSE"), ("830001", "SZ", "BSE"), ("500001", "SH", "UNKNOWN")]
    df = spark.createDataFrame(rows, "s string, m string, want string")
    assert df.where(M.board_name("s", "m") != F.col("want")).count() == 0
    one = spark.createDataFrame([("2024-01-02", 93005007)], "d string, t long")
    assert one.select(M.time_text("d", "t")).first()[0] == "2024-01-02 09:30:05.007"
    bad = spark.createDataFrame([(250000000,), (93000000,), (-1,), (None,)], "t long")
    assert [r[0] for r in bad.select(M.packed_time_valid("t")).collect()] == [False, True, False, False]


def loop_mid(price, qty, trade, ms, half, legacy):
    num = den = 0.0
    mid, last, t0 = [], np.nan, ms[0]
    for p, q, k, t in zip(price, qty, trade, ms):
        if k and q > 0 and p > 0:
            w = 0.5 ** (max(t - t0, 0) / half)
            num, den, t0 = num * w + p * q, den * w + q, t
            last = num / den
        if np.isnan(last) and p > 0:
            last = p
        mid.append(last)
    mid = np.array(mid)
    if legacy and np.isnan(mid).any():
        first = np.flatnonzero(~np.isnan(mid))
        mid[: first[0] if first.size else len(mid)] = mid[first[0]] if first.size else 1.0
    return mid


@pytest.mark.parametrize("version", [E.TRANSFORM_CAUSAL_V2, E.TRANSFORM_BACKFILL_V1])
@pytest.mark.parametrize("width", [7, None])
def test_ew_vwap_equals_the_event_loop(spark, version, width):
    rng = np.random.default_rng(5)
    n = 400
    ms = np.sort(np.concatenate([rng.integers(34_200_000, 41_400_000, n // 2), rng.integers(46_800_000, 53_800_000, n // 2)]))
    price = rng.uniform(9, 11, n).round(2)
    price[:4] = 0.0
    qty = rng.integers(0, 5, n) * 100.0
    trade = rng.random(n) < 0.3
    trade[:12] = False
    rows = [("k", i, float(p), float(q), bool(k), int(t)) for i, (p, q, k, t) in enumerate(zip(price, qty, trade, ms))]
    df = spark.createDataFrame(rows, "key string, i long, p double, q double, tr boolean, ms long")
    got = E.ew_vwap(df, ["key"], ["i"], "p", "q", F.col("tr"), "ms", 5000.0, version, width=width).orderBy("i").toPandas()["mid"]
    want = loop_mid(price, qty, trade, ms, 5000.0, version == E.TRANSFORM_BACKFILL_V1)
    np.testing.assert_allclose(got.to_numpy(dtype=float), want, rtol=1e-12)


def test_ew_vwap_leading_rows(spark):
    df = spark.createDataFrame([("k", 0, 0.0, 0.0, False, 0), ("k", 1, 0.0, 0.0, False, 1), ("k", 2, 10.0, 100.0, True, 2)],
                               "key string, i long, p double, q double, tr boolean, ms long")
    run = lambda v: [r["mid"] for r in E.ew_vwap(df, ["key"], ["i"], "p", "q", F.col("tr"), "ms", 5000.0, v).orderBy("i").collect()]
    assert run(E.TRANSFORM_CAUSAL_V2) == [None, None, 10.0]
    assert run(E.TRANSFORM_BACKFILL_V1) == [10.0, 10.0, 10.0]
    with pytest.raises(ValueError):
        E.ew_vwap(df, ["key"], ["i"], "p", "q", F.col("tr"), "ms", 0.0)


def test_features_do_not_see_the_future(spark):
    rows = [("T" if i % 3 else "O", 93000000 + 700 * i, i, i) for i in range(60)]
    cols = ["event_idx", "mid", "price_rel", "log_delta_t", "log_volume"]
    def feats(r):
        return E.derived_features(E.canonical_v1(E.event_stream(raw(spark, r)))).select(cols).orderBy("event_idx").toPandas()
    whole, part = feats(rows), feats(rows[:30])
    assert whole.head(30).equals(part)


def test_ordering_audit_counts(spark):
    rows = [(0, 5, 1, 0), (1, 4, 9, 0), (2, 4, 8, 0), (3, 4, 8, 0), (4, 4, 8, -1), (5, 6, None, 0)]
    df = spark.createDataFrame([("f", *r) for r in rows], "f string, pos long, t long, s long, e long")
    got = E.ordering_audit(df, ["f"], "pos", ["t", "s", "e"]).first().asDict()
    assert (got["time_inversions"], got["sequence_inversions"], got["tie_inversions"]) == (1, 1, 1)
    assert got["first_bad_row"] == 1 and got["null_ordering_values"] == 1 and got["n_rows"] == 6


def test_book_version_needs_a_state_for_every_event(spark):
    s = E.event_stream(raw(spark, [("T", 93000000, 1, 1), ("O", 93000001, 2, 2)]))
    book = spark.createDataFrame([("2026-01-05", "1", 0, True, 1.0)], "date string, symbol string, event_idx long, book_valid_post boolean, imbalance_l1_post double")
    book = book.withColumn("symbol", zero_fill("symbol"))
    with pytest.raises(PySparkException):
        E.canonical(s, "v2", book).collect()
    with pytest.raises(ValueError):
        E.canonical(s, "v2")


def test_dense_blocks_need_no_quantiles(spark):
    df = spark.range(100).select(F.lit("k").alias("key"), F.col("id").alias("i"))
    got = B.running(df, ["key"], ["i"], {"p": B.previous(F.col("i")), "n": B.number()}, width=9).orderBy("i").collect()
    assert [r["p"] for r in got] == [None, *range(99)] and [r["n"] for r in got] == list(range(1, 101))


def test_ew_vwap_on_a_clock_that_steps_back(spark):
    ms, price, qty = [0, 4000, 1000, 2500, 3000], [10.0, 11.0, 12.0, 99.0, 13.0], [100.0] * 5
    trade = [True, True, True, False, True]
    rows = [("k", i, *r) for i, r in enumerate(zip(price, qty, trade, ms))]
    df = spark.createDataFrame(rows, "key string, i long, p double, q double, tr boolean, ms long")
    out = E.ew_vwap(df, ["key"], ["i"], "p", "q", F.col("tr"), "ms", 5000.0).orderBy("i").toPandas()
    want = loop_mid(np.array(price), np.array(qty), np.array(trade), np.array(ms), 5000.0, False)
    np.testing.assert_allclose(out["mid"].to_numpy(dtype=float), want, rtol=1e-12)
