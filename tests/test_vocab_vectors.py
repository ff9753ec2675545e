import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowmill.operators import checks as C, vectors as W, vocab as V


def shards(spark, missing=False):
    rows = [(f"d{s}", f"e{s}", "ADD", s * 100 + i, None if missing and i == 0 else float(s)) for s in (0, 1) for i in range(20)]
    return spark.createDataFrame(rows, "date string, exchange string, evt_type string, event_idx long, x double")


SPEC = V.FieldSpec("x", "x", "ordinal", 4)


def test_two_value_fit(spark):
    v = V.fit_vocab(shards(spark), [SPEC])
    assert v.numeric["x"].edges == (0.5,) and v.numeric["x"].occupancy == (20, 20)
    assert v.fit_dates == ("d0", "d1")
    m = V.fit_vocab(shards(spark, True), [SPEC]).numeric["x"]
    assert (m.n_observed, m.n_missing) == (38, 2)


def test_fit_does_not_depend_on_row_order(spark):
    rng = np.random.default_rng(0)
    rows = [("d", "ab"[i % 2], "ADD", i, float(x)) for i, x in enumerate(rng.normal(size=400))]
    schema = "date string, exchange string, evt_type string, event_idx long, x double"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(rows[::-1], schema).repartition(5)
    fit = lambda d: V.fit_vocab(d, [SPEC])
    one, two = fit(a), fit(b)
    assert one.numeric["x"].edges == two.numeric["x"].edges and one.numeric["x"].occupancy == two.numeric["x"].occupancy
    assert one.numeric["x"].mean == pytest.approx(two.numeric["x"].mean, rel=1e-12)
    assert V.Vocab.from_json(one.to_json()) == one


def test_priority_sample_equals_sort_and_cut(spark):
    rows = [("d", "abc"[min(i % 7, 2)], "ADD", i, float(i)) for i in range(700)]
    df = spark.createDataFrame(rows, "date string, exchange string, evt_type string, event_idx long, x double")
    keys = {"exchange=a": 20, "exchange=b": 30, "exchange=c": 40}
    got = V.priority_sample(df, SPEC, ["exchange"], keys, ["event_idx"])
    every = df.withColumn("priority", V.key_digest(F.lit(0), F.lit("x"), "event_idx")).toPandas()
    want = {e for k, n in keys.items() for e in every[every.exchange == k[-1]].nsmallest(n, "priority").event_idx}
    assert {r["event_idx"] for r in got.collect()} == want


def test_quotas(spark):
    def quotas(sizes, budget):
        table = spark.createDataFrame(list(sizes.items()), "stratum string, n bigint")
        return {r["stratum"]: r["quota"] for r in V.quotas(table, budget).collect()}

    q = quotas({"a": 1000, "b": 10, "c": 1, "z": 0}, 100)
    assert sum(q.values()) == 100 and q["c"] == 1 and q["b"] >= 1 and "z" not in q
    assert quotas({"a": 3, "b": 2}, 10) == {"a": 3, "b": 2}
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sizes = {f"s{i}": int(n) for i, n in enumerate(rng.integers(1, 500, 9))}
        q = quotas(sizes, 9 + int(rng.integers(0, 400)))
        assert all(1 <= q[k] <= n for k, n in sizes.items())
    with pytest.raises(ValueError):
        quotas({"a": 5, "b": 5, "c": 5}, 2)


@pytest.mark.parametrize("two_sided", [False, True])
def test_edges_equal_numpy(spark, two_sided):
    x = np.random.default_rng(2).lognormal(size=500)
    lo, hi = np.quantile(x, [0.01 if two_sided else 0.0, 0.99])
    c = np.clip(x, lo, hi)
    want = [e for e in np.quantile(c, np.linspace(0, 1, 9)[1:-1]) if lo < e < hi]
    got = V.quantile_edges(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 8, two_sided)
    np.testing.assert_allclose(got, np.unique(want), rtol=1e-12)


def test_constant_and_empty_columns(spark):
    same = spark.createDataFrame([(3.0,)] * 5, "x double")
    assert V.quantile_edges(same, "x", 8) == []
    assert len(V.quantile_edges_v1(same, "x", 8)) == 7
    none = spark.createDataFrame([(None,)], "x double")
    assert V.quantile_edges(none, "x", 8) == [] and V.quantile_edges_v1(none, "x", 3) == [-1.0, 1.0]


def test_digitize_boundaries_and_missing(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 2.0, None, float("nan"))], "x double")
    got = [r["b"] for r in V.add_bins(df, {"b": (F.col("x"), [0.5, 1.0])}).collect()]
    assert got == [0, 1, 2, 2, None, None]


def test_tokens_use_special_ids(spark):
    train = shards(spark)
    specs = [SPEC, V.FieldSpec("ex", "exchange", "categorical", applicable=("ADD",))]
    v = V.fit_vocab(train, specs)
    new = spark.createDataFrame([("d", "e1", "ADD", 1, 0.9), ("d", "zz", "ADD", 2, None), ("d", None, "EXEC", 3, 0.1)], train.schema)
    got = V.tokenize(new, v, ["event_idx"]).orderBy("event_idx").collect()
    assert [r["tok_x_bin"] for r in got] == [7, 2, 6] and [r["tok_ex"] for r in got] == [7, 1, 2]
    assert got[1]["val_x"] == 0.0
    assert V.train_entropy(v, "x") == pytest.approx(np.log(2))


def test_storage_roundtrip_and_range(spark):
    xs = [-5.0, -1.25, 0.0, 1.25, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    coded = V.quantise(df, ["v"], 5.0)
    assert [r["v"] for r in coded.collect()][0] == -32767 and dict(coded.dtypes)["v"] == "smallint"
    back = [r["v"] for r in V.dequantise(coded, ["v"], 5.0).collect()]
    assert max(abs(a - b) for a, b in zip(xs, back)) <= 5 / (2 * 32767) + 2e-7
    with pytest.raises(PySparkException):
        V.quantise(spark.createDataFrame([(5.1,)], "v double"), ["v"], 5.0).collect()
    with pytest.raises(PySparkException):
        V.narrow_tokens(spark.createDataFrame([(9,)], "t long"), {"t": 9}).collect()


def test_vocab_checks_catch_bad_artifacts(spark):
    rows = [("a", [1.0, 2.0], [1, 2, 3], 6, 3), ("b", [2.0, 1.0], [1, 2], 4, 2)]
    df = spark.createDataFrame(rows, "field string, edges array<double>, occupancy array<long>, n_observed long, requested int")
    assert {r["check_id"]: r["bad_rows"] for r in V_checks(spark, df)} == {
        "edges_increasing": 1, "one_count_per_bin": 1, "counts_sum_to_observed": 1, "bins_within_request": 0}


def V_checks(spark, df):
    return C.vocab_checks(spark, df).collect()


def test_leave_one_out_context(spark):
    rows = [(0, 1, [1.0], 0, True), (0, 2, [3.0], 0, True), (0, 3, [10.0], 1, True), (0, 4, [99.0], 0, False)]
    df = spark.createDataFrame(rows, "t long, s long, v array<double>, ind long, active boolean")
    got = {r["s"]: r for r in W.cross_context(df, "t", "v", "ind").collect()}
    assert got[1]["market"][0] == pytest.approx(14 / 3)
    assert [got[i]["industry_mean"][0] for i in (1, 2, 3)] == [3.0, 1.0, 0.0]
    assert [got[i]["has_peer"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[4]["market"] == [0.0] and got[4]["own_minus_market"] == [0.0]


def test_pooling_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([("k", i, 34_200_000 + i, [float(v) for v in r]) for i, r in enumerate(x)], "k string, i long, ms long, v array<double>")
    one = lambda m, k=8: W.pool(df, ["k"], ["i"], "v", m, k).first()["pooled"]
    np.testing.assert_allclose(one("mean"), x.mean(axis=0))
    np.testing.assert_allclose(one("last"), x[-1])
    np.testing.assert_allclose(one("lastk_mean"), x[-8:].mean(axis=0))
    wide = W.pool_windows(df, ["k"], ["i"], "v", "ms", 3, ("mean_all", "last_256", "close_call"), tails={"last_256": 5}).first()["pooled"]
    np.testing.assert_allclose(wide, np.concatenate([x.mean(axis=0), x[-5:].mean(axis=0), np.zeros(3)]))
    with pytest.raises(ValueError):
        W.pool(df, ["k"], ["i"], "v", "max")


def test_vector_columns_must_be_contiguous(spark):
    with pytest.raises(ValueError):
        W.to_array(spark.createDataFrame([(1.0, 2.0)], "emb_0 double, emb_2 double"), "v")
    a = spark.createDataFrame([(1.0, 2.0)], "emb_0 double, emb_1 double")
    b = spark.createDataFrame([(1.0, 2)], "emb_0 double, emb_1 int")
    assert C.same_columns(a, a) == [] and C.same_columns(a, b) == ["emb_1"]


def test_clock_alignment_marks_missing(spark):
    df = spark.createDataFrame([("d", "A", 1, [1.0]), ("d", "B", 2, [2.0])], "date string, symbol string, i int, v array<double>")
    out = W.align_to_clock(df, ["date", "symbol"], "i", "v", 60)
    assert out.count() == 10 and out.where("active").count() == 2
