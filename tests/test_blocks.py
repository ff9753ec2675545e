import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowmill.operators import blocks as B


def skewed(rows=600, seed=3, ties=False):
    """One key holds more than a third of the rows; optionally one time holds a third too."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < 0.4, 0, rng.integers(1, 20, rows))
    t = rng.permutation(rows).astype("int64")
    if ties:
        t = np.where(rng.random(rows) < 0.4, 100, t)
    seq = np.arange(rows)
    v = rng.normal(size=rows).round(3)
    return pd.DataFrame({"key": key, "t": t, "seq": seq, "v": v})


@pytest.mark.parametrize("ties", [False, True])
def test_running_matches_pandas(spark, ties):
    pdf = skewed(ties=ties).sort_values(["key", "t", "seq"]).reset_index(drop=True)
    df = spark.createDataFrame(pdf).withColumn("maybe", F.when(F.col("seq") % 5 == 0, F.col("v")))
    got = B.running(
        df, ["key"], ["t", "seq"],
        {
            "n": B.number(), "s": B.total(F.col("seq")), "hi": B.highest(F.col("v")),
            "last": B.latest(F.col("maybe")), "prev": B.previous(F.col("maybe")), "nxt": B.following(F.col("v")),
        },
    ).toPandas().sort_values(["key", "t", "seq"]).reset_index(drop=True)
    pdf["maybe"] = pdf["v"].where(pdf["seq"] % 5 == 0)
    g = pdf.groupby("key")
    assert len(got) == len(pdf)
    assert (got["n"] == g.cumcount() + 1).all()
    assert (got["s"] == g["seq"].cumsum()).all()
    np.testing.assert_array_equal(got["hi"], g["v"].cummax())
    np.testing.assert_array_equal(got["last"], g["maybe"].ffill())
    np.testing.assert_array_equal(got["prev"], g["maybe"].shift(1))
    np.testing.assert_array_equal(got["nxt"], g["v"].shift(-1))


def test_heavy_value_is_split_along_the_tie_breaker(spark):
    df = spark.createDataFrame(skewed(ties=True))
    sizes = B.add_blocks(df, ["t", "seq"]).groupBy(B.BLOCK).count().toPandas()["count"]
    assert sizes.max() < 0.25 * sizes.sum()


def test_average_rank_and_quantiles(spark):
    pdf = skewed().assign(v=lambda d: d["v"].round(1))
    df = spark.createDataFrame(pdf)
    got = B.average_rank(df, ["key"], "v", "r", "n").toPandas().sort_values("seq")
    np.testing.assert_array_equal(got["r"], pdf.groupby("key")["v"].rank("average"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    q = B.quantiles(df, ["key"], "v", probs).toPandas()
    for key, sub in pdf.groupby("key"):
        mine = q[q["key"] == key].sort_values("p_index")["quantile"].to_numpy()
        np.testing.assert_allclose(mine, np.quantile(sub["v"], probs), rtol=0, atol=1e-12)
    whole = B.quantiles(df, [], "v", probs).toPandas().sort_values("p_index")["quantile"]
    np.testing.assert_allclose(whole, np.quantile(pdf["v"], probs), rtol=0, atol=1e-12)
