"""Matching within a tolerance against brute force; key sets; preflight with planted failures."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowmill.operators import agreement as A

COLUMNS = ["k", "real_value", "sim_value", "n", "status"]


def greedy(real, sim, tolerance):
    """Closest pair first, over all pairs of single rows."""
    out, real, sim = Counter(), list(real), list(sim)
    while True:
        pairs = [
            ((0 if a[1] is None else abs(a[1] - b[1]), a[1], b[1]), i, j) for i, a in enumerate(real) for j, b in enumerate(sim)
            if a[0] == b[0] and (a[1] is None) == (b[1] is None) and (a[1] is None or abs(a[1] - b[1]) <= tolerance)
        ]
        if not pairs:
            break
        _, i, j = min(pairs, key=lambda p: tuple((x is not None, x or 0) for x in p[0]))
        out[(real[i][0], real[i][1], sim[j][1], "matched")] += 1
        del real[i], sim[j]
    for k, v in real:
        out[(k, v, None, "missing")] += 1
    for k, v in sim:
        out[(k, None, v, "extra")] += 1
    return out


def matched(spark, real, sim, tolerance, kind="long"):
    a, b = (spark.createDataFrame(rows, f"k string, v {kind}") for rows in (real, sim))
    rows = A.match_within(a, b, ["k"], "v", tolerance).select(*COLUMNS).collect()
    out = Counter()
    for k, x, y, n, status in rows:
        assert n > 0
        out[(k, x, y, status)] += n
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matching_equals_closest_pair_first(spark, seed):
    draw = random.Random(seed)
    side = lambda n: [(draw.choice(["a", "b", None]), draw.choice([None, *range(40)])) for _ in range(n)]
    real, sim = side(60), side(50)
    tolerance = [0, 1, 3, 50][seed]
    assert matched(spark, real, sim, tolerance) == greedy(real, sim, tolerance)


def test_both_sides_of_the_tolerance(spark):
    real = [("at", 1.0), ("over", 1.0), ("below", 1.0), ("nan", float("nan"))]
    sim = [("at", 1.25), ("over", 1.2500001), ("below", 0.75), ("nan", float("nan"))]
    got = {(k, s): n for (k, _, _, s), n in matched(spark, real, sim, 0.25, "double").items()}
    assert got == {("at", "matched"): 1, ("below", "matched"): 1, ("over", "missing"): 1, ("over", "extra"): 1, ("nan", "matched"): 1}


def test_a_chain_takes_a_round_a_pair(spark):
    # each value's closest partner prefers the next one, so only the end of the chain settles at once
    real, sim, at = [], [], 0
    for gap in range(12, 0, -1):
        (real if gap % 2 else sim).append(("c", at))
        at += gap
    assert matched(spark, real, sim, 12) == greedy(real, sim, 12)


def test_a_hot_value_is_counted_not_paired(spark):
    one = spark.range(30_000).select(F.lit("h").alias("k"), F.lit(5).cast("long").alias("v"))
    two = spark.range(20_000).select(F.lit("h").alias("k"), F.lit(6).cast("long").alias("v"))
    rows = {r["status"]: r["n"] for r in A.match_within(one, two, ["k"], "v", 1).collect()}
    assert rows == {"matched": 20_000, "missing": 10_000}


def test_empty_sides_and_cut(spark):
    none = spark.createDataFrame([], "k string, v long")
    some = spark.createDataFrame([("a", 1)], "k string, v long")
    assert A.match_within(none, none, ["k"], "v", 1).collect() == []
    assert [r["status"] for r in A.match_within(some, none, ["k"], "v", 1).collect()] == ["missing"]
    assert [r["status"] for r in A.match_within(none, some, ["k"], "v", 1).collect()] == ["extra"]
    with pytest.raises(ValueError):
        A.match_within(some, some, ["k"], "v", -1)
    times = spark.createDataFrame([("1",), ("9",), ("10",), (None,), ("x",)], "t string")
    assert [r["t"] for r in A.before_cut(times, "t", 10).collect()] == ["1", "9"]
    assert A.before_cut(times, "t", None).count() == 5


def test_key_agreement_lists_every_combination(spark):
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    sets = {"x": keys("a", "b", None), "y": keys("a", "c", "c", None), "z": keys("a", "d")}
    rules = [A.Rule("whole", ["x", "y", "z"], passes=True), A.Rule("no_z", ["x", "y"], ["z"], passes=True), A.Rule("only_y", ["y"], ["x", "z"], passes=True)]
    got = {r["present"]: (r["mask"], r["n_keys"], r["n_repeated"], r["status"], r["verdict"]) for r in A.key_agreement(sets, ["k"], rules).collect()}
    assert got == {
        "x,y,z": (7, 1, 0, "whole", "pass"), "x,y": (3, 1, 0, "no_z", "pass"), "x": (1, 1, 0, "unruled", "fail"),
        "y": (2, 1, 1, "only_y", "fail"), "z": (4, 1, 0, "unruled", "fail"),
    }
    with pytest.raises(ValueError):
        A.key_agreement(sets, ["k"], [A.Rule("typo", ["w"])]).collect()


def test_preflight_finds_each_planted_failure(spark):
    days = [f"d{i}" for i in range(5)]
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date string, calendar_index long")
    table = lambda rows: spark.createDataFrame(rows, "date string, symbol string")
    universe = [(d, s) for d in days for s in "abc"]

    def bad(embedded, members=universe):
        rows = A.period_preflight(table(embedded), table(members), calendar, ["date", "symbol"], 2, 2).collect()
        assert all((r["status"] == "fail") == (r["bad"] > 0) for r in rows) and len(rows) == 6
        return {r["check_id"]: r["bad"] for r in rows if r["bad"]}

    whole = [(d, s) for d in days[:3] for s in "abc"]
    assert bad(whole) == {}
    assert bad([*whole, ("d0", "a")]) == {"repeated_keys": 1}
    assert bad([*whole, ("d3", "a"), ("d3", "b")]) == {"cut_horizon": 1}
    assert bad([*whole, ("x", "a"), ("x", "b")], [*universe, ("x", "a"), ("x", "b")]) == {"off_calendar": 1}
    assert bad([*whole[:-3], ("d2", "z")]) == {"lost_days": 1, "narrow_days": 1}
    assert bad(whole[:-2]) == {"narrow_days": 1}
    assert bad([]) == {"no_days": 1}
