"""The policy grid against a day-by-day simulation of equal weights."""

import random

import pytest

from flowmill.operators import xsection as X


def by_hand(rows, k, h, w, bps):
    days = sorted({r[0] for r in rows})
    score = {(r[0], r[1]): r[2] for r in rows}
    gain = {(r[0], r[1]): r[3] or 0.0 for r in rows}
    out, held = {}, None
    for i, day in enumerate(days):
        turnover = 0.0
        if i % h == 0:
            means = {}
            for s in {r[1] for r in rows if r[0] == day}:
                seen = [x for x in (score.get((t, s)) for t in days[max(0, i - w + 1) : i + 1]) if x is not None]
                if seen:
                    means[s] = sum(seen) / len(seen)
            new = set(sorted(means, key=lambda s: (-means[s], s))[:k])
            turnover = len(new ^ (held or set())) / (2 * k)
            held = new
        if held:
            gross = sum(gain.get((day, s), 0.0) for s in held) / len(held)
            out[day] = (gross, turnover, gross - turnover * bps / 1e4)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_every_policy_equals_the_simulation(spark, seed):
    draw = random.Random(seed)
    rows = [
        (f"d{day:02}", s, draw.choice([None, *range(6)]), draw.choice([None, 0.01, -0.02, 0.03]))
        for day in range(11) for s in "abcdefgh" if draw.random() < 0.8
    ]
    df = spark.createDataFrame(rows, "date string, symbol string, score long, fwd_ret double")
    ks, hs, ws = [1, 3], [1, 2, 4], [1, 2, 5]
    got = {}
    for r in X.policy_grid(df, ks, hs, ws, [0.0, 20.0]).collect():
        got.setdefault((r["top_k"], r["interval"], r["smoothing"], r["cost_bps"]), {})[r["date"]] = (r["gross"], r["turnover"], r["ret"])
    assert len(got) == len(ks) * len(hs) * len(ws) * 2
    for (k, h, w, bps), days in got.items():
        want = by_hand(rows, k, h, w, bps)
        assert days.keys() == want.keys()
        for day, values in days.items():
            assert values == pytest.approx(want[day], abs=1e-12)


def test_empty_table_and_bad_axis(spark):
    df = spark.createDataFrame([], "date string, symbol string, score long, fwd_ret double")
    assert X.policy_grid(df, [1], [1], [1]).collect() == []
    with pytest.raises(ValueError):
        X.policy_grid(df, [1], [0], [1])
