"""Receipt logs against a fold by hand, for any cutting into blocks."""

import random

import pytest

from flowmill.operators import receipts as R


def by_hand(log):
    out = {}
    for k in {r[0] for r in log}:
        state, bad, unknown = R.NONE, 0, 0
        entries = {(at, e if e in R.LEGAL and e != R.NONE else None) for key, at, e in log if key == k}
        names = list(R.LEGAL)
        for _, e in sorted(entries, key=lambda x: (x[0], -1 if x[1] is None else names.index(x[1]))):
            unknown += e is None
            if e in R.LEGAL[state]:
                state = e
            else:
                bad += 1
        out[k] = (state, len(entries), bad, unknown)
    return out


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_fold_equals_the_log_read_in_order(spark, blocks):
    draw = random.Random(blocks)
    events = [e for e in R.LEGAL if e != R.NONE] * 3 + ["none", "lost", None]
    log = [(draw.choice(["hot"] * 6 + ["a", "b", None]), draw.randrange(150), draw.choice(events)) for _ in range(300)]
    df = spark.createDataFrame(log, "k string, at long, event string")
    got = {r["k"]: (r["state"], r["n_events"], r["n_illegal"], r["n_unknown"]) for r in R.fold_log(df, ["k"], ["at"], "event", blocks=blocks).collect()}
    assert got == by_hand(log)


def test_single_transitions(spark):
    paths = {
        "fine": ["failed", "retried", "written", "verified"], "twice": ["written", "verified", "written"],
        "early": ["verified", "written"], "stuck": ["failed", "written"], "late": ["empty", "written", "verified"],
    }
    df = spark.createDataFrame([(k, i, e) for k, es in paths.items() for i, e in enumerate(es)], "k string, at long, event string")
    rows = R.fold_log(df, ["k"], ["at"], "event")
    assert {r["k"]: (r["state"], r["n_illegal"]) for r in rows.collect()} == {
        "fine": ("verified", 0), "twice": ("verified", 1), "early": ("written", 1), "stuck": ("failed", 1), "late": ("verified", 0),
    }
    expected = spark.createDataFrame([(k,) for k in ("fine", "twice", "early", "stuck", "never")], "k string")
    assert {r["status"]: r["n_keys"] for r in R.receipt_gaps(expected, rows, ["k"]).collect()} == {
        "complete": 1, "damaged": 1, "open": 2, "unwritten": 1, "unexpected": 1,
    }


def test_empty_log_and_wrong_table(spark):
    df = spark.createDataFrame([], "k string, at long, event string")
    assert R.fold_log(df, ["k"], ["at"], "event").collect() == []
    with pytest.raises(ValueError):
        R.fold_log(df, ["k"], ["at"], "event", {"none": ("made",)})
