"""Receipts of deliveries: an append-only log of events, folded to each key's last valid state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowmill.operators import blocks as B
from flowmill.session import staged

NONE = "none"  # state of a key before its first event
# From a state (or from nothing) the events that may follow; an event leads to the state of its name.
LEGAL = {
    NONE: ("written", "empty", "failed"),
    "written": ("verified", "failed"),
    "empty": ("verified", "written"),
    "failed": ("retried",),
    "retried": ("written", "empty", "failed"),
    "verified": (),
}


def fold_log(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], event: str, legal: Mapping[str, Sequence[str]] = LEGAL, blocks: int | None = None
) -> DataFrame:
    """One row per key: ``state``, ``n_events``, ``n_illegal`` and ``n_unknown``.

    Events apply in the order of ``order`` (its first column numeric or a time and not null), at one place by name. An
    event that may not follow the present state is counted as illegal and leaves the state as it is; one that no state
    names, or null, is counted as unknown and illegal. An entry that is logged twice (same key, place and event) counts once.

    Each block of a key's log is folded to a function of the state before it: where every state leads, and how many
    events are illegal on the way. These functions are applied in order, so a key's log is never in one task.
    """
    keys, order, names = list(keys), list(order), list(legal)
    if any(e not in legal for after in legal.values() for e in after):
        raise ValueError("every event needs the states that may follow it")
    n = len(names)
    allowed = F.array(*[F.lit(e in legal[s]) for s in names for e in names])
    known = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(event)).cast("int") - 1
    code = F.coalesce(F.when(F.col(event) != NONE, known), F.lit(-1))  # array_position says 0 for what it does not find
    entries = log.select(*keys, *order, F.when(code >= 0, code).otherwise(-1).alias("__e")).distinct()
    entries = staged(entries, "log")

    def step(at: Column, e: Column) -> Column:
        return (e >= 0) & F.element_at(allowed, at["s"] * n + F.greatest(e, F.lit(0)) + 1)

    def apply(at: Column, e: Column) -> Column:
        fits = step(at, e)
        return F.struct(F.when(fits, e).otherwise(at["s"]).alias("s"), (at["bad"] + F.when(fits, 0).otherwise(1)).alias("bad"))

    same = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(0).cast("long").alias("bad")) for i in range(n)])
    placed = F.array_sort(F.collect_list(F.struct(*order, "__e")))
    folded = F.aggregate(placed, same, lambda acc, x: F.transform(acc, lambda at: apply(at, x["__e"])))
    parts = B.add_blocks(entries, order, blocks).groupBy(*keys, B.BLOCK).agg(
        folded.alias("__f"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("__e") < 0).alias("n_unknown"),
    )
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("bad"))
    whole = F.aggregate(
        F.array_sort(F.collect_list(F.struct(B.BLOCK, "__f"))), start,
        lambda at, x: F.struct(
            F.element_at(x["__f"], at["s"] + 1)["s"].alias("s"), (at["bad"] + F.element_at(x["__f"], at["s"] + 1)["bad"]).alias("bad"),
        ),
    )
    out = parts.groupBy(*keys).agg(whole.alias("__w"), F.sum("n_events").alias("n_events"), F.sum("n_unknown").alias("n_unknown"))
    state = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("__w")["s"] + 1)
    return out.select(*keys, state.alias("state"), "n_events", F.col("__w")["bad"].alias("n_illegal"), "n_unknown")


def receipt_gaps(expected: DataFrame, receipts: DataFrame, keys: Sequence[str], final: Sequence[str] = ("verified",)) -> DataFrame:
    """``status`` and ``n_keys``: complete, open (another state than ``final``), damaged (final, but with illegal events),
    unwritten (expected, no event) and unexpected (events, not expected). Null keys equal each other."""
    keys = list(keys)
    marks = expected.select(*keys, F.lit(1).alias("__x"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("n_illegal"))
    marks = marks.unionByName(receipts.select(*keys, F.lit(0).alias("__x"), "state", "n_illegal"))
    both = marks.groupBy(*keys).agg(F.max("__x").alias("__x"), F.max("state").alias("state"), F.max("n_illegal").alias("n_illegal"))
    status = (
        F.when(F.col("__x") == 0, "unexpected").when(F.col("state").isNull(), "unwritten")
        .when(~F.col("state").isin(*final), "open").when(F.col("n_illegal") > 0, "damaged").otherwise("complete")
    )
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_keys"))
