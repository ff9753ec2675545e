"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowmill.session import staged


def _towards_minimum(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on (u, v): every node sends its larger (or, small: its smaller) neighbours to its least one."""
    if small:
        own = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        own = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = own.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least if small else staged(least, "least")  # written, so that a hub's edges can be split in the join
    joined = own.join(least, "u")
    if small:
        to = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        to = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) of every node that has an edge in ``edges`` (u, v).

    Each round is written to the shared folder, so that a lost executor repeats one round at most. The number
    of rounds grows with the logarithm of the largest component; a graph that is not settled after
    ``most_rounds`` is an error, never a partial result.
    """
    now = staged(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        now = staged(_towards_minimum(_towards_minimum(now, small=False), small=True), "edges")
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == row:
            roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        state = row
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
