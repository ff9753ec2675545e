"""Query registry: each entry pairs a Spark job with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


def rounded(c: str | Column, digits: int = 8) -> Column:
    """Round for comparison; the sum order of doubles differs between engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sql_round(expr: str, digits: int = 8) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"
