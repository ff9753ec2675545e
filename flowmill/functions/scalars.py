"""Null, finite, string and date helpers as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True only for a non-null value that is neither NaN nor infinite; never null."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), col(c))


def zero_fill(c: str | Column, width: int = 6) -> Column:
    """Left-pad with zeros; unlike ``lpad`` a longer value is kept whole."""
    c = col(c).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def clip(c: str | Column, lo: float | None, hi: float | None) -> Column:
    c = col(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def recode(c: str | Column, mapping: dict[str, str], default: str) -> Column:
    """Replace categories by a small fixed mapping, everything else by ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col(c)], F.lit(default))


def is_iso_date(c: str | Column) -> Column:
    """Strict ``YYYY-MM-DD``: shape, a real calendar day, and a lossless round trip."""
    c = col(c)
    parsed = F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(parsed, "yyyy-MM-dd") == c)
    return F.coalesce(ok, F.lit(False))


def parse_day(c: str | Column) -> Column:
    """Date from either spelling, ``2024-01-31`` or ``2024.01.31``; null when neither."""
    c = col(c)
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("yyyy.MM.dd"))
    ).cast("date")


def day_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def any_of(conds: list[Column]) -> Column:
    return reduce(or_, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(and_, conds)


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` where the denominator is positive, else null."""
    return F.when(den > 0, num / den)


def text_digest(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def key_digest(*parts: str | Column) -> Column:
    """First 60 bits of SHA-256 of the joined key, as a non-negative long."""
    joined = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two equally long arrays."""
    return F.aggregate(
        F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
