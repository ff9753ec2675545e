"""Gates before data is used: every check counts its bad rows, a report is judged as a whole, and a refusal names what failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowmill.functions.scalars import is_finite
from flowmill.operators.panel import identity_conflicts
from flowmill.session import staged
from flowmill.sources import inventory

# The markets quotes may come from.
MARKETS = ("SH", "SZ")


def report(counts: DataFrame, checks: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(check, bad_rows, status)`` of a table with a count per check: one row, or one per value of ``by``."""
    status = lambda c: F.when(F.col(c) == 0, "pass").otherwise("fail")
    cells = [F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("bad_rows"), status(c).alias("status")) for c in checks]
    return counts.select(*by, F.inline(F.array(*cells)))


def verdict(report: DataFrame) -> DataFrame:
    """One row: ``n_checks``, ``n_failed``, ``verdict`` ('ready' or 'refused') and the ``failed`` checks by name."""
    bad = F.col("status") != "pass"
    failed = F.array_join(F.sort_array(F.collect_list(F.when(bad, F.col("check")))), ",")
    return report.agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(bad).alias("n_failed"),
        F.when(F.count_if(bad) == 0, "ready").otherwise("refused").alias("verdict"), failed.alias("failed"),
    )


def require(report: DataFrame) -> None:
    """Raise with the failed checks and their counts; a report has one row per check."""
    bad = [f"{r['check']}: {r['bad_rows']}" for r in report.where("status <> 'pass'").orderBy("check").collect()]
    if bad:
        raise ValueError("refused, " + ", ".join(bad))


def quote_rejections(quotes: DataFrame, calendar: DataFrame, markets: Sequence[str] = MARKETS) -> DataFrame:
    """Rows of daily quotes (date, symbol, market) that may not enter: one report row per check.

    ``missing_key``: no date or symbol; ``duplicate_key``: rows of a key that occurs more than once; ``foreign_market``:
    a market not listed, or none; ``off_calendar``: a date the calendar lacks. Rows are summed by key in each task
    first, so a repeated key costs one row each.
    """
    n = F.count(F.lit(1))
    foreign = ~F.coalesce(F.upper("market").isin(*markets), F.lit(False))
    keys = quotes.groupBy("date", "symbol").agg(n.alias("__n"), F.count_if(foreign).alias("__foreign"))
    known = calendar.select("date", F.lit(True).alias("__on")).distinct()
    keys = keys.join(known, "date", "left")
    gone = F.col("date").isNull() | F.col("symbol").isNull()
    total = lambda e: F.coalesce(F.sum(F.when(e, F.col("__n"))), F.lit(0))
    counts = keys.agg(
        total(gone).alias("missing_key"), total(~gone & (F.col("__n") > 1)).alias("duplicate_key"),
        F.coalesce(F.sum("__foreign"), F.lit(0)).alias("foreign_market"),
        total(F.col("date").isNotNull() & F.col("__on").isNull()).alias("off_calendar"),
    )
    return report(counts, ["missing_key", "duplicate_key", "foreign_market", "off_calendar"])


def regime_gates(
    features: DataFrame, atomic: DataFrame, quotes: DataFrame, columns: Sequence[str], min_coverage: float, min_book_valid: float
) -> DataFrame:
    """Report over the rows of ``panel.regime_features``, for ``atomic`` rows that state their own market and board.

    ``in_universe``, ``has_quote``, ``has_history``: the row's flags; ``coverage``: a day whose return or amount coverage
    is below ``min_coverage``; ``features``: any of ``columns`` not finite; ``book_valid_ratio``: null or too low;
    ``duplicate_key``: rows of a repeated key; ``identity``: rows whose market or board is not that of their quote.
    """
    covered = F.coalesce((F.col("return_coverage") >= min_coverage) & (F.col("amount_coverage") >= min_coverage), F.lit(False))
    whole = is_finite(columns[0])
    for c in columns[1:]:
        whole = whole & is_finite(c)
    valid = is_finite("book_valid_ratio") & (F.col("book_valid_ratio") >= min_book_valid)
    bad: dict[str, Column] = {
        "in_universe": ~F.col("in_universe"), "has_quote": ~F.col("has_quote"), "has_history": ~F.col("has_history"),
        "coverage": ~covered, "features": ~F.coalesce(whole, F.lit(False)), "book_valid_ratio": ~F.coalesce(valid, F.lit(False)),
    }
    keys = features.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(e).alias(c) for c, e in bad.items()])
    twice = F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0))
    counts = keys.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in bad], twice.alias("duplicate_key"))
    odd = identity_conflicts(atomic, quotes).where("q_market is not null or q_board is not null").agg(F.count(F.lit(1)).alias("identity"))
    return report(counts, [*bad, "duplicate_key"]).unionByName(report(odd, ["identity"]))


# --- a manifest against the files that are there ------------------------------


def shard_path(keys: Sequence[str]) -> Column:
    """Folder of a shard below the archive, as its key columns are written."""
    parts: list[Column] = []
    for i, k in enumerate(keys):
        parts += [F.lit(f"/{k}=" if i else f"{k}="), F.col(k).cast("string")]
    return F.concat(*parts)


def live_shards(rows: DataFrame, keys: Sequence[str], columns: Sequence[str | Column]) -> DataFrame:
    """``path, n_rows, digest`` of the shards below a partitioned archive; a shard may lie in several files.

    The path is that of the files, not of the rows' keys. Digests are additive over rows: no shard is one value, and
    neither the order of rows nor their split into files matters.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/(" + "/".join(f"{k}=[^/]*" for k in keys) + ")/[^/]+$", 1)
    parts = staged(inventory.leaves(rows.withColumn("__folder", folder), "__folder", columns), "leaves")
    return inventory.tree(parts).where(F.col("level") == inventory.FILE).select(F.col("node").alias("path"), "n_rows", "digest")


def manifest_status(manifest: DataFrame, live: DataFrame, keys: Sequence[str], vocab_sha256: str) -> DataFrame:
    """One row per shard listed or found: ``keys``, ``path``, ``n_live`` and a status.

    ``manifest`` has ``keys, path, n_rows, digest, vocab_sha256``. The first that holds: ``not_listed`` (found only, its
    keys are null), ``listed_twice`` (its keys come more than once), ``path_wrong`` (not the folder of its keys, so two
    shards cannot share one), ``other_vocabulary``, ``file_missing``, ``rows_differ``, ``content_differs``, ``ok``.
    """
    said = F.struct("path", "n_rows", "digest", "vocab_sha256")
    listed = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("__listed"), F.min(said).alias("__said"))
    listed = listed.select(*keys, "__listed", F.col("__said.path").alias("path"), *[F.col(f"__said.{c}").alias(f"__{c}") for c in ("n_rows", "digest", "vocab_sha256")])
    listed = listed.withColumn("__own", shard_path(keys))
    found = live.select("path", F.col("n_rows").alias("n_live"), F.col("digest").alias("__live"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b) if b != "vocab" else F.lit(vocab_sha256))
    status = (
        F.when(F.col("__listed").isNull(), "not_listed").when(F.col("__listed") > 1, "listed_twice")
        .when(~same("path", "__own"), "path_wrong").when(~same("__vocab_sha256", "vocab"), "other_vocabulary")
        .when(F.col("n_live").isNull(), "file_missing").when(~same("__n_rows", "n_live"), "rows_differ")
        .when(~same("__digest", "__live"), "content_differs").otherwise("ok")
    )
    return listed.join(found, "path", "full_outer").select(*keys, "path", "n_live", status.alias("status"))


def manifest_report(status: DataFrame) -> DataFrame:
    """``manifest_status`` as a report: one row per kind of fault."""
    kinds = ["not_listed", "listed_twice", "path_wrong", "other_vocabulary", "file_missing", "rows_differ", "content_differs"]
    return report(status.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds]), kinds)
