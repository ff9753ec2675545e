"""Mixing sources to target weights, in DataFrame functions only.

Documents are the leaves' content in a tree domain - language - source. A token budget runs down the tree: at
each node it is dealt to the children by their weights, a child takes no more than its subtree holds (its
tokens times ``epochs``), and what it cannot take goes to its siblings; only what a whole subtree cannot take
goes to the ancestors' other children. Each leaf then reads its documents in seeded order, one order for each
epoch, and takes documents while the tokens before them are below the leaf's share.

A leaf's order is never sorted as a whole: documents fall into equal ranges of their order key, token sums by
range tell which range holds the cut, and only that range is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.session import staged

LEVELS = ("domain", "lang", "source")
PER_RANGE = 4096


def n_words(text: Column) -> Column:
    """Words between blanks and the controls 0x09-0x0D; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def deal(nodes: DataFrame, parents: list[str], budget: str, weight: str, room: str) -> DataFrame:
    """Add ``share``: each parent's ``budget`` dealt to its rows by ``weight``, none above its ``room``.

    In ascending order of room / weight the first rows are full; the rest divide what is left by weight,
    rounded down. Whole numbers throughout. Sorting is within a parent's children, who are few.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    family = Window.partitionBy(*parents)
    order = family.orderBy((F.col(room).cast("double") / F.col(weight)), *LEVELS)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rest = order.rowsBetween(1, Window.unboundedFollowing)
    out = nodes.withColumn("__held", F.sum(room).over(upto)).withColumn("__rest", F.coalesce(F.sum(weight).over(rest), F.lit(0)))
    full = wide(room) * wide("__rest") + wide("__held") * wide(weight) <= wide(budget) * wide(weight)
    out = out.withColumn("__full", full)
    out = out.withColumn("__taken", F.coalesce(F.sum(F.when(F.col("__full"), F.col(room))).over(family), F.lit(0)))
    out = out.withColumn("__open", F.coalesce(F.sum(F.when(~F.col("__full"), F.col(weight))).over(family), F.lit(0)))
    out = out.withColumn("__due", (wide(budget) - wide("__taken")) * wide(weight))
    share = F.when(F.col("__full"), F.col(room)).otherwise(F.expr("__due div __open"))
    return out.withColumn("share", share).drop("__held", "__rest", "__full", "__taken", "__open", "__due")


def shares(leaves: DataFrame, budget: int, epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, weight_domain, weight_lang, weight_source) with the tokens each is to give."""
    sums = leaves.withColumn("room", F.col("tokens") * epochs)
    top = sums.groupBy("domain").agg(F.sum("room").alias("room"), F.max("weight_domain").alias("weight"))
    top = top.select("domain", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "room", "weight")
    top = deal(top.withColumn("budget", F.least(F.lit(budget), F.sum("room").over(Window.partitionBy(F.lit(1))))).withColumn("root", F.lit(1)), ["root"], "budget", "weight", "room")
    mid = sums.groupBy("domain", "lang").agg(F.sum("room").alias("room"), F.max("weight_lang").alias("weight"))
    mid = mid.join(top.select("domain", F.col("share").alias("budget")), "domain").withColumn("source", F.lit(None).cast("string"))
    mid = deal(mid, ["domain"], "budget", "weight", "room")
    low = sums.join(mid.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    return deal(low.withColumn("weight", F.col("weight_source")), ["domain", "lang"], "budget", "weight", "room")


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in a leaf's order for an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def leaf_tables(docs: DataFrame, id_col: str, text_col: str, domain: Column, lang: Column, source: Column) -> DataFrame:
    """``id``, levels (null: 'none') and ``tokens`` of every row, without its text."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), named(domain).alias("domain"), named(lang).alias("lang"),
        named(source).alias("source"), n_words(F.col(text_col)).alias("tokens"),
    )


def plan(
    rows: DataFrame, weights: dict[str, Column], percent: int, epochs: int, seed: int
) -> DataFrame:
    """For each leaf: ``share``, ``whole`` epochs, and the last order key of the epoch it breaks off in.

    ``rows`` as of ``leaf_tables``; the budget is ``percent`` of all their tokens. Leaves without tokens give
    nothing and take nothing.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).where("tokens > 0")
    leaves = leaves.select("*", *(weights[n].cast("long").alias(f"weight_{n}") for n in LEVELS))
    leaves = staged(leaves, "leaves")
    total = leaves.agg(F.sum("tokens"), F.sum("rows")).first()
    tokens, n = int(total[0] or 0), int(total[1] or 0)
    digits = max(1, len(f"{n // PER_RANGE:x}"))  # a range holds PER_RANGE rows of a leaf or fewer, on average
    dealt = shares(leaves, tokens * percent // 100, epochs)
    dealt = staged(dealt.select(*LEVELS, "tokens", "share", F.floor(F.col("share") / F.col("tokens")).cast("long").alias("whole")), "shares")
    open_leaves = dealt.where("share > whole * tokens").select(*LEVELS, "whole", (F.col("share") - F.col("whole") * F.col("tokens")).alias("part"))
    keyed = rows.where("tokens > 0").join(open_leaves, list(LEVELS)).withColumn("key", _order_key(seed, F.col("whole"), F.col("id")))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits))
    by_range = keyed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("held"), F.max("part").alias("part"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut_range = by_range.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    cut_range = cut_range.where("before < part and before + held >= part").select(*LEVELS, "range", "before")
    inside = Window.partitionBy(*LEVELS, "range").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = keyed.join(cut_range, [*LEVELS, "range"]).withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
    cut = last.where("upto >= part").groupBy(*LEVELS).agg(F.min("key").alias("cut"))
    return staged(dealt.join(cut, list(LEVELS), "left"), "cuts")


def mix(
    docs: DataFrame, weights: dict[str, Column], percent: int, epochs: int = 1, seed: int = 0, id_col: str = "doc_id",
    text_col: str = "text", domain: Column | None = None, lang: Column | None = None, source: Column | None = None,
) -> DataFrame:
    """Rows of ``docs`` with ``copies``, the number of times the mixture reads each (0: not taken).

    ``weights`` gives a whole, positive weight for each of ``LEVELS`` as a function of the levels' columns; a
    node's weight is the greatest among its leaves. Rows of one id in a leaf are taken together; a null id
    counts as an id; null levels are the level 'none'; rows without tokens are read once if the leaf gives
    at least one whole epoch or its order reaches them. Columns of ``docs`` stay (but for an older ``copies``); an empty table gives an
    empty table.
    """
    domain = F.lit("all") if domain is None else domain
    lang, source = (F.col("lang") if lang is None else lang), (F.col("source") if source is None else source)
    rows = staged(leaf_tables(docs, id_col, text_col, domain, lang, source), "tokens")
    cuts = plan(rows, weights, percent, epochs, seed).select(*(F.col(n).alias(f"__{n}") for n in LEVELS), "whole", "cut")
    named = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    columns = [c for c in docs.columns if c != "copies"]
    own = F.struct(*columns).alias("__row")
    placed = docs.select(own, named(domain).alias("__domain"), named(lang).alias("__lang"), named(source).alias("__source"))
    joined = placed.join(cuts, [f"__{n}" for n in LEVELS], "left")
    return joined.select("__row.*", _copies(seed, F.col(f"__row.{id_col}")).alias("copies"))


def _copies(seed: int, doc_id: Column) -> Column:
    key = _order_key(seed, F.col("whole"), doc_id.cast("long"))
    return F.coalesce(F.col("whole") + F.when(key <= F.col("cut"), 1).otherwise(0), F.lit(0)).cast("long")


def taken(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """``rows`` as of ``leaf_tables`` with their ``copies`` under a plan."""
    return rows.join(cuts.drop("tokens"), list(LEVELS), "left").withColumn("copies", _copies(seed, F.col("id")))
