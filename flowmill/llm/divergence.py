"""Divergence of the sources of a language: which words set a source apart, and how far any two are apart.

Every language keeps the terms of enough of its documents. A source's share of a term is an integer,
``1 + SCALE * (count + PRIOR) // (total + PRIOR * kept terms)``, so that all sums are exact.

Pairs of sources go through run-length columns. Terms with the same counts in all sources are one row with a
multiplicity, and rows are sorted by their counts, so that equal counts stand together. A block is a stretch of the
sorted vocabulary; in it every source is a column of runs of equal counts (what a source does not have is a run of
zeros). For two sources the run boundaries are intersected, and each stretch between two boundaries adds its
difference times its length. Sources are dealt to tiles, so that one call holds two tiles of one block, whatever the
number of sources and terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.llm.words import byte_chunks
from flowmill.session import staged

SCALE, PRIOR = 1_000_000_000, 5
HELD = 1 << 20  # counted terms that a task holds before it passes them on
CELLS = 1 << 20  # counts of a block
TILE = 128  # sources of a tile, on average

#: ASCII letters in lower case; all other ASCII bytes part terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(docs: DataFrame) -> DataFrame:
    """Partial counts by language, source and term: occurrences and documents."""
    schema = "lang string, source string, term string, n bigint, docs bigint"
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def made(counts, seen):
        for (lang, source), terms in counts.items():
            words = list(terms)
            text = pa.array(words, pa.binary()).cast(pa.string())
            same = [pa.repeat(pa.scalar(v, pa.string()), len(words)) for v in (lang, source)]
            held = seen[lang, source]
            values = [pa.array(list(terms.values()), pa.int64()), pa.array([held[w] for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([*same, text, *values], schema=kind)

    def run(batches):
        counts, seen = defaultdict(Counter), defaultdict(Counter)
        for part, texts in byte_chunks(batches, "text"):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                words = text.translate(_LETTERS).split()
                counts[lang, source].update(words)
                seen[lang, source].update(set(words))
            if sum(map(len, counts.values())) >= HELD:
                yield from made(counts, seen)
                counts.clear()
                seen.clear()
        yield from made(counts, seen)

    return docs.mapInArrow(run, schema)


def term_table(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, cells) of terms in at least ``least`` documents of the language; cells are its sources and counts."""
    counts = _counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells")  # as many as the language has sources
    return counts.groupBy("lang", "term").agg(cells, F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")


def share(count: Column, total: Column, kept: Column) -> Column:
    above = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + PRIOR * kept).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, below)


def _runs(terms: DataFrame) -> DataFrame:
    """Run-length columns: rows (lang, block, width, source, starts, ends, counts); a row without a source a block."""
    ordered = terms.groupBy("lang", "cells").agg(F.count("*").alias("m"))
    ordered = ordered.repartitionByRange("lang", "cells").sortWithinPartitions("lang", "cells")
    flat = ordered.select("lang", "m", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts"))
    whole = pa.list_(pa.int64())
    kind = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("width", pa.int64()), ("source", pa.string()), ("starts", whole), ("ends", whole), ("counts", whole)])

    def columns(lang, block, rows):
        """A block's runs out of (m, sources, counts) rows."""
        places = np.concatenate([[0], np.cumsum([m for m, _, _ in rows])])
        by_source = defaultdict(list)
        for at, (_, sources, counts) in enumerate(rows):
            for source, n in zip(sources, counts, strict=True):
                by_source[source].append((at, n))
        out = [(lang, block, int(places[-1]), None, [], [], [])]
        for source, found in by_source.items():
            at, n = np.array(found, np.int64).T
            new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(n) != 0)])
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
            out.append((lang, block, int(places[-1]), source, places[at[new]], places[at[last] + 1], n[new]))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    def run(batches):
        first, n_blocks, rows, held, lang = TaskContext.get().partitionId() << 32, 0, [], 0, None
        for batch in batches:
            for own, m, sources, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (own != lang or held >= CELLS):
                    yield columns(lang, first + n_blocks, rows)
                    n_blocks, rows, held = n_blocks + 1, [], 0
                lang = own
                rows.append((m, sources, counts))
                held += len(sources)
        if rows:
            yield columns(lang, first + n_blocks, rows)

    schema = "lang string, block bigint, width bigint, source string, starts array<bigint>, ends array<bigint>, counts array<bigint>"
    return flat.mapInArrow(run, schema)


def column(width: int, starts, ends, counts, total: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole column of a source in a block: where each run begins, and its share; gaps are runs of zeros."""
    shares = {c: 1 + SCALE * (c + PRIOR) // (total + PRIOR * kept) for c in {0, *counts}} if kept else {0: 0}
    cuts = np.concatenate([[0], np.stack([starts, ends], 1).ravel()]).astype(np.int64)
    values = np.full(len(cuts), shares[0], np.int64)
    values[1::2] = [shares[c] for c in counts]
    real = np.diff(np.concatenate([cuts, [width]])) > 0
    return cuts[real], values[real]


def apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int) -> int:
    """Sum of the differences of two columns over all terms, a stretch between two run boundaries at a time."""
    if not width:
        return 0
    cuts = np.union1d(a[0], b[0])
    at = [values[np.searchsorted(starts, cuts, "right") - 1] for starts, values in (a, b)]
    return int((np.abs(at[0] - at[1]) * np.diff(np.concatenate([cuts, [width]]))).sum())


def _pair_sums(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources of a language, each pair once in either order."""
    blocks = runs.where("source is null").select("lang", "block", "width")
    # a language without kept terms has its sources in an empty block
    blocks = blocks.unionByName(groups.select("lang", F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("width")).distinct())
    tiles = F.ceil(F.col("n_sources") / F.lit(TILE)).cast("int")
    dealt = groups.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    columns = dealt.join(blocks, "lang").join(runs.where("source is not null").drop("width"), ["lang", "block", "source"], "left")
    # once for every tile that the own one meets
    meets = columns.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    meets = meets.select("*", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["source"])
        width = rows[0]["width"]
        made = [column(width, r["starts"] or [], r["ends"] or [], r["counts"] or [], r["total"], r["kept"]) for r in rows]
        out = [
            (x["lang"], x["source"], y["source"], apart(made[u], made[v], width))
            for u, x in enumerate(rows) for v, y in enumerate(rows[u + 1 :], u + 1)
            if x["i"] == x["j"] or x["tile"] != y["tile"]
        ]
        names = ("lang", "a", "b", "value")
        types = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

    sums = meets.groupBy("lang", "block", "i", "j").applyInArrow(work, "lang string, a string, b string, value bigint")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, top: int = 50
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every occurring language and source.

    Part ``pair``: the other sources of the language by the sum of the differences of shares over all kept terms.
    Part ``term``: the ``top`` terms whose share is greater in the source than in the language, by how much. Ranks go
    by value, largest first, then by item. Null texts, languages and sources count as empty strings; a source without
    terms still takes part, and a language without kept terms has pairs of value 0. Rows count once each, repeated or
    not. Other columns are not read; an empty table gives an empty one.
    """
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*plain)
    terms = staged(term_table(docs, least), "terms")
    cells = terms.select("lang", "term", F.explode("cells").alias("cell")).select("lang", "term", "cell.source", "cell.n")
    langs = terms.select("lang", F.aggregate("cells.n", F.lit(0).cast("bigint"), lambda s, n: s + n).alias("n"))
    langs = langs.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total"]).withColumn("n_sources", F.count("*").over(Window.partitionBy("lang")))
    groups = staged(groups, "groups")

    sums = staged(_pair_sums(staged(_runs(terms), "runs"), groups), "pairs")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = both.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    with_all = terms.select(
        "lang", "term", F.aggregate("cells.n", F.lit(0).cast("bigint"), lambda s, n: s + n).alias("all"), F.explode("cells").alias("cell")
    ).select("lang", "term", "all", "cell.source", "cell.n")
    beyond = with_all.join(groups, ["lang", "source"]).withColumn(
        "value", share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("all"), F.col("lang_total"), F.col("kept"))
    )
    over = beyond.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
