"""Repeated passages: seeds on winnowed anchors, extension to whole windows, union to maximal repeats.

A passage of ``length`` words holds an anchor: the smallest hash of ``k`` words among ``length - k + 1``
neighbours (the rightmost among equals). Equal passages have equal anchors, so a window that repeats elsewhere
stands around an anchor that repeats. Anchors (about one position in 20) are joined across documents; around
the shared ones every window is extended to its full length on both sides of the seed, looked up by its whole
content, and adjoining windows make up the maximal repeat that is cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from flowmill.llm.words import U64, Words, lists, map_texts, mixed, rightmost_minima, rolling
from flowmill.session import staged

LENGTH = 50


def _seeds(w: Words, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Anchor width, the hash at each word, and for each window of the chunk the index of its anchor."""
    k = max(1, length // 4)
    grams = rolling(w.hashes, k)
    return k, grams, rightmost_minima(grams, length - k + 1)


def _summaries(docs: DataFrame, length: int) -> DataFrame:
    def work(part, texts):
        w = Words(texts)
        _, grams, anchor = _seeds(w, length)
        out = {"id": part.column(0), "n_words": w.counts, "digest": [], "kept_sha256": []}
        found = []
        for i, text in enumerate(texts):
            a, b = w.bounds[i], w.bounds[i + 1]
            words = b" ".join(text.split())
            out["kept_sha256"].append(hashlib.sha256(words).hexdigest())
            out["digest"].append(hashlib.blake2b(words, digest_size=16).digest())
            found.append(np.unique(grams[np.unique(anchor[a : b - length + 1])]) if b - a >= length else np.zeros(0, U64))
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        out["anchors"] = lists(np.concatenate([*found, np.zeros(0, U64)]), bounds, "int64")
        return out

    return map_texts(docs, "text", "id bigint, n_words bigint, digest binary, kept_sha256 string, anchors array<bigint>", work)


def _windows(seeded: DataFrame, length: int) -> DataFrame:
    """Of rows (id, text, shared anchors) the runs of windows around these: first word and the windows' hashes."""

    def work(part, texts):
        w = Words(texts)
        _, grams, anchor = _seeds(w, length)
        whole = rolling(w.hashes, length)
        shared = part.column(part.schema.get_field_index("shared"))
        ids = part.column(part.schema.get_field_index("id"))
        rows, first, hashes = [], [], []
        for i in range(len(texts)):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a < length:
                continue
            wanted = np.sort(shared[i].values.to_numpy(zero_copy_only=False).view(U64))
            own = grams[anchor[a : b - length + 1]]
            at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == own)
            if len(hit):
                for run in np.split(hit, np.flatnonzero(np.diff(hit) != 1) + 1):
                    rows.append(i)
                    first.append(int(run[0]))
                    # the seed's hash takes part, so that two windows must agree in both hashes
                    hashes.append(mixed(whole[a + run] ^ (own[run] * U64(0x9E3779B97F4A7C15))))
        bounds = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        return {
            "row": part.column(part.schema.get_field_index("row")).take(rows := np.array(rows, np.int64)), "id": ids.take(rows), "first": first,
            "windows": lists(np.concatenate([*hashes, np.zeros(0, U64)]), bounds, "int64"),
        }

    return map_texts(seeded, "text", "row bigint, id bigint, first bigint, windows array<bigint>", work)


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Rows (id, text, starts of repeated windows) without the words these cover."""

    def work(part, texts):
        starts = part.column(part.schema.get_field_index("starts"))
        out = {"id": part.column(0), "digest": [], "n_removed": [], "kept_sha256": [], "text": []}
        for i, text in enumerate(texts):
            words = text.split()
            out["digest"].append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            at = starts[i].values.to_numpy(zero_copy_only=False)
            at = at[at + length <= len(words)]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["text"].append(kept.decode())
        return out

    return map_texts(texts, "text", "id bigint, digest binary, n_removed bigint, kept_sha256 string, text string", work)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False
) -> DataFrame:
    """``id``, ``n_words``, ``n_removed``, ``kept_sha256`` of every row, and with ``with_text`` the kept words.

    Words go that are covered by ``length`` consecutive words which also start in a row with a smaller id.
    Null and empty texts have no words. Rows of one id do not count against each other. A row without an id
    loses nothing and takes nothing. Other columns of ``docs`` are not read; an empty table gives an empty one.
    The kept text is null where a row is unchanged (it is the input's).
    """
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text")
    rows = staged(_summaries(docs, length), "passages")
    long = rows.where(f"n_words >= {length} and id is not null")
    # a whole copy of an earlier text goes entirely: the first one stands for its windows
    firsts = staged(long.groupBy("digest").agg(F.min("id").alias("first_id"), F.first("anchors").alias("anchors")), "firsts")
    seeds = firsts.select(F.col("first_id").alias("id"), F.explode("anchors").alias("anchor"))
    # what is counted by a key is written before it is joined back: both sides then have exchanges of their own,
    # whose hot partitions adaptive execution may split
    shared = staged(seeds.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"), "shared")
    per_text = seeds.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("shared"))
    seeded = staged(docs.join(per_text, "id").withColumn("row", F.monotonically_increasing_id()), "seeded")
    windows = _windows(seeded, length).select("row", "id", F.posexplode("windows").alias("step", "window"), "first")
    windows = staged(windows.select("row", "id", "window", (F.col("first") + F.col("step")).cast("int").alias("start")), "windows")
    origin = staged(windows.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"), "origin")
    later = windows.join(origin.select("window", "low"), "window").where("id > low")
    starts = later.groupBy("row").agg(F.collect_set("start").alias("starts"))
    cut = _cut(seeded.select("row", "id", "text").join(starts, "row").select("id", "text", "starts"), length)
    cut = cut.select("id", "digest", "n_removed", F.col("kept_sha256").alias("cut_sha256"), *([F.col("text").alias("kept_text")] if with_text else []))
    cut = cut.dropDuplicates(["id", "digest"])
    copies = firsts.select("digest", "first_id")
    out = rows.select("id", "n_words", "digest", "kept_sha256").join(copies, "digest", "left").join(cut, ["id", "digest"], "left")
    copy = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    columns = {
        "n_removed": F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))),
        "kept_sha256": F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")),
    }
    if with_text:
        columns["kept_text"] = F.when(copy, F.lit("")).otherwise(F.col("kept_text"))
    return out.select("id", "n_words", *(c.alias(n) for n, c in columns.items()))
