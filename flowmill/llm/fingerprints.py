"""Document fingerprints by winnowing, and the likeness of fingerprints.

Every ``k`` consecutive code points are hashed; of every ``window`` consecutive hashes the smallest is kept,
the rightmost among equals, with its position. Two texts that share ``window + k - 1`` code points share a
kept hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from flowmill.llm.words import U64, byte_chunks, map_texts, mixed, rightmost_minima, rolling

K, WINDOW = 20, 44


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, ascending. A text shorter than ``k`` is one gram, an empty one none."""
    if not len(points):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    values = points.astype(U64) + U64(1)
    grams = rolling(values, min(k, len(values)))
    kept = rightmost_minima(grams, min(window, len(grams)))
    kept = kept[np.concatenate([[True], kept[1:] != kept[:-1]])]
    return grams[kept], kept


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    return hashlib.sha256(hashes.astype("<u8").tobytes() + positions.astype("<i8").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted hash sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW
) -> DataFrame:
    """``id``, ``n_chars`` and ``marks``: the kept hashes with their positions (code points).

    Null texts count as empty and have no marks; a null id stays null; repeated rows repeat. Other columns
    of ``docs`` are not read.
    """

    def work(part, texts):
        points = [code_points(t.decode()) for t in texts]
        found = [winnow(p, k, window) for p in points]
        return {
            "id": part.column(0), "n_chars": [len(p) for p in points],
            "marks": [[{"hash": int(h), "position": int(p)} for h, p in zip(a.view(np.int64), b, strict=True)] for a, b in found],
        }

    schema = "id bigint, n_chars bigint, marks array<struct<hash:bigint,position:bigint>>"
    return map_texts(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text"), "text", schema, work)


def in_order(docs: DataFrame, per_block: int = 8192) -> DataFrame:
    """Rows ``id, text, block, heir`` in ranges of about ``per_block`` rows by ascending id (null first, then text).

    Rows with ``heir`` false are the block's own; the one with ``heir`` true copies the first row of the next
    block (after the last block: of the first), so that every row's successor stands in its block. Only the
    ids' quantiles and one row per block are looked at beyond a block. Rows of one id stay in one block.
    """
    key = F.coalesce(F.col("id"), F.lit(-(2**63)))
    rows = docs.withColumn("key", key)
    blocks = max(1, -(-rows.count() // per_block))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(rows.approxQuantile("key", shares, 0.25 / blocks))) if shares else []
    ranges = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="place", outputCol="block")
    rows = ranges.transform(rows.withColumn("place", F.col("key").cast("double"))).drop("place")
    by_block = Window.orderBy("block")  # one row per block
    heads = rows.groupBy("block").agg(F.min("key").alias("key")).select(
        "key", F.coalesce(F.lag("block").over(by_block), F.max("block").over(by_block.rowsBetween(Window.currentRow, Window.unboundedFollowing))).alias("before")
    )
    # one row of two numbers for each block of ``per_block`` rows: a fraction of a thousandth of the ids
    firsts = rows.join(F.broadcast(heads), "key").groupBy("before", "key", "id").agg(F.min("text").alias("text"))
    copies = firsts.select("id", "text", "key", F.col("before").alias("block"), F.lit(True).alias("heir"))
    return (
        rows.select("id", "text", "key", "block", F.lit(False).alias("heir")).unionByName(copies)
        .repartition(max(2, min(2 * blocks, 1 << 16)), "block").sortWithinPartitions("block", "heir", "key", "text").drop("key")
    )


EDITED = (
    "id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_marks bigint"
)


def edited_likeness(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW
) -> DataFrame:
    """Each text against an edited one, and against the next text by ascending id (after the last: the first).

    The edited text's last ``n_chars // 4`` code points are replaced by the first as many of the next text,
    or by all of it. A fingerprint's digest covers its hashes and positions; likeness is the Jaccard
    coefficient of the kept hashes. Null texts count as empty; rows of one id follow each other by text;
    null ids come first; a single row is its own successor; an empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(EDITED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # block, id, text, hashes, positions
        for part, texts in byte_chunks(batches, "text"):
            out = []
            ids, blocks, heirs = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("id", "block", "heir"))
            for doc, block, heir, raw in zip(ids, blocks, heirs, texts, strict=True):
                text = raw.decode()
                hashes, positions = winnow(code_points(text), k, window)
                known = np.unique(hashes)
                if before is not None and before[0] == block:
                    _, old_id, old, old_hashes, old_positions, old_known = before
                    tail = len(old) // 4
                    edited = old[: len(old) - tail] + text[:tail]
                    h, p = winnow(code_points(edited), k, window)
                    out.append((
                        old_id, len(old), edited, digest(old_hashes, old_positions), digest(h, p),
                        likeness(old_known, np.unique(h)), likeness(old_known, known), len(old_hashes),
                    ))
                before = None if heir else (block, doc, text, hashes, positions, known)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"coalesce(cast(`{text_col}` as string), '') text")
    return in_order(docs).mapInArrow(run, EDITED)
