"""Whole texts as numpy arrays inside a task: chunking by bytes, word spans and word hashes.

Everything works on UTF-8 bytes. The bytes 0x09-0x0D and 0x20 separate words; lower-casing, where an
operator asks for it, touches A-Z only. Hashes are 64 bits wide and depend on nothing but the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U64 = np.uint64
CHUNK_BYTES = 1 << 19  # texts are handled together up to this size; a longer text stands alone

_SPACE = np.zeros(256, np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_TABLES: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit numbers; a longer table begins with the shorter one."""
    have = _TABLES.get(seed)
    if have is None or len(have) < n:
        steps = np.arange(1, max(n, 1024) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        _TABLES[seed] = have = mixed(steps + U64(seed * 2 + 1)) | U64(1)
    return have[:n]


def byte_chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES):
    """Slices of the batches with about ``size`` bytes of text each, and their texts (null: empty)."""
    for batch in batches:
        i = 0
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + size, "right")))
            part = batch.slice(i, j - i)
            yield part, [(t or "").encode() for t in text.slice(i, j - i).to_pylist()]
            i = j


def map_texts(
    df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch, list[bytes]], dict], size: int = CHUNK_BYTES
) -> DataFrame:
    """Run ``work`` over chunks of rows; it returns the columns of ``schema`` by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_chunks(batches, column, size):
            made = work(part, texts)
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := made[f.name], (pa.Array, pa.ChunkedArray)) and c.type == f.type
                     else pa.array(c, f.type) for f in arrow], schema=arrow,
                )

    return df.mapInArrow(run, schema)


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts with a line break after each, and the offset where each begins."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    return b"\n".join(texts) + b"\n", starts


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and where each word starts and ends."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, np.int8)
    gap[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return raw, edges[0::2], edges[1::2]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Multilinear hash of each span's bytes: random odd factor by position, then scrambled with the length."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, U64)
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    position = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    factors = seeded(seed, int(lengths.max()))
    weighted = (raw[position + np.repeat(starts, lengths)].astype(U64) + U64(1)) * factors[position]
    return mixed(np.add.reduceat(weighted, first) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """Words of a chunk of texts: ``hashes`` in order; text ``i`` owns ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, texts: list[bytes], lower: bool = False, seed: int = 1):
        data, offsets = joined(texts)
        raw, self.starts, self.ends = word_spans(data.lower() if lower else data)
        self.data = data
        self.hashes = span_hashes(raw, self.starts, self.ends, seed)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)


def power_table(base: int, n: int) -> np.ndarray:
    key = -(base & 0xFFFFFFFFFFFF) - 1
    have = _TABLES.get(key)
    if have is None or len(have) < n:
        table = np.empty(max(n, 4096), U64)
        table[0] = 1
        table[1:] = U64(base)
        _TABLES[key] = have = np.multiply.accumulate(table)
    return have[:n]


_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values (a polynomial modulo 2**64, scrambled)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power_table(_BASE, len(values)), out=total[1:])
    return mixed((total[k:] - total[:-k]) * power_table(_INVERSE, n))


def rightmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of ``w`` consecutive hashes the index of its minimum, the rightmost among equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(h)), 1
    while span < w:
        step = min(span, w - span)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        span += step
    return best


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists out of flat values and their bounds."""
    flat = pa.array(values.view(np.int64) if values.dtype == U64 else values, kind)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
