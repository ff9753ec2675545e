"""Media columns: bytes kept as 8-bit audio, with log-mel features and active spans.

A text's UTF-8 bytes, padded with blanks to whole blocks of 192 samples, become the samples of a WAV file
(mono, unsigned 8 bit, 8 kHz). The features come from the samples read back from that file: polyphase
resampling to 2/3 of the rate, overlapped frames, a mel filterbank, log energies, and segments found by a
two-threshold (hysteresis) rule. A file's features have one fixed shape, ``TENSOR_SHAPE``.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowmill.llm.words import map_texts

BLOCK, RATE, UP, DOWN = 192, 8000, 2, 3
FRAME, HOP, MELS, SLOTS = 256, 128, 16, 8
TENSOR_SHAPE = (SLOTS, MELS)
_TAPS = 12  # input samples that meet in one output sample
_STRETCH = HOP * DOWN // UP * 4096  # input samples handled at a time
SCHEMA = (
    "id bigint, n_bytes bigint, media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, n_frames bigint, tensor array<float>, "
    "spans array<struct<start_ms:bigint,end_ms:bigint>>"
)


def tensor_type() -> pa.FixedShapeTensorType:
    """Arrow type of the ``tensor`` column, for files written outside Spark's own types."""
    return pa.fixed_shape_tensor(pa.float32(), TENSOR_SHAPE)


def as_tensors(column: pa.Array) -> pa.ExtensionArray:
    """The lists of the ``tensor`` column as an Arrow array of fixed-shape tensors."""
    flat = pa.array(np.asarray(column.flatten(), np.float32))
    return pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(flat, SLOTS * MELS))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth(), w.getframerate()) != (1, 1, RATE):
            raise ValueError("not a mono 8-bit file of the expected rate")
        return w.readframes(w.getnframes())


def _phases() -> np.ndarray:
    """Windowed-sinc low-pass, one row of taps for each output phase."""
    n = np.arange(_TAPS * UP) - (_TAPS * UP - 1) / 2
    h = np.sinc(n / DOWN) * np.hanning(_TAPS * UP + 2)[1:-1]
    h *= UP / h.sum()
    return h.reshape(_TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def _mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(x: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Polyphase 2/3: output ``m`` uses phase ``m * DOWN % UP`` on the inputs up to ``m * DOWN // UP``.

    ``x`` brings ``_TAPS - 1`` samples of context in front.
    """
    windows = np.lib.stride_tricks.sliding_window_view(x, _TAPS)
    parts = [windows[p * DOWN // UP :: DOWN] @ phases[p * DOWN % UP] for p in range(UP)]
    out = np.zeros(sum(map(len, parts)), np.float32)
    for p, part in enumerate(parts):
        out[p::UP] = part
    return out


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames x bands. Long signals are cut into stretches that share their frames' overlap."""
    phases, bank, window = _phases(), _mel_bank(), np.hanning(FRAME).astype(np.float32)
    rows = []
    reach = FRAME * DOWN // UP
    lead = np.zeros(_TAPS - 1, np.float32)
    for at in range(0, max(1, len(samples)), _STRETCH):
        part = samples[at : at + _STRETCH + reach].astype(np.float32) / 128 - 1
        head = lead if at == 0 else samples[at - _TAPS + 1 : at].astype(np.float32) / 128 - 1
        y = resample(np.concatenate([head, part]), phases)
        last = at + _STRETCH >= len(samples)
        n = max(at == 0, -(-(len(y) - FRAME + HOP) // HOP)) if last else _STRETCH * UP // DOWN // HOP
        if not n:  # the frames before reach the end
            break
        y = np.pad(y[: n * HOP + FRAME], (0, max(0, (n - 1) * HOP + FRAME - len(y))))
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
        power = np.abs(np.fft.rfft(frames * window, axis=1)).astype(np.float32) ** 2
        rows.append(np.log(power @ bank + 1e-6))
        if last:
            break
    return np.concatenate(rows)


def active_spans(energy: np.ndarray, high: float = 0.5, low: float = 0.0) -> list[tuple[int, int]]:
    """Frames [start, end) that pass ``high`` deviations above the mean and stay over ``low`` around it."""
    spread = energy.std()
    z = (energy - energy.mean()) / spread if spread > 1e-9 else np.zeros(len(energy))
    over = np.concatenate([[False], z > low, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1])
    peaks = np.concatenate([[0], np.cumsum(z > high)])
    return [(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2], strict=True) if peaks[b] > peaks[a]]


def pooled(mel: np.ndarray) -> np.ndarray:
    """Means over ``SLOTS`` equal stretches of time; a stretch without frames takes its nearest frame."""
    at = np.linspace(0, len(mel), SLOTS + 1).astype(int)
    return np.stack([mel[a : max(b, a + 1)].mean(axis=0) if a < len(mel) else mel[-1] for a, b in zip(at[:-1], at[1:], strict=True)])


def one_text(text: bytes) -> dict:
    payload = text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b" ")
    media = to_wav(payload)
    back = from_wav(media)
    mel = log_mel(np.frombuffer(back, np.uint8))
    ms = 1000 * HOP * DOWN / (UP * RATE)
    return {
        "n_bytes": len(text), "media": media, "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "n_frames": len(mel),
        "tensor": pooled(mel).astype(np.float32).ravel(),
        "spans": [{"start_ms": int(a * ms), "end_ms": int(b * ms)} for a, b in active_spans(mel.mean(axis=1))],
    }


def media_columns(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True
) -> DataFrame:
    """One row per row of ``docs``: the stored file, its digests, the feature tensor and the active spans.

    Null and empty texts are one block of blanks. Repeated rows give repeated, equal rows; a null id stays
    null; other columns of ``docs`` are not read. An empty table gives an empty table. ``with_media=False``
    leaves the ``media`` column null (the file is still made and read back).
    """

    def work(part, texts):
        rows = [one_text(t) for t in texts]
        if not with_media:
            for r in rows:
                r["media"] = None
        return {"id": part.column(0)} | {k: [r[k] for r in rows] for k in rows[0]}

    return map_texts(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text"), "text", SCHEMA, work)
