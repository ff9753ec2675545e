"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of symbol pairs.

A text's characters are its first symbols. Every pair of neighbouring symbols whose concatenation is a piece
waits on an agenda ordered by score, the leftmost first among equals; the best pair is merged and the two pairs
it makes with its neighbours join the agenda, until none is left. Symbols that are no piece become byte pieces.

No merge crosses two characters that stand side by side inside no piece, so a text is cut into words (where the
model has no piece across them), long words into fragments, and each has an agenda of its own; equal words of a task
share one result. The model file is read by the
driver and its size does not depend on the data. ``disagreements`` compares with the sentencepiece library,
Arrow batch by Arrow batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from flowmill.llm.words import map_texts

SPACE = "▁"
CACHED = 300_000  # a task's memory of encoded fragments; cleared when full, so it only saves time
SHORT, NEVER = 40, float("inf")  # fragments of up to so many symbols have a flat agenda
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and flags of a model file; what the encoder does not follow is refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for n, v in message if n == 1]
        trainer = dict(p for n, v in message if n == 2 for p in _fields(v))
        rules = dict(p for n, v in message if n == 3 for p in _fields(v))
        self.names = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces]
        plain = rules.get(1) == b"identity" and not rules.get(2) and not rules.get(4, 1) and rules.get(5, 1)
        if trainer.get(3) != 2 or not plain or trainer.get(24) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models with plain normalisation, leading spaces and no user-defined pieces")
        self.prefix = bool(rules.get(3, 1))
        self.fallback = bool(trainer.get(35))
        self.begin, self.end, self.unknown = trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0)
        self.surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        self.cost = {n: -scores[i] for n, i in self.ids.items()}
        self.bytes = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.bytes[int(self.names[i][3:5], 16)] = i
        self.inside = {(a, b) for n in self.ids for a, b in zip(n, n[1:], strict=False)}
        #: no piece goes on with a space mark after another character: every word may stand alone
        self.by_word = all(a == SPACE for a, b in self.inside if b == SPACE)

    @classmethod
    def of(cls, parts: dict) -> Model:
        """A model from another one's ``__dict__``."""
        new = cls.__new__(cls)
        new.__dict__ = parts
        return new


def merged(text: str, cost: dict[str, float]) -> list[str]:
    """The text's symbols after all merges: the best score first, the leftmost among equals."""
    return _merged_long(text, cost) if len(text) > SHORT else _merged_short(text, cost)


def _merged_short(text: str, cost: dict[str, float]) -> list[str]:
    """The agenda as a flat list in text order: its least cost is found by scanning, the leftmost first."""
    parts, known, never = list(text), cost.get, NEVER
    agenda = [known(a + b, never) for a, b in zip(text, text[1:], strict=False)]
    while agenda:
        best = min(agenda)
        if best == never:
            break
        i = agenda.index(best)
        del agenda[i]
        pair = parts[i] = parts[i] + parts.pop(i + 1)
        if i < len(agenda):
            agenda[i] = known(pair + parts[i + 1], never)
        if i:
            agenda[i - 1] = known(parts[i - 1] + pair, never)
    return parts


def _merged_long(text: str, cost: dict[str, float]) -> list[str]:
    """The agenda as a heap over linked symbols, for fragments of any length."""
    parts: list[str | None] = list(text)
    n = len(parts)
    agenda = [(c, i, p) for i in range(n - 1) if (c := cost.get(p := parts[i] + parts[i + 1])) is not None]
    heapq.heapify(agenda)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    while agenda:
        _, i, pair = heapq.heappop(agenda)
        j = after[i]
        # an entry is stale if one of its symbols has been merged meanwhile
        if parts[i] is None or j < 0 or len(parts[i]) + len(parts[j]) != len(pair):
            continue
        parts[i], parts[j] = pair, None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (c := cost.get(new := pair + parts[k])) is not None:
                heapq.heappush(agenda, (c, i, new))
        h = before[i]
        if h >= 0 and (c := cost.get(new := parts[h] + pair)) is not None:
            heapq.heappush(agenda, (c, h, new))
    return [p for p in parts if p is not None]


def _utf8(data: bytes) -> str:
    """Bytes as UTF-8; each byte that belongs to no character becomes a replacement character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "\ufffd" * (e.end - e.start))
            data = data[e.end :]
    return "".join(out)


class Codec:
    """Encodes and decodes texts one after another; keeps the latest fragments' results."""

    def __init__(self, model: Model):
        self.m = model
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if model.by_word else "(?s:.+)").findall
        self.known: dict[str, tuple[bytes, str, int]] = {}
        self.byte = {i: b for b, i in enumerate(model.bytes) if model.kinds[i] == BYTE}
        self.spaced = {i for n, i in model.ids.items() if n.startswith(SPACE)}
        special = {CONTROL: "", UNKNOWN: model.surface, BYTE: None}
        self.shown = [special.get(k, n.replace(SPACE, " ")) for n, k in zip(model.names, model.kinds, strict=True)]

    def cuts(self, part: str) -> Iterator[str]:
        """The part's fragments between characters that no piece holds side by side."""
        at, inside = 0, self.m.inside
        for i in range(1, len(part)):
            if (part[i - 1], part[i]) not in inside:
                yield part[at:i]
                at = i
        yield part[at:]

    def ids_of(self, part: str) -> list[int]:
        out, ids = [], self.m.ids
        for fragment in self.cuts(part) if len(part) > SHORT else (part,):
            for symbol in merged(fragment, self.m.cost):
                i = ids.get(symbol)
                if i is not None:
                    out.append(i)
                elif self.m.fallback:
                    out += [self.m.bytes[b] for b in symbol.encode()]
                else:
                    out.append(self.m.unknown)
        return out

    def made(self, part: str) -> tuple[bytes, str, int]:
        """The part's ids as little-endian 32-bit numbers, what they decode to, and their number."""
        ids = self.ids_of(part)
        out = (struct.pack(f"<{len(ids)}I", *ids), self.surface(ids), len(ids))
        if len(part) <= 64:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[part] = out
        return out

    def surface(self, ids: list[int]) -> str:
        """What the ids stand for: runs of byte pieces as UTF-8, control pieces as nothing."""
        shown = [self.shown[i] for i in ids]
        if None in shown:
            run = bytearray()
            for at, i in enumerate(ids):
                if shown[at] is None:
                    run.append(self.byte[i])
                    shown[at] = ""
                elif run:
                    shown[at] = _utf8(run) + shown[at]
                    run.clear()
            shown.append(_utf8(run))
        return "".join(shown)

    def encode(self, text: str) -> list[tuple[bytes, str, int]]:
        """Triples as of ``made``, over the whole text, without begin and end."""
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        known, make = self.known.get, self.made
        return [known(p) or make(p) for p in self.parts(SPACE + marked if self.m.prefix else marked)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space that the encoder puts in front goes."""
        first = next((i for i in ids if self.m.kinds[i] != CONTROL), None)
        text = self.surface(ids)
        return text[1:] if self.m.prefix and first in self.spaced else text


COLUMNS = {
    "ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string",
}


def encode_texts(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("ids", "n_tokens"),
) -> DataFrame:
    """``id`` and the asked ``columns`` of each whole text: ids with begin and end, their number, what they decode
    to, or digests of these (ids as little-endian unsigned 32-bit numbers).

    Null and empty texts have the begin and end ids only. Repeated rows repeat; a null id stays null; other columns
    of ``docs`` are not read; an empty table gives an empty table. Texts and words of any length are encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    schema = ", ".join(["id bigint", *(f"{c} {COLUMNS[c]}" for c in columns)])
    made: list[Codec] = []  # one per task

    def work(part, texts):
        if not made:
            made.append(Codec(Model.of(shared.value)))
        codec = made[0]
        first, last = struct.pack("<I", codec.m.begin), struct.pack("<I", codec.m.end)
        out = {"id": part.column(0)} | {c: [] for c in columns}
        for text in texts:
            triples = codec.encode(text.decode())
            if "n_tokens" in out:
                out["n_tokens"].append(sum([t[2] for t in triples]) + 2)
            if "ids" in out or "ids_sha256" in out:
                ids = b"".join([first, *[t[0] for t in triples], last])
                if "ids" in out:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            if "decoded" in out or "decoded_sha256" in out:
                decoded = "".join([t[1] for t in triples])
                decoded = decoded[1:] if codec.m.prefix else decoded  # the encoder's space
                if "decoded" in out:
                    out["decoded"].append(decoded)
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out

    return map_texts(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text"), "text", schema, work)


def disagreements(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose ids or decoded text differ from the sentencepiece library's: ``id``, the ids of both sides, and
    whether the decoded texts agree. Null texts count as empty; an empty result is a passed check.

    The library works on the model's bytes inside the tasks, a batch of texts at a time.
    """
    with open(path, "rb") as f:
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((vars(Model(path)), f.read()))
    made: list = []  # one pair per task

    def work(part, texts):
        if not made:
            import sentencepiece

            made.extend([Codec(Model.of(shared.value[0])), sentencepiece.SentencePieceProcessor(model_proto=shared.value[1])])
        codec, library = made
        texts = [t.decode() for t in texts]
        theirs = library.encode(texts, num_threads=1, add_bos=True, add_eos=True)
        decoded = library.decode(theirs)
        rows, ours, same = [], [], []
        for i, text in enumerate(texts):
            ids = b"".join([t[0] for t in codec.encode(text)])
            ids = [codec.m.begin, *np.frombuffer(ids, "<u4").tolist(), codec.m.end]
            agree = codec.decode(ids) == decoded[i]
            if not agree or ids != theirs[i]:
                rows.append(i)
                ours.append(ids)
                same.append(agree)
        return {"id": part.column(0).take(np.array(rows, np.int64)), "ids": ours, "library_ids": [theirs[i] for i in rows], "same_text": same}

    schema = "id bigint, ids array<int>, library_ids array<int>, same_text boolean"
    return map_texts(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text"), "text", schema, work)
