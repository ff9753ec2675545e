"""Byte-pair encoding with forced cuts, and decoding.

Two neighbouring symbols that stand side by side inside no vocabulary token can never be merged across, so a
word may be cut there: the fragments are encoded apart and their ids put one after another. Words are the
parts that the vocabulary file's normaliser and splitting rule leave; special tokens found in a text are ids
of their own. The file is read once by the driver; its size does not depend on the data.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from flowmill.llm.words import map_texts

CACHED_WORDS = 150_000  # a task's memory of encoded words; cleared when full, so it only saves time


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Vocabulary:
    """What the encoder needs of a word-BPE vocabulary file; small, sent to the executors as it is."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # white space is Unicode's White_Space property
        self.split = split.replace(r"[^\s", r"[^\p{White_Space}")
        self.inside = {(a, b) for t in self.ids for s in [self.symbols(t)] for a, b in zip(s, s[1:], strict=False)}

    @classmethod
    def of(cls, parts: dict) -> Vocabulary:
        """A vocabulary from another one's ``__dict__``."""
        new = cls.__new__(cls)
        new.__dict__ = parts
        return new

    def symbols(self, token: str) -> list[str]:
        """A token's smallest symbols; the last character keeps the end-of-word mark."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def cuts(self, word: list[str]) -> list[list[str]]:
        """The word's fragments between forced cuts."""
        out, at = [], 0
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in self.inside:
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def merge(self, parts: list[str]) -> list[str]:
        """Byte-pair merges in rank order, the leftmost first among equals."""
        parts, ranks, none = list(parts), self.ranks, len(self.ranks)
        if len(parts) > 400:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = none, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]), none)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap over a linked list, for fragments of any length."""
        import heapq

        parts, n, ranks = list(parts), len(parts), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [p for p in parts if p is not None]


class Encoder:
    """Encodes texts one after another; keeps the latest words' results."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.split).findall
        names = "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
        self.special = regex.compile(f"({names})") if names else None
        self.words: dict[str, tuple[str, str, int]] = {}
        self.fragments: dict[tuple, list[str]] = {}
        self.symbol = byte_symbols()

    def tokens_of(self, word: str) -> list[str]:
        symbols = [self.symbol[b] for b in word.encode()]
        symbols[-1] += self.v.end
        out: list[str] = []
        for piece in self.v.cuts(symbols):
            key = tuple(piece) if len(piece) <= 24 else None
            known = self.fragments.get(key) if key else None
            if known is None:
                known = self.v.merge(piece)
                if key:
                    if len(self.fragments) >= CACHED_WORDS:
                        self.fragments.clear()
                    self.fragments[key] = known
            out += known
        return out

    def word(self, word: str) -> tuple[str, str, int]:
        """The word's ids and tokens, each joined by blanks, and their number."""
        tokens = self.tokens_of(word)
        made = (" ".join([str(self.v.ids[t]) for t in tokens]), " ".join(tokens), len(tokens))
        if len(word) <= 64:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = made
        return made

    def plain(self, text: str) -> list[tuple[str, str, int]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # character by character: no rule of the whole word, such as the final sigma, applies
            text = text.lower() if "Σ" not in text and "İ" not in text else "".join([c.lower() for c in text])
        else:
            text = text.lower()
        known, make = self.words.get, self.word
        return [known(w) or make(w) for w in self.find(text)]

    def encode(self, text: str) -> list[tuple[str, str, int]]:
        """Triples as of ``word``, over the whole text."""
        if self.special is None or "<|" not in text:
            return self.plain(text)
        out = []
        for part in self.special.split(text):
            if part in self.v.special:
                out.append((str(self.v.special[part]), part, 1))
            elif part:
                out += self.plain(part)
        return out


COLUMNS = {
    "ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string",
}


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """Tokens of the ids joined by blanks, special ones included; the file names no other decoder."""
    names = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.special.items()}
    return " ".join(names[i] for i in ids)


def encode_texts(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
    columns: tuple[str, ...] = ("ids", "n_tokens"),
) -> DataFrame:
    """``id`` and the asked ``columns`` of each whole text: ids, their number, the decoded text, or digests of these.

    Null and empty texts have no tokens. Repeated rows repeat; a null id stays null; other columns of ``docs``
    are not read; an empty table gives an empty table. Words of any length are encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))
    schema = ", ".join(["id bigint", *(f"{c} {COLUMNS[c]}" for c in columns)])
    made: list[Encoder] = []  # one per task

    def work(part, texts):
        if not made:
            made.append(Encoder(Vocabulary.of(shared.value)))
        out = {"id": part.column(0)} | {c: [] for c in columns}
        for text in texts:
            triples = made[0].encode(text.decode())
            if "n_tokens" in out:
                out["n_tokens"].append(sum([t[2] for t in triples]))
            if "ids" in out or "ids_sha256" in out:
                ids = " ".join([t[0] for t in triples])
                if "ids" in out:
                    out["ids"].append(np.array(ids.split(), dtype=np.int32) if ids else np.zeros(0, np.int32))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            if "decoded" in out or "decoded_sha256" in out:
                text = " ".join([t[1] for t in triples])
                if "decoded" in out:
                    out["decoded"].append(text)
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
        return out

    return map_texts(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text"), "text", schema, work)
