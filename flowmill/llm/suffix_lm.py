"""Language-model scores by a probabilistic suffix tree over words.

Tokens are the words (A-Z lowered) and one end per text. A context is what stands before a token: its last 1 to
``REACH`` words, the start of the text counting as one. A next word seen at least twice after a context is named
there, the others are pooled. A context is kept if one of its named words diverges from its share under the next
shorter context: the likelihood ratio of this word against all others has to exceed ``log(tokens + words)``, which
no word seen once can. A kept context gives a named word its count, and hands the pooled counts and one per named
word to the shorter context (Witten and Bell).

Where no context is kept, a small tree over classes speaks: the most frequent words are classes of their own, the
others go by word length; contexts have up to ``DEPTH`` of ``SYMBOLS`` classes. A word's probability is that of its
class after the longest kept suffix, times that of the word within its class (add one, a share for unseen words).

The logarithm of a text's probability is a sum over its grams: a kept context adds what it hands down, a named word
after it adds the rest.

Texts are read once and lie in blocks, each with its own words, of whole texts up to about ``4 * VALUES`` tokens.
Nothing is exchanged by position or text: in a round, a block asks once for each of its different keys (hashes), all
keys of a bucket in one packed message with the block's own counts, and gets the sums over all blocks in the order of
its question. Longer grams are asked for only where both of their shorter ones occur twice. A block then holds counts
and shares of all its grams, so that contexts and scores are worked out where the texts are; whichever block is told
to be the first with a gram counts it for its context. A key costs a bucket one entry per block, however often it
occurs; the number of buckets grows with the blocks, and no table of grams goes to the driver or to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, functions as F

from flowmill.llm.words import U64, byte_chunks, joined, mixed, signed, span_hashes, word_spans
from flowmill.session import staged

SYMBOLS, DEPTH, COMMON = 32, 3, 1 << 18  # the last: most words that could be classes of their own
REACH, VALUES = 4, 1 << 19  # words of a context; a task holds the grams of four times as many tokens at once
FREQUENT = 24  # classes of a single word
SMOOTHING, DIVERGENCE = 16.0, 61.1  # pseudo-counts of the parent; chi-square bound, 31 degrees, 1 in 1000
_LENGTHS = np.array([3, 5, 7, 9, 12, 16, 24])  # longest words of the classes by length, the last is open
END = mixed(np.array([0x656E64], U64))  # token that closes every text
_MESSAGE = "target bigint, kind int, sender bigint, data binary"
_SUMMARY = -1  # target of what a bucket says of its words
_ECHO = 1000  # kinds from here on come back as they are: what a block has to remember


def length_class(lengths: np.ndarray) -> np.ndarray:
    return FREQUENT + np.searchsorted(_LENGTHS, lengths)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and length classes of the different tokens, which of them each token is (an end after each text), and the bounds of the texts."""
    data, offsets = joined(texts)
    raw, starts, ends = word_spans(data.lower())
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts], inside[ends] = 1, -1
    letters = raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
    spans = np.frombuffer(coded.dictionary.buffers()[1], np.int32, len(coded.dictionary) + 1).astype(np.int64)
    letters = np.frombuffer(coded.dictionary.buffers()[2] or b"", np.uint8)
    words = np.concatenate([span_hashes(letters, spans[:-1], spans[1:], 5), END])
    kinds = np.concatenate([length_class(np.diff(spans)), [FREQUENT]])
    bounds = np.searchsorted(starts, offsets) + np.arange(len(texts) + 1)
    at = np.full(len(starts) + len(texts), len(words) - 1, np.int32)
    is_word = np.ones(len(at), bool)
    is_word[bounds[1:] - 1] = False
    at[is_word] = coded.indices.to_numpy()
    return words, kinds, at, bounds


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers: planes of bytes without the empty ones, compressed."""
    parts = []
    for column in columns:
        numbers = np.ascontiguousarray(column).astype(U64, copy=False)
        planes = (int(numbers.max()).bit_length() + 7) // 8 if len(numbers) else 0
        data = pa.compress(numbers.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes(), "zstd", asbytes=True) if planes else b""
        parts += [np.array([len(numbers), planes, len(data)], np.int64).tobytes(), data]
    return b"".join(parts)


def _unpacked(data: bytes) -> list[np.ndarray]:
    columns, at = [], 0
    while at < len(data):
        n, planes, size = map(int, np.frombuffer(data, np.int64, 3, at))
        at += 24
        width = 1 if planes < 2 else 2 if planes == 2 else 4 if planes <= 4 else 8
        numbers = np.zeros((n, width), np.uint8)
        if planes:
            raw = np.frombuffer(pa.decompress(data[at : at + size], n * planes, "zstd"), np.uint8).reshape(planes, n)
            for i, plane in enumerate(raw):
                numbers[:, i] = plane
        columns.append(numbers.view(f"u{width}").ravel())
        at += size
    return columns


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys ascending, the first place of each, and for every place the number of its key.

    Hashed keys are sorted by their high bits with the place below; what this leaves out of order is put right.
    """
    n = len(keys)
    below = max(n - 1, 0).bit_length()
    order = keys >> U64(below)
    order <<= U64(below)
    order |= np.arange(n, dtype=U64)
    order.sort()
    order &= U64((1 << below) - 1)
    order = order.view(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        again = np.argsort(ranked, kind="stable")
        order, ranked = order[again], ranked[again]
    new = np.ones(n, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.flatnonzero(new)
    ranked, one = ranked[at], order[at]
    numbers = np.empty(n, np.int64)
    numbers[order] = np.cumsum(new)
    numbers -= 1
    return ranked, one, numbers


def _counted(places: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(places, weights, n).astype(np.int64)


def _rows(target, kind, sender, data: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(target, pa.int64()), pa.array(kind, pa.int32()), pa.array(sender, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["target", "kind", "sender", "data"])


def _blocks(rows: DataFrame) -> DataFrame:
    """``id``, ``trains``, ``text`` as blocks of tokens: messages of kind 0 to themselves."""
    most = 4 * VALUES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0

        def block(held: list[tuple]) -> pa.RecordBatch:
            nonlocal made
            words, kinds, at, *rest = zip(*held, strict=True)
            firsts = np.cumsum([0, *map(len, words)])
            words, one, number = _distinct(np.concatenate(words))
            at = np.concatenate([number[i:][x] for i, x in zip(firsts, at, strict=False)])
            order = np.argsort(-np.bincount(at), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words))
            made += 1
            me = task + made - 1
            return _rows([me], [0], [me], [_packed(words[order], np.concatenate(kinds)[one][order], rank[at], *map(np.concatenate, rest))])

        held: list[tuple] = []
        for part, texts in byte_chunks(batches, "text", min(1 << 21, 8 * most)):
            words, kinds, at, bounds = _tokens(texts)
            if held and sum(len(x[2]) for x in held) + len(at) > most:
                yield block(held)
                held = []
            ids = part.column(0)
            held.append((
                words, kinds, at, np.diff(bounds), part.column(1).to_numpy(zero_copy_only=False).astype(bool),
                ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64), ids.is_null().to_numpy(zero_copy_only=False),
            ))
        if held:
            yield block(held)

    return rows.select("id", "trains", "text").mapInArrow(run, _MESSAGE)


@dataclass
class Common:
    """The words that are classes of their own, ascending by hash: counts, length classes and symbols."""

    words: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    symbols: np.ndarray

    def look_up(self, tokens: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words (or -1) and symbol of each token."""
        if not len(self.words):
            return np.full(len(tokens), -1), kind
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        at = np.where(self.words[at] == tokens, at, -1)
        return at, np.where(at >= 0, self.symbols[at], kind)


def _vocabulary(answers: DataFrame) -> tuple[dict[int, tuple[int, int]], Common]:
    """Tokens and different words of each length class, and the most frequent words, out of the buckets' answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3).to_pylist():
                words, kinds, n, v = _unpacked(data)
                named = np.arange(len(kinds)) < len(words)
                words = np.concatenate([words, np.zeros(len(kinds) - len(words), U64)])
                made = [pa.array(words.view(np.int64), mask=~named), *(pa.array(x.astype(np.int64)) for x in (kinds, n, v))]
                yield pa.RecordBatch.from_arrays(made, names=["word", "kind", "n", "v"])

    rows = answers.where(f"target = {_SUMMARY}").mapInArrow(run, "word bigint, kind bigint, n bigint, v bigint")
    by_kind = {r["kind"]: (r["n"], r["v"]) for r in rows.where("word is null").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    top = rows.where("word is not null").orderBy(F.desc("n"), "word").limit(min(FREQUENT, COMMON)).toArrow()
    words, kinds, counts = (top.column(c).to_numpy().astype(np.int64) for c in ("word", "kind", "n"))
    order = np.argsort(words.view(U64))
    return by_kind, Common(words.view(U64)[order], counts[order], kinds[order], np.arange(len(words))[order])


def _contexts(symbols: np.ndarray, bounds: np.ndarray, end_symbol: int) -> np.ndarray:
    """For each token the ``DEPTH`` symbols before it, oldest first, in base ``SYMBOLS``; ends stand before a text."""
    code = np.zeros(len(symbols), np.int32)
    place = (np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.int32)
    symbols = symbols.astype(np.int32)
    for back in range(DEPTH, 0, -1):
        before = np.concatenate([np.full(min(back, len(symbols)), end_symbol, np.int32), symbols[: max(0, len(symbols) - back)]])
        code = code * np.int32(SYMBOLS) + np.where(place >= back, before, np.int32(end_symbol))
    return code.astype(np.int64)


def _gram_counts(blocks: DataFrame, shared, end_symbol: int) -> DataFrame:
    cells = SYMBOLS ** (DEPTH + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(cells, np.int64)
        for block in _read(batches, Block):
            symbols = Common(*shared.value).look_up(block.words, block.kinds)[1][block.at]
            grams = _contexts(symbols, block.bounds, end_symbol) * SYMBOLS + symbols
            count += np.bincount(grams[block.weights], minlength=cells)
        at = np.flatnonzero(count)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(count[at[i : i + 50_000]])], names=["gram", "n"])

    return blocks.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class SuffixTree:
    """Kept contexts by length and the smoothed next-symbol probabilities of each full context."""

    def __init__(self, grams: np.ndarray):
        """``grams``: counts of ``DEPTH + 1`` symbols, oldest first, in base ``SYMBOLS``."""
        a = SYMBOLS
        counts = [grams.reshape(a**DEPTH, a).astype(float)]
        for d in range(DEPTH - 1, -1, -1):  # drop the oldest symbol
            counts.insert(0, counts[0].reshape(a, a**d, a).sum(axis=0))
        root = counts[0][0] + 1.0
        p = (root / root.sum()).reshape(1, a)
        self.kept = [np.ones(1, bool)]
        smoothed = [p]
        for d in range(1, DEPTH + 1):
            parent = np.tile(smoothed[-1], (a, 1))
            c = counts[d]
            total = c.sum(axis=1, keepdims=True)
            own = (c + SMOOTHING * parent) / (total + SMOOTHING)
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(c > 0, c / total, 1.0)
                ratio = 2 * np.where(c > 0, c * np.log(share / parent), 0.0).sum(axis=1)
            self.kept.append(ratio > DIVERGENCE)
            smoothed.append(own)
        # a kept context keeps its suffixes, so that the longest one is found by walking back
        for d in range(DEPTH, 1, -1):
            self.kept[d - 1] |= self.kept[d].reshape(a, a ** (d - 1)).any(axis=0)
        table = np.tile(smoothed[0], (a**DEPTH, 1))
        for d in range(1, DEPTH + 1):
            full = np.tile(self.kept[d], a ** (DEPTH - d))
            own = self._resmoothed(counts, d)
            table[full] = np.tile(own, (a ** (DEPTH - d), 1))[full]
        self.log10 = np.log10(table)

    def _resmoothed(self, counts: list[np.ndarray], depth: int) -> np.ndarray:
        """Distributions of all contexts of a length, smoothed along their kept suffixes."""
        a = SYMBOLS
        root = counts[0][0] + 1.0
        p = (root / root.sum()).reshape(1, a)
        for d in range(1, depth + 1):
            parent = np.tile(p, (a, 1))
            own = (counts[d] + SMOOTHING * parent) / (counts[d].sum(axis=1, keepdims=True) + SMOOTHING)
            p = np.where(self.kept[d][:, None], own, parent)
        return p


def pair_key(context: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mixed(context * U64(0x9E3779B97F4A7C15) + low)


def _read(batches: Iterator[pa.RecordBatch], made: Callable) -> Iterator:
    """One ``made(target, kinds)`` after the other from rows sorted by target, kind and sender.

    ``kinds``: by kind the lists of senders and of their messages.
    """
    target, kinds = None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            to, kind, sender, data = (batch.column(c)[i].as_py() for c in range(4))
            if to != target and kinds:
                yield made(target, kinds)
                kinds = {}
            target = to
            senders, messages = kinds.setdefault(kind, ([], []))
            senders.append(sender)
            messages.append(data)
    if kinds:
        yield made(target, kinds)


@dataclass
class Grams:
    """The different grams of one length that a block has and training has twice, ascending by key.

    ``at`` and ``number``: tokens where they end, and which of them it is. ``ctx`` and ``low``: numbers of the grams
    without the last and without the first word. ``own``: this block counts them. ``p``: smoothed share of the last
    word; ``governed``: by a kept context. ``value`` (log10): of a word that is named after its context. As contexts:
    ``down`` (log10) of what the kept ones hand down, ``first`` (the shortest kept), ``ours`` (told by this block).
    """

    at: np.ndarray
    number: np.ndarray
    keys: np.ndarray
    n: np.ndarray
    own: np.ndarray
    ctx: np.ndarray | None = None
    low: np.ndarray | None = None
    p: np.ndarray | None = None
    governed: np.ndarray | None = None
    value: np.ndarray | None = None
    down: np.ndarray | None = None
    first: np.ndarray | None = None
    ours: np.ndarray | None = None


class Block:
    """Tokens of some texts, and what the buckets have answered.

    Kind ``2 * m`` asks for the counts of grams of ``m`` words, kind ``2 * m + 1`` for what grams of ``m`` words make
    of their contexts: how many of them keep it, how many are governed, their summed counts and their number. Kind
    ``_ECHO + m`` marks the tokens where a gram of ``m`` words ends that occurs twice.
    """

    def __init__(self, target: int, kinds: dict[int, tuple[list[int], list[bytes]]]):
        self.target = target
        self.words, self.kinds, self.at, lengths, trains, ids, null = _unpacked(kinds[0][1][0])
        self.at = self.at.astype(np.int64)
        self.words, self.kinds, self.ids = self.words.astype(U64, copy=False), self.kinds.astype(np.int64), ids.astype(U64, copy=False).view(np.int64)
        self.trains, self.null = trains == 1, null == 1
        self.bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.weights = np.repeat(self.trains, lengths)
        self.answers = {k: v for k, (_, v) in kinds.items() if k}

    def _answer(self, kind: int, columns: int) -> list[np.ndarray]:
        if kind not in self.answers:  # it had nothing to ask
            return [np.zeros(0, np.int64)] * columns
        return [np.concatenate(x).astype(np.int64) for x in zip(*map(_unpacked, self.answers[kind]), strict=True)]

    def word_counts(self) -> np.ndarray:
        """How often each of ``words`` occurs in training."""
        n = np.empty(len(self.words), np.int64)
        n[np.argsort(self.words)] = self._answer(2, 2)[0]
        return n

    def climb(self, rounds: int, unigram: Callable | None = None, bound: float = 0.0, each: Callable | None = None) -> list[tuple]:
        """What to ask after so many rounds: kind, keys ascending, columns.

        ``unigram``: the share of a word by its count. ``each`` is given the grams of one length after the other, with
        their values, once all is answered.
        """
        order = np.argsort(self.words)
        words = self.words[order]
        if not rounds:
            return [(2, words, [_counted(self.at, len(words), self.weights)[order], self.kinds[order]])]
        values = each is not None
        n, own = self._answer(2, 2)
        use = np.flatnonzero(n > 1)
        by_word = np.full(len(n), -1)
        by_word[order[use]] = np.arange(len(use))
        found, number = self.answers.get(_ECHO + 2), None
        if values or not found:
            number = by_word[self.at]
        at = np.flatnonzero(number >= 0) if values else None
        known = Grams(at, number[at] if values else None, words[use], n[use], own[use] > 0)
        known.p, known.governed = unigram(known.n), np.zeros(len(use), bool)
        asks = []
        for m in range(2, REACH + 2):
            if found := self.answers.get(_ECHO + m):
                (bits,) = _unpacked(found[0])
                at = np.flatnonzero(np.unpackbits(bits.astype(np.uint8, copy=False), count=len(self.at)).view(bool))
            else:
                follows = number >= 0
                follows[1:] &= follows[:-1].copy()
                follows[0] &= number[-1] >= 0  # an end stands before the first text
                if m == 3:  # where it is only a start
                    follows[self.bounds[:-1]] = False
                at = np.flatnonzero(follows)
                del follows

            def parts(at: np.ndarray, number=number) -> Iterator[np.ndarray]:  # without the last and without the first word
                return (by_word[self.at[x]] if number is None else number[x] for x in (at - 1, at))

            keys, one, which = _distinct(pair_key(*(known.keys[x] for x in parts(at))))
            if m > rounds:
                if len(keys):
                    asks.append((2 * m, keys, [_counted(which, len(keys), self.weights[at])]))
                break
            n, own = self._answer(2 * m, 2)
            use = np.flatnonzero(n > 1)
            n, own = n[use], own[use] > 0
            ctx, low = parts(at[one if found else one[use]])
            if not found:
                again = np.full(len(keys), -1)
                again[use] = np.arange(len(use))
                which = again[which]
                there = np.flatnonzero(which >= 0)
                at, which, keys = at[there], which[there], keys[use]
            number = again = there = parts = None
            number = np.full(len(self.at), -1)
            number[at] = which
            grams = Grams(at, which, keys, n, own, ctx, low)
            if m > rounds - 1:
                if len(known.keys):
                    asks.append((2 * m + 1, known.keys, self._made(known, grams, bound)))
                if len(at):
                    asks.append((_ECHO + m, None, [np.packbits(number >= 0)]))
            elif values or m < REACH + 1:
                self._settle(known, grams, values, *self._answer(2 * m + 1, 5))
            if values:
                each(known)
            known = grams
        if values:
            each(known)
        return asks

    @staticmethod
    def _made(known: Grams, grams: Grams, bound: float) -> list[np.ndarray]:
        own = np.flatnonzero(grams.own)
        ctx, n = grams.ctx[own], grams.n[own]
        total, p, over = known.n[ctx], known.p[grams.low[own]], known.governed[grams.low[own]]
        more = np.flatnonzero(n > total * p)
        ratio = n[more] * np.log(n[more] / total[more] / p[more])
        rest = np.flatnonzero(total[more] > n[more])
        part = more[rest]
        others = total[part] - n[part]
        ratio[rest] += others * np.log(others / total[part] / (1 - p[part]))
        size = len(known.keys)
        return [_counted(ctx[more[ratio > bound]], size), _counted(ctx[over], size), _counted(ctx, size, n), _counted(ctx, size)]

    @staticmethod
    def _settle(known: Grams, grams: Grams, values: bool, keep, over, named, k, own) -> None:
        """Contexts from the answers, then the grams that stand after them."""
        kept = keep > 0
        handed, total = known.n - named + k, known.n + k
        parent, after = known.p[grams.low], np.flatnonzero(kept[grams.ctx])
        ctx = grams.ctx[after]
        grams.p, grams.governed = parent.copy(), known.governed[grams.low]
        grams.p[after] = (grams.n[after] + handed[ctx] * parent[after]) / total[ctx]
        grams.governed[after] = True
        if values:
            here = np.flatnonzero(kept)
            down = np.ones(len(kept))
            down[here] = handed[here] / total[here]
            known.down, known.first, known.ours = np.log10(down), kept & (over == 0), kept & (own > 0)
            grams.value = np.zeros(len(grams.n))
            grams.value[after] = np.log10(grams.p[after] / parent[after] / down[ctx])


class Bucket:
    """Adds up what blocks ask for: each message has keys, ascending, and columns to sum."""

    def __init__(self, target: int, kinds: dict[int, tuple[list[int], list[bytes]]]):
        self.target, self.kinds = target, kinds

    def answers(self) -> Iterator[pa.RecordBatch]:
        """The sums and who is the first to ask, in the order of each message; nothing where the first sum is too small."""
        for kind, (senders, messages) in self.kinds.items():
            if kind >= _ECHO:
                yield _rows(senders, [kind] * len(senders), [self.target] * len(senders), messages)
                continue
            deltas, *columns = zip(*map(_unpacked, messages), strict=True)
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in deltas])])
            keys, one, number = _distinct(np.concatenate([np.cumsum(x, dtype=U64) for x in deltas]))
            if kind == 2:
                length = np.concatenate(columns.pop()).astype(np.int64)[one]
            sums = [_counted(number, len(keys), np.concatenate(x)) for x in columns]
            use = sums[0] > (kind % 2 == 0 and kind > 2)  # grams seen once are none; a context is kept or not
            told = [np.where(use, x, 0)[number] for x in sums]
            first = np.zeros(len(number), bool)
            first[one] = use
            told.append(first)
            data = [_packed(*(x[i:j] for x in told)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield _rows(senders, [kind] * len(senders), [self.target] * len(senders), data)
            if kind == 2:
                yield _rows([_SUMMARY], [0], [self.target], [self._summary(keys, length, sums[0])])

    @staticmethod
    def _summary(words: np.ndarray, length: np.ndarray, n: np.ndarray) -> bytes:
        """Its most frequent words with classes and counts; then, without words, tokens and different words by class."""
        top = np.lexsort((words.view(np.int64), -n))[:FREQUENT]
        top = top[n[top] > 0]
        v = np.bincount(length[n > 0], minlength=SYMBOLS)
        kinds = np.flatnonzero(v)
        tokens = _counted(length, SYMBOLS, n)
        return _packed(words[top], np.concatenate([length[top], kinds]), np.concatenate([n[top], tokens[kinds]]), np.concatenate([np.ones(len(top), np.int64), v[kinds]]))


@dataclass
class GramValues:
    """The grams that change a score, as the blocks of their texts know them."""

    answered: DataFrame  # blocks with all answers, sorted by block
    climb: Callable  # of a block, with what is to be done for the grams of each length

    def table(self) -> DataFrame:
        """``key``, ``n``, ``value`` (log10) and ``first`` (the shortest kept context of its positions), one row per gram."""
        climb, names = self.climb, ["key", "n", "value", "first"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _read(batches, Block):
                made: list[pa.RecordBatch] = []

                def add(g: Grams, made=made) -> None:
                    for use, value, first in ((g.own, g.value, np.zeros(len(g.n), bool)), (g.ours, g.down, g.first)):
                        if value is not None:
                            at = np.flatnonzero(use & (value != 0))
                            made.append(pa.RecordBatch.from_arrays(
                                [pa.array(signed(g.keys[at])), pa.array(g.n[at]), pa.array(value[at]), pa.array(first[at].astype(np.int32))], names=names
                            ))

                climb(block, add)
                yield from made

        rows = self.answered.mapInArrow(run, "key bigint, n bigint, value double, first int")
        return rows.groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value"), F.max("first").alias("first"))

    def collect(self) -> list[Row]:
        return self.table().collect()


def _dealt(messages: DataFrame, parts: int) -> DataFrame:
    return messages.repartition(parts, "target").sortWithinPartitions("target", "kind", "sender")


class Rounds:
    """Questions of blocks to the buckets of keys, and what is answered so far."""

    def __init__(self, blocks: DataFrame):
        self.told, self.done = blocks, 0
        self.parts = max(1, blocks.count())
        self.buckets = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.parts)

    def blocks(self) -> DataFrame:
        return _dealt(self.told, self.parts) if self.done else self.told

    def ask(self, *how) -> DataFrame:
        """One round; its answers."""
        done, buckets = self.done, self.buckets
        cuts = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64)  # keys are hashes, so buckets are alike

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _read(batches, Block):
                for kind, keys, columns in block.climb(done, *how):
                    if keys is None:
                        yield _rows([block.target % buckets], [kind], [block.target], [_packed(*columns)])
                        continue
                    ends = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
                    to = np.flatnonzero(np.diff(ends))
                    data = [_packed(np.diff(keys[i:j], prepend=U64(0)), *(x[i:j] for x in columns)) for i, j in zip(ends[to], ends[to + 1], strict=True)]
                    yield _rows(to, [kind] * len(to), [block.target] * len(to), data)

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket in _read(batches, Bucket):
                yield from bucket.answers()

        conf, cleanup = self.told.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(cleanup, None)
        conf.set(cleanup, "true")  # nothing reads the round's shuffle files again
        try:
            answers = staged(_dealt(self.blocks().mapInArrow(run, _MESSAGE), buckets).mapInArrow(answer, _MESSAGE), "answers")
        finally:
            conf.unset(cleanup) if before is None else conf.set(cleanup, before)
        self.told = self.told.unionByName(answers.where(f"target <> {_SUMMARY}"))
        self.done += 1
        return answers


def gram_values(rounds: Rounds, unigram: Callable, bound: float) -> GramValues:
    """Counts, shares and values of all grams of up to ``REACH + 1`` words, told to the blocks that have them."""
    last = REACH + 2
    while rounds.done < last and not rounds.ask(unigram, bound).isEmpty():  # or else nothing longer occurs twice
        pass
    return GramValues(rounds.blocks(), lambda block, each: block.climb(last, unigram, bound, each))


def log_scores(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row by a model of the rows for which the SQL condition ``train`` holds.

    ``id``, ``trains``, ``n_tokens``, ``n_known`` (tokens that occur in training), ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score`` (the suffix trees), both log10. Null and empty texts are
    one end token. A condition that is null does not train. Repeated rows train and are scored each. With no
    training rows every token is unseen. Other columns of ``docs`` are not read but for the condition; an
    empty table gives an empty table.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"coalesce({train}, false) trains", f"cast(`{text_col}` as string) text")
    blocks = staged(_blocks(rows), "blocks")
    rounds = Rounds(blocks)
    by_kind, common = _vocabulary(rounds.ask())
    all_tokens, distinct = sum(n for n, _ in by_kind.values()), sum(v for _, v in by_kind.values())
    shared = rows.sparkSession.sparkContext.broadcast((common.words, common.counts, common.kinds, common.symbols))
    _, end_symbols = common.look_up(END, np.array([FREQUENT]))
    end_symbol = int(end_symbols[0])
    grams = np.zeros(SYMBOLS ** (DEPTH + 1), np.int64)
    table = _gram_counts(blocks, shared, end_symbol).toArrow()
    grams[table.column("gram").to_numpy()] = table.column("n").to_numpy()
    tree = rows.sparkSession.sparkContext.broadcast(SuffixTree(grams).log10)

    # tokens and distinct words of each class; the words that are classes of their own leave their length's class
    n_class, v_class = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    for kind, (n, v) in by_kind.items():
        n_class[kind], v_class[kind] = n, v
    for at in np.flatnonzero(common.symbols < FREQUENT):
        symbol, kind, count = common.symbols[at], common.kinds[at], common.counts[at]
        n_class[symbol], v_class[symbol] = count, 1
        n_class[kind] -= count
        v_class[kind] -= 1
    room = np.where(np.arange(SYMBOLS) < FREQUENT, 0, 1)  # unseen words belong to a class by length
    within = np.log10(n_class + v_class + room + (n_class + v_class + room == 0))  # of the denominators
    base = np.log10(all_tokens + distinct + 1)

    def unigram(n: np.ndarray) -> np.ndarray:
        return (n + 1) / float(all_tokens + distinct + 1)

    found = gram_values(rounds, unigram, float(np.log(all_tokens + distinct + 1)))
    climb = found.climb

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches, Block):
            bounds, n_words = block.bounds, block.word_counts()
            symbols = Common(*shared.value).look_up(block.words, block.kinds)[1][block.at]
            path = tree.value[_contexts(symbols, bounds, end_symbol), symbols] - within[symbols]
            del symbols
            total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has its end token
            score = np.log10(n_words + 1.0)[block.at]
            base_score = total(score) - np.diff(bounds) * base
            score += path
            # what the class tree gives the token after each beyond its unigram; a kept context takes it back
            path += base
            after = np.roll(path, -1)
            after[bounds[1:] - 1] = path[bounds[:-1]]
            del path

            def add(g: Grams, score=score, after=after) -> None:
                if g.value is not None:
                    score[g.at] += g.value[g.number]
                if g.down is not None:
                    score[g.at] += g.down[g.number]
                    first = g.at[g.first[g.number]]
                    score[first] -= after[first]

            climb(block, add)
            n = np.diff(bounds)
            made = [
                pa.array(block.ids, mask=block.null), pa.array(block.trains), pa.array(n), pa.array(total((n_words > 0).astype(np.int64)[block.at])),
                pa.array(base_score), pa.array(total(score)),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["id", "trains", "n_tokens", "n_known", "base_score", "score"])

    schema = "id bigint, trains boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    train_tokens = F.lit(all_tokens).cast("long").alias("train_tokens")
    return found.answered.mapInArrow(scored, schema).select("id", "trains", "n_tokens", "n_known", train_tokens, "base_score", "score")
