"""Periodic runs: stretches of words that repeat themselves with a period, found by seeds on diagonals.

A run of period ``q`` and length ``n`` (at least ``least`` words and ``times`` periods) agrees with itself, shifted
by the lag ``q``, over ``n - q`` words. This guaranteed overlap is the gram width ``k`` of a level: 16 words for lags
up to 16 (with 24 words and 3 periods), then 34 for lags up to 34, 70 up to 70, and so on. Each level indexes all
k-grams of a document and takes as seeds the pairs of an occurrence and the next one of the same gram, if they lie
one of the level's lags apart.

The next occurrence is enough. If a gram of a run with smallest period ``q <= k`` came again ``d < q`` words on,
the ``k + d >= q + d`` words from the one to the other's end would have both periods, hence also their greatest
common divisor (Fine and Wilf), and ``q`` would not be the smallest. Likewise a seed's stretch has no smaller
period than its lag. So there is at most one seed a word and level, and not a pair for every two occurrences.

A seed is extended along its diagonal to both sides; a table of the word up to which each lag is covered drops the
seeds inside. What remains are the runs, each once. Grams are numbered exactly (equal numbers
mean equal words), by joining the numbers of the two halves.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from flowmill.llm.words import Words, map_texts, mixed, rolling

LEAST, TIMES = 24, 3


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """Words over which every run is sure to agree with itself shifted: the least of max(least - q, (times - 1) q)."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (left, right): equal numbers for equal pairs."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def _agreement(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around ``at`` whose words equal those ``lag`` further on: its first word and its end."""
    ends = []
    for step, room in ((1, len(x) - lag - at), (-1, at)):
        done, size = 0, 64
        while done < room:
            size = min(size, room - done)
            a = at + done if step > 0 else at - done - size
            equal = x[a : a + size] == x[a + lag : a + lag + size]
            if not equal.all():
                done += int((~equal if step > 0 else ~equal[::-1]).argmax())
                break
            done, size = done + size, size * 2
        ends.append(done)
    return at - ends[1], at + ends[0]


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``x``, by start, then period."""
    if times < 3 or least < times:
        raise ValueError("runs of at least three periods, and of one word a period")
    n, k = len(x), overlap(least, times)
    found: list[tuple[int, int, int]] = []
    if n < least:
        return found
    width, grams, low = 1, np.unique(x, return_inverse=True)[1].astype(np.int64), 1
    while low * times <= n and k < n:
        # numbers of k-grams out of those of the widest power of two within k
        while width * 2 <= k:
            grams = _ranks(grams[:-width], grams[width:])
            width *= 2
        index = grams if width == k else _ranks(grams[: n - k + 1], grams[k - width :])
        order = np.argsort(index, kind="stable")
        same = np.flatnonzero(index[order[1:]] == index[order[:-1]])
        at, lag = order[same], order[same + 1] - order[same]
        wanted = (lag >= low) & (lag <= k)
        at, lag = at[wanted], lag[wanted]
        covered: dict[int, int] = {}
        by_lag = np.lexsort((at, lag))
        at, lag = at[by_lag], lag[by_lag]
        i = 0
        while i < len(at):
            period = int(lag[i])
            start, covered[period] = _agreement(x, int(at[i]), period)
            length = covered[period] + period - start
            if length >= max(least, times * period):
                found.append((start, length, period))
            # on to the lag's first gram that reaches beyond what is covered, or to the next lag
            last = i + int(np.searchsorted(lag[i:], period, "right"))
            i += int(np.searchsorted(at[i:last], covered[period] - k + 1))
        low, k = k + 1, (times - 1) * (k + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repeating(w: Words, k: int) -> np.ndarray:
    """Whether a text of the chunk holds some k-gram twice (by hashes; others have no run)."""
    grams = rolling(w.hashes, k)
    text = np.repeat(np.arange(len(w.counts)), np.maximum(w.counts - k + 1, 0))
    first = np.repeat(w.bounds[:-1], np.maximum(w.counts - k + 1, 0))
    nth = np.arange(len(text)) - np.repeat(np.cumsum(c := np.maximum(w.counts - k + 1, 0)) - c, c)
    own = grams[first + nth] ^ mixed(text.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    twice = order[1:][own[order[1:]] == own[order[:-1]]]
    out = np.zeros(len(w.counts), bool)
    out[text[twice]] = True
    return out


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, with_text: bool = False
) -> DataFrame:
    """``id``, ``n_words``, ``runs`` (start, length and period in words, by start, then period), ``n_dropped`` and
    ``collapsed_sha256`` of every row, and with ``with_text`` the collapsed text itself.

    A run is a stretch with smallest period q, of at least ``least`` words and ``times`` periods, that no neighbour
    extends. The collapsed text has the words, joined by one space, that no run contains after its first q words.
    Null and empty texts have no words and no runs. Repeated rows repeat; a null id stays null; other columns of
    ``docs`` are not read; an empty table gives an empty one. A text is handled as a whole by one task, in memory
    proportional to its length.
    """
    schema = (
        "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, n_dropped bigint, collapsed_sha256 string"
        + (", collapsed string" if with_text else "")
    )
    k = overlap(least, times)

    def work(part, texts):
        w = Words(texts)
        repeating = _repeating(w, k)
        out = {"id": part.column(0), "n_words": w.counts, "runs": [], "n_dropped": [], "collapsed_sha256": [], "collapsed": []}
        for i, text in enumerate(texts):
            words, runs, kept = text.split(), [], None
            if repeating[i]:
                numbers: dict[bytes, int] = {}
                runs = runs_of(np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64), least, times)
            if runs:
                change = np.zeros(len(words) + 1, np.int64)
                for start, length, period in runs:
                    change[start + period] += 1
                    change[start + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = b" ".join(words if kept is None else kept)
            out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            out["n_dropped"].append(0 if kept is None else len(words) - len(kept))
            out["collapsed_sha256"].append(hashlib.sha256(joined).hexdigest())
            if with_text:
                out["collapsed"].append(joined.decode())
        return out

    return map_texts(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text"), "text", schema, work)
