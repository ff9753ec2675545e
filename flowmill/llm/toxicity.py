"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores ``sigmoid(bias + its words' weights)``, a document one
minus the product of its sentences' complements (noisy-or); only documents carry labels. Words are hashed to
2**20 cells. The model is fitted on a bounded sample of labelled rows (``sample``, by hash order), scoring
covers every row and names the offending sentences.

Toxic documents are rare, so the fitted probabilities lie low. The sample is dealt to folds by hash; every document is
scored by a model whose words and weights come from the other folds, and the score that parts these documents best
(the greatest sum of both classes' shares on the right side, with 98 percent of the clean documents or more below)
becomes 0.5: complements of sentence scores are raised to the power ``scale``, which keeps the noisy-or and the order
of the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowmill.llm.words import U64, byte_chunks, joined, map_texts, span_hashes, word_spans
from flowmill.session import staged

CELLS = 20
SAMPLE, FOLDS = 20_000, 4
LEAST_DOCUMENTS, LEAST_DEVIATIONS = 4, 3.5
SPARED = 0.98  # least share of the clean documents that must stay below the cut
STEMS = (5, 6, 7)  # beginnings of longer words, in bytes, that count as words of their own

_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # line break ! . ?


@dataclass(frozen=True)
class Model:
    cells: np.ndarray  # ascending
    weights: np.ndarray
    bias: float
    scale: float = 1.0  # exponent of the sentences' complements

    def table(self) -> np.ndarray:
        """For every cell its place among the weights, or -1."""
        at = np.full(1 << CELLS, -1, np.int32)
        at[self.cells] = np.arange(len(self.cells))
        return at


class Sentences:
    """Words and their beginnings (as cells) and sentences of a chunk of texts; a sentence ends at . ! ? or a line break."""

    def __init__(self, texts: list[bytes]):
        data, self.offsets = joined(texts)
        raw, starts, ends = word_spans(data.translate(_FORM))
        hashes, word = [span_hashes(raw, starts, ends, 3)], [np.arange(len(starts))]
        for size in STEMS:
            word.append(np.flatnonzero(ends - starts > size))
            hashes.append(span_hashes(raw, starts[word[-1]], starts[word[-1]] + size, 3 + size))
        word = np.concatenate(word)
        order = np.argsort(word, kind="stable")
        self.cells = (np.concatenate(hashes)[order] >> U64(64 - CELLS)).astype(np.int64)
        marks = np.cumsum(_STOP[np.frombuffer(data, np.uint8)])
        before = np.concatenate([[0], marks])
        self.sentence = before[starts[word[order]]]  # of each cell
        self.text = np.searchsorted(self.offsets, starts[word[order]], "right") - 1  # of each cell
        self.stops = np.flatnonzero(np.diff(before))  # byte where each sentence ends

    def span(self, sentence: int) -> tuple[int, int]:
        """First and after-last byte of a sentence, its closing mark left out."""
        return (int(self.stops[sentence - 1]) + 1 if sentence else 0), int(self.stops[sentence])


def _sentence_scores(cells: np.ndarray, sentence: np.ndarray, table: np.ndarray, weights: np.ndarray, bias: float):
    """Sentences that have words, whether or not these weigh, and their log-odds; a word counts once a sentence."""
    present = np.unique(sentence)
    logit = np.full(len(present), bias)
    at = table[cells]
    hit = np.flatnonzero(at >= 0)
    if len(hit):
        pairs = np.unique(sentence[hit] * np.int64(len(weights)) + at[hit])
        np.add.at(logit, np.searchsorted(present, pairs // len(weights)), weights[pairs % len(weights)])
    return present, logit


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit_weights(label, sentences, doc, sentence, feature, n_features: int, steps: int = 200, l2: float = 1e-4):
    """Noisy-or fit by Adam on the whole sample. ``label`` and ``sentences`` by document; hits as (doc, sentence, feature)."""
    label = np.asarray(label, float)
    sentences = np.asarray(sentences, float)
    n = len(label)
    if not n or not n_features or label.min() == label.max():
        share = (label.sum() + 0.5) / (n + 1) if n else 0.5
        typical = max(1.0, sentences.mean() if n else 1.0)
        return np.zeros(n_features), float(np.log(np.expm1(-np.log1p(-share) / typical)))
    keys, row = np.unique(doc * np.int64(1 << 32) + sentence, return_inverse=True)
    own = (keys >> 32).astype(np.int64)  # the document of each sentence with hits
    plain = sentences - np.bincount(own, minlength=n)  # sentences without hits
    theta = np.zeros(n_features + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        logit = b + np.bincount(row, w[feature], len(keys))
        odds = plain * softplus(b) + np.bincount(own, softplus(logit), n)  # -log(1 - p)
        odds = np.maximum(odds, 1e-9)
        pull = np.where(label > 0, -np.exp(-odds) / -np.expm1(-odds), 1.0)  # d loss / d odds
        slope = pull[own] / (1 + np.exp(-logit))
        grad = np.empty_like(theta)
        grad[:-1] = np.bincount(feature, slope[row], n_features) / n + l2 * w
        grad[-1] = (slope.sum() + (pull * plain).sum() / (1 + np.exp(-b))) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def odds_of(sentences, doc, sentence, feature, weights: np.ndarray, bias: float) -> np.ndarray:
    """-log(1 - p) of every document, from its number of sentences and its hits (doc, sentence, feature)."""
    sentences = np.asarray(sentences, float)
    keys, row = np.unique(doc * np.int64(1 << 32) + sentence, return_inverse=True)
    own = (keys >> 32).astype(np.int64)
    plain = sentences - np.bincount(own, minlength=len(sentences))
    return plain * softplus(bias) + np.bincount(own, softplus(bias + np.bincount(row, weights[feature], len(keys))), len(sentences))


def parting(label: np.ndarray, odds: np.ndarray) -> float:
    """The odds that part the classes best with at least ``SPARED`` of the clean documents below: the middle, by
    logarithm, of the best gap between neighbouring values."""
    order = np.argsort(odds, kind="stable")
    label, odds = np.asarray(label)[order] > 0, np.maximum(odds[order], 1e-12)
    spared = np.cumsum(~label) / (~label).sum()
    right = spared + (label.sum() - np.cumsum(label)) / label.sum()  # cut behind each document
    gap = (odds[:-1] < odds[1:]) & (spared[:-1] >= SPARED)
    if not gap.any():
        return float(max(np.log(2), 2 * odds[-1]))
    good = np.flatnonzero(gap & (right[:-1] >= right[:-1][gap].max() - 1e-12))
    widest = good[np.argmax(odds[good + 1] / odds[good])]
    return float(np.sqrt(odds[widest] * odds[widest + 1]))


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(key, label, text) of at most ``sample`` labelled texts, the first by hash; a text counts once, however many rows
    have it, so that copies do not make their words stand out (its label is 1 if any is)."""
    known = labels.groupBy("id").agg(F.max("label").alias("label")).where("id is not null and label is not null")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    own = docs.join(F.broadcast(chosen), "id").withColumn("key", F.xxhash64("text"))  # 16 bytes a row, at most ``sample`` rows
    keys = own.select("key").distinct().orderBy("key").limit(sample)
    return own.join(F.broadcast(keys), "key").groupBy("key").agg(F.max("label").alias("label"), F.min("text").alias("text"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """By cell the documents of the sample that hold it: clean_0, toxic_0, ... for every fold; cell -1 counts all."""

    def counted(batches):
        count = np.zeros((2 * FOLDS, 1 << CELLS), np.int32)
        seen = np.zeros(2 * FOLDS, np.int64)
        for part, texts in byte_chunks(batches, "text"):
            s = Sentences(texts)
            label, fold = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "fold"))
            of = 2 * fold + (label > 0)
            seen += np.bincount(of, minlength=2 * FOLDS)
            key = np.unique(s.text * np.int64(1 << CELLS) + s.cells)
            np.add.at(count, (of[key >> CELLS], key & ((1 << CELLS) - 1)), 1)
        at = np.flatnonzero(count.any(axis=0))
        names = ["cell", *_COUNTS]
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1]), *(pa.array([int(n)]) for n in seen)], names=names)
        for i in range(0, len(at), 50_000):
            j = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(j), *(pa.array(c[j].astype(np.int64)) for c in count)], names=names)

    counts = rows.select("label", "fold", "text").mapInArrow(counted, ", ".join(f"{c} bigint" for c in ["cell", *_COUNTS]))
    return counts.groupBy("cell").agg(*(F.sum(c).alias(c) for c in _COUNTS))


_COUNTS = [f"{kind}_{k}" for k in range(FOLDS) for kind in ("clean", "toxic")]


def _stands_out(left_out: int | None, totals: dict[str, int]) -> Column:
    """Whether a word's share is greater among toxic texts, outside the fold ``left_out``; false if a class is empty."""
    names = {kind: [f"{kind}_{k}" for k in range(FOLDS) if k != left_out] for kind in ("clean", "toxic")}
    n = {kind: float(sum(totals[c] for c in cs)) for kind, cs in names.items()}
    if not n["clean"] or not n["toxic"]:
        return F.lit(False)
    clean, toxic = (sum((F.col(c) for c in names[kind]), F.lit(0)) for kind in ("clean", "toxic"))
    both = (clean + toxic) / (n["clean"] + n["toxic"])
    z = (toxic / n["toxic"] - clean / n["clean"]) / F.sqrt(both * (1 - both) * (1 / n["clean"] + 1 / n["toxic"]) + 1e-12)
    return (clean + toxic >= LEAST_DOCUMENTS) & (z >= LEAST_DEVIATIONS)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs`` (id, text) and ``labels`` (id, label 0/1). Conflicting labels of an id count as 1; a null text is empty.

    Without labels of both classes no word weighs and no score is moved; an empty table gives a model of 0.5 a text.
    """
    rows = _sampled(docs, labels, sample).withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int"))
    rows = staged(rows, "labelled")
    counts = _word_counts(rows)
    total = counts.where("cell = -1").first()
    totals = total.asDict() if total else dict.fromkeys(_COUNTS, 0)
    clean, toxic = (sum(totals[c] for c in _COUNTS if c.startswith(kind)) for kind in ("clean", "toxic"))
    if not clean or not toxic:
        empty = np.zeros(0, np.int64)
        _, bias = fit_weights([1] * min(toxic, 1) + [0] * min(clean, 1), [1] * (bool(clean) + bool(toxic)), empty, empty, empty, 0)
        return Model(empty, np.zeros(0), bias)
    use = [f"use_{k}" for k in range(FOLDS)]
    picked = counts.where("cell >= 0").select(
        "cell", _stands_out(None, totals).alias("use"), *(_stands_out(k, totals).alias(c) for k, c in enumerate(use))
    ).where(F.greatest("use", *use)).toPandas().sort_values("cell")  # cells of the bounded sample's words
    cells = picked["cell"].to_numpy(np.int64)
    table = Model(cells, np.zeros(len(cells)), 0.0).table()

    def hits(part, texts):
        s = Sentences(texts)
        at = table[s.cells]
        key = np.unique(s.text * np.int64(1 << 32) + s.sentence)
        number = np.bincount(key >> 32, minlength=len(texts))
        found = np.flatnonzero(at >= 0)
        order = np.searchsorted(s.text[found], np.arange(len(texts) + 1))
        out = []
        for i in range(len(texts)):
            own = found[order[i] : order[i + 1]]
            low = int(s.sentence[own].min()) if len(own) else 0
            out.append(np.unique((s.sentence[own] - low) * np.int64(1 << CELLS) + at[own]))
        columns = {c: part.column(part.schema.get_field_index(c)) for c in ("key", "label", "fold")}
        return columns | {"sentences": number, "hits": out}

    schema = "key bigint, label int, fold int, sentences bigint, hits array<bigint>"
    data = map_texts(rows.select("key", "label", "fold", "text"), "text", schema, hits).toArrow().sort_by("key")
    label, fold, number = (data.column(c).to_numpy() for c in ("label", "fold", "sentences"))
    each = data.column("hits").combine_chunks()
    flat = each.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(label)), np.diff(each.offsets.to_numpy()))
    sentence, feature = flat >> CELLS, flat & ((1 << CELLS) - 1)

    def fitted(use: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of the words in ``use`` (others 0) and the bias, learnt from the documents in ``train``."""
        number_of, place = np.cumsum(train) - 1, np.cumsum(use) - 1
        own = train[doc] & use[feature]
        w, bias = fit_weights(label[train], number[train], number_of[doc[own]], sentence[own], place[feature[own]], int(use.sum()))
        weights = np.zeros(len(cells))
        weights[use] = w
        return weights, bias

    outside = np.zeros(len(label))
    for k, c in enumerate(use):
        train = fold != k
        if train.all() or label[train].min() == label[train].max():
            train = np.ones(len(label), bool)  # a fold that leaves one class only: scored by all
        outside[fold == k] = odds_of(number, doc, sentence, feature, *fitted(picked[c].to_numpy(bool), train))[fold == k]
    weights, bias = fitted(picked["use"].to_numpy(bool), np.ones(len(label), bool))
    return Model(cells, weights, bias, float(np.log(2) / parting(label, outside)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score``, ``n_sentences`` and ``offending`` (sentences at 0.5 or more: code points, score).

    Null and empty texts, and texts without words, have no sentence and score 0. Repeated rows repeat; a null
    id stays null; other columns of ``docs`` are not read; an empty table gives an empty table.
    """
    table, weights, bias, scale = model.table(), model.weights, model.bias, model.scale
    if not len(weights):
        weights = np.zeros(1)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(part, texts):
        s = Sentences(texts)
        present, logit = _sentence_scores(s.cells, s.sentence, shared.value, weights, bias)
        owner = s.text[np.searchsorted(s.sentence, present)]
        odds = scale * np.bincount(owner, softplus(logit), len(texts))
        each = -np.expm1(-scale * softplus(logit))
        offending: list[list[dict]] = [[] for _ in texts]
        for i in np.flatnonzero(each >= 0.5):
            a, b = s.span(int(present[i]))
            text, base = texts[owner[i]], int(s.offsets[owner[i]])
            start = len(text[: a - base].decode())
            offending[owner[i]].append({
                "start": start, "end": start + len(text[a - base : b - base].decode()), "score": float(each[i]),
            })
        return {
            "id": part.column(0), "score": -np.expm1(-odds), "n_sentences": np.bincount(owner, minlength=len(texts)), "offending": offending,
        }

    schema = "id bigint, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
    return map_texts(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text"), "text", schema, work)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, in one pass over the texts; columns stay as they are.

    Null and empty texts, and texts without words, score 0 and stay. Repeated rows go or stay together, whatever their
    ids; an empty table gives an empty table.
    """
    table, weights, bias, scale = model.table(), model.weights, model.bias, model.scale
    if not len(weights):
        weights = np.zeros(1)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for part, texts in byte_chunks(batches, text_col):
            s = Sentences(texts)
            present, logit = _sentence_scores(s.cells, s.sentence, shared.value, weights, bias)
            owner = s.text[np.searchsorted(s.sentence, present)]
            odds = scale * np.bincount(owner, softplus(logit), len(texts))
            yield part.filter(pa.array(-np.expm1(-odds) < threshold))

    return docs.mapInArrow(run, docs.schema)
