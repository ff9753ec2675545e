"""Source divergence, periodic runs and sentence pieces: brute force, the library, awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowmill.llm import divergence, periods, pieces, queries

MODEL = queries.vocabulary_path("piece_bpe_32k.model")
LONG = "alpha beta gamma delta " * 6000 + "end"
# a null text, a null id, an empty text, blanks only, repeated rows, equal texts under two ids, a very long text
AWKWARD = [
    (1, "one " * 30, "x"), (1, "one " * 30, "x"), (2, None, "x"), (3, "", None), (4, " \n\t ", "x"), (None, "no id here", "x"),
    (5, LONG, "y"), (6, LONG, None), (7, "é ñ 漢字 \U0001f600 \0 ▁ x", "y"), (8, "one", "y"), (None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Extra columns carry the names that the operators use themselves."""
    rows = [(i, t, s, "row", 1, 2, "k", 3) for i, t, s in AWKWARD]
    schema = "doc_id bigint, text string, source string, id string, n bigint, runs bigint, term string, value bigint"
    return spark.createDataFrame(rows, schema).withColumn("lang", F.lit("en"))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- source divergence


def brute_audit(docs, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for t, lang, source in docs]
    out = []
    for lang in {x[0] for x in words}:
        seen = collections.Counter(w for x, _, ws in words if x == lang for w in set(ws))
        kept = sorted(w for w, n in seen.items() if n >= least)
        sources = sorted({s for x, s, _ in words if x == lang})
        counts = {s: collections.Counter(w for x, y, ws in words if (x, y) == (lang, s) for w in ws if seen[w] >= least) for s in sources}
        whole = sum(counts.values(), collections.Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        shares, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(shares[s][w] - shares[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, shares[s][w] - q[w]) for w in kept if counts[s][w] and shares[s][w] > q[w]]
            for part, rows, limit in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(rows[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_brute_force(spark, monkeypatch, small):
    """Also with blocks of few counts and tiles of few sources, and a language without any kept term."""
    if small:
        monkeypatch.setattr(divergence, "CELLS", 7)
        monkeypatch.setattr(divergence, "TILE", 2)
        monkeypatch.setattr(divergence, "HELD", 5)
    rng = random.Random(3)
    names = ["the", "THE", "été", "É", "a-b", "q1w", "漢字", "zz", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = [
        (" ".join(rng.choices(names, range(len(names), 0, -1), k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "Z", None]))
        for _ in range(150)
    ] + [("rare words only", "fr", "s1"), (None, "fr", "s2"), ("123", "xx", "alone"), (None, "en", "silent")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    got = sorted(map(tuple, divergence.audit(df, least=6, top=4).collect()))
    assert got == brute_audit(docs, 6, 4) and {("fr", "s1", "pair", "s2", 0, 1)} <= set(got)


def test_audit_awkward(spark, awkward):
    docs = [(t, "en", s) for _, t, s in AWKWARD]
    assert sorted(map(tuple, divergence.audit(awkward, least=2).collect())) == brute_audit(docs, 2, 50)
    assert divergence.audit(awkward.limit(0), least=2).count() == 0


def test_columns_of_large_counts_are_exact():
    n = [10**13, 3, 3, 0]
    cuts, values = divergence.column(6, [0, 2, 5], [1, 4, 6], [n[0], 3, 7], 3 * 10**13 + 1, 6)
    want = [1 + 10**9 * (c + 5) // (3 * 10**13 + 1 + 30) for c in (10**13, 0, 3, 3, 0, 7)]
    assert [values[np.searchsorted(cuts, i, "right") - 1] for i in range(6)] == want
    flat = divergence.column(6, [], [], [], 9, 6)
    assert divergence.apart((cuts, values), flat, 6) == sum(abs(w - int(flat[1][0])) for w in want)


# --- periodic runs


def brute_runs(x, least=24, times=3):
    x, out = np.asarray(x), []
    for q in range(1, len(x) // times + 1):
        edges = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            y = x[s : e + q]
            if len(y) >= max(least, times * q) and not any((y[:-r] == y[r:]).all() for r in range(1, q)):
                out.append((s, len(y), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 3), min_size=1, max_size=400),
    st.lists(st.tuples(st.integers(0, 399), st.integers(1, 130), st.integers(2, 9), st.integers(0, 4)), max_size=4),
    st.sampled_from([(24, 3), (9, 3), (30, 4)]),
)
def test_runs_brute_force(x, planted, limits):
    for start, period, times, more in planted:
        for i in range(start + period, min(len(x), start + period * times + more)):
            x[i] = x[i - period]
    assert periods.runs_of(np.array(x), *limits) == brute_runs(x, *limits)


def test_runs_whose_period_repeats_its_grams():
    """Every 16-gram comes several times within one period, so no gram marks the place in it."""
    x = (([0] * 20 + [1]) * 2 + [0] * 21 + [1]) * 5
    assert periods.runs_of(np.array(x)) == brute_runs(x) and any(q == 64 for _, _, q in brute_runs(x))
    square = [1, 2] * 8
    assert periods.runs_of(np.array(square)) == [] and periods.overlap() == 16
    assert periods.runs_of(np.zeros(100_000, int)) == [(0, 100_000, 1)]


def test_periodic_query_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(rows) and sum(r["n_runs"] > 0 for r in got.values()) > 5
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        codes = {}
        runs = brute_runs([codes.setdefault(w, len(codes)) for w in words]) if len(set(words)) < n else []
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_periodic_runs_awkward(awkward):
    rows = periods.periodic_runs(awkward, with_text=True).collect()
    assert len(rows) == len(AWKWARD) and periods.periodic_runs(awkward.limit(0)).count() == 0
    by = collections.defaultdict(list)
    for r in rows:
        by[r["id"]].append(r)
    assert [tuple(x) for x in by[1][0]["runs"]] == [(0, 30, 1)] and by[1][0]["collapsed"] == "one" and by[1][0] == by[1][1]
    assert [tuple(x) for x in by[5][0]["runs"]] == [(0, 24000, 4)] and by[5][0]["collapsed"] == "alpha beta gamma delta end"
    assert by[2][0]["n_words"] == by[3][0]["n_words"] == by[4][0]["n_words"] == 0 and by[4][0]["collapsed"] == ""
    assert by[7][0]["collapsed"] == "é ñ 漢字 \U0001f600 \0 ▁ x" and len(by[None]) == 2


def test_tails_without_id_or_words(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, None), (2, ""), (3, "  ")], "doc_id bigint, text string")
    assert [r["text"] for r in queries.tail_repeated(docs).collect()] == ["a b c", None, "", "  "]
    tenth = next(i for i in itertools.count() if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(tenth, None), (tenth, ""), (tenth, " \t")], "doc_id bigint, text string")
    assert periods.periodic_runs(queries.tail_repeated(docs)).where("n_words > 0 or size(runs) > 0").count() == 0


# --- sentence pieces


def test_pieces_agree_with_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    assert pieces.disagreements(docs, MODEL).count() == 0


def test_pieces_query(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_sentence_pieces"](spark, sf_dir).collect()}
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids, r = library.encode(text or "", add_bos=True, add_eos=True), got[doc_id]
        digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest, sha(library.decode(ids)))


@pytest.fixture(scope="module")
def both():
    return pieces.Codec(pieces.Model(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(codec, text):
    return np.frombuffer(b"".join(t[0] for t in codec.encode(text)), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁aeinthsou\n")), max_size=80))
def test_pieces_of_any_text(both, text):
    codec, library = both
    want = library.encode(text)
    assert ids_of(codec, text) == want and codec.decode(want) == library.decode(want)


def test_pieces_odd_texts(both):
    codec, library = both
    odd = ["", " ", "▁", "a\0b", "<s> </s> <unk> <0x0A>", " " * 45 + "q" + " " * 17, "é" * 500, "� ﻿", "a" * 5000, "ab " * 3000, "\U0010ffff\n"]
    for text in odd:
        assert ids_of(codec, text) == library.encode(text) and codec.decode(library.encode(text)) == library.decode(library.encode(text))
    rng = random.Random(1)
    for _ in range(300):  # any ids, also bytes that are no UTF-8 and pieces the encoder never makes
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_agenda_takes_the_best_score_and_then_the_leftmost():
    cost = {"ab": 2.0, "bc": 1.0, "aa": 3.0, "aaa": 4.0}
    assert pieces.merged("abc", cost) == ["a", "bc"] and pieces.merged("aaaa", cost) == ["aa", "aa"] and pieces.merged("aaa", cost) == ["aaa"]


@settings(max_examples=300, deadline=None)
@given(text=st.text("▁aeinth ", min_size=1, max_size=60))
def test_flat_agenda_equals_heap(both, text):
    cost = both[0].m.cost
    assert pieces._merged_short(text, cost) == pieces._merged_long(text, cost)


def test_pieces_awkward(awkward, both):
    codec, library = both
    rows = pieces.encode_texts(awkward, codec.m, columns=tuple(pieces.COLUMNS)).collect()
    assert sorted((r["id"] or 0, list(r["ids"]), r["decoded"]) for r in rows) == sorted(
        (i or 0, ids, library.decode(ids)) for i, t, _ in AWKWARD for ids in [library.encode(t or "", add_bos=True, add_eos=True)]
    )
    assert pieces.encode_texts(awkward.limit(0), codec.m).count() == 0 and pieces.disagreements(awkward, MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as f:
        data = f.read()
    (tmp_path / "other.model").write_bytes(data + b"\x1a\x0a\x0a\x08nmt_nfkc")
    with pytest.raises(ValueError):
        pieces.Model(str(tmp_path / "other.model"))
