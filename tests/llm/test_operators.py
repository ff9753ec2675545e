"""Training-data operators against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowmill import session
from flowmill.llm import audio, bpe, fingerprints, graph, licenses, mixing, neardup, pii, queries, substrings, suffix_lm, toxicity

LONG = ("alpha beta gamma delta " * 6000) + "licensed under the apache license version 2.0 mail bob@example.com"
# a null text, a null id, an empty text, blanks only, repeated rows, equal texts under two ids, a very long text
AWKWARD = [
    (1, "The MIT License, see +1 (203) 555-8282 or 10.0.0.1.", "x"), (1, "The MIT License, see +1 (203) 555-8282 or 10.0.0.1.", "x"),
    (2, None, "x"), (3, "", None), (4, " \n\t ", "x"), (None, "no id here", "x"), (5, LONG, "y"), (6, LONG, None),
    (7, "é ñ 漢字 \U0001f600 idiot.", "y"), (8, "one", "y"), (None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Extra columns carry the names that the operators use themselves."""
    rows = [(i, t, s, "row", 1, 2, "k") for i, t, s in AWKWARD]
    schema = "doc_id bigint, text string, source string, id string, n bigint, row bigint, key string"
    return spark.createDataFrame(rows, schema).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))


def weights():
    return {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}


OPERATORS = {
    "licenses": lambda d: licenses.scan(d), "neardup": lambda d: neardup.near_duplicates(d),
    "audio": lambda d: audio.media_columns(d), "substrings": lambda d: substrings.remove_repeats(d, with_text=True),
    "pii": lambda d: pii.find_spans(d), "redact": lambda d: pii.redact(d), "suffix_lm": lambda d: suffix_lm.log_scores(d, "doc_id > 1"),
    "mixing": lambda d: mixing.mix(d, weights(), 50), "prints": lambda d: fingerprints.fingerprints(d),
    "edited": lambda d: fingerprints.edited_likeness(d),
    "bpe": lambda d: bpe.encode_texts(d, bpe.Vocabulary(queries.vocabulary_path()), columns=tuple(bpe.COLUMNS)),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d.select(F.col("doc_id").alias("id"), "text"), d.selectExpr("doc_id id", "cast(doc_id = 7 as int) label"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    """Every input row has its row in the result; equal texts give equal values."""
    rows = OPERATORS[name](awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert OPERATORS[name](awkward.limit(0)).count() == 0


def test_awkward_values(awkward):
    by = lambda df: collections.defaultdict(list, {k: [r for r in rows if r["id"] == k] for rows in [df.collect()] for k in {r["id"] for r in rows}})
    near = by(neardup.near_duplicates(awkward, shingle=2))
    assert [r["component_id"] for r in near[6]] == [5] and not near[6][0]["kept"] and near[3][0]["n_shingles"] == 0
    assert all(r["kept"] and r["component_id"] is None for r in near[None]) and len(near[1]) == 2
    cut = by(substrings.remove_repeats(awkward))
    assert cut[6][0]["n_removed"] == cut[6][0]["n_words"] and cut[5][0]["n_removed"] == 0 and cut[2][0]["n_words"] == 0
    spans = by(pii.find_spans(awkward))
    assert [pii.KINDS[s["kind"]] for s in spans[1][0]["spans"]] == ["ip", "phone"] and spans[2][0]["spans"] == []
    found = by(licenses.scan(awkward))
    assert [b["label"] for b in found[1][0]["base"]] == ["mit"] and found[2][0]["found"] == []
    assert {f["label"] for f in found[5][0]["found"]} == {"apache"}
    tokens = by(bpe.encode_texts(awkward, bpe.Vocabulary(queries.vocabulary_path())))
    assert tokens[2][0]["ids"] == [] and tokens[5][0]["ids"] == tokens[6][0]["ids"]
    media = by(audio.media_columns(awkward))
    assert media[2][0]["payload_bytes"] == 192 and media[5][0]["tensor"] == media[6][0]["tensor"]
    assert len(media[7][0]["tensor"]) == math.prod(audio.TENSOR_SHAPE)
    scores = by(suffix_lm.log_scores(awkward, "doc_id > 1"))
    assert scores[2][0]["n_tokens"] == 1 and scores[5][0]["score"] == pytest.approx(scores[6][0]["score"])
    text = {r["doc_id"]: r["text"] for r in pii.redact(awkward).collect()}
    assert text[1] == "The MIT License, see [PHONE] or [IP]." and text[2] is None and text[3] == ""


def oracle(name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    return [c[0] for c in cur.description], cur.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    names, want = oracle(name, sf_dir)
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_license_base(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op1_license_scan")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))
        at = [(k, label) for k in range(len(words)) for p, label in licenses.BASE.items() if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at)) and 0 <= r["score"] <= 1
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))


def test_suppression_by_containment():
    """Brute force: a hit goes if another one of at least its priority contains it (equal intervals: the first stays)."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        hits = [(int(a), int(a + n), int(p), i) for i, (a, n, p) in enumerate(zip(rng.integers(0, 20, 12), rng.integers(1, 10, 12), rng.integers(1, 4, 12)))]

        def beats(x, y):
            inside = x[0] <= y[0] and y[1] <= x[1] and x[2] >= y[2] and x is not y
            return inside and (x[:2] != y[:2] or x[2] > y[2] or x[3] < y[3])

        assert sorted(licenses.settle(hits)) == [i for i, y in enumerate(hits) if not any(beats(x, y) for x in hits)]
    forms = dict(licenses.rules())
    assert sum(map(len, forms.values())) > 200


def test_toxicity_held_out(spark, sf_dir):
    bigger = sf_dir.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{bigger}/labels.parquet").collect()}
    got = [r for i, r in result(spark, bigger, "op3_toxicity").items() if r["held_out"] and i in labels]
    toxic, clean = ([r["predicted"] for r in got if labels[r["doc_id"]] == k] for k in (1, 0))
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.04


def test_noisy_or_brute_force():
    """Odds, the cut between the classes, and the fit's slope against plain loops and differences."""
    rng = np.random.default_rng(4)
    bags = [[[int(f) for f in np.unique(rng.integers(0, 5, rng.integers(0, 4)))] for _ in range(rng.integers(1, 5))] for _ in range(60)]
    label = np.array([int(any(3 in s for s in b)) for b in bags])
    hits = np.array([(d, s, f) for d, b in enumerate(bags) for s, fs in enumerate(b) for f in fs])
    sentences = np.array([len(b) for b in bags])
    loss = lambda w, b: -sum(
        math.log(1 - math.exp(-o) if y else math.exp(-o)) for y, o in zip(label, plain(w, b), strict=True)
    ) / len(bags) + 0.5e-4 * float(w @ w)

    def plain(w, b):
        return [sum(math.log1p(math.exp(b + sum(w[f] for f in s))) for s in bag) for bag in bags]

    w, b = toxicity.fit_weights(label, sentences, *hits.T, 5, steps=3000)
    assert toxicity.odds_of(sentences, *hits.T, w, b) == pytest.approx(plain(w, b))
    for k in range(5):  # no small step lowers the loss by much
        e = np.eye(5)[k] * 1e-3
        assert abs(loss(w + e, b) - loss(w - e, b)) / 2e-3 < 2e-3
    assert w.argmax() == 3


def test_the_cut_spares_clean_documents():
    odds = np.array([0.1, 0.2, 0.3, 0.4, 5.0, 0.35, 6.0, 7.0])
    label = np.array([0, 0, 0, 0, 0, 1, 1, 1])
    assert 5.0 < toxicity.parting(label, odds) < 6.0  # 0.4 would catch one more, and reject a clean one of five
    assert 0.4 < toxicity.parting(np.array([0, 0, 0, 0, 1, 0, 1, 1]), odds) < 5.0
    assert toxicity.parting(np.array([1, 0]), np.array([0.5, 0.5])) >= math.log(2)


def test_one_id_with_many_texts_stays_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"You stupid thing {i}.") for i in range(50)] + [(i, "A fine day.") for i in range(2, 30)] + [(31, None)], "id bigint, text string")
    labels = docs.select("id", (F.col("id") == 1).cast("int").alias("label")).distinct()
    assert toxicity._sampled(docs, labels, 10).count() == 10 and toxicity._sampled(docs, labels, 1000).count() == 52  # 50 texts, one of 28 rows, a null
    model = toxicity.fit(docs, labels)
    scores = {r["id"]: r["score"] for r in toxicity.score(docs, model, "id").collect()}
    assert scores[1] > 0.5 > scores[2] and scores[31] == 0


def test_offending_sentences(spark):
    train = [(i, f"Plain words {i} here. " + ("You bad thing. " if i % 3 == 0 else "Fine day. ") + "More text.", int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train], "id bigint, label int"))
    new = spark.createDataFrame([(1, "Ünter uns. You bad thing! Good bye."), (2, "Fine day.")], "doc_id bigint, text string")
    rows = {r["id"]: r for r in toxicity.score(new, model).collect()}
    assert rows[1]["score"] > 0.5 > rows[2]["score"]
    spots = ["Ünter uns. You bad thing! Good bye."[s["start"] : s["end"]] for s in rows[1]["offending"]]
    assert [s.strip() for s in spots] == ["You bad thing"]


def test_payload_round_trip(spark, sf_dir, texts):
    rows = audio.media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    for r in rows:
        raw = texts[r["id"]].encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert audio.from_wav(bytes(r["media"])) == payload and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["n_bytes"] == len(raw)
    assert audio.as_tensors(__import__("pyarrow").array([rows[0]["tensor"]])).to_numpy_ndarray().shape == (1, *audio.TENSOR_SHAPE)


def test_polyphase_matches_plain_filter():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400).astype(np.float32)
    phases = audio._phases()
    full = np.zeros(2 * len(x), np.float32)
    full[::2] = x  # zeros between the samples, then the whole filter, then every third
    taps = phases[:, ::-1].T.ravel()
    plain = np.convolve(full, taps)[: len(full)][:: audio.DOWN]
    got = audio.resample(np.concatenate([np.zeros(audio._TAPS - 1, np.float32), x]), phases)
    assert np.allclose(got, plain[: len(got)], atol=1e-4)


def test_long_audio_equals_short_stretches(monkeypatch):
    samples = np.frombuffer(bytes(np.random.default_rng(2).integers(0, 256, 40_000, dtype=np.uint8)), np.uint8)
    whole = audio.log_mel(samples)
    monkeypatch.setattr(audio, "_STRETCH", audio.HOP * audio.DOWN // audio.UP * 8)
    assert np.allclose(whole, audio.log_mel(samples), atol=1e-3)


def test_personal_data_base(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op6_personal_data")
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for i, t in texts.items():
        spans = base_spans(t, patterns)
        assert got[i]["base_sha256"] == sha(",".join(spans)), t
        assert set(spans) <= set(got[i]["spans"].split(",")) | {""}


def base_spans(t, patterns):
    def valid(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "card":
            luhn = sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and luhn % 10 == 0
        return {"ip": lambda: all(int(x) <= 255 for x in s.split(".")), "phone": lambda: 8 <= len(digits) <= 15}.get(kind, lambda: True)()

    return [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t) if valid(k, m.group())]


def test_personal_data_odd_texts(spark):
    """Java's expressions against Python's on runs, repeated separators and long sequences."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("a@.-_%+ 0194\U0001f600é()"), 60)) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "0255.1.1.1", "999.1.1.1.1", "a" * 20_000, "1." * 20_000, "x@y" + ".z" * 20_000, "4 " * 20_000, "4111-1111 1111 1111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = pii.find_spans(docs).select("id", pii.spelled(F.filter("spans", lambda s: s["base"])).alias("base")).collect()
    for r in rows:
        assert r["base"] == ",".join(base_spans(texts[r["id"]], patterns))


def test_a_secret_is_covered_to_its_end(spark):
    texts = [f"set token={'a1' * n} now" for n in (4, 64, 65, 100, 5000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.regexp_extract("text", pii.ADDED["secret"], 0).alias("s")).collect()
    assert all(r["s"] == r["text"][4:-4] for r in rows)


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    rates = [(0.95, 0.05), (0.9, 0.1), (0.8, 0.3), (0.5, 0.5)]
    votes = [tuple(int(rng.random() < (a if z else b)) for a, b in rates) for z in truth]
    share, true, false = pii.reliabilities(sorted((v, float(c)) for v, c in collections.Counter(votes).items()))
    assert abs(share - 0.6) < 0.05 and abs(true[0] - 0.95) < 0.05 and abs(true[3] - false[3]) < 0.1


def test_bpe_equals_library(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    got = result(spark, sf_dir, "op7_bpe")
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_bpe_odd_texts_and_cuts():
    from tokenizers import Tokenizer

    library, vocabulary = Tokenizer.from_file(queries.vocabulary_path()), bpe.Vocabulary(queries.vocabulary_path())
    encoder = bpe.Encoder(vocabulary)
    rng = np.random.default_rng(5)
    alphabet = list("abcXYZ 019'’ΣİßéǺ  \x1c\x85漢字😀\n<|>​ﬁᾳ.,!s") + ["<|endoftext|>", "'ll", "don't"]
    odd = ["".join(rng.choice(alphabet, 40)) for _ in range(600)] + ["a" * 3000, "xq" * 700, "<|startoftext|>A<|endoftext|>", "ΑΣ", "é" * 900]
    for t in odd:
        triples = encoder.encode(t)
        ids = [int(x) for s, _, _ in triples for x in s.split()]
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert " ".join(x for _, x, _ in triples) == library.decode(want, skip_special_tokens=False) == bpe.decode(want, vocabulary)
    for word in ("international", "xqzjkvw", "naïve"):
        symbols = [bpe.byte_symbols()[b] for b in word.encode()]
        symbols[-1] += vocabulary.end
        assert [t for piece in vocabulary.cuts(symbols) for t in vocabulary.merge(piece)] == vocabulary.merge(symbols)
        assert vocabulary._merge_long(symbols) == vocabulary.merge(symbols)


def test_language_model_base(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op8_suffix_tree_scores")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*(t.encode().lower().split()), None] for i, t in texts.items()}
    count = collections.Counter(x for i, t in tokens.items() if not held(i) for x in t)
    total, distinct = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in t))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(count[x] > 0 for x in t), total, held(i))
        assert r["score"] < 0
    kept = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)


def test_suffix_tree_rows_are_distributions():
    grams = np.random.default_rng(6).poisson(0.02, suffix_lm.SYMBOLS ** (suffix_lm.DEPTH + 1))
    tree = suffix_lm.SuffixTree(grams)
    assert np.allclose((10**tree.log10).sum(axis=1), 1)
    grams[:] = 0
    one_after_two = np.zeros((suffix_lm.SYMBOLS,) * 4)
    one_after_two[:, :, 2, 1] = 50  # 1 always follows 2, whatever came before
    one_after_two[:, :, 3, :] = 5
    tree = suffix_lm.SuffixTree(one_after_two.ravel())
    assert tree.kept[1][2] and not tree.kept[2].any() and 10 ** tree.log10[2, 1] > 0.99


def _word_tree(training):
    """Value, and whether it is the shortest kept context, of every gram (tuples, the start and the end are None)."""
    grams = collections.Counter()
    for words in training:
        line = [None, *words, None]
        for m in range(1, suffix_lm.REACH + 2):
            grams.update(tuple(line[i : i + m]) for i in range(m == 1, len(line) - m + 1))
    total, distinct = sum(n for g, n in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    bound, share, governed = math.log(total + distinct + 1), {}, {}
    for g, n in grams.items():
        if len(g) == 1:
            share[g], governed[g] = (n + 1) / (total + distinct + 1), False
    values, first = collections.Counter(), set()
    for m in range(2, suffix_lm.REACH + 2):
        by_context = collections.defaultdict(list)
        for g, n in grams.items():
            if len(g) == m and n > 1:
                by_context[g[:-1]].append(g)
        for c, named in by_context.items():
            n = grams[c]
            ratios = []
            for g in named:
                k, p = grams[g], share[g[1:]]
                rest = (n - k) * math.log((n - k) / n / (1 - p)) if n > k else 0
                ratios.append(k * math.log(k / n / p) + rest if k > n * p else 0)
            over = any(governed[g[1:]] for g in named)
            keep = max(ratios) > bound
            handed = n - sum(grams[g] for g in named) + len(named)
            for g in named:
                p = share[g[1:]]
                share[g], governed[g] = ((grams[g] + handed * p) / (n + len(named)) if keep else p), over or keep
                if keep:
                    values[g] += math.log10(share[g] / p * (n + len(named)) / handed)
            if keep:
                values[c] += math.log10(handed / (n + len(named)))
                if not over:
                    first.add(c)
    return values, first, grams


def test_suffix_tree_over_words_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    phrase = [f"p{i:04d}" for i in range(12)]  # one length, none of them among the most frequent words
    lines = {i: [f"w{int(x):04d}" for x in np.minimum(rng.zipf(1.3, 60), 3000)] for i in range(150)}
    for i in range(0, 150, 6):
        lines[i][20:20] = phrase
        lines[i + 3][30:30] = [f"q{x}" for x in "0000100110101111"]  # four words tell the next one
    inner = {1000 + 5 * a: phrase[a : a + 8] for a in range(3)}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in (lines | inner).items()], "doc_id bigint, text string").repartition(4)
    seen = []
    inside = suffix_lm.gram_values
    monkeypatch.setattr(suffix_lm, "gram_values", lambda *x: seen.append(inside(*x)) or seen[-1])
    scores = []
    for common, values in ((suffix_lm.COMMON, suffix_lm.VALUES), (30, 5)):  # at hand, then nearly all by the join
        monkeypatch.setattr(suffix_lm, "COMMON", common)
        monkeypatch.setattr(suffix_lm, "VALUES", values)
        scores.append({r["id"]: r for r in suffix_lm.log_scores(docs, "doc_id % 5 <> 0").collect()})
    want, first, grams = _word_tree([x for i, x in lines.items() if i % 5])
    assert max(map(len, want)) == suffix_lm.REACH + 1 and first
    want = sorted((grams[g], g in first, round(v, 9)) for g, v in want.items())
    for table in seen:
        assert sorted((r["n"], r["first"] == 1, round(r["value"], 9)) for r in table.collect()) == want
    for i, r in scores[0].items():
        for c in ("score", "base_score", "n_known", "n_tokens"):
            assert scores[1][i][c] == pytest.approx(r[c])
    for i in inner:  # words of a phrase learnt by heart cost little after the first
        assert scores[0][i]["score"] > scores[0][i]["base_score"] + 10


def test_suffix_tree_disk_follows_the_texts(spark, monkeypatch):
    """Nearly all word pairs occur once, and a third of the texts twice: grams must not lie on disk row by row."""
    monkeypatch.setattr(suffix_lm, "VALUES", 20_000)  # fewer than the grams that occur twice
    rng = np.random.default_rng(12)
    lines = [" ".join(f"w{int(x):04d}" for x in rng.integers(0, 3000, 300)) for _ in range(600)]
    lines += lines[:300]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").coalesce(4)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> dict[str, int]:
        files = disk.getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    before, kept, left = shuffled(), [], []
    inside = suffix_lm.staged

    def staged(df, name):
        made = inside(df, name)
        kept.append(sum(Path(f.removeprefix("file://")).stat().st_size for f in made.inputFiles()))
        left.append(sum(n for name, n in shuffled().items() if name not in before))
        return made

    monkeypatch.setattr(suffix_lm, "staged", staged)
    assert len(suffix_lm.log_scores(docs, "doc_id % 5 <> 0").collect()) == len(lines)
    size = sum(map(len, lines))
    assert sum(kept) < size and max(left) < size


def test_suffix_tree_packed_columns_and_distinct_keys():
    rng = np.random.default_rng(13)
    columns = [np.zeros(0, np.uint64), np.zeros(5, np.int64), rng.integers(0, 1 << 20, 99), np.array([2**64 - 1, 0, 1 << 32], np.uint64), np.array([True, False])]
    for got, want in zip(suffix_lm._unpacked(suffix_lm._packed(*columns)), columns, strict=True):
        assert got.tolist() == [int(x) for x in want]
    high = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for keys in (high[rng.integers(0, 300, 2000)], rng.integers(0, 50, 2000).astype(np.uint64), high[:1], high[:0]):  # the second: equal high bits
        found, one, number = suffix_lm._distinct(keys)
        assert found.tolist() == sorted(set(keys.tolist())) and (keys[one] == found).all() and (found[number] == keys).all()


def test_fingerprints(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op10_fingerprints")
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == sha(t[: len(t) - cut] + n[:cut])
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    by_text = collections.defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_winnowing_brute_force_and_guarantee():
    rng = np.random.default_rng(7)
    for n in (0, 1, 19, 20, 63, 64, 300):
        points = rng.integers(97, 100, n).astype(np.uint32)
        hashes, kept = fingerprints.winnow(points, 5, 8)
        grams = [tuple(points[i : i + 5]) for i in range(max(0, n - 4))]
        if n >= 12:
            from flowmill.llm.words import U64, rolling

            h = rolling(points.astype(U64) + U64(1), 5)
            assert len(set(grams)) == len(set(h.tolist()))
            want = {max(j for j in range(a, a + 8) if h[j] == h[a : a + 8].min()) for a in range(len(h) - 7)}
            assert sorted(want) == kept.tolist()
    a, b, shared = (rng.integers(97, 123, 200).astype(np.uint32) for _ in range(3))
    shared = shared[: fingerprints.K + fingerprints.WINDOW - 1]
    x, y = (fingerprints.winnow(np.concatenate([p, shared, p[::-1]]))[0] for p in (a, b))
    assert set(x.tolist()) & set(y.tolist())


def test_blocks_of_successors(spark):
    rows = [(i * 3, f"text {i} " * (i % 7)) for i in range(500)] + [(30, "again"), (None, "nobody")]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    order = sorted(((-(2**63) if i is None else i), t, i) for i, t in rows)
    want = collections.Counter((order[k][2], order[k][1], order[(k + 1) % len(order)][1]) for k in range(len(order)))
    got = collections.Counter()
    parts = fingerprints.in_order(docs, per_block=40).withColumn("part", F.spark_partition_id()).collect()
    for a, b in zip(parts, parts[1:], strict=False):
        if not a["heir"]:
            assert (a["part"], a["block"]) == (b["part"], b["block"])
            got[(a["id"], a["text"], b["text"])] += 1
    assert got == want


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(90)] + [(2000, 2000 + i) for i in range(1, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(x, find(x)) for a, b in pairs if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_duplicates_in_large_groups(spark):
    """Copies and near copies of one text, and texts that share a long passage but are not alike."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] * 40
    for _ in range(150):
        t = list(base)
        for j in rng.choice(120, rng.integers(1, 14), replace=False):
            t[j] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(base[:60] + [f"y{rng.integers(10**6)}" for _ in range(int(rng.integers(10, 90)))]) for _ in range(150)]
    rng.shuffle(texts)
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
        if not changed:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert got == dict(enumerate(root))


def test_a_candidate_pair_comes_out_of_one_list(spark, monkeypatch):
    """Near copies share many lists; what is no longer read is deleted."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(120):
        t = list(base)
        for j in rng.choice(200, rng.integers(8, 14), replace=False):
            t[j] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(t))
    made = {}

    def staged(df, name="stage"):
        made[name] = (df, session.staged(df, name))
        return made[name][1]

    monkeypatch.setattr(neardup, "staged", staged)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = neardup.near_duplicates(docs, shingle=2)
    joined, across = made["across"]
    assert "Aggregate" not in joined._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert across.count() == across.distinct().count() > 0
    assert found.count() == len(texts)
    for name in ("signatures", "classes", "posts", "open", "shingles"):
        assert not any(Path(f.removeprefix("file:")).exists() for f in made[name][1].inputFiles()), name


def test_repeats_brute_force(spark):
    rng = np.random.default_rng(10)
    passages = [[f"p{k}_{i}" for i in range(30)] for k in range(6)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(int(rng.integers(0, 5))):
            p = passages[rng.integers(6)]
            a = int(rng.integers(0, 25))
            words += p[a : a + int(rng.integers(3, 30))] + [f"u{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 4)))]
        texts.append(" ".join(words))
    ids = [int(x) for x in rng.permutation(60)]
    n, first = 8, {}
    for i, t in zip(ids, texts, strict=True):
        w = t.split()
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            first[k] = min(first.get(k, i), i)
    got = {r["id"]: r for r in substrings.remove_repeats(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string"), length=n, with_text=True).collect()}
    for i, t in zip(ids, texts, strict=True):
        w = t.split()
        gone = {p for a in range(len(w) - n + 1) if first[tuple(w[a : a + n])] < i for p in range(a, a + n)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), sha(kept))
        assert got[i]["kept_text"] in (None, kept)


def test_mixture_takes_shares(spark):
    rows = [(i, "w " * 10, "en", f"s{i % 4}") for i in range(4000)] + [(9000 + i, "w " * 10, "en", "s9") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    took = {r["source"]: r["t"] for r in mixing.mix(docs, weights(), 50).groupBy("source").agg((F.sum("copies") * 10).alias("t")).collect()}
    assert took["s9"] == 40  # a small source gives all it has; its siblings make up for it
    assert all(abs(took[f"s{k}"] - (20_020 - 40) / 4) <= 10 for k in range(4))
    twice = mixing.mix(docs, weights(), 200, epochs=2).agg(F.min("copies"), F.max("copies")).first()
    assert tuple(twice) == (2, 2)


def test_pipeline(spark, sf_dir, tmp_path):
    """Each stage against brute force on what it was given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        kept[name] = (before, after)
        assert set(after) <= set(before) and docs.count() == len(after)
        if k < 4:
            assert docs.columns == columns
    before, after = kept["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(i in after for i in before if labels.get(i) == 0) and any(i not in after for i in before if labels.get(i) == 1)
    before, after = kept["near_duplicates"]
    shingles = {i: {tuple(w[a : a + 5]) for w in [(r["text"] or "").lower().split()] for a in range(max(1, len(w) - 4)) if w} for i, r in before.items()}
    alike = lambda a, b: bool(shingles[a] | shingles[b]) and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])
    ids = sorted(before)
    low = {i: i for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if alike(a, b)]
    for _ in ids:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert set(after) == {i for i in ids if low[i] == i}
    before, after = kept["personal_data"]
    assert set(before) == set(after) and all(after[i]["n_chars"] == len(after[i]["text"] or "") for i in after if after[i]["text"] is not None)
    assert not any("@mail" in (r["text"] or "") for r in after.values())
    before, after = kept["source_mixture"]
    size = lambda rows: sum(len((r["text"] or "").split()) for r in rows.values())
    largest = collections.Counter()  # a leaf's last document may reach beyond its share
    for r in before.values():
        largest[r["lang"], r["source"]] = max(largest[r["lang"], r["source"]], len((r["text"] or "").split()))
    assert 0.8 * size(before) - 2 * len(largest) <= size(after) < 0.8 * size(before) + sum(largest.values())
    before, after = kept["bpe"]
    encoder = bpe.Encoder(bpe.Vocabulary(queries.vocabulary_path()))
    assert set(before) == set(after)
    assert all([int(x) for s, _, _ in encoder.encode(before[i]["text"] or "") for x in s.split()] == list(after[i]["ids"]) for i in after)


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(23)
    for n in (1, 40, 1024, 1025, 1500):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False))
        for gone in (0, 1, n // 10):
            other = np.unique(np.concatenate([base[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64, endpoint=False)]))
            (level, x, _), (again, y, _) = neardup.sketches(base), neardup.sketches(other)
            assert level == again == (n > neardup.BITS)
            differing = sum(int(a ^ b).bit_count() for a, b in zip(x, y, strict=True))
            assert differing <= len(np.setxor1d(base, other))
    larger, smaller = base[:1100], base[:1000]  # on both sides of the step from one level to the next
    assert neardup.sketches(larger)[0] == 1 and neardup.sketches(smaller)[0] == 0
    next_of_smaller = neardup.sketches(smaller)[2]
    assert sum(int(a ^ b).bit_count() for a, b in zip(neardup.sketches(larger)[1], next_of_smaller, strict=True)) <= 100
    assert len(neardup.sketches(base[:800])[2]) == 0
