"""The operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowmill.llm import (
    audio, bpe, divergence, fingerprints, licenses, mixing, neardup, periods, pieces, pii, substrings, suffix_lm, toxicity,
)
from flowmill.session import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[job.__name__] = job
    return job


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    names = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*lists))), ",")
    own, base = F.col("found.label"), F.col("base.label")
    miss = F.aggregate("found", F.lit(1.0), lambda p, f: p * (1.0 - f["confidence"]))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        names(base).alias("base_labels"), names(base, own).alias("labels"),
        F.greatest(1.0 - miss, F.when(F.size("base") > 0, 0.7).otherwise(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), shingle=2, percent=80).withColumnRenamed("id", "doc_id")


ORACLES["op2_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM parts LEFT JOIN sizes USING (doc_id)
"""


def toxic_model(spark: SparkSession, sf_dir: str, training: Column) -> toxicity.Model:
    """Fitted on labelled documents for whose id ``training`` holds; the labels are targets only."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(training)
    return toxicity.fit(
        documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"),
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")),
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxic_model(spark, sf_dir, remainder(5) != 0)
    scored = toxicity.score(documents(spark, sf_dir), model).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )


@query
def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.media_columns(documents(spark, sf_dir), with_media=False)
    tensor = F.array_join(F.transform("tensor", lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start_ms"].cast("string"), s["end_ms"].cast("string"))), ",")
    return media.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.sha2(F.concat_ws("|", tensor, spans), 256).alias("feature"), "n_frames", F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


ORACLES["op5_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM windows JOIN first USING (h) WHERE doc_id > low),
each AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM words WHERE len(w) > 0),
kept AS (
  SELECT e.doc_id, count(g.p) AS n_removed, string_agg(e.x, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS t
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.BASE)),
        F.sha2(pii.spelled(base), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"),
    )


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_texts(documents(spark, sf_dir), bpe.Vocabulary(vocabulary_path()), columns=columns).withColumnRenamed("id", "doc_id")


@query
def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_lm.log_scores(documents(spark, sf_dir), "crc32(cast(doc_id as string)) % 7 <> 2")
    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    return scored.withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def domain_of(source: Column) -> Column:
    """The given tables name no domain; sources are grouped by their last character."""
    return F.concat(F.lit("d"), (F.ascii(F.right(source, F.lit(1))) % 4).cast("string"))


def mixing_weights() -> dict[str, Column]:
    domain, lang = F.col("domain"), F.col("lang")
    return {
        "domain": F.when(domain == "d0", 4).when(domain == "d1", 3).when(domain == "d2", 2).otherwise(1),
        "lang": F.when(lang == "en", 5).when(lang.isin("de", "fr"), 2).otherwise(1),
        "source": 1 + F.ascii(F.right(F.col("source"), F.lit(1))) % 3,
    }


MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 17


@query
def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("source")
    rows = staged(mixing.leaf_tables(documents(spark, sf_dir), "doc_id", "text", domain_of(source), F.col("lang"), source), "tokens")
    cuts = mixing.plan(rows, mixing_weights(), MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    taken = mixing.taken(rows, cuts, MIX_SEED)
    return taken.select(F.col("id").alias("doc_id"), "domain", "lang", "source", F.col("tokens").alias("n_tokens"), F.coalesce("share", F.lit(0)).alias("leaf_share"), "copies")


def _deal_sql(name: str, rows: str, parents: str, order: str) -> str:
    """One level of dealing: ``rows`` has budget, weight and room."""
    return f"""
{name}_a AS (
  SELECT *, sum(room) OVER (PARTITION BY {parents} ORDER BY room::DOUBLE / weight::DOUBLE, {order} ROWS UNBOUNDED PRECEDING) AS held,
         coalesce(sum(weight) OVER (PARTITION BY {parents} ORDER BY room::DOUBLE / weight::DOUBLE, {order}
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM {rows}),
{name}_b AS (SELECT *, room::HUGEINT * rest + held * weight <= budget::HUGEINT * weight AS filled FROM {name}_a),
{name}_c AS (
  SELECT *, coalesce(sum(CASE WHEN filled THEN room END) OVER (PARTITION BY {parents}), 0) AS full_room,
         coalesce(sum(CASE WHEN NOT filled THEN weight END) OVER (PARTITION BY {parents}), 0) AS open_weight FROM {name}_b),
{name} AS (
  SELECT *, CASE WHEN filled THEN room ELSE (budget::HUGEINT - full_room) * weight // open_weight END::BIGINT AS share FROM {name}_c)"""


ORACLES["op9_source_mixture"] = (
    r"""
WITH rows AS (
  SELECT doc_id, 'd' || (ascii(right(source, 1)) % 4)::VARCHAR AS domain, lang, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens,
         CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w1,
         CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w2,
         1 + ascii(right(source, 1)) % 3 AS w3
  FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0),"""
    + f"""
top_rows AS (
  SELECT domain, sum(tokens * {MIX_EPOCHS})::BIGINT AS room, max(w1) AS weight, 1 AS root,
         least((SELECT sum(tokens)::BIGINT * {MIX_PERCENT} // 100 FROM leaves), (SELECT sum(tokens * {MIX_EPOCHS})::BIGINT FROM leaves)) AS budget
  FROM leaves GROUP BY domain),"""
    + _deal_sql("top", "top_rows", "root", "domain")
    + f""",
mid_rows AS (
  SELECT l.domain, l.lang, sum(tokens * {MIX_EPOCHS})::BIGINT AS room, max(w2) AS weight, any_value(t.share) AS budget
  FROM leaves l JOIN top t USING (domain) GROUP BY l.domain, l.lang),"""
    + _deal_sql("mid", "mid_rows", "domain", "lang")
    + f""",
low_rows AS (
  SELECT l.domain, l.lang, l.source, tokens, tokens * {MIX_EPOCHS} AS room, w3 AS weight, m.share AS budget
  FROM leaves l JOIN mid m ON m.domain = l.domain AND m.lang = l.lang),"""
    + _deal_sql("low", "low_rows", "domain, lang", "source")
    + f""",
keyed AS (
  SELECT r.*, l.share, l.share // l.tokens AS whole, l.share % l.tokens AS part,
         md5(concat_ws(':', '{MIX_SEED}', (l.share // l.tokens)::VARCHAR, doc_id::VARCHAR)) AS k
  FROM rows r LEFT JOIN low l ON l.domain = r.domain AND l.lang = r.lang AND l.source = r.source),
ordered AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, coalesce(share, 0)::BIGINT AS leaf_share,
       coalesce(whole + CASE WHEN before < part THEN 1 ELSE 0 END, 0)::BIGINT AS copies
FROM ordered
"""
)


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "n_marks",
    )


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


ORACLES["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 30),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (t.total + 5 * s.v) AS p
  FROM totals t JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
lang_totals AS (SELECT lang, sum(total) AS total FROM totals GROUP BY lang),
lang_shares AS (
  SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(c.n) + 5) // (any_value(t.total) + 5 * any_value(s.v)) AS q
  FROM counts c JOIN lang_totals t ON t.lang = c.lang JOIN sizes s ON s.lang = c.lang GROUP BY c.lang, c.term),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, (s.p - l.q)::BIGINT
  FROM shares s JOIN lang_shares l ON l.lang = s.lang AND l.term = s.term WHERE s.n > 0 AND s.p > l.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def tail_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every tenth document by its id's checksum ends in a repetition: from word a on, p words of it come again."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = docs.withColumn("__w", F.when(h % 10 == 0, words)).withColumn("__n", F.size("__w"))
    g = F.floor(h / 10)
    made = made.withColumn("__a", F.when(F.col("__n") > 0, g % F.col("__n")))
    made = made.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8)))
    from_word = F.expr("transform(sequence(0, __n - 1), i -> __w[cast(if(i < __a, i, __a + (i - __a) % __p) as int)])")
    text = F.when(F.col("__n") > 0, F.array_join(from_word, " ")).otherwise(F.col(text_col))
    return made.withColumn(text_col, text).drop("__w", "__n", "__a", "__p")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(tail_repeated(documents(spark, sf_dir).select("doc_id", "text")))
    best = F.expr("aggregate(runs, runs[0], (m, r) -> if(r.length * m.period > m.length * r.period, r, m))")
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        "collapsed_sha256", "n_words", "n_dropped",
    )


@query
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    model = pieces.Model(vocabulary_path("piece_bpe_32k.model"))
    return pieces.encode_texts(documents(spark, sf_dir), model, columns=columns).withColumnRenamed("id", "doc_id")
