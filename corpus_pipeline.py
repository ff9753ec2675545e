"""A training corpus out of ``documents``: stages that each apply one operator to what the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowmill.llm import bpe, mixing, neardup, pii, queries, toxicity
from flowmill.session import staged

MIX_PERCENT, MIX_SEED = 80, 17


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects (0.5 or more) go; the model learns from the labelled rows."""
    model = queries.toxic_model(spark, sf_dir, F.lit(True))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id (of repeated ids, one row)."""
    groups = neardup.near_duplicates(docs, shingle=5, percent=80)
    gone = groups.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id all stay
    return kept.withColumn("__apart", apart).dropDuplicates(["doc_id", "__apart"]).drop("__apart")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; ``n_chars`` follows the text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf gives its share of 80 percent of the tokens; no document is read twice."""
    mixed = mixing.mix(docs, queries.mixing_weights(), MIX_PERCENT, 1, MIX_SEED, domain=queries.domain_of(F.col("source")))
    return mixed.where("copies > 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and digests of the ids and of what they decode to."""
    columns = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    encoded = bpe.encode_texts(docs, bpe.Vocabulary(queries.vocabulary_path()), columns=columns)
    return encoded.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mixture", mix_sources),
    ("bpe", encode),
]
#: Trained scores and byte-pair merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
