"""The corpus pipeline: five stages from raw documents to a weighted mix.

Every stage gets all rows that the one before kept, as they were written and read again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontamination, mixing, near_duplicates, quality, secrets
from recordloom.llm.store import settle, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5; labels are learnt as in the quality query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.learnable()).select("doc_id", F.col("quality").alias("label"))
    (score,) = unused(docs, "quality_score")
    return quality.score(docs, quality.train(docs, labels), docs.columns, score).where(F.col(score) >= 0.5).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    A row is known by a 64-bit hash of its id and text, so that texts under one id, or under none, are
    documents of their own, and similar ones among them are duplicates like others.  Of rows equal in
    id and text the one with the smallest hash of all columns stays.  Reruns keep the same rows.
    """
    key, pick = unused(docs, "row_key", "row_pick")
    of_row = F.xxhash64("doc_id", "text")
    kept = near_duplicates.near_duplicates(docs.select(of_row.alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(key)).distinct()
    first = docs.groupBy(of_row.alias(key)).agg(F.min(F.xxhash64(*docs.columns)).alias(pick))
    named = docs.select("*", of_row.alias(key), F.xxhash64(*docs.columns).alias(pick))
    return named.join(first.join(kept.hint("merge"), key).hint("merge"), [key, pick]).dropDuplicates([key, pick]).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars, where there is one, counts the new text."""
    done = secrets.redact(docs, secrets.train(docs))
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: slot, doc_id, source, first_word, n_words and text of every part of a document."""
    return mixing.mixed_texts(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]
#: Trained stages can't be expressed in SQL; the tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
