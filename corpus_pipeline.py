"""Corpus clean-up: five stages over the documents, each one operator of ``attrloom.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. All but the last return the
columns of ``documents``. Models are fitted on the stage's own input within the bounds the operators document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrloom.llm import bpe, decontaminate, pii, simhash, toxicity
from attrloom.llm.common import bound_batches, table
from attrloom.session import materialize


def _bounded(stage: Callable) -> Callable:
    """The stage with batches bounded by bytes; it runs after it returns, so the setting stays."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is more likely above 0 than not go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (64-bit fingerprints of three-word shingles, 3 bits apart at most)."""
    return simhash.keep_first(docs)


@_bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_bounded
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the new text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


@_bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of the bytes they decode to."""
    fold = bpe.Fold()
    return bpe.encode(docs, fold).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                                         F.sha2(fold.decode(F.col("ids")), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", redact_personal_data), ("encoding", encode)]

#: Trained models and similarity search have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs, name) if number < len(STAGES) - 1 else docs
    return docs
