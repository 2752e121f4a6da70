"""The corpus pipeline: from ``documents`` to packed sequences.

Five stages, each of which applies one operator to all that its predecessor kept:
toxic documents go, repeated lines go, one document of each near-duplicate group
stays, secrets are masked, and what is left is packed into training sequences.
Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import linededup, packing, secrets, simhash, toxicity
from leafmill.llm._shared import materialize, table, together
from leafmill.llm.queries import vocabulary


def _counted(docs: DataFrame) -> DataFrame:
    """With ``n_chars``, if there is such a column, as its text now has them."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go; the model learns from those of ``docs`` that have labels and aren't held out."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines one stays. A document of which nothing stays keeps its row, with an empty text."""
    return _counted(together(linededup.deduplicate(docs, exact_words=linededup.EXACT_WORDS), docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by ``[SECRET]``; all documents stay."""
    return _counted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the edit-distance groups nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
