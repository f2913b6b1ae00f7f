"""A corpus made ready for training: toxic documents go, one document of each group of near-duplicates stays, documents
with benchmark passages go, secrets are blotted out, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of ``documents``.
Rows without a doc_id cannot be named by a decision and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, near_dedup, packing, secrets, toxicity
from pulsegrid.llm.common import semi_join, table
from pulsegrid.session import durable


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents not named in ``ids``."""
    ids = durable(ids.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), "rejected")
    return semi_join(docs, ids, "doc_id", anti=True)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    scores = toxicity.report(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.filter(F.col("predicted") == 1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return _without(docs, near_dedup.classify(docs).filter(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _without(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every reported secret is replaced by a mark, and n_chars follows the text."""
    scanned = secrets.scan(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    clean = secrets.redact(scanned)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or piece of a long one, in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Classifier, similarity join and greedy packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
