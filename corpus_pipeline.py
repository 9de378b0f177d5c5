"""From raw documents to packed training sequences, each stage one operator of ``symbolith.llm``.

Each stage works on all that the one before kept and is written and read again; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symbolith.llm import common, exact_dedup, near_dedup, packing, quality, toxicity
from symbolith.llm.queries import BYTE_BPE


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity under the model of trusted text is low enough."""
    return quality.without_rejected(docs, common.table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted to be toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest doc_id."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that of the smallest doc_id."""
    return near_dedup.without_near_copies(docs, size=5, threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, vocabulary=BYTE_BPE, capacity=1024, end_id=2)


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("packing", pack),
]
#: No SQL expresses the classifiers; tests/llm/test_text_models.py checks what each stage keeps of planted rows, not every
#: row against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, name)
    return docs
