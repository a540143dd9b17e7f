"""A training corpus from `documents`: quality, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linewise.llm import decontaminate, packing, pii, quality, simhash
from linewise.llm.common import table
from linewise.llm.queries import vocabulary
from linewise.session import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores 0.7 or more; it learns from the labelled ones among them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the words of benchmark passages cut out."""
    return decontaminate.remove_phrases(docs, table(spark, sf_dir, "benchmark"))


def without_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms generalised."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, with their ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), keep_ids=True)


#: Each takes (spark, docs, sf_dir); all but the last return the columns of `docs`.
STAGES = [
    ("quality", good),
    ("near_duplicates", unlike),
    ("decontamination", without_benchmark),
    ("private_data", without_private),
    ("packing", packed),
]
#: SQL has no form for the learnt scores that decide the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
