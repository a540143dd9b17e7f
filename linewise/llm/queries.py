"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm import (
    bpe_count, brown, decontaminate, nearest, packing, pii, prefix_trie, quality, ranked_search, repair, simhash, substrings, superminhash,
)
from linewise.llm.common import documents, table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the folder can be named by TOKENIZER_DIR."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_phrases(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, F.col("vec_id") % 20 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_to_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_private(documents(spark, sf_dir)))


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_nearest": op3_nearest,
    "op4_simhash": op4_simhash,
    "op5_brown": op5_brown,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_substrings": op9_substrings,
    "op10_pii": op10_pii,
    "op11_superminhash": op11_superminhash,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}
