"""The corpus pipeline: toxicity filter, exact dedup, near-duplicate removal, decontamination, packing.

Every stage takes what its predecessor kept, as rows of `documents`; the last one returns the packed pieces. Stages decide row by row, so null
ids, ids that several rows share and ties lose no text; an empty table gives an empty result, texts of any length are taken whole, and other
columns are carried along unchanged (n_chars is counted again for texts that were cut) but for the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from sparkloom.session import materialise


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the severity model rejects go. It learns from the labels of the documents it is given; without labels of both kinds all rows stay. Null and
    empty texts stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest id stays, of rows that repeat id and text one."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the row with the smallest id stays. Rows without words have no links and stay."""
    return jaccard_join.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; rows of which more than half is hit go. Rows without words stay as they are."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, sequences and places. A null or empty text is a piece of the end token."""
    return packing.pack_documents(docs, packing.default_tokenizer(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table of documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
