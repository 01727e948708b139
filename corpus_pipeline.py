"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. ``run`` writes every stage's
result as Parquet into the shared folder and reads it again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, packing, secret_scan, simhash, toxicity
from tidemark.llm.common import stored, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score as toxic go. Null and empty texts are scored as wordless and stay if that is clean."""
    return toxicity.keep_clean(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, by similarity: of each group of near duplicates, 0.8 or more of their five-word shingles in common, the
    document of the smallest doc_id stays; texts without words are one group."""
    return simhash.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a window of a test item go whole; null and empty texts hold none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each secret is replaced in its text, and n_chars follows; every document stays."""
    return secret_scan.redact(docs, secret_scan.train_on(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: where each piece of each document stands in which sequence."""
    return packing.packed_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("secrets", secret_redaction),
    ("packing", sequence_packing),
]

#: Trained networks and a search for the fewest sequences are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, on the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
