"""From raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

Every stage takes empty tables (and gives none but a schema), texts of any length whole, and further columns of any
name, which pass through unchanged up to the last stage; ``n_chars``, if there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keysift.llm import decontaminate, line_dedup, near_copies, packing, quality
from keysift.llm.common import remove, shared_dir, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails, go. Null texts have no word and fail; each row is judged by itself."""
    return quality.keep_good(docs, folder=shared_dir(spark))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line stays of each component of similar lines; documents left without a word go. Rows that share an id with
    different texts are apart; rows equal in both lose the same lines; rows without an id take part."""
    return line_dedup.drop_lines(docs, shared_dir(spark))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of near copies: five-word shingles at Jaccard 0.8 or more, verified. Candidates are
    fingerprints at up to four bits, found by op5's anchors, and MinHash bands for those further apart. Rows are known by a key
    of their own, so that null and repeated ids take part."""
    return near_copies.drop_near_copies(docs, shared_dir(spark))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, those without an id too; each row is judged by its own text."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shared_dir(spark), keep_unnamed=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences; null ids and repeated rows are packed like others."""
    return packing.pack_documents(docs, shared_dir(spark), packing.default_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-copy dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("packing", pack_sequences),
]
#: Line similarity, fingerprints and the tokenizer are beyond DuckDB's SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read back, those before it go."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{k}")
        if k:
            remove(f"{folder}/stage-{k - 1}")
    return docs
