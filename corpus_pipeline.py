"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing.

Each stage works on what its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet in the shared folder and reads it
again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from payguard.llm import linededup, mixing, packing, quality, simhash
from payguard.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers go."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go out of the texts."""
    return linededup.deduped_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles alike to 0.8 or more.

    The SimHash trie finds the links of few bits; those that it misses come from shared minimum hashes.
    """
    return simhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that is taken twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Robust estimates, fingerprints and best fit have no SQL; the stages' tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
