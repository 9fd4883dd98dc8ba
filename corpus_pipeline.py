"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing to target weights and best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents`` (the last one: the packed pieces).
What one stage returns is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import core, mixing, near_dedup, packing, quality, substring
from ledgerloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    return quality.rows(spark, docs, core.load(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return near_dedup.rows(spark, docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that occur earlier in the corpus are cut out; a document that loses all its words goes."""
    return substring.rows(spark, docs).where(core.n_words(core.F.col("text")) > 0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents are left out or repeated."""
    return mixing.mix_rows(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of at most 1024 tokens."""
    return packing.pack(spark, docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Learned rules, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = core.keep(spark, docs, name.replace(" ", "_"))
    return docs
