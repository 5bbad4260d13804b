"""A training corpus in five stages, each a corpus operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaro.llm import mixing, ngram_join, packing, passages, quality_rules
from tessaro.llm._work import release, settle, table, written


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words or more are cut, in mid-line too; documents with nothing else go."""
    return passages.dedup_passages(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", drop_poor),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned rules and a genetic search are beyond SQL: tests/llm compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begun = written()
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        release(spark, begun, keep=[docs])  # a stage's result is a table: what it was made of can go
    return STAGES[-1][1](spark, docs, sf_dir)
