"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, decontamination and encoding of documents.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of
documents. Defined cases are those of the operators: a document whose lines all recur stays with an empty text, and
empty texts are nobody's copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import decontamination, jaccard_groups, line_templates, merge_dropout, toxicity
from siftwell.llm.common import discard, stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def recurring_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs across documents."""
    return line_templates.deduplicated(docs)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return jaccard_groups.deduplicated(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens and ids of each document."""
    return merge_dropout.encoded(docs)


STAGES = [("toxicity", toxic_out), ("line_dedup", recurring_lines_out), ("jaccard_join", copies_out), ("decontamination", leaks_out), ("encoding", encoded)]

#: Learned scores and seeded merges aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
