"""Corpus pipeline: five stages over the documents table, each written and read again by whoever runs it.

1. quality rules: rows that fail the base rules or the trees go.
2. n-gram Jaccard join: one row of each class of near and exact copies stays.
3. suffix-array dedup: bytes of 200-byte strings that are found elsewhere in what is left are taken out; rows left empty go.
4. benchmark decontamination: rows that hold a benchmark item go.
5. packing: what is left is dealt to length buckets and batches.

No stage needs the rows in any order; nulls, empty tables and repeated rows are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import contain, neardup, packing, quality, shared, suffixes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees learn from the labelled ones among docs."""
    return quality.keep_good(docs, quality.train(docs, shared.table(spark, sf_dir, "labels"), signs=quality.RULE_SIGNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that are found elsewhere too."""
    return suffixes.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contain.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, length, bucket, bucket_length, batch and slot of each document that is left."""
    return packing.pack(packing.word_lengths(docs))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("length_buckets", length_buckets)]
#: The trees of the first stage and the classes of the second are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back."""
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs)
    return docs
