"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is written as Parquet and
read again.  All but the last return the columns of documents.  A stage changes rows only where its operator decides
so: quality rules drop documents, the Jaccard join leaves one document of each group, substring dedup and the secret
scan change texts (and n_chars) and keep every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldview.llm import jaccard, packing, quality, secrets, substring
from foldview.llm.common import discard, settled_alone, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: the secret scan's forest has no SQL; tests/llm hold each stage against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        # what a stage writes on its way, and what the stage before gave, goes when its result is there
        docs = settled_alone(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
