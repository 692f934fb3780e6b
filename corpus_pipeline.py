"""The corpus pipeline: classify, judge, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and the next stage reads that. The first
four return the columns of ``documents``, and drop the rows that they reject: what the quality classifier scores below 0.5, what
the quality rules find unlikely to be good, all but one document of each group of near copies (five-word n-grams, Jaccard similarity 0.8
or more), and documents with a leaked benchmark item. The last returns the packed pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import decontamination, jaccard_join, packing, quality_classifier, quality_rules
from cuelake.llm.common import Scratch, read


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.filter_documents(spark, docs, sf_dir)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.filter_documents(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.filter_documents(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", judge),
    ("jaccard_join", deduplicate),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: Fitted models, tokens and best fit can't be put into SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; the result of the last one."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
