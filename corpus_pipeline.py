"""A corpus pipeline: quality classifier, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns documents with all
their columns; the last one returns the packed pieces with their ids. ``run`` writes each stage's result to the folder
that the executors share and reads it again, so a lost executor costs one stage's tasks at most.

Cases: null and empty texts are documents like others (the rules reject them for their length); repeated rows are copies, of
which one stays, also where they share a doc_id or have none; an empty table gives an empty result; columns that documents has beyond the usual ones are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sftloom.llm import bytecnn, jaccard, packing, rules
from sftloom.llm.arrow import shared_dir, table

REJECT_BELOW = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores as quality 1."""
    model = bytecnn.fit_quality(docs, table(spark, sf_dir, "labels"))
    return bytecnn.keep_documents(docs, model, REJECT_BELOW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram regression."""
    return rules.keep_documents(docs, rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the lowest doc_id."""
    return jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with their ids."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Trained models and sampled candidates have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    return docs
