"""The training-data pipeline over the documents table: classify, apply rules, deduplicate, decontaminate, pack.

Each stage works on all that the one before it kept, written as Parquet in the shared folder and read again; its verdicts
take effect. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, packing, quality_classifier, quality_rules, simhash_dedup
from quillspark.llm.shared import Workspace, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    return quality_classifier.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule and whose host isn't blocked."""
    return quality_rules.keep_good(spark, docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash_dedup.keep_distinct(spark, docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in token sequences."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", remove_benchmarks),
    ("best-fit packing", pack),
]

#: The classifier's trees, the components and the packing are beyond SQL; run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ws, docs, held = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = ws.keep(docs, f"stage-{n + 1}")
            if held is not None:
                ws.drop(held)
            held = docs
    return docs
