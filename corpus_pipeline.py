"""The corpus pipeline: documents through the training-data operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchflow.llm import stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("secret_scan", stages.mask_secrets),
    ("sentencepiece", stages.encode_and_decode),
]

#: SQL has no equal of the transducers, the fingerprints' components or the piece table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stages.written(docs)
    return docs
