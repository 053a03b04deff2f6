"""Corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabsel.llm import common, fertility, order_minhash, packing, superkmer, toxicity

STAGES = [
    ("quality rules", fertility.stage),
    ("toxicity", toxicity.stage),
    ("near duplicates", order_minhash.stage),
    ("repeated passages", superkmer.stage),
    ("packing", packing.stage),
]

#: The stages need tokenisers, language models and alignments, which SQL has not; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder as Parquet and read again by the next.

    What a stage wrote goes once the next has written its own; the last one's rows stay for the caller.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
