"""Corpus pipeline: documents through five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import stages
from loomline.llm.scratch import Scratch

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("n-gram Jaccard join", stages.drop_near_duplicates),
    ("secret scans", stages.redact_secrets),
    ("mixing sources", stages.mix_sources),
    ("byte-level BPE", stages.encode_bytes),
]
#: The classifier's noise and the hashes of the mix have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
