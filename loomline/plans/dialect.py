"""One SQL text for Spark and, by a short list of renamings, for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Spark's word, DuckDB's word.
RENAMED = [
    ("percentile(", "quantile_cont("),
    ("/*g*/", ", 'g'"),
    ("collect_list(", "list("),
    ("array_sort(collect_set(", "list_sort(list_distinct(list("),
    ("size(", "len("),
    ("/*)*/", ")"),
    ("weekday(", "-1 + isodow("),
    ("dayofmonth(", "day("),
    ("bround(", "round_even("),
    ("regexp_like(", "regexp_matches("),
    ("last_value(sparse) IGNORE NULLS", "last_value(sparse IGNORE NULLS)"),
]


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return run


def duck(text: str) -> str:
    for ours, theirs in RENAMED:
        text = text.replace(ours, theirs)
    return text
