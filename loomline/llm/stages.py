"""Corpus stages: decisions of the operators put into effect on the rows of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, mixing, ngram_join, quality, secrets
from .scratch import sized, table

PERCENT, SHINGLE = 80, 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, accepts; all columns stay.

    Null and empty texts have a weight like any other; repeated rows share their
    fate; without labels, and of an empty input, everything stays.
    """
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by the Jaccard similarity of five-word shingles; all columns stay.

    The smallest doc_id of a group stays. Rows without shingles (null, empty and
    blank texts) are in no group and all stay. Where an id is null or repeated,
    rows are told apart by a hash of id and text: those with different texts are
    documents of their own, of equal ones that with the smallest hash of all its
    columns stays, whatever the order of the rows.
    """
    doubtful = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if doubtful.isEmpty():
        found = ngram_join.jaccard_join(docs, PERCENT, SHINGLE)
        gone = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(sized(gone, 16), "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    found = ngram_join.jaccard_join(rows, PERCENT, SHINGLE, "key").where("n_shingles > 0").distinct()
    # the smallest id of a component, then the smallest hash, is the one that stays
    placed = found.join(rows.groupBy("key").agg(F.min("id").alias("id")), found["doc_id"] == F.col("key"))
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first"))
    gone = placed.join(first, "component_id").where("key <> first.key").select("key")
    kept = rows.join(gone, "key", "left_anti")
    with_text = found.select(F.col("doc_id").alias("key"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("row"))
    single = kept.join(with_text, "key", "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row")
    return single.unionAll(kept.join(with_text, "key", "left_anti").select("row")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; found secrets are replaced by a mark, and n_chars follows. Null and empty texts stay as they are, repeated rows repeat."""
    done = secrets.redact(docs)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target asks for, with all its columns; see mixing.take for nulls, empties and repeats."""
    return mixing.take(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): token ids of every row; exact: they decode to its text. Null and empty texts have no ids, repeated rows repeat."""
    import public_tokenizers

    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
