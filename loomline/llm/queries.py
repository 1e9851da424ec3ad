"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, embedding_dedup, html_text, mixing, ngram_join, quality, secrets, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_embedding_near_dedup": embedding_dedup.query,
    "op3_secret_scans": secrets.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_mixing": mixing.query,
    "op6_byte_bpe": bpe.query,
    "op7_quality_classifier": quality.query,
    "op8_chat_formatting": chat.query,
    "op9_nearest_neighbours": ann.query,
    "op10_html_extraction": html_text.query,
}

SQL: dict[str, str] = {"op8_chat_formatting": chat.SQL}
