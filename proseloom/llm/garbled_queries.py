"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proseloom.llm.garbled import garbled_tokens, restored
from proseloom.session import spread, table

FIELDS = [("text", False), ("html", True)]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that show characters of a wrong decoding."""
    docs = spread(table(spark, sf_dir, "clip_docs").select("doc_key", "text", "html"))
    return garbled_tokens(docs, "doc_key", FIELDS).select("doc_key", "field_name").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected fields with the original text put back where it could be told."""
    docs = spread(table(spark, sf_dir, "clip_docs").select("doc_key", "text", "html"))
    return restored(docs, garbled_tokens(docs, "doc_key", FIELDS), "doc_key", FIELDS)


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
