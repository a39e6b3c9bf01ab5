"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm.pii import pii_spans, redact
from proseloom.llm.tables import clip_docs, corpus
from proseloom.session import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clip_docs(spark, sf_dir, F.lit(0).alias("item"), "text")
    facts = corpus(spark, sf_dir, F.posexplode("facts").alias("item", "text"))
    values = table(spark, sf_dir, "protected_texts").select(F.lit("protected_texts").alias("tbl"), F.col("doc_key").cast("string").alias("row_id"), F.posexplode("fact_values").alias("item", "text"))
    return docs.unionByName(facts).unionByName(values)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of personal information that each record holds."""
    return pii_spans(_items(spark, sf_dir)).select("tbl", "row_id", F.col("kind").alias("pii_kind")).distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and value with placeholders in place of personal information."""
    items = _items(spark, sf_dir)
    return redact(items, pii_spans(items))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
