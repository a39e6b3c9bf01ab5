"""Reading of the tables the queries of this subpackage run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.session import spread, table


def clip_docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``clip_docs`` as (tbl, row_id, the named columns); rows delivered again are still there."""
    df = spread(table(spark, sf_dir, "clip_docs"))
    return df.select(F.lit("clip_docs").alias("tbl"), F.col("doc_key").cast("string").alias("row_id"), *columns)


def corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``corpus`` as (tbl, row_id, the named columns); repeated rows are still there."""
    return spread(table(spark, sf_dir, "corpus")).select(F.lit("corpus").alias("tbl"), F.col("id").alias("row_id"), *columns)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, text) of ``clip_docs`` and ``corpus``."""
    return clip_docs(spark, sf_dir, "text").unionByName(corpus(spark, sf_dir, "text"))
