"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm.level import graded
from proseloom.llm.tables import clip_docs, corpus
from proseloom.session import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, text, source); a source is the cleaned application, in ``corpus`` the kind that begins the id."""
    app = F.coalesce(F.nullif(F.lower(F.trim("app")), F.lit("")), F.lit("unknown"))
    docs = clip_docs(spark, sf_dir, "text", app.alias("source"))
    return docs.unionByName(corpus(spark, sf_dir, "text", F.regexp_replace("id", r"-\d+$", "").alias("source")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose prose is English and mostly of the highest band."""
    return graded(_texts(spark, sf_dir), table(spark, sf_dir, "level_labels")).where("is_top").select("tbl", "row_id")


def p1_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every English row."""
    found = graded(_texts(spark, sf_dir), table(spark, sf_dir, "level_labels"))
    return found.select("tbl", "row_id", F.round("level", 6).alias("level"))


QUERIES = {"p1_found": p1_found, "p1_levels": p1_levels}
