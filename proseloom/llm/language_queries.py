"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm.language import train_language, with_segments
from proseloom.session import spread, table


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "nb_format"))
    return with_segments(docs, train_language(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of documents whose label is missing or wrong or whose text cells hold two languages."""
    found = _segments(spark, sf_dir)
    stretches = F.array_distinct(F.transform(F.filter("segments", lambda s: s["sentences"] >= 2), lambda s: s["lang"]))
    any_lang = F.transform("segments", lambda s: s["lang"])
    cases = found.withColumn("langs", stretches).where(
        (F.size("langs") > 0) & (F.col("label").isNull() | ~F.array_contains(any_lang, F.col("label")) | (F.size("langs") > 1))
    )
    return cases.select("doc_id", F.explode("langs").alias("lang")).distinct()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    found = _segments(spark, sf_dir).select("doc_id", F.posexplode("segments").alias("segment", "s"))
    return found.select("doc_id", "segment", "s.lang", F.round("s.confidence", 4).alias("confidence"), "s.sentences", "s.first_cell", "s.last_cell")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document, by sentences, with its confidence; null where there is no sure sentence."""
    found = _segments(spark, sf_dir).select("doc_id", F.explode_outer("segments").alias("s"))
    by = found.groupBy("doc_id", F.col("s.lang").alias("lang")).agg(F.sum("s.sentences").alias("n"), F.sum(F.col("s.sentences") * F.col("s.confidence")).alias("c"))
    best = by.groupBy("doc_id").agg(F.max(F.struct("n", "c", "lang")).alias("b"), F.sum("n").alias("total"))
    return best.select("doc_id", "b.lang", F.round(F.col("b.c") / F.col("total"), 4).alias("confidence"))


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments, "p8_languages": p8_languages}
