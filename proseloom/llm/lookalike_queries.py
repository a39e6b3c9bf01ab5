"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm.lookalike import lookalike_members, plain_form
from proseloom.session import spread, table, written


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "clip_docs")).select(F.lit("clip_docs").alias("tbl"), F.col("doc_key").alias("key"), "text")
    rules = table(spark, sf_dir, "rules_phrase")
    return docs.unionByName(rules.select(F.lit("rules_phrase").alias("tbl"), F.col("phrase_id").alias("key"), F.col("match_text").alias("text")))


#: Tasks that the strings of one class are dealt to.
SALT = 8


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one table that look the same and are not the same string."""
    members = lookalike_members(_records(spark, sf_dir)).select("tbl", "key", "class_id", "_raw").distinct()
    members = written(members, "lookalike-members")
    # different strings of a class are paired first, then their records: copies of one string never meet each other
    group = ["tbl", "class_id"]
    strings = members.select(*group, "_raw").distinct()
    dealt = strings.withColumnRenamed("_raw", "_a").withColumn("_salt", F.pmod("_a", F.lit(SALT)).cast("int"))
    every = strings.withColumnRenamed("_raw", "_b").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = dealt.join(every, [*group, "_salt"]).where("_a < _b").drop("_salt")
    left = pairs.join(members.select(*group, F.col("_raw").alias("_a"), F.col("key").alias("x")), [*group, "_a"])
    both = left.join(members.select(*group, F.col("_raw").alias("_b"), F.col("key").alias("y")), [*group, "_b"]).where("x <> y")
    return both.select("tbl", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text in its consistent form: ``plain`` for all, and the canonical member of its class, or the text itself if it is alone."""
    records = _records(spark, sf_dir)
    members = lookalike_members(records).select("tbl", "key", F.xxhash64("text", F.lit(7)).alias("_raw"), "class_id", "canonical")
    own = records.withColumn("_raw", F.xxhash64("text", F.lit(7))).dropDuplicates(["tbl", "key", "_raw"])
    found = own.join(members, ["tbl", "key", "_raw"], "left")
    return found.select("tbl", "key", "class_id", F.coalesce("canonical", "text").alias("canonical"), plain_form(F.col("text")).alias("plain"))


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical}
