"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm.mixing import Quota, mix_report, mix_sources
from proseloom.llm.tokens import count_tokens
from proseloom.session import spread, table, written


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Quota]]:
    sizes = count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return mix_sources(written(sizes, "mix-sizes"), table(spark, sf_dir, "mix_targets"), "doc_id", "n_tokens")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mix, with its shard and its place there."""
    return _mix(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual share of each source in the mix beside its target."""
    mixed, plan = _mix(spark, sf_dir)
    return mix_report(mixed, plan).withColumn("actual_share", F.round("actual_share", 9))


QUERIES = {"p7_mix": p7_mix, "p7_report": p7_report}
