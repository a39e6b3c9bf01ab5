"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proseloom.llm.tokens import encode_texts
from proseloom.session import spread, table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids by ``byte_bpe_50k``."""
    return encode_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"p6_ids": p6_ids}
