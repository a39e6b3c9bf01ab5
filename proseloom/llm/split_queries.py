"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proseloom.llm.split import split_items
from proseloom.llm.tables import texts


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose text had to be cut, each once."""
    pieces = split_items(texts(spark, sf_dir))
    return pieces.where("piece = 1 AND n_pieces > 1").select("tbl", "row_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered pieces of every record over the limit; a record delivered twice is cut once."""
    pieces = split_items(texts(spark, sf_dir)).where("n_pieces > 1")
    return pieces.dropDuplicates(["tbl", "row_id", "piece"])


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {
    "p4_found": """
        SELECT DISTINCT 'clip_docs' AS tbl, CAST(doc_key AS VARCHAR) AS row_id FROM clip_docs WHERE length(text) > 6000
        UNION SELECT 'corpus', id FROM corpus WHERE length(text) > 6000""",
}
