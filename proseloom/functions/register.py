"""Functions for SQL: scalar ones that stay in the JVM, vectorised ones, and a table function of findings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.functions.clean import Cleaner
from proseloom.functions.facts import protect
from proseloom.functions.markup import html_of, markdown_of, preview, shape, word_diff
from proseloom.functions.text import LOWER, UPPER, WORD
from proseloom.operators.rows import Detector
from proseloom.sources.pack import Pack


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, pack: Pack) -> list[str]:
    """Registers fold_text, count_words, clean_text, count_fixes, gate_score, protect_text, html_shape, to_markdown, to_markup, safe_preview
    and word_diff for SQL, and the table function detect, for this session; returns the names of the scalar ones."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fold_text(t STRING) RETURNS STRING RETURN translate(t, {_sql(UPPER + '‘’')}, {_sql(LOWER + chr(39) * 2)})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION count_words(t STRING) RETURNS BIGINT RETURN regexp_count(t, {_sql(WORD)})")
    cleaner = Cleaner(pack.phrases)

    def cleaned(part: int, kind: T.DataType):
        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            pattern = cleaner.pattern()
            return texts.map(lambda t: None if t is None else cleaner.clean(t, pattern)[part])

        return run

    finder = Detector(pack)

    @F.pandas_udf(T.LongType())
    def gate_score(texts: pd.Series) -> pd.Series:
        return texts.map(finder.gate_score)

    class Detect:
        def eval(self, text: str):
            yield from finder.find(text)

    spark.udtf.register("detect", F.udtf(Detect, returnType="id: string, matched: string, category: string, weight: int, tier: int"))
    udfs = {
        "gate_score": gate_score,
        "clean_text": cleaned(0, T.StringType()), "count_fixes": cleaned(1, T.IntegerType()), "protect_text": protect, "html_shape": shape, "to_markdown": markdown_of, "to_markup": html_of, "safe_preview": preview, "word_diff": word_diff,
    }
    for name, udf in udfs.items():
        spark.udf.register(name, udf)
    return ["fold_text", "count_words", *udfs]


def register_spans(spark: SparkSession, name: str = "fact_rows") -> None:
    """Registers a table function: fact_rows(text) gives (kind, start, end, value) for each fact of a text."""
    from proseloom.functions.facts import claim

    class FactRows:
        def eval(self, text: str):
            for start, end, kind in claim(text or ""):
                yield kind, start, end, text[start:end]

    spark.udtf.register(name, F.udtf(FactRows, returnType="kind: string, start: int, end: int, value: string"))
