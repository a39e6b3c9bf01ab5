"""Facts behind placeholders: claims by priority, substitution, restoring, and what may be wrong with an answer."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of facts and their patterns, in the order in which they claim text.
KINDS = [
    ("url", r"""https?://[^\s<>()\[\]"']+"""),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("money", r"[\p{Sc}]\s?\d(?:[\d,. ]*\d)?(?:\s?(?:[mkbMKB]n?|million|billion|thousand))?\b|\b\d[\d,.]*\s?(?:GBP|USD|EUR|p|pence)\b"),
    ("iso_date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("slash_date", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    ("month_day", r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?\b"),
    ("day_month", r"(?i)\b\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?(?:,?\s+\d{4})?\b"),
    ("time", r"\b\d{1,2}:\d{2}(?::\d{2})?\s?(?i:[ap]\.?m\.?)?"),
    ("percent", r"\d+(?:\.\d+)?\s?%"),
    ("phone", r"\+\d[\d\s().-]{7,}\d"),
    ("reference", r"\b[A-Z]{2,}[-/]?\d{3,}\b|\b\d{5,}\b"),
]
_PATTERNS = [(kind, regex.compile(pattern)) for kind, pattern in KINDS]
TOKEN = re.compile(r"\[\[F(\d+)\]\]")
# workers import this module without a session, so types are not written as strings
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))
PROTECTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("values", T.ArrayType(T.StringType()))])


def claim(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the facts in order; a match that meets an earlier kind's claim is dropped whole."""
    if not any(c.isdigit() for c in text) and "@" not in text and "://" not in text:
        return []
    held: list[tuple[int, int, str]] = []
    for kind, pattern in _PATTERNS:
        new = [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
        held += [n for n in new if all(n[1] <= s or e <= n[0] for s, e, _ in held)]
    return sorted(held)


def protect_str(text: str) -> tuple[str, list[str]]:
    out, at, values = [], 0, []
    for start, end, _ in claim(text):
        out += [text[at:start], f"[[F{len(values):02d}]]"]
        values.append(text[start:end])
        at = end
    return "".join([*out, text[at:]]), values


@F.pandas_udf(PROTECTED)
def protect(texts: pd.Series) -> pd.DataFrame:
    """The text with placeholders, and the values in their order; null gives null."""
    return pd.DataFrame([protect_str(t) if t is not None else (None, None) for t in texts], columns=["text", "values"])


@F.pandas_udf(SPAN)
def fact_spans(texts: pd.Series) -> pd.Series:
    """Every fact with its kind and place."""
    return texts.map(lambda t: None if t is None else [{"kind": k, "start": a, "end": z, "value": t[a:z]} for a, z, k in claim(t)])


def _bound(answer: Column, other: Column, then) -> Column:
    """``then`` of both, bound as the one element of an array: they are computed once, and may come from Python, which a lambda may not hold."""
    return F.get(F.transform(F.array(F.struct(answer.alias("a"), other.alias("b"))), lambda x: then(x["a"], x["b"])), F.lit(0))


def violation(answer: Column, n_values: Column, may_drop: bool = False) -> Column:
    """What is wrong with the placeholders of an answer: struct(kind, index, token), or null.

    An unknown one comes first (in text order), then the lowest repeated one, then the lowest missing one.
    """
    return _bound(answer, n_values, lambda a, n: _violation(a, n, may_drop))


def _violation(answer: Column, n_values: Column, may_drop: bool) -> Column:
    digits = F.regexp_extract_all(answer, F.lit(r"\[\[F(\d+)\]\]"), F.lit(1))
    index = F.transform(digits, lambda d: F.when(F.length(F.ltrim(d, F.lit("0"))) <= 9, F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0")).cast("int")))
    unknown = F.filter(digits, lambda d: (F.length(F.ltrim(d, F.lit("0"))) > 9) | (F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0")).cast("long") >= n_values))
    repeated = F.array_min(F.filter(index, lambda i: F.size(F.filter(index, lambda j: j == i)) > 1))
    wanted = F.when(n_values > 0, F.sequence(F.lit(0), n_values.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    missing = F.lit(None).cast("int") if may_drop else F.array_min(F.array_except(wanted, index))
    first = F.get(unknown, F.lit(0))

    def one(kind: str, index: Column, token: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), index.cast("int").alias("index"), token.cast("string").alias("token"))

    return (
        F.when(F.size(unknown) > 0, one("unknown", F.lit(None), F.concat(F.lit("[[F"), first, F.lit("]]"))))
        .when(repeated.isNotNull(), one("duplicated", repeated, F.lit(None)))
        .when(missing.isNotNull(), one("missing", missing, F.lit(None)))
    )


def put_back(answer: Column, values: Column) -> Column:
    """The answer with its values; only for answers without a violation. Stays in the JVM."""
    pieces = F.split(answer, r"\[\[F\d+\]\]", -1)
    index = F.transform(F.regexp_extract_all(answer, F.lit(r"\[\[F(\d+)\]\]"), F.lit(1)), lambda d: d.cast("int"))
    own = F.transform(index, lambda i: F.get(values, i))
    return F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(own, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda v, p: F.concat(v, p)), ""))


def restore(answer: Column, values: Column, may_drop: bool = False) -> Column:
    """struct(text, violation): the restored text, or what is wrong."""


    def both(a: Column, v: Column) -> Column:
        wrong = _violation(a, F.size(v), may_drop)
        return F.struct(F.when(wrong.isNull(), put_back(a, v)).alias("text"), wrong.alias("violation"))

    return _bound(answer, values, both)
