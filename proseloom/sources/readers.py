"""Readers and writers: corpora, benchmark rows, whole-text files, clipboard payloads, settings."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField("id", T.StringType()), T.StructField("note", T.StringType()), T.StructField("text", T.StringType()), T.StructField("facts", T.ArrayType(T.StringType()))])
BENCH = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("model",)]
    + [T.StructField("run", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("ms", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("input", "baseline", "output", "rejected")]
    + [T.StructField("facts", T.ArrayType(T.StringType())), T.StructField("load_ms", T.LongType()), T.StructField("vram_mib", T.LongType())]
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of items with id, note, text and facts."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path)


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of benchmark rows; blank lines are skipped."""
    return spark.read.schema(BENCH).json(path).where("model IS NOT NULL OR id IS NOT NULL")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object for each row; nulls are written."""
    df.write.option("ignoreNullFields", False).json(path)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, trimmed."""
    from proseloom.functions.text import trimmed

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), trimmed(F.col("value")).alias("text"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(id, note, text, facts) of any file: one that ends in .json is a corpus, any other is one sample, its text trimmed, its name the id."""
    if path.lower().endswith(".json"):
        return read_corpus(spark, path)
    texts = read_whole_texts(spark, path)
    return texts.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("id"), F.lit(None).cast("string").alias("note"), "text", F.array().cast("array<string>").alias("facts"))


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as Parquet: kind, the text always, the markup and its clipboard payload where a document is rich."""
    from proseloom.functions.codecs import build_payload

    rest = [c for c in docs.columns if c not in ("kind", "html", "text", "payload")]
    rich = F.col("html").isNotNull()
    docs.select(*rest, F.when(rich, "rich").otherwise("plain").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "html", F.when(rich, build_payload(F.col("html"))).alias("payload")).write.parquet(path)


def load_settings(path: str, defaults: str) -> tuple[dict, str | None]:
    """The settings of a file over the defaults; a file that is not there is written with the defaults."""
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write(defaults)
        return tomllib.loads(defaults), None
    with open(path, encoding="utf-8") as f:
        return overlay(defaults, f.read())


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, fragment) of files with clipboard HTML; null where there is no markup in one."""
    from proseloom.functions.codecs import parse_payload

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", parse_payload("content").alias("fragment"))


def normalised(html: Column, text: Column, derived: Column) -> Column:
    """A document of what was read: the markup if there is any, with ``derived`` as its text where it has none; null if blank."""
    from proseloom.functions.text import is_blank

    own = F.coalesce(text, derived)
    rich = html.isNotNull() & ~is_blank(html)
    doc = F.struct(F.when(rich, "rich").otherwise("plain").alias("kind"), F.when(rich, html).alias("html"), F.coalesce(own, F.lit("")).alias("text"))
    return F.when(~is_blank(F.coalesce(own, F.lit(""))), doc)


def overlay(defaults: str, own: str | None) -> tuple[dict, str | None]:
    """Settings of a TOML text over those of another, table by table; an unknown key or bad TOML gives the defaults and why."""
    base = tomllib.loads(defaults)
    if not own:
        return base, None
    try:
        return _merged(base, tomllib.loads(own), ""), None
    except (tomllib.TOMLDecodeError, KeyError, TypeError) as e:
        return base, str(e)


def _merged(base: dict, own: dict, at: str) -> dict:
    out = dict(base)
    for key, value in own.items():
        if key not in base:
            raise KeyError(f"unknown setting {at}{key}")
        if isinstance(base[key], dict) != isinstance(value, dict):
            raise TypeError(f"setting {at}{key} has the wrong form")
        out[key] = _merged(base[key], value, f"{at}{key}.") if isinstance(value, dict) else value
    return out


def upsert_setting(text: str, key: str, value: str) -> str:
    """``text`` with the line ``key = value``: in place of the first one of that key, else before the first table."""
    lines, new = text.splitlines(), f"{key} = {value}"
    own = next((i for i, line in enumerate(lines) if "=" in line and line.split("=", 1)[0].strip() == key), None)
    if own is not None:
        lines[own] = new
    else:
        first = next((i for i, line in enumerate(lines) if line.lstrip().startswith("[")), len(lines))
        lines.insert(first, new)
    return "\n".join(lines) + "\n"
