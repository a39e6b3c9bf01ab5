"""Groups of paragraphs, and paragraphs kept whole. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseloom.functions.text import is_blank, lines, trimmed


def paragraphs(text: Column) -> Column:
    """The paragraphs between empty lines that are not blank."""
    return F.filter(F.split(lines(text), "\n\n", -1), lambda p: ~is_blank(p))


def chunks(text: Column, target: int, ceiling: int) -> Column:
    """Paragraphs packed in order into groups of at most ``target`` code points; null if one paragraph is over ``ceiling``.

    A paragraph between target and ceiling is a group of its own.
    """
    parts = paragraphs(text)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("used"))

    def add(acc: Column, p: Column) -> Column:
        n = F.length(p)
        fits = acc["open"].isNotNull() & (acc["used"] + 2 + n <= target)
        flushed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(flushed).alias("done"),
            F.when(fits, F.concat(acc["open"], F.lit("\n\n"), p)).otherwise(p).alias("open"),
            F.when(fits, acc["used"] + 2 + n).otherwise(n).alias("used"),
        )

    packed = F.aggregate(parts, empty, add, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(F.exists(parts, lambda p: F.length(p) > ceiling), F.lit(None)).otherwise(packed)


def size_gate(text: Column, chunk_chars: int, max_total_chars: int) -> Column:
    """"too_long" before any work, "single" where one call is enough, else "chunked"."""
    n = F.length(text)
    return F.when(n > max_total_chars, "too_long").when(n <= chunk_chars, "single").otherwise("chunked")


def keep_paragraphs(baseline: Column, edited: Column) -> Column:
    """The edited text with single line breaks joined, unless the baseline has such breaks or the lines look like blocks."""
    broken = F.exists(F.split(lines(baseline), "\n\n", -1), lambda p: F.contains(trimmed(p), F.lit("\n")))

    def block(line: Column) -> Column:
        head = F.substring_index(line, ". ", 1)
        return line.rlike(r"^[-*+#|>]") | (F.contains(line, F.lit(". ")) & head.rlike(r"^[0-9]*$"))

    def joined(p: Column) -> Column:
        own = F.transform(F.split(p, "\r?\n", -1), trimmed)
        return F.when(F.exists(own, block), p).otherwise(F.array_join(F.filter(own, lambda x: x != ""), " "))

    return F.when(broken, edited).otherwise(F.array_join(F.transform(F.split(edited, "\n\n", -1), joined), "\n\n"))
