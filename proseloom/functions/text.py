"""Text as Columns: folding, words, blanks. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[\p{IsAlphabetic}\p{N}'’\-–]+"


def fold(text: Column) -> Column:
    """ASCII letters in lower case, curly apostrophes straight; nothing else changes."""
    return F.translate(text, UPPER + "‘’", LOWER + "''")


def fold_str(text: str) -> str:
    return text.translate(str.maketrans(UPPER + "‘’", LOWER + "''"))


def word_count(text: Column) -> Column:
    """Runs of letters, numbers, apostrophes, hyphens and en dashes."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def spaced_words(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\A\s*\z")


def lines(text: Column) -> Column:
    """With line feeds only."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))
