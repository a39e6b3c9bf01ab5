"""The mechanical fixes: phrases with a replacement, and dashes, in one pass.

A phrase is replaced where a word starts (or where another replacement just ended) and no word goes on after it. The
longest phrase wins, and a replacement is never read again. A deleted phrase takes the blanks after it and one mark
out of ``, ; :`` along, together with the same kind of mark on its left; the capital of a deleted phrase goes to the next
letter. Dashes become spaced hyphens, an en dash between digits a plain one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions.patterns import starts, trie
from proseloom.sources.pack import Pack, Phrase

_CAPITAL = "\x00"
_DASH = re.compile(" *[–—] *")
_DIGITS = frozenset("0123456789")
RESULT = "text string, fixes int"


def _either_case(literal: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in literal)


@lru_cache(maxsize=8)
def _some(phrases: tuple[Phrase, ...]) -> re.Pattern[str]:
    """Found in every text that holds a phrase with a replacement; a place is left after a character or two, unlike with the pattern of all phrases."""
    own = [p.match for p in phrases if p.fix is not None and p.match]
    return re.compile(starts(own, True) + trie(own, True))


@dataclass(frozen=True)
class Cleaner:
    phrases: tuple[Phrase, ...]

    def pattern(self) -> re.Pattern[str] | None:
        own = [p for p in self.phrases if p.fix is not None and p.match]
        if not own:
            return None
        body = "|".join(f"({_either_case(p.match)})" for p in own)
        return re.compile(rf"(?<![^\W_])(?<!')(?:{body})(?![^\W_])(?!')")

    def clean(self, text: str, pattern: re.Pattern[str] | None = None) -> tuple[str, int]:
        pattern = pattern or self.pattern()
        fixes, out = 0, text
        if pattern is not None and _some(self.phrases).search(text):
            own = [p for p in self.phrases if p.fix is not None and p.match]
            out, at = "", 0
            while m := pattern.search(text, at):
                out += text[at : m.start()]
                at, fixes = m.end(), fixes + 1
                fix, upper = own[m.lastindex - 1].fix, m.group()[:1].isupper()
                if fix:
                    out += fix[:1].upper() + fix[1:] if upper else fix
                    continue
                if upper:
                    out += _CAPITAL
                mark = re.compile(" *([,;:]) *| *").match(text, at)
                at = mark.end()
                if mark.group(1):
                    kept = out.rstrip(" ")
                    if kept[-1:] in (",", ";", ":") and kept:
                        out = kept[:-1] + " "
            out += text[at:]
        out, dashes = dashed(out)
        return capitals(out), fixes + dashes


def dashed(text: str) -> tuple[str, int]:
    """Dashes as hyphens, and how many there were."""
    if "–" not in text and "—" not in text:
        return text, 0
    out, at, n = "", 0, 0
    while m := _DASH.search(text, at):
        head, after = out + text[at : m.start()], text[m.end() : m.end() + 1]
        before = head.rstrip(_CAPITAL)[-1:]
        if m.group() == "–" and before in _DIGITS and after in _DIGITS:
            out = head + "-"
        else:
            end = len(head.rstrip(" " + _CAPITAL))
            marks = head[end:].replace(" ", "")
            out = head[:end] + marks + (" " if end else "") + "- "
        at, n = m.end(), n + 1
    return out + text[at:], n


def capitals(text: str) -> str:
    """Each marker gone, and the next letter after it in upper case."""
    if _CAPITAL not in text:
        return text
    out, *rest = text.split(_CAPITAL)
    for part in rest:
        i = next((i for i, c in enumerate(part) if c.isalpha()), None)
        out += part if i is None else part[:i] + part[i].upper() + part[i + 1 :]
    return out


def needs_cleaning(text: Column, pack: Pack) -> Column:
    """False only for texts that cleaning leaves as they are; a literal pattern, so it runs in the JVM."""
    own = [p.match for p in pack.phrases if p.fix is not None and p.match]
    dashes = text.rlike(r"[–—\x00]")
    return dashes | text.rlike(starts(own, True) + trie(own, True)) if own else dashes


def clean_texts(df: DataFrame, pack: Pack, text: str = "text", to: str = "cleaned", fixes: str = "fixes") -> DataFrame:
    """``df`` with the cleaned text and the number of fixes. Only texts that need it go through Python; no shuffle."""
    cleaner = Cleaner(pack.phrases)

    @F.pandas_udf(RESULT)
    def run(values: pd.Series) -> pd.DataFrame:
        pattern = cleaner.pattern()
        return pd.DataFrame([cleaner.clean(v, pattern) if v is not None else (None, 0) for v in values], columns=["text", "fixes"])

    need = F.coalesce(needs_cleaning(F.col(text), pack), F.lit(False))
    kept = [c for c in df.columns if c not in (to, fixes)]
    plain = df.where(~need).select(*kept, F.col(text).alias(to), F.lit(0).alias(fixes))
    dirty = df.where(need).select(*kept, run(text).alias("_c")).select(*kept, F.col("_c.text").alias(to), F.col("_c.fixes").alias(fixes))
    return plain.unionByName(dirty)
