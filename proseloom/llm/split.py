"""Splitting oversized items at natural boundaries.

A text is taken as a run of tokens: its code points, their bytes, or the tokens of a public tokenizer, whichever the limit is
given in. The offsets at which tokens begin and the sums of their sizes up to there are two sorted arrays, and the places
where a text may be cut are one more for each strength of boundary (paragraph, line, sentence, clause, word). A piece may
reach as far as the last offset whose prefix sum is within the limit, found by binary search; it ends at the last boundary before
that, found by binary search too, and the strongest kind that lies in the upper part of the piece wins. From there a binary
search in the prefix sums steps back by ``overlap``; the next piece starts at the first boundary from that place on. Where
there is no boundary at all the cut is hard: at a token's beginning, but never inside a combining sequence unless the
sequence itself is longer than the room there is.

Sizes in tokens of a tokenizer are those of the text's own encoding, and cuts lie where one of its tokens begins.

Defined results: a null text gives no piece; an empty text gives one empty piece; a text of at most ``limit`` gives one
piece equal to it; a single token over the limit is a piece of its own; repeated rows are cut alike, each for itself; other
columns are carried along, and an input column whose name clashes with an output column is replaced by it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.llm.tokens import tokenizer, vocabulary

LIMIT, OVERLAP = 6000, 200
#: A stronger boundary is taken only if the piece is filled to this share by it.
MIN_FILL = 0.5
#: From the strongest to the weakest; each match ends at the boundary.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』）]*"),
    re.compile(r"[,;:、，；：]\s*"),
    re.compile(r"\s+"),
]
PIECE_FIELDS = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("n_pieces", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("piece_text", T.StringType()),
]


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(text) + 1)
    return at, at


def _widths(text: str) -> np.ndarray:
    """Bytes of UTF-8 of each code point."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


def _bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(text) + 1), np.append(0, np.cumsum(_widths(text)))


def _tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    own = tokenizer(vocabulary())
    ids = own.plain.encode_ordinary(text)
    begins = np.append(0, np.cumsum(own.length[np.array(ids, dtype=np.int64)])) if ids else np.zeros(1, dtype=np.int64)
    points = np.append(0, np.cumsum(_widths(text)))
    # a token may begin inside a character; there is no cut
    place = np.searchsorted(points, begins)
    clean = points[np.minimum(place, len(text))] == begins
    return place[clean], np.flatnonzero(clean)


#: For each unit, a text's token offsets in code points and the sum of sizes before each, both with the end of the text.
UNITS: dict[str, Callable[[str], tuple[np.ndarray, np.ndarray]]] = {"chars": _points, "bytes": _bytes, "tokens": _tokens}


@dataclass(frozen=True)
class Cutter:
    """Cuts texts; limit and overlap are in code points, bytes of UTF-8 or tokens of the public tokenizer."""

    limit: int = LIMIT
    overlap: int = OVERLAP
    unit: str = "chars"

    def __post_init__(self) -> None:
        if self.limit < 1 or not 0 <= self.overlap < self.limit or self.unit not in UNITS:
            raise ValueError(f"limit must be positive, overlap smaller than it, unit one of {', '.join(UNITS)}")

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code point offsets of the pieces, in order."""
        at, prefix = UNITS[self.unit](text)
        if prefix[-1] <= self.limit:
            return [(0, len(text))]
        marks = [np.fromiter((m.end() for m in b.finditer(text)), dtype=np.int64) for b in BOUNDARIES]
        # boundaries, as numbers of tokens; one inside a token is none
        kinds = [k[at[k] == m] for m in marks for k in [np.searchsorted(at, m)]]
        spans, start, done, last = [], 0, 0, len(at) - 1
        while True:
            room = max(int(np.searchsorted(prefix, prefix[start] + self.limit, "right")) - 1, start + 1, done + 1)
            if room >= last:
                return [*spans, (int(at[start]), len(text))]
            fill = int(np.searchsorted(prefix, prefix[start] + max(1, (prefix[room] - prefix[start]) * MIN_FILL)))
            least = max(fill, done + 1)
            found = (int(e[i]) for e in kinds if (i := int(np.searchsorted(e, room, "right")) - 1) >= 0 and e[i] >= least)
            end = next(found, 0) or self._hard_end(text, at, least, room)
            spans.append((int(at[start]), int(at[end])))
            back = max(int(np.searchsorted(prefix, prefix[end] - self.overlap)), start + 1)
            start = next((int(e[i]) for e in kinds[2:] if (i := int(np.searchsorted(e, back))) < len(e) and e[i] < end), back)
            while start < end and unicodedata.combining(text[at[start]]):
                start += 1
            # the next piece has to go beyond the end of this one
            start = min(end, max(start, int(np.searchsorted(prefix, prefix[end + 1] - self.limit))))
            done = end

    @staticmethod
    def _hard_end(text: str, at: np.ndarray, least: int, room: int) -> int:
        cut = room
        while cut > least and unicodedata.combining(text[at[cut]]):
            cut -= 1
        return cut if cut > least else room


def split_items(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "chars") -> DataFrame:
    """One row for each piece of each row of ``df``: its columns except ``text``, and the columns of PIECE_FIELDS.

    Items that can't be over the limit stay in the JVM (no token is shorter than a byte); only the others go through Python. No shuffle.
    """
    cutter = Cutter(limit, overlap, unit)
    names = {f.name.lower() for f in PIECE_FIELDS}
    kept = [c for c in df.columns if c != text and c.lower() not in names]
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("piece_text")).where(F.col("piece_text").isNotNull())
    size = F.length("piece_text") if unit == "chars" else F.octet_length("piece_text")
    short = base.where(size <= limit).select(
        *[F.col(f"`{c}`") for c in kept], F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"),
        F.lit(0).cast("long").alias("start"), F.length("piece_text").cast("long").alias("end"), "piece_text",
    )

    @F.pandas_udf(T.ArrayType(T.StructType(PIECE_FIELDS)))
    def cut(texts: pd.Series) -> pd.Series:
        def pieces(text: str) -> list[dict]:
            spans = cutter.spans(text)
            return [
                {"piece": i + 1, "n_pieces": len(spans), "start": a, "end": b, "piece_text": text[a:b]}
                for i, (a, b) in enumerate(spans)
            ]

        return texts.map(pieces)

    long = base.where(size > limit).select(*[F.col(f"`{c}`") for c in kept], F.explode(cut("piece_text")).alias("_p"))
    return short.unionByName(long.select(*[F.col(f"`{c}`") for c in kept], "_p.*"))
