"""Clipboard payloads, an 8-bit code page, and small scalars of the installer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The payload's frame; offsets count bytes and have ten digits.
VERSION = "Version:0.9\r\n"
FIELDS = ["StartHTML", "EndHTML", "StartFragment", "EndFragment"]
OPEN, CLOSE = "<!--StartFragment-->", "<!--EndFragment-->"
HEAD, FOOT = f"<html>\r\n<body>\r\n{OPEN}", f"{CLOSE}\r\n</body>\r\n</html>"
HEADER_BYTES = len(VERSION) + sum(len(f) + 1 + 10 + 2 for f in FIELDS)


def build_payload(fragment: Column) -> Column:
    """The bytes of a clipboard payload around an HTML fragment. Stays in the JVM."""
    start = F.lit(HEADER_BYTES + len(HEAD))
    end = start + F.octet_length(fragment)
    at = {"StartHTML": F.lit(HEADER_BYTES), "EndHTML": end + len(FOOT), "StartFragment": start, "EndFragment": end}
    lines = [F.concat(F.lit(f"{f}:"), F.lpad(at[f].cast("string"), 10, "0"), F.lit("\r\n")) for f in FIELDS]
    return F.encode(F.concat(F.lit(VERSION), *lines, F.lit(HEAD), fragment, F.lit(FOOT)), "UTF-8")


def decode_1252(data: bytes) -> str:
    """Windows-1252; the five open positions become U+FFFD."""
    return data.decode("cp1252", "replace")


def _strict(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def payload_fragment(raw: bytes | None) -> str | None:
    """The fragment of a payload of any origin; offsets are only believed where they give valid UTF-8."""
    if raw is None:
        return None
    raw = bytes(raw).rstrip(b"\x00")
    ranges = []
    a, z = raw.find(OPEN.encode()), raw.find(CLOSE.encode())
    marked = (a + len(OPEN), z) if 0 <= a and a + len(OPEN) <= z else None
    if marked:
        ranges.append(marked)
    header = re.split(rb"(?m)^<", raw, maxsplit=1)[0]
    found = {m.group(1): int(m.group(2)) for m in re.finditer(rb"(?m)^(StartFragment|EndFragment):\s*\+?(\d{1,18})\s*$", header.replace(b"\r\n", b"\n"))}
    start, end = found.get(b"StartFragment"), found.get(b"EndFragment")
    if start is not None and end is not None and len(VERSION) <= start <= end <= len(raw):
        ranges.append((start, end))
    for a, z in ranges:
        if (text := _strict(raw[a:z])) is not None:
            return text
    first = raw.find(b"<")
    rest = raw[slice(*marked)] if marked else raw[first:] if first >= 0 else None
    return None if rest is None else _strict(rest) if _strict(rest) is not None else decode_1252(rest)


@F.pandas_udf(T.StringType())
def parse_payload(data: pd.Series) -> pd.Series:
    return data.map(payload_fragment)


@F.pandas_udf(T.StringType())
def from_1252(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decode_1252(bytes(b)))


def percent(done: Column, total: Column) -> Column:
    """Whole per cent, at most 100; null where the total is null or 0."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total)).cast("int"))


def size_label(n: Column) -> Column:
    """"1.5GB" from one GiB on, else whole "12MB", cut off."""
    return F.when(n >= 1 << 30, F.format_string("%.1fGB", n / float(1 << 30))).otherwise(F.concat(F.floor(n / (1 << 20)).cast("string"), F.lit("MB")))


def checksum_matches(data: Column, wanted: Column) -> Column:
    return F.lower(wanted) == F.sha2(data, 256)
