"""Texts that look the same and are made of other characters.

A text is mapped character by character to the plain character it looks like: full-width forms and the spaces of other
widths to their ASCII forms, Cyrillic, Greek, Cherokee, Lisu and Latin look-alikes to the Latin letter, letters of the mathematical
alphabets to plain ones, ligatures to their letters, characters that show nothing (format and ASCII control
characters, variation selectors, tags) to nothing. Values mapped in this way are then grouped in SQL under the accent-sensitive
``UNICODE`` collation, which takes care of combining accents (a letter with its accent is the letter followed by it) and
keeps cases and accents apart; values that a collation takes as equal and a reader does not are kept apart by their canonical
composition, which is a second key of the grouping. Each class has one canonical member, chosen by rule: the text with the
fewest signs of another spelling (letters of two scripts side by side, full-width and invisible forms), then the one that
is least in code point order. It is joined back to all members. ``plain_form`` gives every text, alone in its class or not,
the mapped and composed form, which is the same for all texts that look the same, in whatever table.

Grouping by collation costs much more than grouping by bytes, and nearly all texts are alone in their class. So a hash of the
plain form comes first, and only values whose hash holds two different texts go to the collation. Texts are not shuffled
for this: one pass writes a row of two hashes for each of them, and the few texts that have a rival are fetched by a second scan.

Defined results: null texts, and texts that show nothing, are in no class and have no canonical form; rows of one key with
the same text count once; a text alone in its class is its own canonical form. Spaces at the ends of a text and of a line
show nothing; the number of spaces inside a line does show.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.session import written

# Which characters look like which, in the order of the Latin letters they look like.
LOOKALIKES = [
    # Latin capitals
    ("A", "АΑ"), ("B", "ВΒ"), ("C", "СϹ"), ("E", "ЕΕ"), ("F", "Ϝ"), ("H", "НΗ"), ("I", "ІΙӀ"), ("J", "ЈͿ"), ("K", "КΚ" + chr(0x212A)), ("M", "МΜ"),
    ("N", "Ν"), ("O", "ОΟ"), ("P", "РΡ"), ("Q", "Ԛ"), ("S", "Ѕ"), ("T", "ТΤ"), ("W", "Ԝ"), ("X", "ХΧ"), ("Y", "УΥҮ"), ("Z", "Ζ"),
    # Latin small letters
    ("a", "аɑ"), ("c", "сϲ"), ("d", "ԁ"), ("e", "е"), ("g", "ɡ"), ("h", "һ"), ("i", "іι"), ("j", "јϳ"), ("l", "ӏ"), ("o", "оοօ"),
    ("p", "рρ"), ("q", "ԛ"), ("s", "ѕ"), ("v", "νѵ"), ("w", "ԝ"), ("x", "хχ"), ("y", "уү"),
    # accented letters of Cyrillic that have a Latin twin
    ("ë", "ё"), ("Ë", "Ё"), ("ï", "ї"), ("Ï", "Ї"), ("è", "ѐ"), ("È", "Ѐ"),
    # signs
    (chr(0xC5), chr(0x212B)), (chr(0xB5), chr(0x3BC)), (chr(0x3A9), chr(0x2126)), (chr(0x2206), chr(0x394)), ("-", chr(0x2010) + chr(0x2011)),
    (";", chr(0x37E)), (chr(0xB7), chr(0x387)), ("`", chr(0x1FEF)),
]
#: Capitals of Cherokee and of Lisu as they look in Latin, in the order of the Latin ones.
CHEROKEE = list(zip("ABCDEGHJKLMPRSTVWYZ", map(chr, [0x13AA, 0x13F4, 0x13DF, 0x13A0, 0x13AC, 0x13C0, 0x13BB, 0x13AB, 0x13E6, 0x13DE, 0x13B7, 0x13E2, 0x13A1, 0x13DA, 0x13A2, 0x13D9, 0x13B3, 0x13A9, 0x13C3])))
LISU = list(zip("ABCDEFGHIJKLMNOPRSTUVWXYZ", map(chr, [0xA4EE, 0xA4D0, 0xA4DA, 0xA4D3, 0xA4F0, 0xA4DD, 0xA4D6, 0xA4E7, 0xA4F2, 0xA4D9, 0xA4D7, 0xA4E1, 0xA4DF, 0xA4E0, 0xA4F3, 0xA4D1, 0xA4E3, 0xA4E2, 0xA4D4, 0xA4F4, 0xA4E6, 0xA4EA, 0xA4EB, 0xA4EC, 0xA4DC])))
LIGATURES = [(chr(0xFB00 + i), letters) for i, letters in enumerate(["ff", "fi", "fl", "ffi", "ffl", "st", "st"])]
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
#: What shows nothing: fillers and joiners, ASCII control characters but white space, by their Unicode category format characters (the signs
#: put before Arabic and Syriac numbers do show), variation selectors, and the tags and selectors beyond the first plane.
INVISIBLE = "".join(
    dict.fromkeys(
        [chr(c) for c in [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]]
        + [chr(c) for c in (*range(9), *range(0xE, 0x20), 0x7F)]
        + [chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2)]
        + [chr(c) for c in (*range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0))]
    )
)
MARKS = r"\u0300-\u036F\u3099\u309A"


def ranges(chars: str) -> str:
    """The inside of a character class for Java; code points side by side make one range."""
    codes, found = sorted(map(ord, set(chars))), []
    for c in codes:
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{z:X}}}" if z > a else "") for a, z in found)


def _mathematical() -> list[tuple[str, str]]:
    """Letters and digits of the mathematical alphabets, which Unicode itself says are font variants of plain ones."""
    found = []
    for c in [*range(0x2100, 0x2140), *range(0x1D400, 0x1D800)]:
        kind, _, plain = unicodedata.decomposition(chr(c)).partition(" ")
        if kind == "<font>" and " " not in plain and int(plain, 16) < 0x80:
            found.append((chr(c), chr(int(plain, 16))))
    return found


@lru_cache
def mapping() -> tuple[str, str]:
    """The characters that are mapped and, in the same order, what they are mapped to; what has no partner is dropped."""
    pairs = [(other, plain) for plain, others in LOOKALIKES for other in others]
    pairs += [(chr(c + 0xFEE0), chr(c)) for c in range(0x21, 0x7F)]
    pairs += [(other, plain) for plain, other in (*CHEROKEE, *LISU)] + _mathematical()
    # ideographs that are canonically others, as the hash has to know them
    pairs += [(chr(c), unicodedata.normalize("NFC", chr(c))) for c in (*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)) if unicodedata.decomposition(chr(c))]
    pairs += [(s, " ") for s in SPACES]
    return "".join(a for a, _ in pairs) + INVISIBLE, "".join(b for _, b in pairs)


#: Most texts with rivals whose hashes are broadcast.
MAX_BROADCAST = 1_000_000
#: What is not printable ASCII, tab or line end.
SPECIAL = r"[^\t\n\r\x20-\x7E]"
_FORMS = mapping()[0] + "".join(a for a, _ in LIGATURES)
_TO = str.maketrans(*(x[: len(mapping()[1])] for x in mapping()), mapping()[0][len(mapping()[1]) :]) | str.maketrans(dict(LIGATURES))
#: Any character that may be mapped; beyond the first plane a set of single ones would be tried one by one.
_MAPPED = re.compile("[" + re.escape("".join(c for c in _FORMS if c < "\U00010000")) + "\U00010000-\U0010FFFF]")
#: Signs of another spelling: letters of two scripts side by side, and forms that have a plainer one.
ODD = rf"[A-Za-z][\u0370-\u04FF]|[\u0370-\u04FF][A-Za-z]|[{MARKS}\u0261\u2010\u2011{ranges(INVISIBLE + SPACES + ''.join(c for c in _FORMS if ord(c) > 0x13A0))}]"


def may_be_mapped(text: str) -> bool:
    return _MAPPED.search(text) is not None


def plain_characters(text: str) -> str:
    """The text with every character in the place of which a plain one is known replaced."""
    return text.translate(_TO)


def shown(text: str) -> str:
    """The text in plain, composed characters."""
    return unicodedata.normalize("NFC", plain_characters(text) if may_be_mapped(text) else text)


@F.udf(T.StringType(), useArrow=True)
def _changed(text: str | None) -> str | None:
    """``shown``, where it is another string."""
    if text is None:
        return None
    plain = shown(text)
    return None if plain == text else plain


def plain_form(text: Column) -> Column:
    """The consistent form of a text: what a reader sees, in plain, composed characters, without spaces at the ends of text and lines.

    Texts of printable ASCII, and those that are plain already, don't come back from Python.
    """
    plain = F.coalesce(_changed(F.when(text.rlike(SPECIAL), text)), text)
    plain = F.btrim(F.replace(F.replace(plain, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" \t\n"))
    return F.when(plain.rlike(r"[ \t]\n"), F.regexp_replace(plain, r"[ \t]+\n", "\n")).otherwise(plain)


def lookalike_members(df: DataFrame, text: str = "text") -> DataFrame:
    """(the columns of ``df``, class_id, canonical) of the rows in classes with at least two different texts.

    ``df`` has one text of a record in each row; rows that are equal count once. It is scanned twice.
    """
    raw = F.xxhash64(text, F.lit(7)).alias("_raw")
    # the condition comes after the writing, else it would compute the hash once more
    seen = written(df.where(F.col(text).isNotNull()).select(raw, F.xxhash64(plain_form(F.col(text))).alias("_hash")), "lookalike-hashes").where(F.col("_hash") != F.xxhash64(F.lit("")))
    mixed = seen.groupBy("_hash").agg(F.min("_raw").alias("_low"), F.max("_raw").alias("_high")).where("_low <> _high").select("_hash")
    wanted = written(seen.join(mixed, "_hash", "left_semi").distinct(), "lookalike-wanted")
    # hashes of two long integers; beyond the bound the texts are joined by a shuffle
    few = wanted.count() <= MAX_BROADCAST
    rivals = df.withColumn("_raw", raw).join(F.broadcast(wanted) if few else wanted.hint("merge"), "_raw")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rivals = rivals.repartition(parts, "_raw").dropDuplicates(df.columns)
    rivals = rivals.withColumn("_plain", plain_form(F.col(text))).withColumn("_odd", F.when(F.col(text).rlike(SPECIAL), F.regexp_count(text, F.lit(ODD))).otherwise(F.lit(0)))
    return classes(written(rivals, "lookalike-composed"), text).drop("_hash")


def classes(rivals: DataFrame, text: str) -> DataFrame:
    """The SQL part: classes under the collation, their canonical members, and the join back."""
    spark = rivals.sparkSession
    grouped = spark.sql(
        f"""
        SELECT _hash, _plain COLLATE UNICODE AS _class, _plain AS _composed, min(struct(_odd AS odd, `{text}` AS member)) AS _canonical
        FROM {{rivals}}
        GROUP BY _hash, _plain COLLATE UNICODE, _plain
        HAVING min(_raw) <> max(_raw)
        """,
        rivals=rivals,
    )
    return spark.sql(
        f"""
        SELECT r.*, xxhash64(c._composed, 11) AS class_id, c._canonical.member AS canonical
        FROM {{rivals}} r JOIN {{grouped}} c ON r._hash = c._hash AND r._plain COLLATE UNICODE = c._class AND r._plain = c._composed
        """,
        rivals=rivals,
        grouped=grouped,
    ).drop("_plain", "_odd")
