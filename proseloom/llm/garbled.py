"""Text that was decoded with the wrong character encoding.

From every distinct clean word of the corpus, and from every distinct character beyond ASCII, the forms are generated that
it takes when it is encoded in one encoding and decoded in another, under all chains below: UTF-8 read in each of WIDE, that read once
more in each of WIDE, one byte a character under NARROW, and LOSSY ones. The tokens of the records are joined by hash with that
table; what joins is garbled, and the original of the joined row, which by construction gives exactly that garbled form
again, takes its place.

Tokens. A word is a run of ASCII letters and characters beyond ASCII with at least one of the latter; kana and ideographs, which
stand beside each other without blanks, part it. A unit is what a wrong decoding makes of one character of UTF-8: a lead
character and its continuations; units stand for themselves, inside words too, since a passage can be garbled in part.
Two to four adjoining units are one more token each (what a character of two to four bytes turns into when it is garbled twice).

Evidence. A unit is garbled if the corpus has its original UNIT_RATIO times as often as the unit. A word is garbled if its
original is RATIO times as frequent in the corpus as it is itself, so that real words which happen to be what another word
would turn into stay. Where another token of the field is garbled by the same chain, SAME_RATIO times is enough, unless
the original may be garbled itself. A single sign counts as garbled only for a dash, quotation mark, bullet or ellipsis.
U+FFFD and C1 control characters are always the trace of a wrong decoding; where no form joins they have no original, and the
result says so (``traces``).

Only what is displayed counts: tags, comments, styles and scripts of HTML don't, and character references are what
they stand for. Defined results: null, empty and plain ASCII fields are sound; a field is restored in part where only part
of it can be, and all else in it stays byte for byte; rows delivered again give the same result once; a token with two originals gets
that of the longer kind of token, then the more frequent one.
"""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.session import written

RATIO, UNIT_RATIO, SAME_RATIO = 10, 3, 1
#: Kinds of tokens.
CHAR, WHOLE, UNIT = 0, 1, 2
#: Decodings that turn the bytes of UTF-8 into several characters each.
WIDE = ["latin-1", "windows-1252", "mac_roman", "cp1251", "cp437", "cp850", "koi8_r", "cp1250"]
LATIN, CYRILLIC = ["windows-1252", "cp437", "cp850", "mac_roman"], ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"]
#: (encoding, wrong decoding) of one byte a character.
NARROW = [
    *((a, b) for a in LATIN for b in [*LATIN, "latin-1", "cp1251", "koi8_r", "cp1250"] if a != b),
    *((a, b) for a in CYRILLIC for b in [*CYRILLIC, "latin-1", "windows-1252", "mac_roman", "cp437"] if a != b),
]
LOSSY = [("windows-1252", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8"), ("utf-8", "ascii"), ("utf-8", "cp1252")]
#: A character for each chain: one wrong decoding of UTF-8, two of them, one byte a character, and those that lose bytes.
CHAINS = {c: chr(0x100 + i) for i, c in enumerate([*((d,) for d in WIDE), *((d, e) for d in WIDE for e in WIDE), *(("narrow", *c) for c in NARROW), *(("lossy", *c) for c in LOSSY)])}
HIDDEN = re.compile(r"<!--.*?-->|<(style|script|template|title)\b.*?</\1\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE)
WORD = re.compile(r"[A-Za-z]*[^\x00-\x7F][A-Za-z\x80-\U0010FFFF]*")
CJK, OTHER = re.compile(r"[぀-ヿ㐀-鿿]"), re.compile(r"[^぀-ヿ㐀-鿿]+")
#: Signs that stand alone between words.
SIGN_CHAINS = {("windows-1252", "cp437"), ("windows-1252", "cp850")}
MARKS = set(map(chr, [0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2026]))
#: Character references, as html.unescape reads them.
REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[^\t\n\f <&#;]{1,32};?)")
#: Tasks that the rows of one token are dealt to.
SALT = 8
TRACE = re.compile(r"[\uFFFD\x80-\x84\x86-\x9F]")


def _page(encoding: str) -> str:
    """What each byte is in a one-byte encoding; as browsers do it, bytes that Windows-1252 leaves open become C1 control characters."""
    if encoding == "windows-1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
    return bytes(range(256)).decode(encoding, "replace")


PAGES = {d: _page(d) for d in {*WIDE, *LATIN, *CYRILLIC}}
#: How to write them; what is U+FFFD in a page can't be written.
_BYTES = {d: codecs.charmap_build(page.replace("\uFFFD", "\uFFFE")) for d, page in PAGES.items()}


def encode(text: str, encoding: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _BYTES[encoding])[0] if encoding in PAGES else text.encode(encoding)
    except UnicodeEncodeError:
        return None


def decode(data: bytes, encoding: str) -> str:
    return codecs.charmap_decode(data, "strict", PAGES[encoding])[0] if encoding in PAGES else data.decode(encoding, "replace")


def _units() -> list[re.Pattern[str]]:
    found = []
    for d in WIDE:
        group = lambda a, b, page=PAGES[d]: "[" + re.escape(page[a:b].replace("\uFFFD", "")) + "]"
        # strict readers of Windows-1252 lose five of the continuations
        cont = group(0x80, 0xC0)[:-1] + ("\uFFFD]" if d == "windows-1252" else "]")
        found.append(f"{group(0xC2, 0xE0)}{cont}|{group(0xE0, 0xF0)}{cont}{{2}}|{group(0xF0, 0xF5)}{cont}{{3}}")
    return [re.compile(x) for x in found]


UNITS = _units()
_ROWS = [re.compile(f"(?:{u.pattern})+") for u in UNITS]
#: A character has two to four bytes, so it takes as many units when it is garbled twice.
ROW_UNITS = (4, 3, 2, 1)


def visible(text: str | None, markup: bool) -> str:
    if not text or not markup:
        return text or ""
    return html.unescape(HIDDEN.sub(" ", text))


def words_of(text: str) -> Iterator[tuple[int, str]]:
    """The words of a displayed text with their places."""
    for m in WORD.finditer(text):
        if not CJK.search(m.group()):
            yield m.start(), m.group()
            continue
        for part in OTHER.finditer(m.group()):
            if not part.group().isascii():
                yield m.start() + part.start(), part.group()


def unit_rows(word: str) -> Iterator[list[tuple[int, int]]]:
    """The rows of adjoining units of a word, as the places of their units, by each wrong decoding."""
    for unit, row in zip(UNITS, _ROWS):
        for m in row.finditer(word):
            yield [u.span() for u in unit.finditer(word, m.start(), m.end())]


@lru_cache(maxsize=100_000)
def _of_word(word: str) -> tuple[tuple[str, int], ...]:
    found = {(word, WHOLE)}
    for row in unit_rows(word):
        for n in ROW_UNITS:
            found.update((word[row[i][0] : row[i + n - 1][1]], UNIT) for i in range(len(row) - n + 1))
    return tuple(found)


def tokens(text: str) -> set[tuple[str, int]]:
    """The characters beyond ASCII, the words, and the units and short rows of units of a displayed text, with their kinds."""
    if text.isascii():
        return set()
    return {(c, CHAR) for c in set(text) if c > "\x7F"} | {t for word in {w for _, w in words_of(text)} for t in _of_word(word)}


def forms(word: str, kind: int) -> Iterator[tuple[str, int, str]]:
    """What a character or a word turns into under all chains, with the kind of token that has to be looked for and the chains."""
    made: dict[str, str] = {}
    data = word.encode()
    for d in WIDE:
        form = decode(data, d)
        made[form] = made.get(form, "") + CHAINS[d,]
        again = form.encode()
        for e in WIDE:
            twice = decode(again, e)
            made[twice] = made.get(twice, "") + CHAINS[d, e]
    if kind == CHAR:
        # of the readings that lose bytes only that one is so common that a single character is guessed from it
        made = {form: chains for form, chains in made.items() if "\uFFFD" not in form}
        strict = data.decode("cp1252", "replace")
        if "\uFFFD" in strict[1:]:
            made[strict] = CHAINS["lossy", "utf-8", "cp1252"]
        yield from ((form, UNIT, chains) for form, chains in made.items())
        return
    bytes_of = {a: encode(word, a) for a in {a for a, _ in (*NARROW, *LOSSY)}}
    for a, b in NARROW:
        if bytes_of[a] and (len(word) > 1 or (a, b) in SIGN_CHAINS):
            form = decode(bytes_of[a], b)
            made[form] = made.get(form, "") + CHAINS["narrow", a, b]
    for a, b in LOSSY:
        if bytes_of[a]:
            form = bytes_of[a].decode(b, "replace")
            made[form] = made.get(form, "") + CHAINS["lossy", a, b]
    # alone, a letter or sign may stand for itself
    yield from ((form, WHOLE, chains) for form, chains in made.items() if form != word and (len(form) > 1 or word in MARKS))


def field_tokens(df: DataFrame, key: str, fields: list[tuple[str, bool]]) -> DataFrame:
    """(key, field_name, token, kind) of every distinct token of every field; fields are (name, markup)."""
    of = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, found, kinds = [], [], [], []
            for j, (name, markup) in enumerate(fields):
                for i, text in enumerate(batch.column(j + 1).to_pylist()):
                    if text is None or (text.isascii() and not (markup and "&" in text)):
                        continue
                    for token, kind in tokens(visible(text, markup)):
                        at.append(i)
                        names.append(name)
                        found.append(token)
                        kinds.append(kind)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(found, pa.string()), pa.array(kinds, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "field_name", "token", "kind"])

    chosen = df.select(key, *[name for name, _ in fields])
    return chosen.mapInArrow(run, f"{key} {of}, field_name string, token string, kind int")


def garbled_table(found: DataFrame) -> DataFrame:
    """(token, kind, original, n_original, chains, sure) of the tokens among those of ``found`` that are or may be garbled.

    ``original`` is null for mere traces. A token is sure once, or has a row for each original that is enough by SAME_RATIO only.
    """

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (form, form_kind, word, n, chains)
                for word, kind, n in zip(*(batch.column(i).to_pylist() for i in range(3)))
                if not TRACE.search(word)
                for form, form_kind, chains in forms(word, kind)
            ]
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["token", "kind", "original", "n_original", "chains"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = written(found.groupBy("token", "kind").agg(F.count("*").alias("n")), "garbled-words")
    # a word makes some hundred forms: the words are dealt to all tasks, however small their table is
    dealt = words.where(F.col("kind") != UNIT).repartition(parts, "token", "kind")
    made = dealt.mapInArrow(generate, "token string, kind int, original string, n_original long, chains string")
    joined = words.hint("merge").join(made, ["token", "kind"]).withColumn("sure", F.expr(f"n_original >= n * CASE WHEN kind = {UNIT} THEN {UNIT_RATIO} ELSE {RATIO} END"))
    joined = written(joined.where(f"sure OR (kind = {WHOLE} AND n_original >= n * {SAME_RATIO})"), "garbled-pairs")
    best = joined.where("sure").groupBy("token", "kind").agg(F.max(F.struct("n_original", "original", "chains")).alias("b")).select("token", "kind", "b.original", "b.n_original", "b.chains", F.lit(True).alias("sure"))
    known = best.where(f"kind = {WHOLE}").select("token", "kind")
    maybe = joined.where(f"kind = {WHOLE} AND n_original > n").select(F.col("token").alias("original")).distinct()
    near = joined.where("NOT sure").join(known, ["token", "kind"], "left_anti").join(maybe, "original", "left_anti")
    traces = words.where(F.col("token").rlike(TRACE.pattern)).where(F.col("kind") == CHAR).select("token", "kind", *(F.lit(None).cast(t).alias(c) for c, t in (("original", "string"), ("n_original", "long"), ("chains", "string"))), F.lit(True).alias("sure"))
    return best.unionByName(traces).unionByName(near.select(*best.columns))


def garbled_tokens(df: DataFrame, key: str, fields: list[tuple[str, bool]]) -> DataFrame:
    """(key, field_name, token, kind, original) of the garbled tokens of every record; ``original`` is null for mere traces."""
    found = written(field_tokens(df, key, fields), "garbled-tokens")
    # a garbled sign may stand in a third of all records: its rows are dealt to SALT tasks
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"))
    known = garbled_table(found).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = written(salted.join(known, ["token", "kind", "_salt"]).drop("_salt"), "garbled-hits")
    sure, field = hits.where("sure"), [key, "field_name"]
    chain = F.explode(F.filter(F.split("chains", ""), lambda c: c != "")).alias("chain")
    near = hits.where("NOT sure").select(*field, "token", "kind", "original", "n_original", chain).join(sure.select(*field, chain).distinct(), [*field, "chain"])
    near = near.groupBy(*field, "token", "kind").agg(F.max(F.struct("n_original", "original")).alias("b"))
    return sure.select(*field, "token", "kind", "original").unionByName(near.select(*field, "token", "kind", F.col("b.original").alias("original")))


def edits(text: str, pairs: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, new) for the garbled tokens of a displayed text: rows of units, longest first, and units; else the word."""
    for at, word in words_of(text):
        taken: list[tuple[int, int, str]] = []
        for n in ROW_UNITS:
            for row in unit_rows(word):
                i = 0
                while i + n <= len(row):
                    a, z = row[i][0], row[i + n - 1][1]
                    new = pairs.get(word[a:z])
                    if new is not None and all(z <= x or y <= a for x, y, _ in taken):
                        taken.append((a, z, new))
                        i += n
                    else:
                        i += 1
        if not taken and word in pairs:
            taken = [(0, len(word), pairs[word])]
        yield from ((at + a, at + z, new) for a, z, new in sorted(taken))


def restore_text(text: str, pairs: dict[str, str], markup: bool) -> str:
    """``text`` with its garbled tokens replaced; all else stays as it is, character references of markup included."""
    if not markup:
        stretches = [(0, len(text))]
    else:
        bounds = [0, *(x for m in HIDDEN.finditer(text) for x in m.span()), len(text)]
        stretches = list(zip(bounds[::2], bounds[1::2]))
    out, last = [], 0
    for begin, end in stretches:
        shown, place = (text[begin:end], None) if not markup else _shown(text[begin:end])
        for a, z, new in edits(shown, pairs):
            x, y = (a, z) if place is None else (place[a], place[z])
            if place is not None and (a and place[a - 1] == x or y == place[z - 1]):
                continue  # a part of what one reference stands for
            out += [text[last : begin + x], html.escape(new, quote=False) if markup else new]
            last = begin + y
    return "".join([*out, text[last:]])


def _shown(text: str) -> tuple[str, list[int] | None]:
    """Markup without tags as displayed, and for each displayed character where it begins; one place more for the end."""
    if "&" not in text:
        return text, None
    out, place, last = [], [], 0
    for m in REFERENCE.finditer(text):
        out += text[last : m.start()]
        place += range(last, m.start())
        shown = html.unescape(m.group())
        out += shown
        place += [m.start()] * len(shown)
        last = m.end()
    out += text[last:]
    return "".join(out), [*place, *range(last, len(text) + 1)]


def restored(df: DataFrame, found: DataFrame, key: str, fields: list[tuple[str, bool]]) -> DataFrame:
    """(key, field_name, restored, n_garbled, n_restored, n_traces) of every affected field; ``n_traces`` tokens have no original."""
    one = found.groupBy(key, "field_name", "token").agg(F.max(F.struct("kind", "original")).alias("b")).select(key, "field_name", "token", "b.original")
    pairs = one.groupBy(key, "field_name").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("token", "original")))).alias("pairs"),
        F.count("*").alias("n_garbled"), F.count_if(F.col("original").isNull()).alias("n_traces"),
    )
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("value"), F.lit(m).alias("markup")) for n, m in fields])).alias("f"))
    hit = long.select(key, "f.*").where("value IS NOT NULL").join(pairs, [key, "field_name"]).dropDuplicates([key, "field_name"])

    @F.pandas_udf("string")
    def apply(values, maps, markups):
        return values.combine(maps, lambda v, m: (v, dict(m))).combine(markups, lambda x, k: restore_text(x[0], x[1], k))

    return hit.select(key, "field_name", apply("value", "pairs", "markup").alias("restored"), "n_garbled", F.size("pairs").cast("long").alias("n_restored"), "n_traces")
