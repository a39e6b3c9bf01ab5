"""Personal information inside free text: candidates, boosted trees, calibrated thresholds.

1. Generators with high recall propose spans, which may overlap: email addresses (obfuscated ones as well), phone numbers and
   identity numbers (every run of digit groups, with and without letters at its ends), street addresses in several orders,
   names (every pair of capitalised words of any alphabet that has capitals, with titles, initials, particles, apostrophes,
   hyphens and inner capitals, or all in capitals, and "surname, given name"). They read a view of the text in which
   full-width and look-alike characters are plain and invisible ones are gone; spans are kept in the offsets of the text itself.
2. Boosted trees, one model for each kind, score a candidate by its format (groups of digits and their lengths, separators,
   letters, key words) and its context (cue words before it, characters around it; LEFT, NEAR, RIGHT characters). They are
   fitted to generated examples: formats of public numbering plans and address styles against look-alikes such as dates,
   prices, versions, references and titles. Name candidates have four features more, from the corpus itself, for their first and
   last word: in how many email addresses found in it the word stands, and how often it stands there in small letters.
3. Thresholds come from held-out examples. The best candidate wins where spans overlap, an email before anything else.

The model depends on no data and is fitted once a process. Bounds: an email's local part has at most 64 characters, as its
standard says; a phone or identity number at most LONGEST_NUMBER. Names of alphabets without capitals are not proposed.

Defined results: null and empty texts hold nothing; an array's null items hold nothing; rows that come twice give one result;
everything outside the placeholders stays as it is, byte for byte.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.llm.boost import Boost, best_cut
from proseloom.llm.lookalike import LIGATURES, mapping, may_be_mapped
from proseloom.session import written

KINDS = ["email", "phone", "id_number", "address", "name"]
_SOURCE, _TARGET = mapping()
_ONE = {ord(c): _TARGET[i] for i, c in enumerate(_SOURCE[: len(_TARGET)])} | {0x2019: "'", 0x3001: ",", 0x3002: "."}
_DROP = dict.fromkeys(map(ord, _SOURCE[len(_TARGET) :])) | {ord(a): b for a, b in LIGATURES}
# beyond the first plane a set of single characters would be tried one by one
_ODD = re.compile("[" + re.escape("".join(chr(c) for c in _DROP if c < 0x10000)) + "\U00010000-\U0010FFFF]")



def _letters(*categories: str) -> str:
    """The inside of a character class of the letters of some Unicode categories."""
    codes = [c for c in range(0x10000) if unicodedata.category(chr(c)) in categories]
    ends = [(a, b) for a, b in zip([None, *codes], codes) if a is None or b != a + 1]
    starts = [b for _, b in ends]
    stops = [a for a, _ in ends[1:]] + [codes[-1]]
    return "".join(chr(x) if x == y else f"{chr(x)}-{chr(y)}" for x, y in zip(starts, stops))


_UP, _LOW = _letters("Lu", "Lt"), _letters("Ll")
# Kana, ideographs and Hangul may stand directly beside an item, and so may the full stops and commas after them, which a
# view shows as plain ones; every other letter or digit (_IN) goes on with a word.
_CJK = "々-〇ぁ-ヿ㐀-䶿一-鿿豈-﫿가-힣ｦ-ﾟ\U00020000-\U0003FFFF"
_IN = "_" + "".join(f"{m[0]}-{m[-1]}" for m in re.findall(rf"(?:(?![{_CJK}])[^\W_])+", "".join(chr(c) for c in range(0x10000)))) + "\U00010000-\U0001FFFF"
_GLUED = re.compile(f"[{_CJK}]")
_after = lambda signs: rf"(?:(?<![{_IN}{signs}])|(?<=[{_CJK}][.,]))"
_WORD = rf"[{_UP}][{_LOW}]+"
#: A word of a name: O'Brien, McDonald, Anne-Marie.
_PART = rf"[{_UP}](?:'[{_UP}])?[{_LOW}]+(?:[{_UP}][{_LOW}]+)?"
_PART = rf"{_PART}(?:-{_PART})?"
_PARTICLE = r"(?:(?:(?:van|von)\s(?:der|den|dem)|de\s(?:la|los|las)|van|von|zu|de|da|di|del|della|dos|du|ter|bin|al)\s)?"
_UNIT = rf"(?:Flat|Apt|Apartment|Unit|Suite|Room|Floor)\.?\s[{_IN}]{{1,5}}"
_CITY = rf"[{_UP}][{_LOW}]+(?:[ -][{_UP}][{_LOW}]+)?"
EMAIL = re.compile(
    _after(".+-") + rf"[A-Za-z0-9][{_IN}.+-]{{0,63}}" + r"\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[A-Za-z0-9-]+)*", re.IGNORECASE
)
_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]", re.IGNORECASE)
DIGITS = re.compile(_after(".,/-") + r"([A-Z]{1,2}[ -]?)?(\+?\(?\d(?:(?!\.\s|\s\d{4}-\d\d-|\s\d{1,2}/\d)[\d ().\-/]){4,24}\d)([ -]?[A-Z]" + rf"(?![{_IN}])" + r")?((?:,?\s?(?:ext\.?|x|Durchwahl|poste)\s?)\d{1,5})?")
ADDRESS = [
    re.compile(
        rf"(?<![{_IN}])(?:{_UNIT},\s)?\d{{1,5}},?\s(?:(?:[NSEW]\.?|rue|de|la|le|du|des|via|rua|calle|avenue|place)\s){{0,3}}{_WORD}(?:[ \t]{_WORD})?(?:[ \t][{_UP}][a-z]+\.?)?"
        rf"(?:[,\n]\s?{_UNIT})?(?:[,.]?\s?[,\n]\s?{_CITY}(?:,?\s(?:[A-Z]{{1,2}}\d[A-Z\d]?\s\d[A-Z]{{2}}|[A-Z]{{2}}\s\d{{5}}|\d{{4,5}}))?)?"
    ),
    re.compile(
        rf"(?<![{_IN}])(?:Calle|Via|Viale|Rua|Avenida|Av\.|Plaza|Piazza|Rue|Corso|ul\.|Praça)\s(?:(?:de|da|do|dos|del|della|la)\s){{0,2}}{_WORD}(?:\s{_WORD})?,?\s\d{{1,5}}"
        rf"(?:,\s\d{{1,2}}\.?[ºª°]\s?[{_IN}]*)?(?:,\s(?:\d{{4,5}}\s)?{_CITY})?"
    ),
    re.compile(rf"(?<![{_IN}])[{_UP}][{_LOW}]+(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer)\s\d{{1,4}}[a-z]?(?:,?\s\d{{4,5}}\s{_CITY})?"),
]
_TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Sr|Sra|Sig|Dott|Mme|M)\.?\s)?"
_TITLED = re.compile(_TITLE + "$")
NAME = [
    re.compile(_after(".@+-") + rf"(?=({_TITLE}(?:{_PART}|[{_UP}]\.)(?:\s[{_UP}]\.)?\s{_PARTICLE}{_PART})(?![{_IN}@]))"),
    re.compile(_after(".@+-") + rf"(?=({_PART},\s{_PART})(?![{_IN}@]))"),
    re.compile(_after(".@+-") + rf"(?=({_TITLE}[{_UP}]{{2,}}(?:\s[{_UP}]\.)?\s[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})?)(?![{_IN}@]))"),
]

# Cue words and key words of the languages at hand.
CUES = {
    "email": r"e-?mail|mail|write to|reply to|cc|contact|forward|correo|escrib|écri|scriv|antwort|пишите|почт|連絡|宛",
    "phone": r"tel|phone|mobile|cell|call|text|fax|pager|sms|ring|handy|anruf|llam|appel|chiam|ligue|móvil|móv|тел|звон|電話|reach|desk on|hotline|whatsapp|extension|numéro",
    "id_number": r"passport|identity|identi\w+|insurance|social security|ssn|personal id|tax|licen[cs]e|ausweis|documento|dni|nif|cpf|codice fiscale|identité|identificação|identità|identificaci|паспорт|удостовер|снилс|身分|番号|\bid\b",
    "address": r"address|live|lives|moved|deliver|ship|parcel|keys|street|adresse|anschrift|wohn|direcci|morada|endereço|indirizzo|адрес|住所|office at|house|visit",
    "name": r"name|signed|regards|sincerely|ask|met|dear|mr|mrs|from|by|contact|grüßen|cordialement|saludos|cumprimentos|saluti|уважением|担当|attn|author|called|thanks|hi|hello|señor|herr|frau|doctor|colleague|patient",
}
_CUES = {k: re.compile(rf"(?:{v})", re.IGNORECASE) for k, v in CUES.items()}
REFERENCE = re.compile(r"order|invoice|ticket|batch|serial|version|build|node|port|slot|pack|page|case|ref|item|sku|model|no\. of|release|line|step|room|shelf|bestell|rechnung|factur|pedido|commande|ordine|заказ|注文|log", re.IGNORECASE)
STREET = re.compile(r"(?:\b(?:street|st|road|rd|avenue|ave|blvd|boulevard|lane|ln|drive|dr|court|ct|way|square|sq|close|row|terrace|rue|calle|via|viale|rua|avenida|av|plaza|piazza|corso|praça)\b|straße|strasse|str\.|weg\b|platz\b|allee\b|gasse\b|ufer\b)", re.IGNORECASE)
MONTH = re.compile(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b", re.IGNORECASE)
MONEY = re.compile(r"\b(?:USD|EUR|GBP|CHF|JPY)\b|[$€£¥]")
POSTAL = re.compile(r"\b[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}\b|\b[A-Z]{2}\s\d{5}\b|\b\d{5}\s[A-Z]")
COMMON = frozenset(
    "the a an this that these those our my your his her their its we i you he she it they each every no in on at by for to of and or but if as from with when while after before "
    "all any some several most both one two first second third last next new old monday tuesday wednesday thursday friday saturday sunday january february march april may june july "
    "august september october november december der die das ein eine einer dieser diese dieses jeder jede jedes unser unsere mein le la les un une des du ce cette ces notre chaque el los las una "
    "este esta cada nuestro nuestra o os as um uma nosso nossa il lo gli i questo questa ogni nostro call text reply ask see use send contact mr mrs dr prof questions please last "
    "street road avenue river lake mount north south east west united states этот эта это эти наш наша мой каждый каждая все новый".split()
)
DATE = re.compile(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})$")
#: Characters of context that are read: on the left, next to the candidate on the left, and on the right; digits and separators of a number.
LEFT, NEAR, RIGHT, LONGEST_NUMBER = 28, 16, 12, 26
#: Features of a candidate's own, and those of its words' counts in the corpus, which are at most COUNTED.
OWN, COUNTS, COUNTED = 46, 4, 60.0


def view(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and for each of them its offset in ``text`` (None: the same)."""
    if text.isascii():
        return text, None
    if not may_be_mapped(text):
        return text.replace("\u2019", "'").replace("\u3001", ",").replace("\u3002", "."), None
    if not _ODD.search(text):
        return text.translate(_ONE), None
    out, at = [], []
    for i, c in enumerate(text):
        plain = (_DROP[ord(c)] or "") if ord(c) in _DROP else _ONE.get(ord(c), c)
        out.append(plain)
        at += [i] * len(plain)
    return "".join(out), [*at, len(text)]


COMMON = frozenset(view(w)[0] for w in COMMON)


#: Where an item may begin; the patterns themselves are only tried there.
# the set comes first, which lets a search skip; what stands before is looked at from behind it
_CAPITAL, _NUMBER, _HOUSE = re.compile(f"[{_UP}](?<![0-9A-Za-z_@+-].)"), re.compile(r"[A-Z+(\d](?<![0-9A-Za-z_].)", re.DOTALL), re.compile(r"[\dFAUSR](?<![0-9A-Za-z_].)", re.DOTALL)
_STREETS = re.compile(r"Calle|Via|Viale|Rua|Avenida|Av\.|Plaza|Piazza|Rue|Corso|ul\.|Praça")
_GERMAN = re.compile(r"straße|strasse|str\.|weg|platz|allee|gasse|ufer")


def _each(pattern: re.Pattern[str], start: re.Pattern[str], plain: str) -> Iterator[re.Match[str]]:
    """As ``pattern.finditer``, for a pattern that can only match where ``start`` does."""
    done = 0
    for m in start.finditer(plain):
        if m.start() >= done and (found := pattern.match(plain, m.start())):
            yield found
            done = found.end()


def propose(plain: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every candidate."""
    if _AT.search(plain):
        for m in EMAIL.finditer(plain):
            yield "email", m.start(), m.end()
    for m in _each(DIGITS, _NUMBER, plain):
        if sum(c.isdigit() for c in m.group(2)) < 6:
            continue
        a, z = m.span(2)
        for kind in ("phone", "id_number"):
            yield kind, a, z
            if m.group(1) or m.group(3):
                yield kind, m.start() if m.group(1) else a, m.end(3) if m.group(3) else z
        if m.group(4):
            yield "phone", a, m.end()
    for pattern, start in zip(ADDRESS, (_HOUSE, _STREETS, _CAPITAL if _GERMAN.search(plain) else None)):
        if start is not None:
            for m in _each(pattern, start, plain):
                yield "address", m.start(), m.end()
    for c in _CAPITAL.finditer(plain):
        for pattern in NAME:
            if m := pattern.match(plain, c.start()):
                yield "name", m.start(1), m.end(1)


def _class(c: str) -> int:
    return 0 if not c else 7 if _GLUED.match(c) else 1 if c.isalnum() else 2 if c.isspace() else 3 if c in ".,;:!?)" else 4 if c in "([\"'" else 5 if c in "-/_#" else 6


def words_of(value: str) -> tuple[str, str]:
    """The first and the last word of a name, in lower case; titles don't count."""
    value = re.sub(rf"^{_TITLE}", "", value)
    parts = [p for p in re.split(r"[\s,]+", value) if p]
    return (parts[0].rstrip(".").lower(), parts[-1].lower()) if parts else ("", "")


def _shared(plain: str, a: int, z: int) -> dict:
    """What the features of a span are made of, whatever kind it is a candidate of."""
    value, left, right = plain[a:z], plain[max(0, a - LEFT) : a], plain[z : z + RIGHT]
    near, before = left[-NEAR:], left.rstrip()
    groups = [len(g) for g in re.findall(r"\d+", value)]
    digits, words = sum(groups), value.split()
    upper = sum(map(str.isupper, value))
    format = [
        len(value), digits, sum(map(str.isalpha, value)), upper, len(groups), max(groups, default=0), *(groups + [0] * 6)[:6],
        value.startswith("+"), "(" in value, value.count("-"), value.count("."), value.count(" "), value.count("/"), "ext" in value or "x" in value[-6:],
    ]
    ends = [value[-1:].isalpha() and digits > 0, bool(DATE.match(value)), value[:1] == "0"]
    around = [
        _class(left[-1:]), _class(right[:1]), before[-1:] in (":", ","), bool(before), bool(right.strip()),
        bool(STREET.search(value)), bool(MONTH.search(value)), bool(MONEY.search(value)) or bool(MONEY.search(right[:5])) or before[-1:] in ("$", "€", "£"), bool(POSTAL.search(value)),
        value.count(","), value.count("\n"), len(words), value[:1].isdigit(),
    ]
    context = near + right
    rest = [bool(re.search(r"\b[A-Z]\.", value)), sum(w.strip(".,").lower() in COMMON for w in words[:4]), sum(map(str.isupper, context)) / (1 + sum(map(str.isalpha, context)))]
    cues = {k: bool(c.search(near)) for k, c in _CUES.items()}
    return {"value": value, "left": left, "words": words, "format": format, "ends": ends, "around": around, "rest": rest, "cues": cues, "reference": bool(REFERENCE.search(near)), "head": re.match(r"[A-Z]*", value).end()}


def measure(plain: str, kind: str, a: int, z: int, known: dict | None = None) -> list[float]:
    """The features of a candidate; the last ones are for the corpus' counts of a name's words.

    ``known`` keeps what candidates of one span of a text have in common.
    """
    known = {} if known is None else known
    s = known.get((a, z))
    if s is None:
        s = known[a, z] = _shared(plain, a, z)
    domain = re.split(r"@|at[)\]}]", s["value"], maxsplit=1, flags=re.IGNORECASE)[-1] if kind == "email" else ""
    title = kind == "name" and bool(s["words"]) and bool(_TITLED.match(s["words"][0] + " "))
    out = [
        *s["format"], 0 if kind == "name" else s["head"], *s["ends"],
        bool(_CUES[kind].search(s["left"])), s["cues"][kind], sum(s["cues"].values()) - s["cues"][kind], s["reference"], *s["around"],
        len(re.findall(r"\.|dot", domain, re.IGNORECASE)) if domain else 0, len(domain) - domain.rfind(".") - 1 if domain else 0, title, *s["rest"],
    ]
    if len(out) != OWN:
        raise AssertionError(f"{len(out)} features")
    return [*map(float, out), *[0.0] * COUNTS]


# ---- generated examples -------------------------------------------------------------------------------------------------

_ONSETS, _MIDS, _ENDS = "B D F G H K L M N P R S T V Z Br Tr Gr Sk Th Dr Kl Qu Wh Š Ł Č".split(), "a e i o u ai el or an ir un al er in".split(), "rick ton well son mar dale ini ez ova ard wick sen ley ado eau ier ski ham more hart stone field".split()
_CYRILLIC = "Ба Ве Га Де Жи Зо Ка Ле Ми Но Па Ру Са То Фе Ши".split(), "ла ро ни ви ту ме со ри".split(), "нов ев ин ский на ва ко ян".split()
_CITIES = "ford ton ham mouth bridge wick by dale burg field stadt ville".split()
#: Common words of titles, headings and the like.
_PLAIN = "annual central global local digital public royal green golden modern open final early senior team project budget quarter office plan market system health energy summer guide policy library garden harbour council review summary design station theatre museum bridge valley island park village hotel school college club festival award cup league".split()
_FILL = {
    "before": ["The report was sent on", "It was fixed in", "They agreed on", "We saw", "Il modello usa", "Das Ergebnis war", "Le total est", "El valor es", "Значение", "値は"],
    "after": [" and it worked.", " as planned.", ".", ", which is fine.", " war es.", " en el informe.", " сегодня.", "です。", " A nova versão.", " Das ist gut.", ""],
}


def _one(rng: np.random.Generator, options: list[str]) -> str:
    return options[int(rng.integers(len(options)))]


def _name_word(rng: np.random.Generator, cyrillic: bool = False, ascii: bool = False) -> str:
    if cyrillic:
        return "".join(str(_one(rng, x)) for x in _CYRILLIC)
    w = _one(rng, _ONSETS[:-3] if ascii else _ONSETS) + _one(rng, _MIDS) + (_one(rng, "l n r m s t v k".split()) + _one(rng, _MIDS) if rng.random() < 0.4 else "") + _one(rng, _ENDS if rng.random() < 0.6 else ["a", "o", "e", "in", "ek", "us", "ia"])
    return str(w)


def _d(rng: np.random.Generator, *sizes: int) -> list[str]:
    """Runs of digits."""
    digits = "".join(map(str, rng.integers(0, 10, sum(sizes)).tolist()))
    ends = np.cumsum(sizes).tolist()
    return [digits[z - n : z] for z, n in zip(ends, sizes)]


def _positive(kind: str, rng: np.random.Generator) -> str:
    pick = lambda *x: x[int(rng.integers(len(x)))]
    a, b = _name_word(rng, ascii=kind == "email"), _name_word(rng, ascii=kind == "email")
    if kind == "email":
        local = pick(f"{a}.{b}", f"{a}-{b}", f"{a[0]}{b}", f"{a}_{rng.integers(100)}", f"{b}+list", a).lower()
        domain = pick("mail", "corp", "uni", "desk", a.lower()) + "." + pick("com", "org", "net", "de", "test", "example", "co.uk", "example.com")
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("{at}", "{dot}"), ("(at)", "."))
        out = local + at + domain.replace(".", dot)
        return out.upper() if rng.random() < 0.1 else out
    if kind == "phone":
        x = _d(rng, 3, 3, 4, 4, 6, 2, 2, 2, 2)
        return pick(
            f"+1 {x[0]} {x[1]} {x[2]}", f"+1-{x[0]}-{x[1]}-{x[2]}", f"({x[0]}) {x[1]}-{x[2]}", f"{x[0]}.{x[1]}.{x[2]}", f"{x[0]}-{x[1]}-{x[2]}", f"{x[0]}-{x[1]}-{x[2]} ext. {x[5]}",
            f"+44 20 {x[2]} {x[3]}", f"+44 7{x[0]} {x[4]}", f"07{x[0]} {x[4]}", f"0{x[0]} {x[4]}", f"+33 {rng.integers(1, 10)} {x[5]} {x[6]} {x[7]} {x[8]}", f"0{rng.integers(1, 10)} {x[5]} {x[6]} {x[7]} {x[8]}",
            f"+49 ({rng.integers(30, 90)}) {x[1]}{x[5]}-{x[0]}", f"+49 {rng.integers(30, 90)} {x[4]}{x[5]}", f"0{rng.integers(30, 90)}/{x[4]}", f"+34 6{x[5]} {x[0]} {x[1]}", f"+39 3{x[5]} {x[1]} {x[2]}", f"+7 {x[0]} {x[1]}-{x[5]}-{x[6]}", f"+81 3-{x[2]}-{x[3]}",
        )
    if kind == "id_number":
        x, u = _d(rng, 3, 2, 4, 8, 6, 7, 2, 2, 2, 3, 3), "".join(rng.choice(list("ABCEHKLMPQXYZ"), 3))
        return pick(
            f"{x[0]}-{x[1]}-{x[2]}", f"{x[0]} {x[1]} {x[2]}", f"{x[3]}{u[0]}", f"{x[3]}-{u[0]}", f"{u[:2]}{x[4]}{u[2]}", f"{u[:2]} {x[1]} {x[6]} {x[7]} {u[2]}", f"{u[:2]}{x[5]}", f"{u[0]}{x[3]}", f"{x[0]}.{x[9]}.{x[10]}-{x[8]}", f"{u[0]}{x[5]}{u[1]}",
        )
    city, n = a + str(_one(rng, _CITIES)), rng.integers(1, 999)
    if kind == "address":
        s = pick("Street", "Road", "Ave", "Avenue", "Blvd", "Lane", "Ln", "Drive", "Court", "Way")
        zips, uk = _d(rng, 5)[0], f"{pick('N', 'SW', 'V', 'Q')}{rng.integers(1, 20)} {rng.integers(1, 9)}{pick('ZZ', 'AB', 'XD')}"
        return pick(
            f"{n} {b} {s}, {city}", f"{n} {b} {s}, Apt {rng.integers(40)}, {city}", f"{n} {pick('N', 'S')}. {b} {s}, {city}", f"Flat {rng.integers(1, 60)}, {n} {b} {s}, {city} {uk}", f"{n} {b} {s}.\n{city}, {pick('XA', 'NY', 'ZQ')} {zips}", f"{n} {b} {s}\n{city}, {pick('XA', 'NY', 'ZQ')} {zips}", f"{n} {b} {s}, {city}, {pick('XA', 'NY')} {zips}",
            f"{n}, rue de {b}, {city}", f"{n} rue {b}, {city}", f"Calle {b} {n}, {rng.integers(1, 9)}º B, {city}", f"Via {b} {n}, {city}", f"Rua {b}, {n}", f"{b}straße {n}, {zips} {city}", f"{b}weg {n}, {zips} {city}", f"{n} {b} {s}",
        )
    i = chr(65 + int(rng.integers(26)))
    if rng.random() < 0.1:
        return f"{_name_word(rng, True)} {_name_word(rng, True)}"
    if rng.random() < 0.12:
        return pick(f"{a} O'{b}", f"{a} Mc{b}", f"{a}-{_name_word(rng)} {b}", f"{a} van der {b}", f"{a} de {b}", f"{a.upper()} {b.upper()}")
    return pick(f"{a} {b}", f"{a} {b}", f"{b}, {a}", f"Dr. {a} {b}", f"{i}. {b}", f"{a} {i}. {b}", f"{a} {b}-{_name_word(rng)}", f"Mrs {a} {b}", f"Herr {a} {b}")


def _title(rng: np.random.Generator) -> str:
    """Capitalised words that are no name of a person."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    a, b, word = str(_one(rng, _PLAIN)).title(), str(_one(rng, _PLAIN)).title(), _name_word(rng, rng.random() < 0.1)
    return pick(f"{a} {b}", f"{a} {b}", f"{a} {b}", f"{word} {b}", f"{word} {b}", f"{a}, {b}", f"{a.upper()} {b.upper()}", " ".join(rng.choice(_PLAIN, int(rng.integers(3, 6)))).upper(), f"{word} {a} {b} {word}".upper(), f"{a} {pick('de', 'del', 'di', 'da', 'von', 'du')} {b}", f"{word} {pick('de', 'del', 'di', 'von', 'du')} {a}", f"The {word}", f"Das {word}", f"{pick('Our', 'Each', 'Last', 'Every', 'Unser', 'Die', 'Ein', 'Этот')} {word}", f"{word} {word}ing")


def _negative(rng: np.random.Generator) -> str:
    pick = lambda *x: x[int(rng.integers(len(x)))]
    x = _d(rng, 2, 3, 4, 5, 6, 7, 8, 10, 1)
    y, m, d = rng.integers(1990, 2030), rng.integers(1, 13), rng.integers(1, 29)
    month, word, plain = pick("January", "March", "June", "July", "October", "November"), _name_word(rng), str(_one(rng, _PLAIN))
    code = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), int(rng.integers(2, 5))))
    if rng.random() < 0.3:
        return _title(rng)
    return pick(
        f"{y}-{m:02}-{d:02}", f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{d} {month} {y}", f"{month} {d}", f"{month} {d}, {y}", f"10.{d}.{m}.{x[0]}", f"version {m}.{d}.{x[0]}", f"{code}-{x[2]}", f"{code}-{x[4]}", f"{code}{x[3]}", f"{code}/{x[4]}", f"{code}{x[4]}", f"order {x[4]}", f"batch {x[5]}", f"No. {x[6]}", x[4], x[5], x[6], x[7], f"{x[3]}", f"ID-{x[3]}-{x[2]}",
        f"{x[0]},{x[1]} EUR", f"${x[1]},{x[1]}", f"{d}:{x[0]}", f"{x[0]}%", f"0.{x[4]}", f"serial {x[2]}/{x[2]}/{x[0]}-B", f"slot {x[1]} to {x[1]}", f"pack {d} of {x[0]}", f"{x[7]},{x[1]},0.{x[2]},ok", f"{d} {month}", f"page {d} Section {m}", f"{d}, {month} {y}", f"{x[1]} USD and {word}", f"{x[2]}-{x[2]}", f"{x[3]}-{x[1]}",
        " ".join(map(str, rng.integers(0, 10, 14))), " ".join(map(str, rng.integers(0, 10, 8))), " ".join(map(str, rng.integers(100, 1000, 6))),
        f"@{plain}", f"@{plain}_{_one(rng, _PLAIN)}", f"@{word.lower()} above", f"at {d} and {x[0]}", f"meet at {d} in {word}",
        f"{month} {word}", f"Next {month}, {word}", f"{d} Items, {word}", f"{d} {plain.title()} and", f"Chapter {d}, Part {m}", f"Node {x[0]}, Rack {d}", f"{word}, {month}", f"{y} Edition, {word}",
    )


_LEADS = {
    "email": ["Write to", "E-mail:", "Contact", "cc:", "Reply to", "Antwort an", "Escriba a", "Scriva a", "Пишите на", "連絡先は"],
    "phone": ["Call", "Tel.:", "mobile", "Text", "Phone:", "Telefon:", "Teléfono:", "Appelez le", "Тел.:", "電話は"],
    "id_number": ["passport no.", "ID number", "social security number", "identity card", "Ausweisnummer", "El documento de identidad es", "codice fiscale", "паспорт", "番号は"],
    "address": ["My address is", "Deliver to", "Ship it to", "They moved to", "Die Adresse ist", "La dirección es", "L'indirizzo è", "Адрес:", "住所は"],
    "name": ["My name is", "signed by", "Please ask", "Kind regards,", "Mit freundlichen Grüßen,", "Saludos,", "С уважением,", "担当は", "We met"],
}


@dataclass
class Examples:
    """Candidates of generated texts: features, whether each is an item of its kind, and which one (-1: none, or only in part)."""

    x: np.ndarray
    truth: np.ndarray
    item: np.ndarray
    items: int


def _counts(rng: np.random.Generator, name: bool, words: tuple[str, str]) -> list[float]:
    """Counts of a candidate's words in a corpus: names stand in addresses and hardly ever in small letters, others the other way round."""
    some = lambda p: float(rng.integers(1, 60)) if rng.random() < p else 0.0
    mail = [some(0.9 if name else 0.02) for _ in range(2)] if rng.random() < 0.8 else [0.0, 0.0]
    return mail + [some(0.04 if name else 0.7 if w in _PLAIN or w in COMMON else 0.1) for w in words]


def examples(n: int, seed: int) -> dict[str, Examples]:
    """For each kind the candidates in ``n`` generated texts; one that meets an item in part is no example."""
    rng = np.random.default_rng(seed)
    rows: dict[str, list] = {k: [] for k in KINDS}
    items = dict.fromkeys(KINDS, 0)
    for _ in range(n):
        text, gold = "", []
        for _ in range(int(rng.integers(1, 4))):
            positive = rng.random() < 0.5
            kind = KINDS[int(rng.integers(5))] if positive else ""
            item = _positive(kind, rng) if positive else _negative(rng)
            bare = rng.random() < 0.35
            if not bare:
                lead = _LEADS[kind] if positive and rng.random() < 0.75 else _FILL["before"]
                lead = str(_one(rng, lead))
                text += (" " if text else "") + lead + ("" if ord(lead[-1]) > 0x3000 else " ")
            elif text:
                break
            if positive:
                gold.append((kind, len(text), len(text) + len(item), items[kind]))
                items[kind] += 1
            text += item + ("" if bare else str(_one(rng, _FILL["after"])))
            if bare:
                break
        plain, known = view(text)[0], {}
        for kind, a, z in propose(plain):
            near, which = max((((min(z, e) - max(a, s)) / (max(z, e) - min(a, s)), i) for k, s, e, i in gold if k == kind), default=(0.0, -1))
            if 0.5 < near < 0.85:
                continue
            truth, x = near >= 0.85, measure(plain, kind, a, z, known)
            if kind == "name":
                x[-COUNTS:] = _counts(rng, truth, words_of(plain[a:z]))
            rows[kind].append((x, truth, which if truth else -1))
    return {k: Examples(np.array([x for x, _, _ in v]), np.array([t for _, t, _ in v], dtype=float), np.array([i for _, _, i in v]), items[k]) for k, v in rows.items()}


@dataclass
class PiiModel:
    trees: dict[str, Boost]
    cuts: dict[str, float]
    held_out: dict[str, tuple[float, float]]


@lru_cache(maxsize=4)
def fit_pii(n: int = 8_000, seed: int = 11) -> PiiModel:
    """One model for each kind; thresholds from examples of a second seed. ``held_out`` has, on those of a third, the precision of the
    candidates chosen and the recall of all items, those for which nothing was proposed included."""
    trees, cuts, held = {}, {}, {}
    train, tune, test = examples(n, seed), examples(n // 3, seed + 1), examples(n // 3, seed + 2)
    for kind in KINDS:
        trees[kind] = Boost("logistic", rounds=50, depth=4, rate=0.2, least=5).fit(train[kind].x, train[kind].truth)
        cuts[kind] = best_cut(trees[kind].predict(tune[kind].x), tune[kind].truth)
        hit = trees[kind].predict(test[kind].x) >= cuts[kind]
        held[kind] = (float(test[kind].truth[hit].mean()), len(set(test[kind].item[hit].tolist()) - {-1}) / test[kind].items)
    return PiiModel(trees, cuts, held)


# ---- the pipeline -------------------------------------------------------------------------------------------------------

SPANS = "tbl string, row_id string, item int, kind string, start int, end int, score double, first string, last string, features array<float>"


def _bare(word: str) -> str:
    return word.strip(".,;:!?()[]\"'")


#: Tasks that the names of one word are dealt to.
SALT = 8


def _best(spans: list[tuple]) -> list[tuple]:
    """The best of spans (rank, score, start, end, ..) that overlap, by rank, then score, then length."""
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2] - s[3], s[2])):
        if all(s[3] <= k[2] or k[3] <= s[2] for k in kept):
            kept.append(s)
    return kept


def candidate_spans(items: DataFrame, model: PiiModel) -> DataFrame:
    """Chosen spans of the kinds but names, and all name candidates that may still be chosen, of (tbl, row_id, item, text).

    Rows of the kind "word", without a record, count the texts of a batch in which a word stands in small letters.
    """
    counted = list(range(OWN, OWN + COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in KINDS}
            plains: list[tuple[str, list[int] | None]] = []
            small: Counter[str] = Counter()
            for i, text in enumerate(batch.column(3).to_pylist()):
                plain, at = view(text or "")
                plains.append((plain, at))
                if len(plain) >= 4:
                    small.update({w for w in map(_bare, set(plain.split())) if w.islower()})
                    known: dict = {}
                    for kind, a, z in propose(plain):
                        rows[kind].append((i, a, z, measure(plain, kind, a, z, known)))
            chosen: dict[int, list[tuple]] = {}
            for kind in KINDS[:-1]:
                if rows[kind]:
                    score = model.trees[kind].predict(np.array([r[3] for r in rows[kind]]))
                    for (i, a, z, _), s in zip(rows[kind], score.tolist()):
                        if s >= model.cuts[kind]:
                            chosen.setdefault(i, []).append((kind != "email", s - model.cuts[kind], a, z, kind))
            out: list[tuple] = []
            best = {i: _best(spans) for i, spans in chosen.items()}
            for i, spans in best.items():
                for _, s, a, z, kind in spans:
                    local = re.split(r"\s?(?:@|[(\[{]\s?at)", plains[i][0][a:z], maxsplit=1, flags=re.IGNORECASE)[0].lower() if kind == "email" else None
                    out.append((i, kind, a, z, s, local, None, None))
            if rows["name"]:
                free = [r for r in rows["name"] if not any(a < r[2] and r[1] < z for _, _, a, z, _ in best.get(r[0], []))]
                if free:
                    # what the counts in the corpus can make of a candidate at best
                    may = model.trees["name"].upper(np.array([r[3] for r in free]), counted) >= model.cuts["name"]
                    for (i, a, z, f), ok in zip(free, may):
                        if ok:
                            out.append((i, "name", a, z, None, *words_of(plains[i][0][a:z]), f))
            out += [(None, "word", 0, 0, float(n), w, None, None) for w, n in small.items() if len(w) > 2]
            rows_at = pa.array([r[0] for r in out], pa.int64())
            place = lambda i, p: p if plains[i][1] is None else plains[i][1][p]
            end = lambda i, p: p if plains[i][1] is None else plains[i][1][p - 1] + 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(rows_at) for c in range(3)), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] if r[0] is None else place(r[0], r[2]) for r in out], pa.int32()), pa.array([r[3] if r[0] is None else end(r[0], r[3]) for r in out], pa.int32()),
                    pa.array([r[4] for r in out], pa.float64()), pa.array([r[5] for r in out], pa.string()), pa.array([r[6] for r in out], pa.string()), pa.array([r[7] for r in out], pa.list_(pa.float32())),
                ],
                names=["tbl", "row_id", "item", "kind", "start", "end", "score", "first", "last", "features"],
            )

    return items.select("tbl", "row_id", "item", "text").where("length(text) >= 4").mapInArrow(run, SPANS)


def pii_spans(items: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """(tbl, row_id, item, kind, start, end, score) of the personal information in (tbl, row_id, item, text).

    Offsets are code points of the text. Spans of names may overlap each other; the score decides.
    """
    model = model or fit_pii()
    spans = written(candidate_spans(items, model), "pii-spans")
    # words of email addresses, with the number of different addresses that have them; "jdoe" counts for "doe" too
    local = spans.where("kind = 'email'").select("first").distinct()
    parts = F.filter(F.split("first", r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    words = local.select("first", F.explode(F.array_distinct(F.concat(parts, F.transform(parts, lambda w: F.substring(w, 2, 99))))).alias("w"))
    small = spans.where("kind = 'word'").select(F.col("first").alias("w"), F.lit(0).alias("mail"), F.col("score").cast("long").alias("low"))
    lexicon = words.where("length(w) >= 3").select("w", F.lit(1).alias("mail"), F.lit(0).cast("long").alias("low")).unionByName(small)
    lexicon = lexicon.groupBy("w").agg(F.sum("mail").alias("mail"), F.sum("low").alias("low"))
    # a name's word may be very frequent: its rows are dealt to SALT tasks
    lexicon = lexicon.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    names = spans.where("kind = 'name'").withColumn("last", F.split("last", "-")[0]).withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALT)).cast("int"))
    for word in ("first", "last"):
        names = names.join(lexicon.select(F.col("w").alias(word), "_salt", F.col("mail").alias(f"mail_{word}"), F.col("low").alias(f"low_{word}")), [word, "_salt"], "left")

    @F.pandas_udf(T.DoubleType())
    def rescored(features, mail_first, mail_last, low_first, low_last):
        import pandas as pd

        if not len(features):
            return pd.Series([], dtype="float64")
        x = np.stack(features.to_numpy()).astype(np.float64)
        for i, n in enumerate((mail_first, mail_last, low_first, low_last)):
            x[:, OWN + i] = np.minimum(n.fillna(0).to_numpy(), COUNTED)
        return pd.Series(model.trees["name"].predict(x) - model.cuts["name"])

    counts = [F.col(c).cast("double") for c in ("mail_first", "mail_last", "low_first", "low_last")]
    names = names.withColumn("score", rescored("features", *counts)).where("score >= 0")
    columns = ["tbl", "row_id", "item", "kind", "start", "end", "score"]
    return spans.where("kind NOT IN ('name', 'word')").select(*columns).unionByName(names.select(*columns))


def redact(items: DataFrame, spans: DataFrame) -> DataFrame:
    """(tbl, row_id, item, redacted) of every item of (tbl, row_id, item, text), placeholders in place of the spans."""
    keys = ["tbl", "row_id", "item"]
    by = spans.groupBy(*keys).agg(F.collect_set(F.struct("score", "start", "end", "kind")).alias("spans"))

    @F.pandas_udf(T.StringType())
    def apply(text, found):
        import pandas as pd

        def one(t, s):
            if t is None or s is None:
                return t
            best = _best([(x["kind"] != "email", x["score"], x["start"], x["end"], x["kind"]) for x in s])
            out, last = [], 0
            for _, _, a, z, kind in sorted(best, key=lambda b: b[2]):
                out += [t[last:a], f"[{kind.upper()}]"]
                last = z
            return "".join([*out, t[last:]])

        return pd.Series([one(t, s) for t, s in zip(text, found)])

    joined = items.dropDuplicates(keys).join(by, keys, "left")
    return joined.select(*keys, F.when(F.col("spans").isNull(), F.col("text")).otherwise(apply("text", "spans")).alias("redacted"))
