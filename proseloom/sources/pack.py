"""Rule packs: loading from JSON or tables, validation, and compilation to plain pattern strings."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule tables are dimension tables whose rows become literals of the plan; more rows than this are refused.
MAX_RULES = 5_000

# The regular-expression detectors as (id, pattern, flags, category, weight). No flags means "gi".
DETECTORS = [
    ("em-dash", r"—|–|\s--\s", None, "style", 2),
    ("curly-double-quotes", r"[“”]", None, "style", 1),
    ("emoji", "", None, "style", 2),
    ("negative-parallelism", r"\bnot (?:just|only|merely)\b[^.!?\n]{0,80}?\bbut\b", None, "language", 3),
    ("its-not-x-its-y", r"\b(?:it|this|that)['’]s not [^.!?\n]{2,60}[.,;] (?:it|this|that)['’]s\b", None, "language", 3),
    ("negative-listing", r"\bnot an? [^.!?\n]{2,40}\. not an? [^.!?\n]{2,40}\.", None, "rhetoric", 3),
    ("ing-tail", r",\s+(?:highlighting|underscoring|emphasizing|showcasing|reflecting|symbolizing|ensuring|fostering|demonstrating|illustrating|solidifying|cementing|signaling)\b", None, "content", 4),
    ("copula-avoidance", r"\b(?:serves as|stands as|boasts)\b", None, "language", 3),
    ("vague-attribution", r"\b(?:experts (?:believe|argue|say)|studies show|industry reports suggest|observers have (?:cited|noted)|some critics argue|it is believed that|it is widely (?:believed|regarded))\b", None, "content", 4),
    ("chatbot-artifact", r"\b(?:i hope this helps|great question|excellent point|let me know if|would you like me to|feel free to|don['’]t hesitate to|happy to help|you['’]re absolutely right|is there anything else)\b", None, "communication", 5),
    ("cutoff-disclaimer", r"\b(?:as of my last (?:training|knowledge)|knowledge cutoff|while specific details are (?:limited|scarce)|based on available information|maintains a low profile|keeps personal details private)\b", None, "communication", 4),
    ("hedging-stack", r"\b(?:could|may|might) (?:potentially|possibly|perhaps)\b|\b(?:potentially|arguably) (?:possibly|perhaps)\b", None, "filler", 3),
    ("generic-conclusion", r"\b(?:the future looks bright|exciting times lie ahead|only time will tell|the possibilities are endless|poised for growth|watch this space|journey toward excellence|step in the right direction)\b", None, "filler", 4),
    ("significance-inflation", r"\b(?:marking a pivotal|(?:is|as) a testament to|serves as a reminder|underscor(?:es|ing) the (?:importance|significance)|reflects broader|setting the stage for|key turning point|evolving landscape|indelible mark|deeply rooted)\b", None, "content", 4),
    ("throat-clearing", r"\b(?:here['’]s the thing|here['’]s what you need to know|let['’]s dive in|let['’]s explore|let['’]s break (?:this|it) down|without further ado|let that sink in|make no mistake|the uncomfortable truth)\b", None, "rhetoric", 4),
    ("authority-trope", r"\b(?:at its core|the real question is|what really matters|the heart of the matter|the deeper issue)\b", None, "rhetoric", 3),
    ("vague-declarative", r"\bthe (?:implications|stakes|consequences|reasons) are (?:significant|high|real|structural|profound|far-reaching)\b", None, "rhetoric", 4),
    ("false-agency", r"\b(?:the (?:data|numbers) tells? us|the market rewards|the decision emerge[sd]|the culture shift(?:s|ed)|the conversation move[sd] toward)\b", None, "rhetoric", 3),
    ("inline-header-list", r"^\s*[-*]\s+\*\*[^*\n]{2,60}\*\*:", "gim", "style", 3),
    ("oxford-triple", r"\b\w+, \w+, and \w+\b", None, "language", 1),
]
#: Two shapes that only the scorer looks for, as (id, pattern, weight).
SCORER_EXTRAS = [
    ("prompt:not-just-it", r"(?:not|n[o’']t)\s+(?:just|only|merely)\b[^.!?\n]{0,80}?,\s*(?:it|this|that|they)\b", 3),
    ("prompt:scene-setting", r"(?:^|\n|\. )\s*in (?:the world of|a world of|an era|the era|an age of|the age of)\b", 3),
]
EMOJI = r"[\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F300}-\x{1FAFF}]"


class PackError(ValueError):
    """A rule pack that can't be used."""


@dataclass(frozen=True)
class Phrase:
    match: str
    fix: str | None
    category: str
    weight: int


@dataclass(frozen=True)
class Tier:
    number: int
    weight: int
    words: tuple[str, ...]
    min_distinct: int = 2
    max_density_pct: float = 1.5


@dataclass(frozen=True)
class Detector:
    """``flags`` holds i and m where they are on, ``given`` the flags as written; the pattern of "emoji" is a range of code points."""

    id: str
    pattern: str
    flags: str
    category: str
    weight: int
    given: str = ""


@dataclass(frozen=True)
class Pack:
    phrases: tuple[Phrase, ...]
    tiers: tuple[Tier, ...]
    detectors: tuple[Detector, ...]
    skipped: tuple[str, ...] = field(default=())

    @property
    def phrase_count(self) -> int:
        """Phrases that can be replaced mechanically."""
        return sum(p.fix is not None for p in self.phrases)


def translate(pattern: str) -> str | None:
    r"""A pattern with \uXXXX escapes as is, or None if one of them is half of a surrogate pair."""
    return None if re.search(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}", pattern) else pattern


def java_pattern(d: Detector) -> str:
    """As Java runs it: classes and case by Unicode, line feeds alone end lines."""
    return "(?Ud" + d.flags + ")" + d.pattern


def _compiles(d: Detector) -> bool:
    """Whether Java takes a pattern, since that is where it runs; without a session, whether it looks as if it would."""
    context = SparkContext._active_spark_context
    if context is None:
        try:
            re.compile(re.sub(r"\\[pP]\{\w+\}", "x", d.pattern))
        except re.error:
            return False
        return "(?P" not in d.pattern
    try:
        context._jvm.java.util.regex.Pattern.compile(java_pattern(d))
    except (Py4JJavaError, PySparkException):
        return False
    return True


def detector(id: str, pattern: str, flags: str | None, category: str, weight: int) -> Detector | None:
    if id == "emoji":
        return Detector(id, EMOJI, "", category, weight)
    usable = translate(pattern)
    if usable is None:
        return None
    given = flags or ""
    flags = "gi" if flags is None else flags
    made = Detector(id, usable, "".join(f for f in "im" if f in flags), category, weight, given)
    return made if _compiles(made) else None


def _build(phrases: list[Phrase], tiers: list[Tier], detectors: list[tuple]) -> Pack:
    if len(phrases) + sum(len(t.words) for t in tiers) + len(detectors) > MAX_RULES:
        raise PackError(f"more than {MAX_RULES} rules")
    built = [(d[0], detector(*d)) for d in detectors]
    # the longest phrase comes first; those of one length stay in the pack's order
    longest = sorted(phrases, key=lambda p: -len(p.match.encode()))
    return Pack(tuple(longest), tuple(tiers), tuple(d for _, d in built if d), tuple(i for i, d in built if not d))


def load_pack(text: str) -> Pack:
    """The pack of a JSON text; unknown keys are ignored, anything malformed raises PackError."""
    try:
        raw = json.loads(text)
        vocabulary = raw["vocabulary"]
        tiers = []
        for n in (1, 2, 3):
            t = vocabulary[f"tier{n}"] if n == 1 else vocabulary.get(f"tier{n}", {"weight": 1, "words": []})
            tiers.append(Tier(n, int(t.get("weight", 1)), tuple(map(str, t.get("words", []))), int(t.get("minDistinct") or 2), float(t.get("maxDensityPct") or 1.5)))
        phrases = [Phrase(str(p["match"]), p.get("fix"), str(p.get("category", "")), int(p.get("weight", 1))) for p in raw["phrases"]]
        detectors = [(str(r["id"]), str(r["pattern"]), r.get("flags"), str(r.get("category", "")), int(r.get("weight", 1))) for r in raw.get("regex", [])]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise PackError(str(e)) from e
    return _build(phrases, tiers, detectors)


def pack_or_default(text: str | None, default: Pack | None = None) -> tuple[Pack, str | None]:
    """The pack of ``text`` if it is given and valid, else the default one (that of the package, if none is named) and the reason."""
    if default is None:
        from proseloom.sources.default_pack import default_pack

        default = default_pack()
    if not text:
        return default, None
    try:
        return load_pack(text), None
    except PackError as e:
        return default, str(e)


def pack_from_tables(spark: SparkSession, vocab: DataFrame, phrases: DataFrame, detectors: list[tuple] = DETECTORS) -> Pack:
    """The pack of rule tables. A rule that comes twice counts once; of equal keys the row with the least ``seq`` stands."""
    words = vocab.select("tier", "word", "weight", "min_distinct", F.col("max_density_pct").cast("double"), "seq").distinct().orderBy("seq", "word").limit(MAX_RULES + 1).collect()
    rows = phrases.select("match_text", "fix", "category", "weight", "seq", "phrase_id").where("match_text IS NOT NULL").distinct().orderBy("seq", "phrase_id").limit(MAX_RULES + 1).collect()
    tiers = []
    for n in (1, 2, 3):
        own = [w for w in words if w.tier == n and w.word]
        least = [w.min_distinct for w in own if w.min_distinct is not None]
        dense = [w.max_density_pct for w in own if w.max_density_pct is not None and w.max_density_pct == w.max_density_pct]
        tiers.append(Tier(n, own[0].weight if own else 1, tuple(dict.fromkeys(w.word for w in own)), least[0] if least else 2, dense[0] if dense else 1.5))
    found: dict[str, Phrase] = {}
    for r in rows:
        found.setdefault(r.match_text, Phrase(r.match_text, r.fix, r.category or "", r.weight or 1))
    return _build(list(found.values()), tiers, detectors)
