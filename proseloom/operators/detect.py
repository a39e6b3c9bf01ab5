"""Detection: vocabulary in tiers, phrases, and regular expressions, as one array of findings for each text.

Everything is a Column expression over literals of the pack, so a scan of texts needs no shuffle and no Python. Each tier
is one alternation, read once over the folded text; phrases are looked for one by one only in texts that an alternation of
their beginnings lets through.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions.patterns import required, starts, trie
from proseloom.functions.text import fold, fold_str, trimmed, word_count
from proseloom.sources.pack import Detector, Pack, Tier, java_pattern

FINDING = "struct<seq: int, id: string, matched: string, category: string, weight: int, tier: int>"


def occurrences(text: Column, words: tuple[str, ...]) -> Column:
    """The words of the list, folded, that stand in the text between other characters than ASCII letters, digits and _, one entry
    for each occurrence. Words with inner marks are looked for on their own, as they may meet inside one another."""
    plain = [fold_str(w) for w in words if re.fullmatch(r"[a-z0-9_]+", fold_str(w))]
    none, found = F.array().cast("array<string>"), []
    if plain:
        found.append(F.regexp_extract_all(text, F.lit(rf"{starts(plain, True)}(?<![A-Za-z0-9_])(?:{trie(plain, True)})(?![A-Za-z0-9_])"), F.lit(0)))
    for w in map(fold_str, words):
        if w and w not in plain:
            one = trie([w], True)
            hit = F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_]){one}(?![A-Za-z0-9_])"), F.lit(0))
            found.append(F.when(text.rlike(one), hit).otherwise(none))
    return F.transform(F.concat(*found), fold) if found else none


def _literals(rows: list[dict], kind: str) -> Column:
    """An array of structs as one literal; thousands of single literals would take seconds to hand over and to analyse."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _finding(seq: int, id: str, matched: str, category: str, weight: int, tier: int | None) -> dict:
    return {"needle": fold_str(matched), "f": {"seq": seq, "id": id, "matched": matched, "category": category, "weight": weight, "tier": tier}}


KEYED = f"struct<needle: string, f: {FINDING}>"


def tier_findings(hits: Column, words: Column, tier: Tier, seq: int) -> Column:
    """Findings of a tier whose gate is passed; ``hits`` are its occurrences, ``words`` the words of the text."""
    entries = _literals([_finding(seq + i, f"vocab:{w}", w, "vocabulary", tier.weight, tier.number) for i, w in enumerate(tier.words)], KEYED)
    # bound as the one element of an array: computed once, and it may come from Python, which a lambda may not hold
    held = lambda h: F.transform(F.filter(entries, lambda e: F.array_contains(h, e["needle"])), lambda e: e["f"])
    present = F.get(F.transform(F.array(hits), held), F.lit(0))
    if tier.number == 1:
        gate = F.size(hits) > 0
    elif tier.number == 2:
        gate = F.size(F.array_distinct(hits)) >= tier.min_distinct
    else:
        share = (F.size(hits) / F.greatest(words, F.lit(1))).cast("float") * F.lit(100).cast("float")
        gate = share.cast("float") > F.lit(tier.max_density_pct).cast("float")
    return F.when(gate & (F.size(hits) > 0), present).otherwise(_none())


def phrase_findings(text: Column, pack: Pack, seq: int) -> Column:
    """Findings of the phrases in a text. It is folded only if an alternation of the phrases' beginnings is found in it, and
    then once, as the one element of an array."""
    entries = [_finding(seq + i, f"phrase:{p.match}", p.match, p.category, p.weight, None) for i, p in enumerate(pack.phrases) if p.match]
    if not entries:
        return _none()
    heads = sorted({e["needle"][:16] for e in entries})
    some = text.rlike(starts(heads, True) + trie(heads, True))
    keyed = _literals(entries, KEYED)

    def held(folded: Column) -> Column:
        return F.transform(F.filter(keyed, lambda e: F.contains(folded, e["needle"])), lambda e: e["f"])

    return F.when(some, F.flatten(F.transform(F.array(fold(text)), held))).otherwise(_none())


def _hinted(text: Column, d: Detector) -> Column | None:
    """Whether a detector can match at all, by literals of which one stands in every match; it only saves time."""
    literals = required(d.pattern)
    if not literals or "i" not in d.flags:
        return None
    # letters with a twin that only full case folding knows are left open
    return text.rlike(re.sub(r"\[([SK])([sk])\]", r"[\1\2ſK]", trie(literals, True)))


def matches(text: Column, d: Detector) -> Column:
    """What a detector matches, trimmed; the emoji detector gives its first match only."""
    none = F.array().cast("array<string>")
    if d.id == "emoji":
        first = F.regexp_extract(text, d.pattern, 0)
        return F.when(first == "", none).otherwise(F.array(first))
    found = F.transform(F.regexp_extract_all(text, F.lit(java_pattern(d)), F.lit(0)), trimmed)
    hinted = _hinted(text, d)
    return found if hinted is None else F.when(hinted, found).otherwise(none)


def detector_findings(text: Column, d: Detector, seq: int) -> Column:
    made = lambda m: F.struct(F.lit(seq).alias("seq"), F.lit(d.id).alias("id"), m.alias("matched"), F.lit(d.category).alias("category"), F.lit(d.weight).alias("weight"), F.lit(None).cast("int").alias("tier"))
    return F.transform(matches(text, d), made).cast(f"array<{FINDING}>")


def repair_required(f: Column) -> Column:
    return F.coalesce(f["tier"].isin(1, 2), F.lit(False)) | (f["weight"] >= 3)


def editable(f: Column) -> Column:
    return f["id"] != "inline-header-list"


def structural(f: Column) -> Column:
    return f["tier"].isNull()


def deduplicated(found: Column) -> Column:
    """The first finding of each id and match, ASCII case aside. Sorts by key, so its time is that of a sort."""
    key = lambda f: F.concat(f["id"], F.lit("\x00"), F.translate(f["matched"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    keyed = F.array_sort(F.transform(found, lambda f, i: F.struct(key(f).alias("k"), i.alias("i"), f.alias("f"))))

    def firsts(rows: Column) -> Column:
        return F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["k"] != x["k"]))

    # bound as the one element of an array, so that it is sorted once
    kept = F.get(F.transform(F.array(keyed), firsts), F.lit(0))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["f"].alias("f")))), lambda x: x["f"])


def ordered(found: Column) -> Column:
    """Those that call for repair first, then by falling weight, then by match, then in the pack's order."""
    keyed = F.transform(found, lambda f: F.struct((~repair_required(f)).alias("a"), (-f["weight"]).alias("b"), f["matched"].alias("c"), f["seq"].alias("d"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def with_findings(df: DataFrame, pack: Pack, text: str = "text", to: str = "findings") -> DataFrame:
    """``df`` with the ordered findings of ``text``; null texts have none."""
    base = df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", word_count(F.col("_text")))
    parts, seq = [], 0
    for tier in pack.tiers:
        base = base.withColumn(f"_hits{tier.number}", occurrences(F.col("_text"), tier.words))
        parts.append(tier_findings(F.col(f"_hits{tier.number}"), F.col("_words"), tier, seq))
        seq += len(tier.words)
    parts.append(phrase_findings(F.col("_text"), pack, seq))
    seq += len(pack.phrases)
    for d in pack.detectors:
        parts.append(detector_findings(F.col("_text"), d, seq))
        seq += 1
    out = base.withColumn("_all", F.concat(*parts)).withColumn(to, ordered(deduplicated(F.col("_all"))))
    return out.drop("_text", "_words", "_all", *[f"_hits{t.number}" for t in pack.tiers])


def _sum(found: Column, keep) -> Column:
    return F.aggregate(F.filter(found, keep), F.lit(0).cast("long"), lambda a, f: a + F.greatest(f["weight"], F.lit(1)).cast("long"))


def repair_score(found: Column) -> Column:
    return _sum(found, lambda f: repair_required(f) & editable(f))


def gate_score(found: Column) -> Column:
    return _sum(found, lambda f: repair_required(f) & editable(f) & structural(f))


def probe_score(found: Column) -> Column:
    return F.size(F.filter(found, lambda f: F.coalesce(f["tier"] == 1, F.lit(False)) | (structural(f) & (f["weight"] >= 2)))).cast("long")


def checklist(found: Column, limit: int = 24) -> Column:
    """What a rewriter is shown: findings of weight 2 and more that can be edited away."""
    return F.slice(F.filter(found, lambda f: (f["weight"] >= 2) & editable(f)), 1, limit)


def repair_targets(found: Column, limit: int = 16) -> Column:
    return F.slice(F.filter(found, lambda f: repair_required(f) & editable(f)), 1, limit)
