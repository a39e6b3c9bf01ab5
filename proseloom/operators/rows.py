"""Detection of one text in Python, for SQL functions that take a text at a time. The Column form of ``detect`` is the fast one."""

from __future__ import annotations

import re

import numpy as np
import regex

from proseloom.functions.text import fold_str
from proseloom.sources.pack import Pack

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = regex.compile(r"[\p{Alphabetic}\p{N}'’\-–]+")
_EMOJI = re.compile("[☀-➿⬀-⯿\U0001F300-\U0001FAFF]")


class Detector:
    """Finds what ``with_findings`` finds, in the same order, as (id, matched, category, weight, tier)."""

    def __init__(self, pack: Pack) -> None:
        self.pack = pack
        self.shapes = []
        for d in pack.detectors:
            flags = (regex.IGNORECASE if "i" in d.flags else 0) | (regex.MULTILINE if "m" in d.flags else 0)
            try:
                self.shapes.append((d, _EMOJI if d.id == "emoji" else regex.compile(d.pattern, flags)))
            except regex.error:
                continue  # written for Java only

    def _tiers(self, folded: str, words: int):
        for t in self.pack.tiers:
            own = {w: len(re.findall(rf"(?<![A-Za-z0-9_]){re.escape(fold_str(w))}(?![A-Za-z0-9_])", folded)) for w in t.words}
            present, total = [w for w in t.words if own[w]], sum(own.values())
            share = np.float32(np.float32(total / max(words, 1)) * np.float32(100))
            if t.number == 1 or (t.number == 2 and len(present) >= t.min_distinct) or (t.number == 3 and share > np.float32(t.max_density_pct)):
                yield from ((f"vocab:{w}", w, "vocabulary", t.weight, t.number) for w in present)

    def find(self, text: str | None) -> list[tuple[str, str, str, int, int | None]]:
        text = text or ""
        folded = fold_str(text)
        found = list(self._tiers(folded, len(_WORDS.findall(text))))
        found += [(f"phrase:{p.match}", p.match, p.category, p.weight, None) for p in self.pack.phrases if p.match and fold_str(p.match) in folded]
        for d, shape in self.shapes:
            hits = [m.group().strip() for m in shape.finditer(text)]
            found += [(d.id, h, d.category, d.weight, None) for h in (hits[:1] if d.id == "emoji" else hits)]
        first = {}
        for f in found:
            first.setdefault((f[0], f[1].translate(_ASCII)), f)
        required = lambda f: f[4] in (1, 2) or f[3] >= 3
        return sorted(first.values(), key=lambda f: (not required(f), -f[3], f[1].encode()))

    def gate_score(self, text: str | None) -> int:
        return sum(max(w, 1) for i, _, _, w, t in self.find(text) if t is None and w >= 3 and i != "inline-header-list")
