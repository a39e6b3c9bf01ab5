"""Patterns for Java and RE2 built from lists of literals."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _parser


APOSTROPHES = "['‘’]"


def quoted(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def trie(words: Iterable[str], any_case: bool = False) -> str:
    """One pattern for all words, sharing their beginnings, so that a place in a text is left after a character or two.

    The longest word is preferred. ``any_case`` lets ASCII letters match in either case, and an apostrophe its curly forms.
    """
    root: dict = {}
    for w in words:
        node = root
        for c in w.lower() if any_case and w.isascii() else w:
            node = node.setdefault(c, {})
        node[""] = {}

    def char(c: str) -> str:
        if any_case and c == "'":
            return APOSTROPHES
        return f"[{c.upper()}{c}]" if any_case and c.isascii() and c.isalpha() else quoted(c)

    def body(node: dict) -> str:
        out = ""
        while len(node) == 1 and "" not in node:
            c, node = next(iter(node.items()))
            out += char(c)
        if set(node) == {""}:
            return out
        parts = [char(c) + body(n) for c, n in sorted(node.items()) if c]
        return out + "(?:" + "|".join(parts) + ")" + ("?" if "" in node else "")

    return body(root)


def starts(words: Iterable[str], any_case: bool = False) -> str:
    """A look-ahead for the first characters of the words."""
    first = {w[0] for w in words if w}
    if any_case:
        first |= {c.upper() for c in first if c.isascii()} | {c.lower() for c in first if c.isascii()} | ({"‘", "’"} if "'" in first else set())
    return "(?=[" + "".join(quoted(c) for c in sorted(first)) + "])"


def required(pattern: str, most: int = 64) -> list[str] | None:
    """Literals, in small letters, one of which stands in every match of a pattern, case aside; None if none can be told or they are too short."""
    try:
        found = _required(_parser.parse(pattern), most)
    except (re.error, OverflowError, RecursionError):
        return None
    return sorted(found) if found and min(map(len, found)) >= 3 else None


def _required(parts, most: int) -> set[str] | None:
    """Of a sequence, the best of the literal runs in it; alternatives in a run multiply it."""
    best: set[str] | None = None
    run: set[str] = {""}

    def better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
        return b if a is None or (b is not None and min(map(len, b), default=0) > min(map(len, a), default=0)) else a

    for kind, value in parts:
        more = _literal(kind, value, most)
        if more is not None and len(run) * len(more) <= most:
            run = {x + y for x in run for y in more}
            continue
        if kind is _parser.AT:
            continue
        best, run = better(best, run if run != {""} else None), {""}
        if kind is _parser.SUBPATTERN:
            best = better(best, _required(value[3], most))
        elif kind is _parser.BRANCH:
            own = [_required(b, most) for b in value[1]]
            best = better(best, set().union(*own) if all(own) else None)
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] >= 1:
            best = better(best, _required(value[2], most))
    return better(best, run if run != {""} else None)


def _literal(kind, value, most: int) -> set[str] | None:
    """What an element matches, if that is a few literals."""
    if kind is _parser.LITERAL:
        return {chr(value).lower()} if chr(value).isascii() else None
    if kind is _parser.SUBPATTERN and not value[1] and not value[2]:
        out = {""}
        for k, v in value[3]:
            more = _literal(k, v, most)
            if more is None or len(out) * len(more) > most:
                return None
            out = {x + y for x in out for y in more}
        return out
    if kind is _parser.BRANCH:
        own = [_literal(_parser.SUBPATTERN, (None, 0, 0, b), most) for b in value[1]]
        return set().union(*own) if all(o is not None for o in own) else None
    if kind is _parser.IN and all(k is _parser.LITERAL for k, _ in value):
        found = {_literal(k, v, most) and chr(v).lower() for k, v in value}
        return None if None in found else found
    return None
