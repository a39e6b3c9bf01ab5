"""The running text of computational notebooks.

``prose`` gives the sentences of the text cells, cell by cell; code, comments, outputs, headings, formulas, images and
link targets are left out. What cannot be read in its stated format is read in the format it looks like.
"""

from __future__ import annotations

import json
import re

from proseloom.llm.level import SENTENCE

FENCE = re.compile(r"^[ ]{0,3}(```|~~~)")
IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)|<img[^>]*>|data:[a-z]+/[\w.+-]+;base64,[A-Za-z0-9+/=]+")
LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
TAG = re.compile(r"<[^>]*>|`[^`]*`|\$\$.*?\$\$|\$[^$\n]+\$|https?://\S+", re.DOTALL)
HEADING = re.compile(r"^\s{0,3}#{1,6}(\s|$)")
UNDERLINE = re.compile(r"^\s{0,3}(=+|-{2,})\s*$")
BULLET = re.compile(r"^\s*(?:[-*+•>|]|\d+[.)])\s+")


def cells(text: str, form: str | None) -> list[str]:
    """The text cells of a notebook."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    start = text.lstrip()[:1]
    if form == "ipynb" or start == "{":
        try:
            found = json.loads(text)
            return [_joined(c.get("source")) for c in found.get("cells", []) if isinstance(c, dict) and c.get("cell_type") == "markdown"]
        except (ValueError, AttributeError, TypeError):
            if start == "{":
                return []
    if form == "percent" or re.search(r"^# %%", text, re.MULTILINE):
        return _percent(text)
    return _markdown(text)


def _joined(source: object) -> str:
    if isinstance(source, list):
        source = "".join(s for s in source if isinstance(s, str))
    return source.replace("\r\n", "\n").replace("\r", "\n") if isinstance(source, str) else ""


def _percent(text: str) -> list[str]:
    found, current = [], None
    for line in text.split("\n"):
        if line.startswith("# %%"):
            current = [] if "[markdown]" in line or "[md]" in line else None
            if current is not None:
                found.append(current)
        elif current is not None and line.startswith("#") and not line.startswith("#>"):
            current.append(line[2:] if line.startswith("# ") else line[1:])
    return ["\n".join(c) for c in found]


def _markdown(text: str) -> list[str]:
    found: list[list[str]] = [[]]
    fenced = False
    for line in text.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
            found.append([])
        elif fenced:
            continue
        elif line.startswith(("    ", "\t")):
            if found[-1]:
                found.append([])
        else:
            found[-1].append(line)
    return ["\n".join(c) for c in found if c]


def prose(text: str | None, form: str | None) -> list[list[str]]:
    """The sentences of each text cell that has any."""
    if not text or not text.strip():
        return []
    found = []
    for cell in cells(text, form):
        cell = LINK.sub(r"\1", IMAGE.sub(" ", cell))
        cell = TAG.sub(" ", cell)
        sentences: list[str] = []
        block: list[str] = []
        for line in [*_body(cell), ""]:
            bullet = BULLET.match(line)
            if block and (bullet or not line.strip()):
                sentences += [s.strip() for s in SENTENCE.split(" ".join(block))]
                block = []
            if line.strip():
                block.append((line[bullet.end() :] if bullet else line).strip())
        kept = [s for s in sentences if sum(c.isalpha() for c in s) >= (4 if any(ord(c) > 0x3000 for c in s) else 8)]
        if kept:
            found.append(kept)
    return found


def _body(cell: str) -> list[str]:
    """The lines of a text cell without headings and fenced or indented code."""
    out: list[str] = []
    fenced = False
    for line in cell.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        elif fenced or HEADING.match(line) or (line.startswith(("    ", "\t")) and not (out and out[-1].strip())):
            out.append("")
        elif UNDERLINE.match(line) and out:
            out[-1] = ""
        else:
            out.append(line)
    return out
