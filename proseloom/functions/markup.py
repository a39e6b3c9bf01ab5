"""HTML and Markdown: a small tolerant parser, and what is done with the tree.

The parser takes what clipboards hold: fragments with unclosed paragraphs, list items, rows and cells, void elements, raw
text elements, comments. It is a subset of the HTML standard; a text that has no markup is one text node.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(["script", "style"])
CODE = frozenset(["script", "style", "code", "pre"])
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An element that opens closes these open ones first, unless one of the fences stands between.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
ALLOWED = frozenset(
    "a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i ins kbd li map mark nav ol p pre q rp rt ruby s samp "
    "small span strike strong sub summary sup table tbody td th thead time tr tt u ul var wbr".split()
)
SCHEMES = frozenset("http https mailto ftp tel".split())
_KEPT_ATTRIBUTES = frozenset("title lang href hreflang align colspan rowspan start datetime cite".split())


@dataclass
class Node:
    tag: str
    attrs: list[tuple[str, str | None]] = field(default_factory=list)
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the text; nesting may be as deep as it likes."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif not c.tag.startswith("!"):
                stack += reversed(c.children)
        return "".join(out)

    def get(self, name: str) -> str | None:
        return next((v or "" for k, v in self.attrs if k == name), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.count: Counter[str] = Counter()

    def _cut(self, i: int) -> None:
        self.count.subtract(n.tag for n in self.open[i:])
        del self.open[i:]

    def _close(self, tags: set[str] | frozenset[str], fences: set[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in fences:
                return
            if self.open[i].tag in tags:
                self._cut(i)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in _BLOCK:
            self._close({"p"}, {"table", "td", "th", "li", "div", "blockquote"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            self._cut(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag))

    def handle_data(self, data: str) -> None:
        own = self.open[-1].children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].children.append(Node("!--", [], [data]))


def parse(text: str) -> Node:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def serialise(node: Node) -> str:
    out: list[str] = []
    # a string waiting with None is done already, as an end tag is
    stack: list[tuple[Node | str, bool | None]] = [(node, False)]
    while stack:
        c, raw = stack.pop()
        if isinstance(c, str):
            out.append(c if raw is None or raw else c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;"))
        elif c.tag == "!--":
            out.append(f"<!--{c.children[0]}-->")
        else:
            if c.tag:
                attrs = "".join(f' {k}="{(v or "").replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in c.attrs)
                out.append(f"<{c.tag}{attrs}>")
                if c.tag in VOID:
                    continue
                stack.append((f"</{c.tag}>", None))
            stack += [(x, c.tag in RAW) for x in reversed(c.children)]
    return "".join(out)


def map_text(text: str, transform: Callable[[str], str]) -> str:
    """The markup with every text outside scripts, styles and code transformed, in order."""
    root = parse(text)
    stack: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while stack:
        node, at, code = stack.pop()
        for i in range(at, len(node.children)):
            c = node.children[i]
            if isinstance(c, str):
                if not code:
                    node.children[i] = transform(c)
            elif not c.tag.startswith("!"):
                stack += [(node, i + 1, code), (c, 0, code or c.tag in CODE)]
                break
    out = serialise(root)
    return out if out or not text.strip() else text


def _seen(nodes: list[Node]) -> set[int]:
    """Of all elements below a root, in their order, those that show text or an image."""
    seen: set[int] = set()
    for n in reversed(nodes):
        if n.tag == "img" or any(c.strip() if isinstance(c, str) else id(c) in seen for c in n.children if not n.tag.startswith("!")):
            seen.add(id(n))
    return seen


def shape_of(text: str | None) -> tuple[int, int, int]:
    """(tables, links that can be seen and lead somewhere, list items)."""
    if not text or "<" not in text:
        return 0, 0, 0
    nodes = list(parse(text).walk())
    seen = _seen(nodes)
    links = sum(n.tag == "a" and bool((n.get("href") or "").strip()) and id(n) in seen for n in nodes)
    return sum(n.tag == "table" for n in nodes), links, sum(n.tag == "li" for n in nodes)


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("tables", "links", "list_items")]))
def shape(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shape_of(t) for t in texts], columns=["tables", "links", "list_items"])


def promote_headers(root: Node) -> None:
    for table in [n for n in root.walk() if n.tag == "table"]:
        own = list(table.walk())
        row = next((n for n in own if n.tag == "tr"), None)
        if row is not None and not any(n.tag == "th" for n in own):
            for c in row.children:
                if isinstance(c, Node) and c.tag == "td":
                    c.tag = "th"


def drop_invisible_links(root: Node) -> None:
    nodes = list(root.walk())
    seen = _seen(nodes)
    for node in [root, *nodes]:
        node.children = [c for c in node.children if not (isinstance(c, Node) and c.tag == "a" and c.get("href") is not None and id(c) not in seen)]


#: Markup nested deeper than this is read as the text in it, where it is converted.
MAX_DEPTH = 120


def flatten(root: Node, most: int = MAX_DEPTH) -> None:
    """What is nested deeper than ``most`` becomes text."""
    level = [root]
    for _ in range(most):
        level = [c for n in level for c in n.children if isinstance(c, Node)]
    for n in level:
        if not n.tag.startswith("!"):
            n.children = [n.text()]


def from_html(text: str) -> str:
    """Markdown of markup: headings, paragraphs, lists, tables, links, emphasis, code."""
    root = parse(text)
    flatten(root)
    promote_headers(root)
    drop_invisible_links(root)
    out = _blocks(root.children, "")
    return re.sub(r"\n{3,}", "\n\n", out).strip("\n")


def _inline(children: list) -> str:
    out = ""
    for c in children:
        if isinstance(c, str):
            out += re.sub(r"\s+", " ", c)
            continue
        inner = _inline(c.children)
        if c.tag in ("b", "strong") and inner.strip():
            out += f"**{inner.strip()}**"
        elif c.tag in ("i", "em") and inner.strip():
            out += f"*{inner.strip()}*"
        elif c.tag in ("del", "s", "strike") and inner.strip():
            out += f"~~{inner.strip()}~~"
        elif c.tag == "code":
            out += f"`{c.text()}`"
        elif c.tag == "a":
            out += f"[{inner.strip()}]({c.get('href') or ''})" if c.get("href") is not None else inner
        elif c.tag == "img":
            out += f"![{c.get('alt') or ''}]({c.get('src') or ''})"
        elif c.tag == "br":
            out += "  \n"
        elif c.tag not in RAW and not c.tag.startswith("!"):
            out += inner
    return out


def _blocks(children: list, indent: str) -> str:
    out, run = [], []

    def flush() -> None:
        text = _inline(run).strip()
        if text:
            out.append(text)
        run.clear()

    for c in children:
        if isinstance(c, str) or c.tag not in _BLOCK | {"li", "tr", "td", "th", "tbody", "thead", "tfoot", "dt", "dd"}:
            run.append(c)
            continue
        flush()
        if re.fullmatch(r"h[1-6]", c.tag):
            out.append("#" * int(c.tag[1]) + " " + _inline(c.children).strip())
        elif c.tag in ("ul", "ol"):
            items = [n for n in c.children if isinstance(n, Node) and n.tag == "li"]
            rows = []
            for i, item in enumerate(items):
                mark = f"{i + 1}. " if c.tag == "ol" else "- "
                body = _blocks(item.children, indent).replace("\n\n", "\n").replace("\n", "\n" + " " * len(mark))
                rows.append(mark + body)
            out.append("\n".join(rows))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.tag == "blockquote":
            out.append("\n".join("> " + x for x in _blocks(c.children, indent).split("\n")))
        elif c.tag == "hr":
            out.append("---")
        else:
            body = _blocks(c.children, indent)
            if body:
                out.append(body)
    flush()
    return "\n\n".join(out)


def _table(table: Node) -> str:
    rows = [[_inline(c.children).strip().replace("|", "\\|").replace("\n", " ") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


_ITEM = re.compile(r"^( *)(?:([-*+])|(\d{1,9})[.)])\s+(.*)$")
_RULE = re.compile(r"^\s{0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def to_html(text: str) -> str:
    """HTML of Markdown: paragraphs, headings, lists, tables, fences, quotes, links, images, emphasis, strikethrough, code."""
    return _to_blocks(text.replace("\r\n", "\n").split("\n"))


def _to_blocks(rows: list[str], depth: int = 0) -> str:
    if depth > MAX_DEPTH // 2:
        return _to_inline("\n".join(rows))
    out, i = [], 0
    while i < len(rows):
        row = rows[i]
        if not row.strip():
            i += 1
        elif m := re.match(r"^ {0,3}(```+|~~~+)", row):
            j = next((k for k in range(i + 1, len(rows)) if rows[k].strip().startswith(m.group(1))), len(rows))
            out.append("<pre><code>" + entities.escape("".join(r + "\n" for r in rows[i + 1 : j]), quote=False) + "</code></pre>\n")
            i = j + 1
        elif m := re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", row):
            out.append(f"<h{len(m.group(1))}>{_to_inline(m.group(2))}</h{len(m.group(1))}>\n")
            i += 1
        elif re.match(r"^ {0,3}(?:-\s*){3,}$|^ {0,3}(?:\*\s*){3,}$|^ {0,3}(?:_\s*){3,}$", row):
            out.append("<hr />\n")
            i += 1
        elif row.lstrip().startswith(">"):
            j = i
            while j < len(rows) and rows[j].lstrip().startswith(">"):
                j += 1
            out.append("<blockquote>\n" + _to_blocks([re.sub(r"^\s*> ?", "", r) for r in rows[i:j]], depth + 1) + "</blockquote>\n")
            i = j
        elif "|" in row and i + 1 < len(rows) and "-" in rows[i + 1] and _RULE.match(rows[i + 1]) and len(_cells(row)) == len(_cells(rows[i + 1])):
            j = i + 2
            while j < len(rows) and rows[j].strip() and "|" in rows[j]:
                j += 1
            out.append(_to_table(rows[i], rows[i + 2 : j]))
            i = j
        elif _ITEM.match(row):
            i = _to_list(rows, i, out, depth)
        else:
            j = i
            while j < len(rows) and rows[j].strip() and not (j > i and (_ITEM.match(rows[j]) and not _ITEM.match(rows[j]).group(3) or re.match(r"^ {0,3}(#{1,6}\s|```|>)", rows[j]))):
                j += 1
            out.append("<p>" + _to_inline("\n".join(r.strip() for r in rows[i:j])) + "</p>\n")
            i = j
    return "".join(out)


def _to_list(rows: list[str], i: int, out: list[str], depth: int = 0) -> int:
    first = _ITEM.match(rows[i])
    numbered, indent = first.group(3) is not None, len(first.group(1))
    items: list[list[str]] = []
    while i < len(rows):
        m = _ITEM.match(rows[i])
        if m and len(m.group(1)) <= indent + 1:
            if (m.group(3) is not None) != numbered or len(m.group(1)) < indent:
                break
            items.append([m.group(4)])
        elif rows[i].strip() == "":
            after = rows[i + 1] if i + 1 < len(rows) else ""
            if not (after.startswith(" " * (indent + 2)) or ((n := _ITEM.match(after)) and (n.group(3) is not None) == numbered)):
                break
            items[-1].append("")
        elif rows[i].startswith(" " * (indent + 2)) or not rows[i - 1].strip() == "":
            most = indent + 4 if m else 4
            items[-1].append(rows[i][min(most, len(rows[i]) - len(rows[i].lstrip(" "))) :])
        else:
            break
        i += 1
    tag = "ol" if numbered else "ul"
    body = ""
    for item in items:
        inner = _to_blocks(item, depth + 1)
        single = re.fullmatch(r"<p>(.*?)</p>\n", inner, re.DOTALL)
        if not single:
            single = None
            inner = re.sub(r"^<p>(.*?)</p>\n", r"\1\n", inner, count=1, flags=re.DOTALL)
        body += f"<li>{single.group(1) if single else inner}</li>\n"
    out.append(f"<{tag}>\n{body}</{tag}>\n")
    return i


def _cells(row: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\|", "", re.sub(r"(?<!\\)\|\s*$", "", row)))]


def _to_table(head: str, body: list[str]) -> str:
    top = _cells(head)
    out = "<table><thead><tr>" + "".join(f"<th>{_to_inline(c)}</th>" for c in top) + "</tr></thead><tbody>\n"
    for row in body:
        cells = (_cells(row) + [""] * len(top))[: len(top)]
        out += "<tr>" + "".join(f"<td>{_to_inline(c)}</td>" for c in cells) + "</tr>\n"
    return out + "</tbody></table>\n"


_SPANS = re.compile(
    r"(?P<code>`+)(?P<code_text>.+?)(?P=code)|\\(?P<escape>[!-/:-@\[-`{-~])|(?P<image>!)?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?P<url><[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+\"(?P<title>[^\"]*)\")?\)"
    r"|(?P<strong>\*\*|__)(?=\S)(?P<strong_text>.+?)(?<=\S)(?P=strong)|~~(?=\S)(?P<del>.+?)(?<=\S)~~|(?P<em>[*_])(?=\S)(?P<em_text>[^*_]+?)(?<=\S)(?P=em)(?!\w)|(?P<break>(?:(?<! ) {2,}|\\)\n)",
    re.DOTALL,
)


def _to_inline(text: str, depth: int = 0) -> str:
    if depth > MAX_DEPTH:
        return entities.escape(entities.unescape(text), quote=False)
    out, at = "", 0
    for m in _SPANS.finditer(text):
        out += entities.escape(entities.unescape(text[at : m.start()]), quote=False)
        at = m.end()
        g = m.groupdict()
        if g["code"]:
            out += f"<code>{entities.escape(g['code_text'].strip(), quote=False)}</code>"
        elif g["escape"]:
            out += entities.escape(g["escape"], quote=False)
        elif g["label"] is not None:
            url = entities.escape(g["url"].strip("<>"))
            out += f'<img src="{url}" alt="{entities.escape(g["label"])}" />' if g["image"] else f'<a href="{url}">{_to_inline(g["label"], depth + 1)}</a>'
        elif g["strong"]:
            out += f"<strong>{_to_inline(g['strong_text'], depth + 1)}</strong>"
        elif g["del"]:
            out += f"<del>{_to_inline(g['del'], depth + 1)}</del>"
        elif g["em"]:
            out += f"<em>{_to_inline(g['em_text'], depth + 1)}</em>"
        else:
            out += "<br />\n"
    return out + entities.escape(entities.unescape(text[at:]), quote=False)


def preview_str(html: str | None, text: str | None) -> str:
    """Markup that is safe to show: listed elements and attributes, links of known schemes, no images; plain text as it is."""
    if html is None:
        return f"<pre>{entities.escape(text or '', quote=False)}</pre>"

    root = parse(html)
    out = Node("")
    # children still to be looked at, with the element that takes them
    stack: list[tuple[Node | str, Node]] = [(c, out) for c in reversed(root.children)]
    while stack:
        c, into = stack.pop()
        if isinstance(c, str):
            into.children.append(c)
        elif c.tag in RAW or c.tag.startswith("!"):
            continue
        elif c.tag not in ALLOWED:
            stack += [(x, into) for x in reversed(c.children)]
        else:
            attrs = [(k, v) for k, v in c.attrs if k in _KEPT_ATTRIBUTES and (k not in ("href", "cite") or _safe(v or ""))]
            if c.tag == "a":
                attrs.append(("rel", "noopener noreferrer"))
            kept = Node(c.tag, attrs)
            into.children.append(kept)
            stack += [(x, kept) for x in reversed(c.children)]
    return serialise(out)


def _safe(url: str) -> bool:
    head = re.match(r"^([a-z][a-z0-9+.-]*):", re.sub(r"[\x00-\x20]", "", url).lower())
    return head is None or head.group(1) in SCHEMES


#: Words of both texts up to which every change is found; longer texts are compared by lines, and words only within changed lines, with
#: up to DIFF_CHANGES changes each, beyond which a stretch counts as changed whole.
DIFF_WORDS, DIFF_CHANGES = 1_500, 200


def _shortest(a: list, b: list, most: int) -> list[tuple[int, int, int, int]] | None:
    """Matching runs (start in a, end in a, start in b, end in b) of a shortest edit script, in O((n + m) d) for d changes; None if d is over ``most``."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
    p, q = a[head : len(a) - tail], b[head : len(b) - tail]
    ends = [(0, head, 0, head)] if head else []
    last = [(len(a) - tail, len(a), len(b) - tail, len(b))] if tail else []
    if not p or not q:
        return ends + last
    far, trail = {1: 0}, []
    for d in range(min(most, len(p) + len(q)) + 1):
        trail.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far.get(k - 1, -1) < far.get(k + 1, -1)) else far[k - 1] + 1
            y = x - k
            while x < len(p) and y < len(q) and p[x] == q[y]:
                x, y = x + 1, y + 1
            far[k] = x
            if x >= len(p) and y >= len(q):
                return ends + _traced(trail, len(p), len(q), head) + last
    return None


def _traced(trail: list[dict[int, int]], x: int, y: int, shift: int) -> list[tuple[int, int, int, int]]:
    runs: list[tuple[int, int, int, int]] = []
    for d in range(len(trail) - 1, -1, -1):
        far, k = trail[d], x - y
        before = k + 1 if k == -d or (k != d and far.get(k - 1, -1) < far.get(k + 1, -1)) else k - 1
        px = far[before] if d else 0
        py = px - before if d else 0
        start = px if not d else (px if before == k + 1 else px + 1)
        if x > start:
            runs.append((shift + start, shift + x, shift + y - (x - start), shift + y))
        x, y = px, py
    return runs[::-1]


def _changes(a: list, b: list, most: int) -> Iterator[tuple[bool, list, list]]:
    """(same, of a, of b) of the stretches of two lists; one change in the middle where there are more than ``most``."""
    runs = _shortest(a, b, most)
    if runs is None:
        head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
        runs = [(0, head, 0, head), (len(a) - tail, len(a), len(b) - tail, len(b))]
    i = j = 0
    for x, end, y, stop in [*runs, (len(a), len(a), len(b), len(b))]:
        if x > i or y > j:
            yield False, a[i:x], b[j:y]
        if end > x:
            yield True, a[x:end], b[y:stop]
        i, j = end, stop


def diff_str(before: str, after: str) -> str:
    """A word diff: what is gone in del, what is new in ins, everything escaped. Its time is bounded by the two parameters, whatever the texts."""
    cut = lambda t: re.findall(r"\s+|\S+", t)
    a, b, out = cut(before), cut(after), []

    def show(parts: Iterator[tuple[bool, list, list]]) -> None:
        for same, x, y in parts:
            if same:
                out.append(entities.escape("".join(x), quote=False))
                continue
            if x:
                out.append(f"<del>{entities.escape(''.join(x), quote=False)}</del>")
            if y:
                out.append(f"<ins>{entities.escape(''.join(y), quote=False)}</ins>")

    if len(a) + len(b) <= DIFF_WORDS:
        show(_changes(a, b, DIFF_WORDS))
    else:
        for same, x, y in _changes(before.splitlines(keepends=True), after.splitlines(keepends=True), DIFF_CHANGES):
            show(iter([(True, x, y)]) if same else _changes(cut("".join(x)), cut("".join(y)), DIFF_CHANGES))
    return "<pre>" + "".join(out) + "</pre>"


def _text_udf(fn: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return run


markdown_of = _text_udf(from_html)
html_of = _text_udf(to_html)


@F.pandas_udf(T.StringType())
def preview(html: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([preview_str(h, t) for h, t in zip(html, text)])


@F.pandas_udf(T.StringType())
def word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([diff_str(a or "", b or "") for a, b in zip(before, after)])
