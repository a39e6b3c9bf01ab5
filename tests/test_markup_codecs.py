import time
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from proseloom.functions import codecs
from proseloom.functions.markup import _changes, diff_str, from_html, map_text, parse, preview_str, serialise, shape_of, to_html


def test_map_text_leaves_code_and_attributes():
    up = str.upper
    assert map_text("<p>a <b>b</b> c", up) == "<p>A <b>B</b> C</p>"
    assert map_text('<a title="in order to" href="x?a=1&amp;b=2">t</a>', up) == '<a title="in order to" href="x?a=1&amp;b=2">T</a>'
    for tag in ("code", "pre", "script", "style"):
        assert map_text(f"<{tag}>a &amp; b</{tag}>x" if tag in ("code", "pre") else f"<{tag}>a & b</{tag}>x", up).endswith("X") and "A" not in map_text(f"<{tag}>a</{tag}>", up)
    assert map_text("<!-- a -->b", up) == "<!-- a -->B" and map_text("", up) == "" and map_text("plain", up) == "PLAIN"
    assert map_text("<p>one<p>two<ul><li>x<li>y</ul>", up) == "<p>ONE</p><p>TWO</p><ul><li>X</li><li>Y</li></ul>"
    assert serialise(parse("<br><img src=a>")) == '<br><img src="a">'


@pytest.mark.parametrize(
    "html,shape",
    [("<table><tr><td>a<td>b<tr><td>c</table>", (1, 0, 0)), ('<a href="x">t</a><a href=" ">t</a><a href="y"> </a><a href="z"><img></a><a>n</a>', (0, 2, 0)), ("<ul><li>a<li>b<ul><li>c</ul></ul>", (0, 0, 3)), ("", (0, 0, 0)), (None, (0, 0, 0)), ("a < b", (0, 0, 0))],
)
def test_shape(html, shape):
    assert shape_of(html) == shape


def test_markdown_both_ways():
    page = '<h2>Head</h2><p>One <b>two</b> <a href="u">three</a>.</p><ul><li>a</li><li>b</li></ul><table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table><ol><li>n</li></ol><a href="#p"></a><pre>k  v</pre>'
    md = from_html(page)
    assert md == "## Head\n\nOne **two** [three](u).\n\n- a\n- b\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\n1. n\n\n```\nk  v\n```"
    back = to_html(md)
    assert shape_of(back) == (1, 1, 3) and "<th>x</th>" in back and "<strong>two</strong>" in back and "<ol>" in back
    assert shape_of(to_html("[text]()")) == (0, 0, 0) and shape_of(to_html("- a\n- b\n\ntext")) == (0, 0, 2) and shape_of(to_html("a\nb")) == (0, 0, 0)
    assert to_html("1. a\n2. b\n") == "<ol>\n<li>a</li>\n<li>b</li>\n</ol>\n" and "<del>x</del>" in to_html("~~x~~") and "&lt;script&gt;" in to_html("<script>")
    assert to_html("") == "" and from_html("") == ""


@pytest.mark.parametrize("bad", ["<script>alert(1)</script>x", '<a href="javascript:alert(1)">x</a>', '<a href=" java\tscript:alert(1)">x</a>', '<img src="http://t/p.gif">x', '<p onclick="a()">x</p>', "<style>p{}</style>x", "<iframe src=a>x</iframe>", "<svg><script>1</script></svg>x"])
def test_preview_is_safe(bad):
    out = preview_str(bad, "t")
    for part in ("script", "onclick", "<img", "<style", "iframe", "p.gif"):
        assert part not in out
    assert "x" in out


def test_preview_of_plain_text():
    assert preview_str(None, "<b>\n&") == "<pre>&lt;b&gt;\n&amp;</pre>" and preview_str("<p>ok <b>b</b></p>", "") == "<p>ok <b>b</b></p>"


def test_diff_parts_give_both_texts():
    rng = random.Random(1)
    import html
    import re

    for _ in range(200):
        a, b = (" ".join(rng.choice(["x", "<b>", "y&", "z"]) for _ in range(rng.randint(0, 8))) for _ in range(2))
        out = diff_str(a, b)[5:-6]
        assert html.unescape(re.sub(r"<ins>.*?</ins>|</?del>", "", out, flags=re.S)) == a
        assert html.unescape(re.sub(r"<del>.*?</del>|</?ins>", "", out, flags=re.S)) == b


def test_payload_round_trip(spark):
    rng = random.Random(9)
    texts = ["", "é€🙂", "<p>a</p>"] + ["".join(rng.choice("ab<>/é–\n\r🙂") for _ in range(rng.randint(0, 199))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", codecs.build_payload(F.col("t")))
    for r in df.select("t", "p", codecs.parse_payload("p").alias("back")).collect():
        assert r.back == r.t
        raw = bytes(r.p)
        head = dict(x.split(b":") for x in raw[: codecs.HEADER_BYTES].split(b"\r\n") if x)
        assert raw[int(head[b"StartFragment"]) : int(head[b"EndFragment"])].decode() == r.t and int(head[b"EndHTML"]) == len(raw)


def test_malformed_payloads():
    f = codecs.payload_fragment
    assert f(None) is None and f(b"") is None and f(b"no markup") is None and f(b"x<b>y") == "<b>y"
    assert f(b"Version:0.9\r\nStartFragment:9999\r\nEndFragment:10000\r\n<!--StartFragment-->ok<!--EndFragment-->\x00\x00") == "ok"
    good = b"Version:0.9\r\nStartFragment:0000000080\r\nEndFragment:0000000083\r\n"
    assert f(good.ljust(80, b" ") + b"abc<x>") == "abc"
    assert f(b"<!--StartFragment-->a\x97b\x81<!--EndFragment-->") == "a—b�"
    assert f(b"Version:0.9\r\nStartFragment:0000000060\r\nEndFragment:0000000020\r\n<p>z") == "<p>z"


def test_small_codecs(spark):
    row = spark.range(1).select(
        codecs.percent(F.lit(5), F.lit(0)), codecs.percent(F.lit(5), F.lit(None).cast("long")), codecs.percent(F.lit(1), F.lit(3)), codecs.percent(F.lit(9), F.lit(3)), codecs.size_label(F.lit(3 << 30)), codecs.size_label(F.lit((12 << 20) + 99)),
        codecs.checksum_matches(F.lit(b"a"), F.upper(F.sha2(F.lit(b"a"), 256))), codecs.from_1252(F.lit(b"\x80\x81a\xe9")),
    ).first()
    assert tuple(row) == (None, None, 33, 100, "3.0GB", "12MB", True, "€�aé")


@pytest.mark.parametrize("tag", ["div", "b", "ul", "blockquote", "span", "a", "table"])
def test_deep_markup_ends_nothing(tag):
    deep = f"<{tag}>" * 10_000 + "in order — to" + f"</{tag}>" * 10_000 + "<ul><li>x</li></ul>"
    assert serialise(parse(deep)) == deep.replace("<ul><li>x</li></ul>", "") + "<ul><li>x</li></ul>"
    assert map_text(deep, str.upper).count("IN ORDER — TO") == 1
    assert shape_of(deep)[2] == 1 and shape_of(deep)[0] == (10_000 if tag == "table" else 0)
    assert "in order — to" in preview_str(deep, None)
    assert ("in order — to" in from_html(deep)) == (tag not in ("ul", "table"))  # text beside items and cells is not converted


def test_deep_markdown_ends_nothing():
    for text in (">" * 5000 + " x", "\n".join("  " * i + "- x" for i in range(3000)), "**" * 4000 + "x" + "**" * 4000, "[" * 3000 + "x" + "]" * 3000 + "(u)"):
        assert "x" in to_html(text)


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_diff_is_a_shortest_one_and_bounded():
    rng = random.Random(3)
    for n in (0, 1, 5, 30):
        for _ in range(60):
            a, b = ([rng.choice("abc") for _ in range(rng.randint(0, n))] for _ in range(2))
            parts = list(_changes(a, b, 1000))
            assert [x for _, p, _ in parts for x in p] == a and [y for _, _, q in parts for y in q] == b
            assert all(p == q for same, p, q in parts if same) and sum(len(p) for same, p, _ in parts if same) == lcs(a, b)
    words = [rng.choice("abcdefgh") for _ in range(8000)], [rng.choice("abcdefgh") for _ in range(8000)]
    began = time.time()
    for sep in (" ", "\n"):
        out = diff_str(*(sep.join(w) for w in words))[5:-6]
        assert re.sub(r"<ins>.*?</ins>|</?del>", "", out, flags=re.DOTALL) == sep.join(words[0]) and re.sub(r"<del>.*?</del>|</?ins>", "", out, flags=re.DOTALL) == sep.join(words[1])
    assert time.time() - began < 5
