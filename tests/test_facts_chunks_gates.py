import random

import pytest
from pyspark.sql import functions as F

from proseloom.functions.facts import claim, protect, protect_str, restore
from proseloom.operators import chunk, gates

ONE = ["£1.4m", "£5", "£2bn", "£9 million", "£4,500", "$7k"]


def test_claims():
    for v in ONE:
        assert protect_str(v) == ("[[F00]]", [v])
    for t, tail in (("£5 monthly", " monthly"), ("£5 bits", " bits"), ("£5 km", " km")):
        assert protect_str(t)[0] == "[[F00]]" + tail
    assert len(claim("See https://example.com/2024-01-30/invoice/99999 today.")) == 1
    assert len(claim("Call at 3:30pm, again at 09:15.")) == 2 and claim("We cut 3 of the 12 sections.") == []
    # a percentage comes before a phone number, which is then dropped whole
    assert [k for _, _, k in claim("+1 (499) 555-6503%%%")] == ["percent"]
    assert protect_str("x " * 3 + " ".join(f"{10000 + i}" for i in range(101)))[0].endswith("[[F100]]")


def test_claims_never_overlap():
    rng = random.Random(2)
    parts = ["£", "5", "12", ":30", "%", " ", "+1 ", "2024-01-30", "Jan ", "a@b.co", "https://x.y/", "AB-", "12345", "(", ")", ",", "."]
    for _ in range(2000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        held = claim(t)
        assert all(a[1] <= b[0] for a, b in zip(held, held[1:]))
        text, values = protect_str(t)
        for i, v in enumerate(values):
            text = text.replace(f"[[F{i:02d}]]", v, 1)
        assert text == t


def test_restore(spark):
    values = ["£4,500", "b@example.com", "March 12"]
    cases = {"Pay [[F00]] to [[F01]] by [[F02]].": ("Pay £4,500 to b@example.com by March 12.", None), "Pay [[F00]] by [[F02]].": (None, ("missing", 1, None)), "[[F00]] [[F0]] [[F01]] [[F02]]": (None, ("duplicated", 0, None)), "[[F99]] [[F00]] [[F00]]": (None, ("unknown", None, "[[F99]]")), "[[F99999999999999999999]]": (None, ("unknown", None, "[[F99999999999999999999]]")), "[[F000]][[F01]][[F2]]": ("£4,500b@example.comMarch 12", None)}
    df = spark.createDataFrame([(a, values) for a in cases], "a string, v array<string>")
    for r in df.select("a", restore(F.col("a"), F.col("v")).alias("r"), restore(F.col("a"), F.col("v"), True).alias("s")).collect():
        text, wrong = cases[r.a]
        assert r.r.text == text and (tuple(r.r.violation) if r.r.violation else None) == wrong
        if r.a.startswith("Pay [[F00]] by"):
            assert r.s.text == "Pay £4,500 by March 12."
    none = spark.createDataFrame([("plain",), (None,), ("",)], "t string").withColumn("p", protect("t"))
    assert [x.t for x in none.select(restore(F.col("p.text"), F.col("p.values"))["text"].alias("t")).collect()] == ["plain", None, ""]


def test_chunks_against_a_loop(spark):
    def slow(text, target, ceiling):
        out = []
        for p in text.replace("\r\n", "\n").split("\n\n"):
            if not p.strip():
                continue
            if len(p) > ceiling:
                return None
            if out and len(out[-1]) + 2 + len(p) <= target:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return out

    rng = random.Random(3)
    texts = ["a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 30, "x" * 101, "", " \n\n ", "a\n\n\nb", "a\r\n\r\nb"] + ["".join(rng.choice(["ab", "é" * 9, "\n", "\n\n", " ", "\r\n"]) for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for target, ceiling in ((62, 100), (20, 40)):
        for r in df.select("k", chunk.chunks(F.col("t"), target, ceiling).alias("c")).collect():
            assert r.c == slow(texts[r.k], target, ceiling), texts[r.k]


def test_keep_paragraphs(spark):
    rows = [("One. Two.", "One.\nTwo.", "One. Two."), ("a\nb", "One.\nTwo.", "One.\nTwo."), ("x", "- a\n- b", "- a\n- b"), ("x", "1. a\nb", "1. a\nb"), ("x\n\ny", "a\n b \n\nc\nd", "a b\n\nc d"), ("x", "a\n. b", "a\n. b")]
    df = spark.createDataFrame(rows, "b string, e string, w string")
    for r in df.select("w", chunk.keep_paragraphs(F.col("b"), F.col("e")).alias("g")).collect():
        assert r.g == r.w


@pytest.mark.parametrize(
    "before,after,length,shorter,talk",
    [("a" * 30, "b" * 10, None, None, False), ("a" * 30, "b" * 9, "the rewrite dropped most of the text", None, False), ("a" * 3, "b" * 10, "the rewrite ran away", "the summary is no shorter than the text", False), ("a", " \xa0", "the rewrite came back empty", "the summary came back empty", False),
     ("hello there", "As an AI, hello", None, "the summary is no shorter than the text", True), ("as an ai said", "As an AI said", None, "the summary is no shorter than the text", False)],
)
def test_gates(spark, before, after, length, shorter, talk):
    a, b = F.lit(before), F.lit(after)
    assert tuple(spark.range(1).select(gates.length_gate(a, b), gates.shorter_gate(a, b), gates.commentary(a, b)).first()) == (length, shorter, talk)


def test_small_gates(spark):
    s = lambda t, l, i: F.struct(F.lit(t).alias("tables"), F.lit(l).alias("links"), F.lit(i).alias("list_items"))  # noqa: E731, E741
    row = spark.range(1).select(gates.lost(s(1, 1, 1), s(0, 0, 0)), gates.lost(s(0, 1, 2), s(0, 1, 1)), gates.lost(s(0, 0, 2), s(0, 0, 0)), gates.style_gate(F.lit(3), F.lit(3)), gates.style_gate(F.lit(0), F.lit(3)), gates.worth_another_draw(F.lit("facts")), gates.worth_another_draw(F.lit("model"))).first()
    assert tuple(row) == ("the table was lost", None, "the list was lost", "the style did not improve", None, True, False)
