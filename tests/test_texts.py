import random
import re

import pytest
from pyspark.sql import functions as F

from proseloom.functions.clean import Cleaner, clean_texts, dashed
from proseloom.functions.text import fold, is_blank, spaced_words, trimmed, word_count
from proseloom.sources.pack import Pack, PackError, Phrase, load_pack, pack_or_default, translate

PHRASES = (
    Phrase("it is important to note that", "", "f", 4), Phrase("it is worth noting that", "", "f", 4), Phrase("due to the fact that", "because", "f", 3), Phrase("at the end of the day", "", "f", 3),
    Phrase("in the realm of", "in", "f", 4), Phrase("best practices", None, "j", 2), Phrase("in order to", "to", "f", 3),
)
GOLDEN = [
    ("We did it in order to ship.", "We did it to ship.", 1), ("Slow due to the fact that it blocks.", "Slow because it blocks.", 1), ("In order to ship, we cut scope.", "To ship, we cut scope.", 1),
    ("It is important to note that the build is green.", "The build is green.", 1), ("Also, it is worth noting that tests pass.", "Also, tests pass.", 1), ("It works—mostly.", "It works - mostly.", 1), ("It works — mostly.", "It works - mostly.", 1),
    ("It works -- mostly.", "It works -- mostly.", 0), ("See pages 10–12.", "See pages 10-12.", 1), ("The reorder took time and the disorder toppled it.", "The reorder took time and the disorder toppled it.", 0),
    ("We shipped. At the end of the day, this is fine.", "We shipped. This is fine.", 1), ("The plan, at the end of the day, was vague.", "The plan was vague.", 1), ("In order to ship—it is important to note that the table is final.", "To ship - the table is final.", 3),
    ("In order to ship — we cut scope due to the fact that it slipped.", "To ship - we cut scope because it slipped.", 3), ("in the realm of order to", "in order to", 1), ("'in order to'", "'in order to'", 0), ("“in order to”", "“to”", 1), ("— x", "- x", 1), ("x —", "x - ", 1),
    ("a\n— x", "a\n - x", 1), ("a — — b", "a - - b", 2), ("10 – 12", "10 - 12", 1), ("", "", 0), ("\x00abc", "Abc", 0), ("It is worth noting that — x", "- X", 2),
]


@pytest.mark.parametrize("text,want,fixes", GOLDEN)
def test_clean(text, want, fixes):
    assert Cleaner(PHRASES).clean(text) == (want, fixes)


def test_clean_in_a_frame(spark):
    pack = Pack(PHRASES, (), ())
    rows = [(i, t, "x") for i, (t, _, _) in enumerate(GOLDEN)] + [(900, None, "x"), (0, GOLDEN[0][0], "x")]
    got = clean_texts(spark.createDataFrame(rows, "k int, text string, fixes string"), pack).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.cleaned, r.fixes) == ((None, 0) if r.k == 900 else GOLDEN[r.k][1:])


def test_dashes_against_a_character_loop():
    def slow(text):
        out, n, i = "", 0, 0
        while i < len(text):
            c = text[i]
            if c in "–—":
                n += 1
                if c == "–" and out[-1:].isdigit() and text[i + 1 : i + 2].isdigit():
                    out += "-"
                else:
                    out = out.rstrip(" ")
                    out += (" " if out else "") + "- "
                    while text[i + 1 : i + 2] == " ":
                        i += 1
            else:
                out += c
            i += 1
        return out, n

    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("a1 –—\n-") for _ in range(rng.randint(0, 14)))
        assert dashed(t) == slow(t), t


def test_cleaning_again_changes_nothing():
    c = Cleaner(PHRASES)
    for text, _, _ in GOLDEN[:14]:
        once = c.clean(text)[0]
        assert c.clean(once) == (once, 0)


def test_scalars(spark):
    rows = [("ÉCOLE ‘x’ ABC",), ("one-two it’s a–b _ 3",), ("\xa0  ",), ("",), (None,), ("été KK",)]
    got = spark.createDataFrame(rows, "t string").select("t", fold(F.col("t")).alias("f"), word_count(F.col("t")).alias("w"), is_blank(F.col("t")).alias("b"), trimmed(F.col("t")).alias("s"), spaced_words(F.col("t")).alias("p")).collect()
    assert got[0].f == "École 'x' abc".replace("École", "École") or got[0].f.startswith("É")
    assert got[0].f == "Écol" "e 'x' abc" and got[1].w == 4 and got[1].p == 5 and got[2].b and got[3].b and got[2].s == "" and got[4].f is None and got[5].f.endswith("kK")


@pytest.mark.parametrize("bad", ["", "{", "{}", '{"phrases": "nonsense"}', "[]", '{"phrases": [{}], "vocabulary": {"tier1": {"words": []}}}'])
def test_malformed_packs_are_errors(bad):
    with pytest.raises(PackError):
        load_pack(bad)
    default = Pack((), (), ())
    assert pack_or_default(bad, default)[0] is default


def test_pack_order_and_translation():
    pack = load_pack('{"note": 1, "phrases": [{"match": "a b"}, {"match": "abcd", "fix": ""}, {"match": "a c", "fix": "x"}], "vocabulary": {"tier1": {"weight": 5, "words": ["w"], "note": "x"}}, "regex": [{"id": "q", "pattern": "\\\\uD83C"}, {"id": "r", "pattern": "("}, {"id": "s", "pattern": "s", "flags": "m"}]}')
    assert [p.match for p in pack.phrases] == ["abcd", "a b", "a c"] and pack.phrase_count == 2 and pack.skipped == ("q", "r") and pack.detectors[0].flags == "m"
    assert translate(r"—") == r"—" and translate(r"\uDBFF") is None
    assert re.compile(r"—").match("—")
