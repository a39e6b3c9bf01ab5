import random
import unicodedata

import numpy as np
import pytest

from proseloom.llm.split import UNITS, Cutter, split_items
from proseloom.llm.tokens import tokenizer, vocabulary


def size(text, unit):
    return len(text) if unit == "chars" else len(text.encode()) if unit == "bytes" else len(tokenizer(vocabulary()).plain.encode_ordinary(text))


def tokens_between(text, a, z):
    """Of the text's own encoding."""
    own = tokenizer(vocabulary())
    ends = np.append(0, np.cumsum([own.length[i] for i in own.plain.encode_ordinary(text)]))
    x, y = np.searchsorted(ends, [len(text[:a].encode()), len(text[:z].encode())])
    assert ends[x] == len(text[:a].encode()) and ends[y] == len(text[:z].encode())
    return y - x


def check(text, cutter):
    spans = cutter.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    between = (lambda a, z: tokens_between(text, a, z)) if cutter.unit == "tokens" else (lambda a, z: size(text[a:z], cutter.unit))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d
        assert between(c, b) <= cutter.overlap
    assert all(between(a, b) <= cutter.limit or b - a == 1 for a, b in spans)
    return spans


@pytest.mark.parametrize("unit", ["chars", "bytes", "tokens"])
def test_random_texts(unit):
    rng = random.Random(1)
    parts = ["word ", "longerword", ". ", "\n", "\n\n", "é", "。", "日本", ", ", "🙂", " "]
    for _ in range(400):
        limit = rng.randint(8, 60)
        check("".join(rng.choices(parts, k=rng.randint(0, 200))), Cutter(limit, rng.randint(0, limit - 1), unit))


def test_prefers_paragraphs_then_sentences():
    text = "One two three. " * 10 + "\n\n" + "Four five six. " * 10
    (a, b), (c, d) = Cutter(200, 0).spans(text)
    assert text[:b].endswith("\n\n") and c == b
    spans = check("One two three. " * 40, Cutter(100, 20))
    assert all(b % 15 == 0 for _, b in spans[:-1]) and all(a % 15 == 0 for a, _ in spans)


def test_hard_cut_keeps_marks_with_their_letter():
    text = "é" * 200
    for a, b in check(text, Cutter(51, 10)):
        assert not unicodedata.combining(text[a])


def test_frame(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("b", "", 2), ("c", "x" * 10, 3), ("d", "word " * 30, 4), ("d", "word " * 30, 4)],
        "row_id string, text string, piece int",
    )
    rows = split_items(df, limit=50, overlap=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.row_id, []).append(r)
    assert "a" not in by and len(by["b"]) == 1 and by["c"][0].piece_text == "x" * 10
    assert len(by["d"]) == 2 * by["d"][0].n_pieces and max(len(r.piece_text) for r in by["d"]) <= 50
    assert split_items(df.limit(0), limit=50, overlap=5).count() == 0


def test_bad_parameters():
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            Cutter(*bad)


def test_prefix_sums():
    text = "né 日本🙂 words"
    for unit in ("chars", "bytes", "tokens"):
        at, prefix = UNITS[unit](text)
        assert at[0] == 0 and at[-1] == len(text) and (np.diff(at) > 0).all() and (np.diff(prefix) > 0).all()
        assert prefix[-1] == size(text, unit)
    at, prefix = UNITS["bytes"](text)
    assert prefix.tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert UNITS["tokens"]("")[1].tolist() == [0]


def test_frame_in_tokens(spark):
    df = spark.createDataFrame([("a", "word " * 300), ("b", "two words"), ("c", None)], "row_id string, text string")
    rows = split_items(df, limit=100, overlap=10, unit="tokens").collect()
    assert sorted({r.row_id for r in rows}) == ["a", "b"] and all(size(r.piece_text, "tokens") <= 101 for r in rows)
    assert sum(r.row_id == "a" for r in rows) in (3, 4)
