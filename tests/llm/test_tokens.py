import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402

from proseloom.llm.tokens import ChunkTable, Tokenizer, chunk_counts, chunks_of, count_tokens, encode_texts, shared_chunks, vocabulary  # noqa: E402


@pytest.fixture(scope="module")
def tok():
    return Tokenizer(vocabulary())


def table_of(tok, texts, bits=1):
    """The table of every chunk of the texts that can be shared."""
    chunks = set()
    for t in texts:
        data = t.encode()
        c = chunks_of(np.frombuffer(data, dtype=np.uint8), np.array([0]), bits)
        chunks |= {data[a : a + n] for a, n in zip(c.start[c.can].tolist(), c.size[c.can].tolist())}
    chunks = sorted(chunks)
    return ChunkTable.of(chunks, [tok.direct(c) for c in chunks])


EMPTY = ChunkTable.of([], [])


def same(tok, texts, table):
    found = list(tok.texts(pa.array(texts, pa.string()), table))
    ids, n = np.concatenate([i for i, _ in found]).tolist(), np.concatenate([c for _, c in found]).tolist()
    want = [tok.plain.encode_ordinary(t) if t else [] for t in texts]
    assert n == [len(w) for w in want] and ids == [i for w in want for i in w]


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n\n", "a", "<|endoftext|> end", "tab\tand  two   blanks \r\n\r\n x", "it's they'll we've 'r e 're", "0.904 0.426 " * 500,
     "短い実験は節の終わりに差を説明できません。" * 200, "QUJD0123+/" * 3000, " " * 5000 + "x", " x　 y" * 900, "\x1b[31mred\x1b[0m\n" * 300, "don't" * 400, "'re" * 600, "\n \n" * 700],
)
def test_known_texts(tok, text):
    same(tok, [text], EMPTY)
    same(tok, [text, "", None, text, "x " + text], table_of(tok, [text]))


def test_random_texts_agree_with_the_plain_tokenizer():
    rng = random.Random(5)
    parts = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'re", "'l", "l", "1", "23", ".", "--", "é", "́", "日", "本語", "。", "　", "\xa0", "🙂", "\x1f", "\x85", "x" * 40, "some words here", "12ab34 cd"]
    tight = [p for p in parts if not p.isspace() and not p.isascii()] + ["'", "r", "e", "\n"]
    for bits, hard in ((1, 1024), (0, 40), (2, 17)):
        tok = Tokenizer(vocabulary(), bits=bits, hard=hard)
        for own in (parts, tight):
            texts = ["".join(rng.choices(own, k=rng.randint(1, 300))) for _ in range(700)]
            same(tok, texts, EMPTY)
            same(tok, texts, table_of(tok, texts[::2], bits))


def test_a_hash_alone_is_not_believed(tok):
    text = "the same words stand here and there, again and again. " * 20
    t = table_of(tok, [text])
    t.words[:, 1] ^= np.uint64(1)
    t.ids[:] = 0
    same(tok, [text], t)


def test_frames(spark):
    df = spark.createDataFrame([(1, "x y", 7), (2, None, 8), (3, "", 9), (3, "", 9)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    assert rows[2] == [] and rows[3] == [] and len(rows[1]) == 2
    assert sorted(r.n_tokens for r in count_tokens(df).collect()) == [0, 0, 0, 2]
    assert encode_texts(df.limit(0)).collect() == []


def test_chunks_are_counted_over_the_corpus_and_encoded_once(spark, tok):
    rng = random.Random(9)
    copied = "A tutorial that was copied whole, with numbers such as 4711 and names. " * 3
    rows = [(i, " ".join(str(rng.random()) for _ in range(20)) + " " + copied * (1 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = {r.h: r.n for r in chunk_counts(df).collect()}
    want = {}
    for _, t in rows:
        for h in chunks_of(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0])).hash.view(np.int64).tolist():
            want[h] = want.get(h, 0) + 1
    assert counts == want
    table = shared_chunks(df)
    assert 0 < len(table.hash) <= sum(n > 1 for n in want.values())
    small = shared_chunks(df, most=3)
    assert len(small.hash) <= 3
    for most in (1 << 17, 3, 0):
        got = {r.doc_id: r.ids for r in encode_texts(df, most=most).collect()}
        assert all(got[i] == tok.plain.encode_ordinary(t) for i, t in rows)
