import json

import numpy as np
import pytest

from proseloom.llm.language import BUCKETS, MAX_NOISE, REJECT_BELOW, LanguageModel, calibrate, fit_language, segments_of, subwords, train_language, with_segments
from proseloom.llm.notebook import cells, prose

EN = ["The histogram compares both groups.", "A larger batch takes about a minute.", "The first column hides a weekly pattern.", "Each sensor needs a few more rows."]
DE = ["Das Histogramm vergleicht beide Gruppen.", "Die erste Spalte verdeckt ein Muster.", "Der Zeitraum läuft ungefähr eine Minute.", "Die nächste Zelle braucht noch einige Zeilen."]


def test_cells_of_each_format():
    nb = {"cells": [{"cell_type": "markdown", "source": ["# Head\n", "\n", "One two three four. Five six seven."]}, {"cell_type": "code", "source": "x = 'no prose here at all'", "outputs": [{"text": "It is output text."}]}, {"cell_type": "markdown", "source": "Plain string cell here."}, {"cell_type": "markdown", "source": None}, 5]}
    assert prose(json.dumps(nb), "ipynb") == [["One two three four.", "Five six seven."], ["Plain string cell here."]]
    percent = "# %% [markdown]\r\n# ## Head\r\n#\r\n# One two three four.\r\n\r\n# %% In[1]\r\n# a comment of some length\r\nx = 1\r\n#> Output of some length\r\n"
    assert prose(percent, "percent") == [["One two three four."]]
    md = "# Head\n\nOne two three four.\n\n```python\n# a comment of some length\n```\n\n    Output of some length here\n\n- A bullet of some length. \n- Another bullet there.\n\n$$ y = a x $$\n"
    assert prose(md, "markdown") == [["One two three four."], ["A bullet of some length.", "Another bullet there."]]
    for bad in (None, "", "  \n", "{broken", '{"cells": 3}', "[]"):
        for form in ("ipynb", "percent", "markdown", None):
            assert isinstance(prose(bad, form), list)
    assert cells("One two.", None) == ["One two."]


def test_subwords_of_odd_sentences():
    for s in ("", " ", "1", "é", "x" * 10000):
        assert subwords(s).dtype == np.int32
    assert len(subwords("")) > 0


@pytest.fixture(scope="module")
def model():
    sentences = (EN + DE) * 40
    labels = (["en"] * 4 + ["de"] * 4) * 40
    noisy = [("de" if i % 9 == 0 else v) for i, v in enumerate(labels)]
    return fit_language(sentences, noisy, list(range(len(sentences))))


def test_held_out_agreement_and_noise(model):
    # every sentence counts, those under a wrong label as well: one in nine has the label "de" whatever it is
    assert model.held_out["sentences"] == 320 and 0.9 < model.held_out["agreement"] < 0.97
    assert 0.02 < model.held_out["noise"] < 0.12 and model.held_out["right"] > 0.97 and model.held_out["kept"] > 0.97
    assert [model.read(EN + DE)[s][0] for s in EN + DE] == ["en"] * 4 + ["de"] * 4
    assert model.read(["Die letzte Spalte braucht eine Minute."])["Die letzte Spalte braucht eine Minute."][0] in ("de", None)
    assert fit_language(EN, ["en"] * 4, [1, 2, 3, 4]) is None


@pytest.mark.parametrize("n", [2, 3, 8])
def test_random_labels_give_a_model_that_rejects_everything(n):
    rng = np.random.default_rng(n)
    sentences = ["".join(rng.choice(list("abcdefghij "), 60)) for _ in range(600)]
    model = fit_language(sentences, [f"l{i}" for i in rng.integers(0, n, 600)], list(range(600)))
    assert model.held_out["agreement"] < 1.6 / n and model.held_out["noise"] > MAX_NOISE and model.held_out["kept"] == 0
    found = model.read(sentences)
    assert all(found[s][0] is None for s in sentences)


def test_calibration_follows_the_share_that_is_right():
    # two languages; six in ten sentences have a large margin and are right, the others are right in six of ten cases
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 4000)
    easy = np.arange(4000) < 2400
    said = np.where(easy | (rng.random(4000) < 0.6), y, 1 - y)
    z = np.where(np.arange(2)[None, :] == said[:, None], np.where(easy, 6.0, 1.0)[:, None], 0.0)
    temperature, knots, values, found = calibrate(z, y)
    p = np.exp(np.array([6.0, 1.0]) / temperature)
    high, low = np.interp(p / (1 + p), knots, values)
    assert high > 0.98 and 0.55 < low < 0.65 < REJECT_BELOW and abs(found["kept"] - 0.6) < 0.01


def test_segments(model):
    found = segments_of([EN[:2], DE[:3], EN[2:3]], model)
    assert [(s[0], s[2], s[3], s[4]) for s in found] == [("en", 2, 0, 0), ("de", 3, 1, 1), ("en", 1, 2, 2)]


def test_frames(spark):
    rows = [(i, "\n\n".join([" ".join(EN if i % 2 else DE)]), "EN-gb" if i % 2 else "de_DE", "markdown") for i in range(60)]
    rows += [(100, " ".join(DE), None, "markdown"), (101, None, "en", None), (102, "", " ", "ipynb"), (103, " ".join(EN), "und", "markdown"), (103, " ".join(EN), "und", "markdown")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, nb_format string")
    model = train_language(docs)
    got = {}
    for r in with_segments(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].label == "en" and got[0][0].label == "de" and got[100][0].label is None and len(got[103]) == 2
    assert [s.lang for s in got[100][0].segments] == ["de"] and got[101][0].segments == [] and got[103][0].segments[0].sentences == 4
    assert train_language(docs.limit(0)) is None and with_segments(docs.limit(0), None).count() == 0


def test_averages_do_not_depend_on_how_many_are_taken_together():
    rng = np.random.default_rng(1)
    model = LanguageModel(["a", "b"], rng.normal(size=(BUCKETS, 2)).astype(np.float32), np.eye(2), np.zeros(2))
    ids = [subwords(s) for s in [*EN, *DE, "x" * 9000, ""]]
    assert np.allclose(model.logits(ids), np.concatenate([model.logits([i]) for i in ids]), atol=1e-5)


def test_long_sentences_count_to_their_end():
    tail = "ein langer Absatz ohne Satzzeichen "
    assert subwords("1 " * 400 + tail).tolist() == subwords(tail).tolist()
    assert len(subwords(tail * 100)) > 4 * 2000
    table = np.random.default_rng(0).normal(size=(BUCKETS, 2)).astype(np.float32)
    model, long = LanguageModel(["a", "b"], table, np.eye(2), np.zeros(2)), subwords(tail * 1000)
    assert len(long) > BUCKETS
    z = table[long].astype(float).mean(0)
    assert np.allclose(model.scores([long])[0], np.exp(z) / np.exp(z).sum(), atol=1e-5)
