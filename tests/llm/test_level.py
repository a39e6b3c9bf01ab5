import numpy as np

from proseloom.llm import level
from proseloom.llm.boost import Boost, best_cut, folds, isotonic
from proseloom.llm.level import FEATURES, features, graded
from proseloom.llm.level_queries import p1_levels

EASY = ["The dog runs to the hill.", "We all go in and it is fun.", "A cat sits by the door now.", "The boy has a red ball."]
HARD = [
    "Heteroscedasticity notwithstanding, the epistemological presuppositions of methodological individualism remain practically indeterminate.",
    "Any normative justification of redistributive intervention problematises the ontological characterisation of institutional legitimacy.",
    "The conventional dichotomy between procedural and substantive rationality is a sedimented accumulation of terminological idiosyncrasies.",
]


def test_boost_learns_and_predicts_alike():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1]
    model = Boost(rounds=80).fit(x[:1500], y[:1500])
    assert np.mean((model.predict(x[1500:]) - y[1500:]) ** 2) < 0.15 * np.var(y)
    p = Boost("logistic", rounds=60).fit(x[:1500], x[:1500, 2] > 0).predict(x[1500:])
    assert ((p > 0) == (x[1500:, 2] > 0)).mean() > 0.95
    assert Boost(rounds=3).fit(np.ones((5, 2)), np.ones(5)).predict(np.ones((2, 2))).tolist() == [1.0, 1.0]


def test_calibration_parts():
    k, v = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 5]))
    assert (np.diff(v) >= 0).all() and np.interp(2.5, k, v) == 2.5
    assert 0.4 < best_cut(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.6
    f = folds(np.array(list("aaabbbccd")), 3)
    assert len(set(f[:3])) == 1 and len(set(f)) == 3


def test_features_of_odd_texts():
    assert features(None) is None and features("") is None and features(" \n ") is None and features("12 3,4 5.6\n" * 50) is None
    assert features("Das zweite Modell erklärt die Lücke nicht in den meisten Läufen.") is None
    assert len(features(" ".join(EASY))) == len(FEATURES) and len(features(" ".join(EASY * 5000))) == len(FEATURES)


def test_levels(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(160):
        hard = rng.random() < 0.5
        parts = [str(rng.choice(HARD if hard else EASY)) for _ in range(6)]
        rows.append(("clip_docs" if i % 2 else "corpus", str(i), " ".join(parts)))
        if i < 120:
            labels.append((rows[-1][0], str(i), 5 if hard else 1, f"r{i % 3}"))
    rows += [rows[0], ("corpus", "empty", ""), ("corpus", "null", None)]
    labels += [("corpus", "0", None, "r1"), ("corpus", "none", 3, None)]
    texts = spark.createDataFrame(rows, "tbl string, row_id string, text string")
    frame = spark.createDataFrame(labels, "tbl string, row_id string, band int, rater string")
    got = {r.row_id: r for r in graded(texts, frame).collect()}
    assert len(got) == 160
    for _, i, text in rows[:160]:
        assert got[i].is_top == (text[:3] not in ("The", "We ", "A c") or "dichotomy" in text or "epistem" in text or "normative" in text)
    assert graded(texts, frame.limit(0)).count() == 0 and graded(texts.limit(0), frame).count() == 0


def test_whole_sources_are_held_out(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    apps, kinds = ["mail", "Mail ", "wiki", None, " ", "UNKNOWN"], ["how-to", "blog-draft"]
    text = lambda hard: " ".join(str(rng.choice(HARD if hard else EASY)) for _ in range(6))
    docs = [(i, text(i % 2), apps[i % 6]) for i in range(60)]
    rows = [(f"{kinds[i % 2]}-{i:07}", text(i % 4 < 2)) for i in range(40)]
    labels = [("clip_docs", str(i), 5 if i % 2 else 1, "r1") for i in range(60)] + [("corpus", k, 5 if i % 4 < 2 else 1, "r2") for i, (k, _) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_key long, text string, app string").write.parquet(f"{tmp_path}/clip_docs.parquet")
    spark.createDataFrame(rows, "id string, text string").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame(labels, "tbl string, row_id string, band int, rater string").write.parquet(f"{tmp_path}/level_labels.parquet")
    seen = []
    monkeypatch.setattr(level, "folds", lambda groups, n: seen.append(set(groups)) or folds(groups, n))
    assert p1_levels(spark, str(tmp_path)).count() == 100
    assert seen == [{"clip_docs-mail", "clip_docs-wiki", "clip_docs-unknown", "corpus-how-to", "corpus-blog-draft"}]


def test_error_by_source_is_held_out():
    # the labels of one source follow a rule of their own, which a model can't know that has not seen it
    rng = np.random.default_rng(3)
    x, source = rng.normal(size=(600, 4)), np.repeat(["a", "b", "c", "odd"], 150)
    band = np.where((x[:, 0] > 0) != (source == "odd"), 5, 1)
    model = level.fit_levels(x, band, np.full(600, "r"), source)
    assert set(model.by_source) == {"a", "b", "c", "odd"} and model.by_source["odd"] > 2


def test_ties_are_pooled_and_cut_together():
    knots, values = isotonic(np.array([1.0, 1, 2, 2, 3]), np.array([1.0, 0, 1, 0, 1]))
    assert np.allclose(np.interp([1, 2, 3], knots, values), [0.5, 0.5, 1.0])
    knots, values = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 5]), strict=True)
    assert knots.tolist() == [1, 2.5, 4] and values.tolist() == [1, 2.5, 5]
    # half of the three rows of one score are right: they come in or stay out together
    assert best_cut(np.array([2.0, 2, 1, 1, 1, 0]), np.array([1, 1, 1, 1, 0, 0])) == 0.5
    assert best_cut(np.array([2.0, 2, 1, 1, 1, 1, 1, 1]), np.array([1, 1, 1, 0, 0, 0, 0, 0])) == 1.5


def test_rows_are_those_over_the_cut_of_the_calibrated_level():
    rng = np.random.default_rng(5)
    x, source = rng.normal(size=(900, 4)), np.array([f"s{i % 6}" for i in range(900)])
    band = np.clip(np.round(3 + x[:, 0] * 1.5 + rng.normal(0, 0.4, 900)), 1, 5).astype(int)
    model = level.fit_levels(x, band, np.full(900, "r"), source)
    assert 3.5 < model.cut < 5 and (np.diff(model.values) > 0).all()
    assert ((model.grade(x) >= model.cut) == (band == 5)).mean() > 0.9
    assert model.trees.rounds == level.TREES["rounds"] and model.trees.rate == level.TREES["rate"]


def test_short_sentences_count():
    # three words of less than eight characters make a sentence
    assert features("I am in. He is it. We do so.") is not None
