"""Reading level of documents by gradient-boosted regression trees.

Each English sentence of running text is measured (length, vocabulary, syntax); a document's features are the
distributions of these measures over its sentences, its vocabulary's variety, and the cohesion of adjoining sentences.
Trees are fitted to the labelled rows, after the raters' own offsets were estimated and taken off. Out-of-fold predictions,
with whole sources (applications of ``clip_docs``, kinds of text of ``corpus``) held out in turn, give the calibration to the
scale of the labels (isotonic, with a knot in the middle of each pool, so that levels rise with the predictions) and the
threshold of the highest band, on the calibrated level. What is reported of a fold comes from the calibration and the
threshold of the other folds.

Sentences that are not English prose (other languages, log lines, tables, lines made of numbers and links) are not
measured. Defined results: null, empty and blank texts, and texts whose prose is mostly not English, have no level (null);
a row that comes twice has one level; without any usable label nothing has a level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm.boost import Boost, best_cut, folds, isotonic
from proseloom.llm.lookalike import may_be_mapped, plain_characters
from proseloom.session import written

#: The most labelled rows the trees are fitted to, in the order of a hash of their keys; the trees, the same for held-out folds and for all rows.
MAX_LABELS, TREES = 6_000, {"rounds": 120, "depth": 3, "rate": 0.1}
#: A sentence is English prose if of its characters at least LETTERS_SHARE are letters, of those at least LATIN_SHARE basic Latin ones in
#: words, and of its words, LEAST_WORDS at least, FUNCTION_SHARE function words.
LETTERS_SHARE, LATIN_SHARE, LEAST_WORDS, FUNCTION_SHARE = 0.6, 0.8, 3, 0.12
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n+|(?<=[。！？])")
WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")
LETTERS = re.compile(r"[^\W\d_]+")
VOWELS = re.compile(r"[aeiouy]+")
# Frequent English function words, connectives and subordinators, and endings of learned words.
FUNCTION = frozenset(
    "a about after again all an and any are as at be because been before but by can could did do for from had has have he her "
    "his how i if in into is it its just more most my no not now of off on once one or our out over own she should so some "
    "such than that the their them then there these they this those through to too under until up very was we were what when "
    "where which while who why will with would you your".split()
)
LINKS = frozenset("also although because but consequently furthermore hence however instead moreover nevertheless notwithstanding so then therefore though thus whereas whereby while yet".split())
SUBORDINATE = frozenset("after although as because before if once since so that though unless until when whenever where whereas whereby which while who whom whose".split())
LEARNED = re.compile(r"(?:tion|sion|ment|ity|ism|ance|ence|ical|ive|ous|ate|ise|ify|ology|ible|able|ship|ness|ic|ary)s?$")
MEASURES = ["words", "letters", "syllables", "long", "very_long", "function", "learned", "subordinate", "marks", "grade"]
QUANTILES = [0.2, 0.5, 0.8]
FEATURES = [f"{m}_{q}" for m in MEASURES for q in ("mean", *QUANTILES)] + [
    "hard_share", "very_hard_share", "variety", "cohesion", "links", "log_sentences", "log_words", "deviation",
]
#: All ASCII bytes but letters.
_OTHERS = bytes(c for c in range(128) if not chr(c).isalpha())


def letters_in(text: str) -> int:
    return len(text.encode().translate(None, _OTHERS)) if text.isascii() else len(text) - len(LETTERS.sub("", text))


@lru_cache(maxsize=200_000)
def word(w: str) -> tuple[int, int, bool, bool, bool, bool, bool, bool]:
    """Letters and syllables of a word, and whether it is long, very long, a function word, learned, a subordinator, a link."""
    syllables = max(1, len(VOWELS.findall(w)) - (w.endswith("e") and not w.endswith("le") and len(w) > 3))
    return len(w), syllables, len(w) >= 7, len(w) >= 11, w in FUNCTION, len(w) > 5 and LEARNED.search(w) is not None, w in SUBORDINATE, w in LINKS


@lru_cache(maxsize=50_000)
def sentence(text: str) -> tuple[tuple[float, ...], frozenset[str], int, int] | None:
    """The measures of an English sentence, its content words, connectives and words; a word count where it is not English."""
    letters = letters_in(text)
    if letters < LETTERS_SHARE * len(text):
        return (), frozenset(), 0, 0
    words = WORD.findall(text.lower())
    if len(words) < LEAST_WORDS or sum(map(len, words)) < LATIN_SHARE * letters:
        return (), frozenset(), 0, letters
    n = len(words)
    size, syllables, long, very_long, function, learned, subordinate, links = map(sum, zip(*map(word, words)))
    if function < FUNCTION_SHARE * n:
        return (), frozenset(), 0, letters
    measures = (
        n, size / n, syllables / n, long / n, very_long / n, function / n, learned / n, subordinate,
        text.count(",") + text.count(";") + text.count(":"), 0.39 * n + 11.8 * syllables / n - 15.59,
    )
    return measures, frozenset(words) - FUNCTION, links, letters


def features(text: str | None) -> list[float] | None:
    """The features of a document; None if it has no English prose or is mostly in other languages."""
    if not text:
        return None
    if not text.isascii():
        text = (plain_characters(text) if may_be_mapped(text) else text).replace("\u2019", "'")
    rows, sets, links, english, other = [], [], 0, 0, 0
    for s in SENTENCE.split(text):
        if not s:
            continue
        measures, content, n_links, letters = sentence(s)
        if measures:
            rows.append(measures)
            sets.append(content)
            links += n_links
            english += letters
        else:
            other += letters
    if not rows or english < other:
        return None
    m = np.array(rows)
    q = np.sort(m, axis=0)[[int(p * (len(m) - 1) + 0.5) for p in QUANTILES]]
    out = np.concatenate([m.mean(0)[None, :], q]).T.ravel().tolist()
    words = float(m[:, 0].sum())
    seen = set().union(*sets)
    overlap = [len(a & b) / max(1, min(len(a), len(b))) for a, b in pairwise(sets)]
    grade = m[:, -1]
    return out + [
        float((grade > 14).mean()), float((grade > 18).mean()), len(seen) / max(1, sum(map(len, sets))),
        float(np.mean(overlap)) if overlap else 0.0, links / len(rows), float(np.log(len(rows))), float(np.log(words)), float(grade.std()),
    ]


def level_features(texts: DataFrame) -> DataFrame:
    """(tbl, row_id, features, source) of the rows of (tbl, row_id, text, source) that have English prose, each once.

    Without a column ``source`` each table is one source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float32())), batch.column(3)], names=["tbl", "row_id", "features", "source"])

    source = "source" if "source" in texts.columns else F.col("tbl").alias("source")
    found = texts.select("tbl", "row_id", "text", source).where("text IS NOT NULL AND text <> ''")
    found = found.mapInArrow(run, "tbl string, row_id string, features array<float>, source string").where("features IS NOT NULL")
    return found.groupBy("tbl", "row_id").agg(F.first("features").alias("features"), F.min("source").alias("source"))


@dataclass
class LevelModel:
    """``cut`` is a threshold on the calibrated level."""

    trees: Boost
    knots: np.ndarray
    values: np.ndarray
    cut: float
    report: dict[str, float]
    by_source: dict[str, float] = field(default_factory=dict)

    def grade(self, x: np.ndarray) -> np.ndarray:
        """Levels on the scale of the labels."""
        return np.interp(self.trees.predict(x), self.knots, self.values)


def fit_levels(x: np.ndarray, band: np.ndarray, rater: np.ndarray, source: np.ndarray, top: int = 5) -> LevelModel | None:
    """Trees for rows of features with a band each; ``source`` names what is held out together."""
    if len(band) < 40:
        return None
    n_folds = min(3, len(set(source)))
    # a single source can't be held out
    fold, n_folds = (folds(source, n_folds), n_folds) if n_folds > 1 else (np.arange(len(band)) % 3, 3)
    target, oof = band.astype(float), np.zeros(len(band))
    for _ in range(2):  # the second time without the raters' offsets
        for k in range(n_folds):
            if (fold == k).any():
                oof[fold == k] = Boost(**TREES).fit(x[fold != k], target[fold != k]).predict(x[fold == k])
        for r in set(rater):
            mine = rater == r
            if mine.sum() >= 20:
                target[mine] = band[mine] - np.clip(np.mean(band[mine] - oof[mine]), -1, 1)
    trees = Boost(**TREES).fit(x, target)
    level, hit = np.zeros(len(band)), np.zeros(len(band), dtype=bool)
    for k in range(n_folds):
        mine = fold == k
        knots, values = isotonic(oof[~mine], target[~mine], strict=True)
        level[mine] = np.interp(oof[mine], knots, values)
        hit[mine] = level[mine] >= best_cut(np.interp(oof[~mine], knots, values), band[~mine] >= top)
    error = np.abs(level - target)
    found = {"rows": float(len(band)), "mean_error": float(error.mean()), "precision": float((band[hit] >= top).mean()) if hit.any() else 0.0, "recall": float(hit[band >= top].mean()) if (band >= top).any() else 0.0}
    knots, values = isotonic(oof, target, strict=True)
    cut = best_cut(np.interp(oof, knots, values), band >= top)
    return LevelModel(trees, knots, values, cut, found, {str(s): float(error[source == s].mean()) for s in sorted(set(source))})


def train_levels(found: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> LevelModel | None:
    """The model for the labelled rows among ``found`` (tbl, row_id, features, source); at most ``most`` rows are used, by a hash of their keys."""
    usable = labels.where("band BETWEEN 1 AND 5").select("tbl", "row_id", "band", F.coalesce("rater", F.lit("")).alias("rater"))
    usable = usable.withColumn("_h", F.pmod(F.xxhash64("tbl", "row_id"), F.lit(1 << 30)))
    n = usable.count()
    if n > most:  # a few more than that are fetched, and the last ones of their order left out
        usable = usable.where(F.col("_h") < int((1 << 30) * min(1.0, most / n + 4 * (most**0.5) / n)))
    rows = sorted(usable.join(found, ["tbl", "row_id"]).collect(), key=lambda r: (r["_h"], r.tbl, r.row_id, r.rater, r.band))[:most]
    if not rows:
        return None
    x = np.array([r.features for r in rows])
    band, rater = np.array([r.band for r in rows]), np.array([r.rater for r in rows])
    source = np.array([f"{r.tbl}-{r.source or ''}" for r in rows])
    return fit_levels(x, band, rater, source)


def graded(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(tbl, row_id, level, is_top) of every row with English prose."""
    found = written(level_features(texts), "level-features")
    model = train_levels(found, labels)
    found = found.select("tbl", "row_id", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            level = model.grade(x)
            columns = [batch.column(0), batch.column(1), pa.array(level, pa.float64()), pa.array(level >= model.cut, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["tbl", "row_id", "level", "is_top"])

    schema = "tbl string, row_id string, level double, is_top boolean"
    if model is None:
        return found.sparkSession.createDataFrame([], schema)
    return found.mapInArrow(run, schema)
