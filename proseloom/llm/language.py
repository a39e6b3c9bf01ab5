"""Languages of documents and of stretches of them: averaged hashed subword embeddings with a linear softmax.

A sentence is the set of its character sequences of one to four, hashed to rows of an embedding table; their mean goes
through a linear softmax. Both are trained by stochastic gradient descent in numpy on sentences of labelled documents, a
bounded sample with at most DOCS_A_LANGUAGE documents of each language.

Labels are wrong now and then, and a document of two languages has one label. So calibration works as follows.

1. Documents are dealt to FOLDS folds. Every sentence is read by a model that has not seen its document; where that model
   gives another language than the label, the sentence is left out of what the second models (and the last one) are trained on.
2. The second models, again one for each fold, read every sentence of the documents they have not seen. All of these count
   in what follows: none is left out because a model and its label disagree.
3. Label noise is, for each language told, the share of disagreement in the more confident half (a sample with as many
   documents of each label has many sentences of the most frequent language under the labels of the others). The
   temperature of the softmax is the one under which the labels, as they are, are most likely, given that noise. Its
   probability is mapped, by isotonic regression, to the share of sentences that were right at it, the noise taken off;
   this share is the confidence given out, and a sentence for which it is under REJECT_BELOW is rejected. If noise
   is over MAX_NOISE in the mean every sentence is rejected: labels that say nothing give a model that says nothing.

Sentences of one language in a row make a segment; a segment of one sentence does not count as a stretch. Defined results:
null, empty and blank texts, and texts without sentences in text cells, have no segment; repeated rows give the same
segments each; a label of any spelling counts by its language part, null, blank and "und" as missing; fewer than two
languages among the labels give no model and no segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm.boost import isotonic
from proseloom.llm.notebook import prose

LANGUAGES = ["de", "en", "es", "fr", "it", "ja", "pt", "ru"]
#: Bounds of the training sample (longer sentences are no examples), and the model's size.
DOCS_A_LANGUAGE, SENTENCES_A_DOC, EXAMPLE_CHARS, BUCKETS, DIM = 250, 8, 2_000, 1 << 15, 16
#: Sentences whose languages a worker remembers, and subwords that are averaged at a time.
CACHE, AT_A_TIME = 60_000, 1 << 17
#: The least confidence with which a sentence gets a language, the most label noise that is believed, and folds.
REJECT_BELOW, MAX_NOISE, FOLDS = 0.8, 0.25, 2
TEMPERATURES = [0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
_OTHER = re.compile(r"[^\w']+|[\d_]+")


def subwords(sentence: str) -> np.ndarray:
    """Rows of the embedding table for a sentence."""
    text = " " + " ".join(_OTHER.sub(" ", sentence.lower()).split()) + " "
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    out, h = [], code * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :] * np.uint64(0x94D049BB133111EB)
            out.append((h >> np.uint64(40)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int32)


def softmax(z: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = z / temperature
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    """``knots`` and ``values`` map the probability of a language to the confidence in it."""

    languages: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    held_out: dict[str, float] = field(default_factory=dict)
    cache: dict[str, tuple[str | None, float]] = field(default_factory=dict, repr=False)

    def logits(self, ids: list[np.ndarray]) -> np.ndarray:
        """Those of sentences as rows of the table, many at a time."""
        mean, i = np.empty((len(ids), self.table.shape[1]), dtype=np.float32), 0
        while i < len(ids):
            if len(ids[i]) >= BUCKETS:  # of a long sentence the rows are counted, so that it takes no more memory than the table
                mean[i] = np.bincount(ids[i], minlength=BUCKETS) @ self.table / len(ids[i])
                i += 1
                continue
            j, total = i, 0
            while j < len(ids) and len(ids[j]) < BUCKETS and total < AT_A_TIME:
                total += len(ids[j])
                j += 1
            sizes = np.array([len(x) for x in ids[i:j]])
            mean[i:j] = np.add.reduceat(self.table[np.concatenate(ids[i:j])], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            i = j
        return mean @ self.weights + self.bias

    def scores(self, ids: list[np.ndarray]) -> np.ndarray:
        return softmax(self.logits(ids), self.temperature)

    def read(self, sentences: list[str]) -> dict[str, tuple[str | None, float]]:
        """For each sentence the language (None if no one is likely enough) and the confidence."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        new = [s for s in dict.fromkeys(sentences) if s not in self.cache]
        if new:
            p = self.scores([subwords(s) for s in new])
            sure = np.interp(p.max(1), self.knots, self.values)
            for s, k, c in zip(new, p.argmax(1).tolist(), sure.tolist()):
                self.cache[s] = (self.languages[k] if c >= REJECT_BELOW else None, c)
        return self.cache


def _descend(ids: list[np.ndarray], y: np.ndarray, n: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, n)).astype(np.float32), np.zeros(n, dtype=np.float32)
    seen_t, seen_w = np.full((BUCKETS, 1), 1e-6, dtype=np.float32), np.full((DIM, n), 1e-6, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            batch = [ids[i] for i in rows]
            sizes = np.array([len(i) for i in batch])
            flat = np.concatenate(batch)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(table[flat], starts, axis=0) / sizes[:, None]
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = (p @ w.T) / sizes[:, None]
            gw = mean.T @ p / len(rows)
            order_t = np.argsort(flat.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting
            at_t = flat[order_t]
            first = np.flatnonzero(np.append(True, at_t[1:] != at_t[:-1]))
            used = at_t[first]
            gt = np.add.reduceat(np.repeat(back.astype(np.float32), sizes, axis=0)[order_t], first, axis=0)
            seen_w += gw**2
            w -= 0.3 * gw / np.sqrt(seen_w)
            b -= 0.1 * p.mean(0)
            seen_t[used] += (gt**2).mean(1, keepdims=True)
            table[used] -= 0.3 * gt / np.sqrt(seen_t[used])
    return table, w, b


def calibrate(z: np.ndarray, y: np.ndarray, most_noise: float = MAX_NOISE) -> tuple[float, np.ndarray, np.ndarray, dict[str, float]]:
    """Temperature, the calibration of its confidence (knots and values) and figures, from logits of held-out sentences, all of
    them, and their labels as they are."""
    n, rows = z.shape[1], np.arange(len(y))
    told, sure = z.argmax(1), softmax(z).max(1)
    agree, noise = told == y, np.zeros(n)
    for m in set(told.tolist()):
        own = told == m
        noise[m] = 1 - agree[own & (sure >= np.median(sure[own]))].mean()
    found = {"sentences": float(len(y)), "agreement": float(agree.mean()), "noise": float(noise[told].mean()), "kept": 0.0, "right": 0.0}
    if found["noise"] > most_noise:
        return 1.0, np.array([0.0]), np.array([0.0]), found

    def loss(temperature: float) -> float:
        p = softmax(z, temperature)
        wrong = (p * noise).sum(1) - p[rows, y] * noise[y]
        return -float(np.log(np.maximum(p[rows, y] * (1 - noise[y]) + wrong / (n - 1), 1e-12)).mean())

    temperature = min(TEMPERATURES, key=loss)
    best = softmax(z, temperature).max(1)
    knots, values = isotonic(best, agree / (1 - noise[told]))
    values = np.minimum(values, 1.0)
    kept = np.interp(best, knots, values) >= REJECT_BELOW
    right = float(agree[kept].sum() / (1 - noise[told[kept]]).sum()) if kept.any() else 0.0
    return temperature, knots, values, found | {"kept": float(kept.mean()), "right": min(1.0, right)}


def fit_language(sentences: list[str], labels: list[str], docs: list[int], epochs: int = 3, seed: int = 3) -> LanguageModel | None:
    """A model from labelled sentences of documents, calibrated on what models of the other folds say of each."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return None
    ids = [subwords(s) for s in sentences]
    y = np.array([languages.index(v) for v in labels])
    own = sorted(set(docs))
    n = min(FOLDS, len(own))
    place = {d: i for i, d in enumerate(np.random.default_rng(seed).permutation(len(own)).tolist())}
    fold = np.array([place[i] % n for i in np.searchsorted(own, docs)])

    def trained(rows: np.ndarray) -> LanguageModel:
        return LanguageModel(languages, *_descend([ids[i] for i in rows], y[rows], len(languages), epochs, seed))

    keep, z = np.ones(len(y), dtype=bool), np.zeros((len(y), len(languages)))
    for _ in range(2):
        for k in range(n):
            out = np.flatnonzero(fold == k)
            rows = np.flatnonzero((fold != k) & keep)
            z[out] = trained(rows).logits([ids[i] for i in out]) if len(rows) else 0.0
        keep = z.argmax(1) == y
    model = trained(np.flatnonzero(keep) if keep.any() else np.arange(len(y)))
    model.temperature, model.knots, model.values, model.held_out = calibrate(z, y)
    return model


def label_language(label: Column) -> Column:
    """The language part of a label, null where it is missing."""
    part = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]+)", 1)
    return F.when(~part.isin("", "und", "unknown", "none", "null"), part)


def train_language(docs: DataFrame, languages: list[str] = LANGUAGES, most: int = DOCS_A_LANGUAGE) -> LanguageModel | None:
    """A model from (doc_id, text, lang, nb_format): a sample by hash with about ``most`` documents a language."""
    own = docs.withColumn("_l", label_language(F.col("lang"))).where(F.col("_l").isin(languages))
    counts = {r["_l"]: r["count"] for r in own.groupBy("_l").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * most / n))])
    picked = own.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share[F.col("_l")] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [s for cell in prose(t, f) for s in cell if len(s) <= EXAMPLE_CHARS][:SENTENCES_A_DOC]
                for t, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "l", "sentences"])

    rows = picked.select("doc_id", "_l", "text", "nb_format").mapInArrow(run, "doc_id long, l string, sentences array<string>").where("size(sentences) > 0").collect()
    used: dict[str, int] = {}
    sentences, labels, ids = [], [], []
    for r in sorted(rows, key=lambda r: r.doc_id):
        used[r.l] = used.get(r.l, 0) + 1
        if used[r.l] <= most:
            sentences += r.sentences
            labels += [r.l] * len(r.sentences)
            ids += [r.doc_id] * len(r.sentences)
    return fit_language(sentences, labels, ids)


def segments_of(cells: list[list[str]], model: LanguageModel) -> list[tuple[str, float, int, int, int]]:
    """(language, confidence, sentences, first cell, last cell) of the stretches of a document, in order.

    A sentence without a sure language goes with the stretch it stands in.
    """
    found: list[list] = []
    read = model.read([s for cell in cells for s in cell])
    for i, cell in enumerate(cells):
        for s in cell:
            lang, p = read[s]
            if lang is None:
                continue
            if found and found[-1][0] == lang:
                found[-1][1] += p
                found[-1][2] += 1
                found[-1][4] = i
            else:
                found.append([lang, p, 1, i, i])
    return [(lang, total / n, n, a, b) for lang, total, n, a, b in found]


SEGMENTS = "array<struct<lang: string, confidence: double, sentences: int, first_cell: int, last_cell: int>>"


def with_segments(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, label, segments) of every row of (doc_id, text, lang, nb_format). No shuffle."""
    kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("first_cell", pa.int32()), ("last_cell", pa.int32())]))
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prose(t, f) if model else [] for t, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            if model:
                model.read([s for cells in found for cell in cells for s in cell])
            found = [[dict(zip(names, s)) for s in segments_of(cells, model)] for cells in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["doc_id", "label", "segments"])

    chosen = docs.select("doc_id", label_language(F.col("lang")).alias("label"), "text", "nb_format")
    return chosen.mapInArrow(run, f"doc_id long, label string, segments {SEGMENTS}")
