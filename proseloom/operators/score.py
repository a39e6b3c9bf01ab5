"""Scoring of benchmark rows: spans that were flagged, merged to islands, and the roll-ups by model."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.operators.running import before, sliced
from proseloom.session import written
from proseloom.sources.pack import SCORER_EXTRAS, Pack

SPANS = "array<struct<s: int, e: int, id: string, weight: int>>"


def scorer_rules(pack: Pack) -> list[tuple[str, str, int, int]]:
    """(id, pattern, flags, weight): detectors (case counts where they carry no flags of their own), words of the first tier,
    phrases without a replacement or with an empty one, and two shapes more."""
    rules = []
    for d in pack.detectors:
        if not _python_takes(d.pattern):
            continue  # written for Java only
        pattern = "[\u2600-\u27BF\u2B00-\u2BFF]" if d.id == "emoji" else d.pattern
        rules.append((d.id, pattern, re.MULTILINE | (re.IGNORECASE if "i" in d.given else 0), d.weight))
    for t in pack.tiers[:1]:
        rules += [(f"vocab:{w}", rf"\b{re.escape(w)}\b", re.IGNORECASE, 3) for w in t.words]
    rules += [(f"phrase:{p.match}", rf"\b{re.escape(p.match)}\b", re.IGNORECASE, 2) for p in pack.phrases if not p.fix]
    return rules + [(i, p, re.IGNORECASE, w) for i, p, w in SCORER_EXTRAS]


def _python_takes(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def tell_spans(pack: Pack):
    """A Column function: every flagged span of a text that is not empty, with its rule and weight; null gives none."""
    rules = scorer_rules(pack)
    literal = [(i, p, w) for i, p, f, w in rules if i.startswith(("vocab:", "phrase:"))]
    heads = "|".join(re.escape(i.split(":", 1)[1]) for i, _, _ in literal)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        shapes = [(i, re.compile(p, f), w) for i, p, f, w in rules if not i.startswith(("vocab:", "phrase:"))]
        words = [(i, re.compile(p, re.IGNORECASE), w) for i, p, w in literal]
        any_word = re.compile(heads, re.IGNORECASE) if heads else None

        def one(text: str | None) -> list[dict]:
            if not text:
                return []
            found = shapes + (words if any_word is not None and any_word.search(text) else [])
            return [{"s": m.start(), "e": m.end(), "id": i, "weight": w} for i, rx, w in found for m in rx.finditer(text) if m.end() > m.start()]

        return texts.map(one)

    return spans


def islands(spans: Column) -> Column:
    """How many islands the spans of an array make; spans that only touch are two."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))

    def add(a: Column, x: Column) -> Column:
        new = x["s"] >= a["end"]
        return F.struct((a["n"] + new.cast("long")).alias("n"), F.when(new, x["e"]).otherwise(F.greatest(a["end"], x["e"])).alias("end"))

    return F.aggregate(F.array_sort(spans), start, add, lambda a: a["n"])


def island_rows(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, island, start, end, n) of intervals in rows: the union of those that overlap, for each key."""
    seen = before(sliced(rows, keys, [start, end]), keys, [start, end], F.col(end), "_high")
    seen = written(seen.withColumn("_new", (F.col("_high").isNull() | (F.col(start) >= F.col("_high"))).cast("long")), "islands")
    numbered = before(seen, keys, [start, end], F.col("_new"), "_n", "sum")
    numbered = numbered.withColumn("island", F.coalesce("_n", F.lit(0)) + F.col("_new"))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def facts_lost(facts: Column, output: Column) -> Column:
    """Facts that don't stand in the output; a null output has lost them all, a null list has none."""
    out = F.coalesce(output, F.lit(""))
    return F.coalesce(F.size(F.filter(facts, lambda f: f.isNotNull() & ~F.contains(out, f))), F.lit(0)).cast("long")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row of each key: that with the greatest ``by``, then with the greatest hash of the rest.

    Pre-aggregates before the shuffle, so a hot key is no hot task. Every column of ``rows`` is read and shuffled: select first.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(by), F.xxhash64(*[F.col(c).cast("string") for c in rest])))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def model_rollup(rows: DataFrame) -> DataFrame:
    """For each model: runs, rewrites, rejections, facts lost, median time, time to load and memory of its first row by run and id.

    ``rows`` has the facts lost as ``lost``.
    """
    first = F.struct("run", "id")
    return rows.groupBy("model").agg(
        (F.max("run") + 1).cast("long").alias("runs"), F.count("*").alias("rewrites"), F.count("rejected").alias("rejected"), F.sum("lost").alias("facts_lost"),
        F.median("ms").alias("median_ms"), F.min_by("load_ms", first).alias("load_ms"), F.min_by("vram_mib", first).alias("vram_mib"),
    )


def drop_against(rows: DataFrame, base: int) -> DataFrame:
    """(model, runs, tells, tells_per_run, drop_pct) of rows with counts as ``output``: a run's tells against the baseline's of one pass over
    the samples; nothing drops where the baseline has none."""
    out = rows.groupBy("model").agg((F.max("run") + 1).cast("long").alias("runs"), F.sum("output").alias("tells"))
    per_run = F.col("tells") / F.col("runs")
    drop = F.round(100 * (1 - per_run / F.lit(float(base))), 6) if base else F.lit(0.0)
    return out.select("model", "runs", "tells", F.round(per_run, 6).alias("tells_per_run"), drop.alias("drop_pct"))


def rejection_reasons(rows: DataFrame) -> DataFrame:
    return rows.where("rejected IS NOT NULL").groupBy("model", "rejected").agg(F.count("*").alias("n"))


def top_hits(rows: DataFrame, spans: str, k: int = 6) -> DataFrame:
    """The rules whose spans survive most often, by model: the first k by count, then by name."""
    hits = rows.select("model", F.explode(spans).alias("x")).groupBy("model", F.col("x.id").alias("rule")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("model").orderBy(F.desc("n"), "rule")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def sample_means(rows: DataFrame, value: str) -> DataFrame:
    """Mean of ``value`` for each id and model."""
    return rows.groupBy("id", "model").agg(F.avg(value).alias("mean"))


def sample_table(rows: DataFrame, value: str, models: list[str]) -> DataFrame:
    """The same as one column for each of ``models``."""
    return rows.groupBy("id").pivot("model", models).agg(F.avg(value))


def samples(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, ``columns``) of each sample once: from the first run of the first model by name, whose inputs and baselines all models share."""
    first = rows.agg(F.min("model")).first()[0]
    return rows.where(F.col("model").eqNullSafe(F.lit(first))).groupBy("id").agg(F.min_by(F.struct(*columns), "run").alias("_s")).select("id", "_s.*")


def corpus_totals(counted: DataFrame) -> DataFrame:
    """Samples, and their tells as they came and after the rules alone, of (id, input, baseline) with counts."""
    return counted.agg(F.count("*").alias("samples"), F.coalesce(F.sum("input"), F.lit(0)).alias("input"), F.coalesce(F.sum("baseline"), F.lit(0)).alias("baseline"))


def probe_totals(rows: DataFrame) -> DataFrame:
    """For each model: probe scores before and after, and rejections; a rejected run keeps its score before."""
    after = F.when(F.col("rejected").isNotNull() | F.col("after").isNull(), F.col("before")).otherwise(F.col("after"))
    return rows.groupBy("model").agg(F.sum("before").alias("before"), F.sum(after).alias("after"), F.count("rejected").alias("rejected"))
