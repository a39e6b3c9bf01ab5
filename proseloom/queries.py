"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom import goldens
from proseloom.functions import codecs, markup
from proseloom.functions.clean import clean_texts
from proseloom.functions.facts import fact_spans, protect, restore, violation
from proseloom.functions.text import is_blank, spaced_words, word_count
from proseloom.operators import chunk, detect, gates, score
from proseloom.operators.running import before
from proseloom.plans import prompts, rewrite
from proseloom.session import distinct_by, spread, table
from proseloom.sources.pack import DETECTORS, SCORER_EXTRAS, Detector, Pack, Tier, pack_from_tables
from proseloom.streaming import jobs

#: Sentences that are put to the texts of derived queries, one for each kind of finding.
SAMPLES = [
    "It holds — mostly — and ends.", "They wrote “done” twice.", "Launch day ☀ came.", "The tool is not only quick but kind.", "It’s not a bug, it’s a habit.", "Not a list. Not a table.", "Sales rose, highlighting the trend.",
    "The hall serves as a gym.", "Studies show a rise.", "Feel free to ask.", "Based on available information it rained.", "It may possibly rain.", "Only time will tell.", "This is a testament to work.", "Here's the thing we saw.",
    "At its core it is a pump.", "The stakes are high.", "The data tells us more.", "\n- **Name**: value\n", "Red, green, and blue lamps.", "See pages 10–12 – now.", "Nothing to see here.",
]
ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’', 'abcdefghijklmnopqrstuvwxyz''''')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of clip_docs; those that were delivered again are still there."""
    return spread(table(spark, sf_dir, "clip_docs").select("doc_key", "text"))


def _each(df: DataFrame, *columns: str | Column) -> DataFrame:
    """What was computed of each record, once: the texts stay where they are scanned, only results are shuffled."""
    return distinct_by(df.select("doc_key", *columns), "doc_key")


def _rows(df: DataFrame, column: str, to: str, *keep: str) -> DataFrame:
    """(``keep``, ``to``) for each element of an array. Outer: of a plain explode a filter is made that computes the array once more, before the shuffle."""
    return df.select(*keep, F.explode_outer(column).alias(to)).where(F.col(to).isNotNull())


def _whole(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Every record once, where its text is the result."""
    return distinct_by(table(spark, sf_dir, "clip_docs").select("doc_key", *columns), "doc_key")


def _pack(spark: SparkSession, sf_dir: str) -> Pack:
    return pack_from_tables(spark, table(spark, sf_dir, "rules_vocab"), table(spark, sf_dir, "rules_phrase"))


def _derived(spark: SparkSession, sf_dir: str, pack: Pack, docs: DataFrame | None = None) -> DataFrame:
    """The records with two words of the vocabulary and one sample sentence put to their texts."""
    words = F.array(*[F.lit(w) for t in pack.tiers for w in t.words])
    n = sum(len(t.words) for t in pack.tiers)
    key, one = F.col("doc_key"), lambda i: F.get(words, i.cast("int"))
    sample = F.element_at(F.array(*map(F.lit, SAMPLES)), (key % len(SAMPLES) + 1).cast("int"))
    docs = _docs(spark, sf_dir) if docs is None else docs
    return docs.select("doc_key", F.concat("text", F.lit(" "), one(key % n), F.lit(" "), one((key * 7 + 3) % n), F.lit(" "), sample).alias("text"))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Pack]:
    """The derived records with their findings."""
    pack = _pack(spark, sf_dir)
    return detect.with_findings(_derived(spark, sf_dir, pack), pack), pack


def _bench(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """(model, run, id, ``columns``) of every benchmark row once: of equal keys the one that was logged last. Only what is asked for is read."""
    rows = spread(table(spark, sf_dir, "bench_rows")).select("model", "run", "id", F.col("logged_at").alias("_by"), *columns)
    return score.latest(rows, ["model", "run", "id"], "_by").drop("_by")


# ---- texts and findings -------------------------------------------------------------------------------------------------


def doc_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_docs(spark, sf_dir), word_count(F.col("text")).alias("words"), is_blank(F.col("text")).alias("blank"))


def vocab_hits_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = _pack(spark, sf_dir)

    def of_tier(t: Tier) -> Column:
        return F.transform(detect.occurrences(F.col("text"), t.words), lambda w: F.struct(F.lit(t.number).alias("tier"), w.alias("word")))

    found = _each(_derived(spark, sf_dir, pack), F.concat(*[of_tier(t) for t in pack.tiers]).alias("hits"))
    found = _rows(found, "hits", "h", "doc_key").select("doc_key", "h.*")
    return found.groupBy("tier", "word").agg(F.countDistinct("doc_key").alias("docs"), F.count("*").alias("hits"))


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _each(_docs(spark, sf_dir), F.transform(detect.phrase_findings(F.col("text"), _pack(spark, sf_dir), 0), lambda f: f["matched"]).alias("hits"))
    return _rows(found, "hits", "match_text").groupBy("match_text").agg(F.count("*").alias("docs"))


def regex_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = _pack(spark, sf_dir)

    def of_detector(d: Detector) -> Column:
        return F.transform(detect.matches(F.col("text"), d), lambda m: F.struct(F.lit(d.id).alias("id"), m.alias("matched")))

    found = _each(_derived(spark, sf_dir, pack), F.concat(*map(of_detector, pack.detectors)).alias("hits"))
    return _rows(found, "hits", "f", "doc_key").groupBy(F.col("f.id").alias("detector")).agg(F.countDistinct("doc_key").alias("docs"), F.count("*").alias("hits"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every record, in order."""
    found = _each(_found(spark, sf_dir)[0], "findings")
    return found.select("doc_key", F.posexplode_outer("findings").alias("place", "f")).where("place IS NOT NULL").select("doc_key", F.col("place").cast("long").alias("place"), "f.id", "f.matched", "f.category", "f.weight", "f.tier")


def finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("findings")
    return _each(_found(spark, sf_dir)[0], F.size(f).cast("long").alias("n"), detect.repair_score(f).alias("repair"), detect.gate_score(f).alias("gate"), detect.probe_score(f).alias("probe"))


def tier_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record, the words of the gated tiers that are there, and whether the gate lets them through."""
    found, pack = _found(spark, sf_dir)
    count = lambda n: F.size(F.filter("findings", lambda f: f["tier"] == n)).cast("long")
    distinct = F.size(F.array_distinct(detect.occurrences(F.col("text"), pack.tiers[1].words))).cast("long")
    return _each(found, distinct.alias("tier2_words"), (count(2) > 0).alias("tier2_passed"), (count(3) > 0).alias("tier3_passed"))


def finding_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("findings")
    return _each(_found(spark, sf_dir)[0], F.size(detect.checklist(f)).cast("long").alias("listed"), F.size(detect.repair_targets(f)).cast("long").alias("targets"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived text after the mechanical fixes."""
    pack = _pack(spark, sf_dir)
    return clean_texts(_derived(spark, sf_dir, pack, _whole(spark, sf_dir, "text")), pack).select("doc_key", "cleaned", F.col("fixes").cast("long").alias("fixes"))


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of every record after the mechanical fixes."""
    return rewrite.clean_documents(_whole(spark, sf_dir, "kind", "html", "text"), _pack(spark, sf_dir))


def dash_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes of the texts, and hyphens and dashes after cleaning with a pack without phrases: each dash has become one hyphen."""
    out = clean_texts(_docs(spark, sf_dir), Pack((), (), ()))
    count = lambda c: F.regexp_count("cleaned", F.lit(c)).cast("long")
    return _each(out, F.col("fixes").cast("long").alias("dashes"), count("-").alias("hyphens"), count("[–—]").alias("left_over"))


# ---- facts --------------------------------------------------------------------------------------------------------------


def fact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _each(_docs(spark, sf_dir), F.transform(fact_spans("text"), lambda s: s["kind"]).alias("kinds"))
    return _rows(found, "kinds", "kind", "doc_key").groupBy("kind").agg(F.countDistinct("doc_key").alias("docs"), F.count("*").alias("spans"))


def protected_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text with placeholders and the number of values of every record."""
    return _whole(spark, sf_dir, "text").select("doc_key", protect("text").alias("p")).select("doc_key", "p.text", F.size("p.values").cast("long").alias("n_values"))


def protect_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every text protected and restored; null where the text itself holds a token, which restoring refuses."""
    out = _docs(spark, sf_dir).withColumn("p", protect("text"))
    return _each(out, F.md5(restore(F.col("p.text"), F.col("p.values"))["text"].cast("binary")).alias("digest"))


def restored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protected texts with their values put back."""
    return _each(spread(table(spark, sf_dir, "protected_texts")), F.md5(restore(F.col("text"), F.col("fact_values"))["text"].cast("binary")).alias("digest"))


def restore_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found wrong when the first token is dropped, repeated, or an unknown one is put to the end."""
    rows = spread(table(spark, sf_dir, "protected_texts"))
    cases = {"dropped": F.replace("text", F.lit("[[F00]]"), F.lit("")), "repeated": F.concat("text", F.lit("[[F00]]")), "invented": F.concat("text", F.lit("[[F9999]]"))}
    n = F.size("fact_values")
    judged = [F.struct(F.lit(k).alias("change"), violation(a, n)["kind"].alias("kind"), violation(a, n, may_drop=True)["kind"].alias("loose_kind")) for k, a in cases.items()]
    return _rows(_each(rows, F.array(*judged).alias("c")), "c", "x", "doc_key").select("doc_key", "x.*")


# ---- chunks and gates ---------------------------------------------------------------------------------------------------


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of paragraphs of every record with no paragraph over 6,000 code points."""
    sizes = F.transform(chunk.chunks(F.col("text"), 400, 6000), lambda p: F.length(p).cast("long"))
    return _each(_docs(spark, sf_dir), sizes.alias("sizes")).select("doc_key", F.posexplode_outer("sizes").alias("chunk", "size")).where("chunk IS NOT NULL").withColumn("chunk", F.col("chunk").cast("long"))


def too_long_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and groups of paragraphs by the gate of their size."""
    parts = rewrite.split_documents(_docs(spark, sf_dir).withColumnRenamed("doc_key", "doc_id"))
    own = distinct_by(parts.select("doc_id", "gate", "chunk"), "doc_id")
    return own.groupBy("gate").agg(F.countDistinct("doc_id").alias("docs"), F.count("chunk").alias("chunks"))


def answer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("input"), F.col("output")
    return _bench(spark, sf_dir, gates.length_gate(a, b).alias("length_gate"), gates.shorter_gate(a, b).alias("shorter_gate"), gates.commentary(a, b).alias("commentary"))


def kept_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chunk.keep_paragraphs(F.col("baseline"), F.col("output"))
    return _bench(spark, sf_dir, F.md5(kept.cast("binary")).alias("kept")).where("kept IS NOT NULL")


def answer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewriting plan over the benchmark's inputs with its outputs as the answers, one document for each row."""
    rows = _bench(spark, sf_dir, "input", "output").withColumn("doc_id", F.xxhash64("model", "run", "id"))
    answers = rows.select("doc_id", F.lit(0).alias("chunk"), F.lit("edit").alias("stage"), F.lit(0).alias("draw"), F.col("output").alias("answer"), F.lit(None).cast("string").alias("error"))
    parts = rows.select("doc_id", F.lit(0).alias("chunk"), F.col("input").alias("part"))
    judged = rewrite.judge(parts.withColumn("part", protect("part")["text"]), answers.withColumn("answer", protect("answer")["text"]), _pack(spark, sf_dir))
    return judged.groupBy(F.coalesce(F.col("rejected.kind"), F.lit("accepted")).alias("decision")).agg(F.count("*").alias("rows"))


def prompt_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length a summary of each record is asked for."""
    text = F.col("text")
    return _each(_docs(spark, sf_dir), spaced_words(text).alias("words"), prompts.target_words(text).alias("target"))


# ---- scoring ------------------------------------------------------------------------------------------------------------


def latest_bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir, "ms", "vram_mib", F.coalesce(F.length("output"), F.lit(-1)).cast("long").alias("n_output"))


def latest_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as it was delivered last."""
    rows = table(spark, sf_dir, "clip_docs").select("doc_key", "kind", "app", "loaded_at", F.length("text").cast("long").alias("n"))
    return score.latest(rows, ["doc_key"], "loaded_at")


def model_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.model_rollup(_bench(spark, sf_dir, "ms", "rejected", "load_ms", "vram_mib", score.facts_lost(F.col("facts"), F.col("output")).alias("lost")))


def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.rejection_reasons(_bench(spark, sf_dir, "rejected"))


def _tells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(model, run, id, output) with the tells of each output, and those that the samples' baselines have in one pass."""
    spans = score.tell_spans(_pack(spark, sf_dir))
    base = score.samples(_bench(spark, sf_dir, "baseline"), "baseline").select(F.lit(0).alias("input"), score.islands(spans("baseline")).alias("baseline"))
    return _bench(spark, sf_dir, score.islands(spans("output")).alias("output")), score.corpus_totals(base).first()["baseline"]


def model_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model: tells of its outputs, for each run, and the drop against the baseline."""
    return score.drop_against(*_tells(spark, sf_dir))


def sample_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean tells left in each sample by each model."""
    return score.sample_means(_tells(spark, sf_dir)[0], "output").select("id", "model", F.round("mean", 6).alias("mean"))


def surviving_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six rules that hit each model's outputs most often."""
    spans = score.tell_spans(_pack(spark, sf_dir))
    return score.top_hits(_bench(spark, sf_dir, spans("output").alias("spans")).select("model", "spans"), "spans")


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tells of the benchmark's samples, raw and after the rules alone."""
    spans = score.tell_spans(_pack(spark, sf_dir))
    own = score.samples(_bench(spark, sf_dir, "input", "baseline"), "input", "baseline")
    return score.corpus_totals(own.select(*[score.islands(spans(c)).alias(c) for c in ("input", "baseline")]))


def probe_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe scores of inputs and outputs by model."""
    pack = _pack(spark, sf_dir)
    rows = spread(table(spark, sf_dir, "bench_rows").select("model", "run", "id", F.col("logged_at").alias("_by"), "rejected", "input", "output"))
    rows = detect.with_findings(detect.with_findings(rows, pack, "input", "_a"), pack, "output", "_b")
    after = F.when(F.col("output").isNotNull(), detect.probe_score(F.col("_b"))).alias("after")
    rows = rows.select("model", "run", "id", "_by", "rejected", detect.probe_score(F.col("_a")).alias("before"), after)
    return score.probe_totals(score.latest(rows, ["model", "run", "id"], "_by"))


def busy_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of time in which rewrites of one model overlapped."""
    rows = _bench(spark, sf_dir, "ms", "finished_at").where("ms IS NOT NULL AND finished_at IS NOT NULL")
    end = F.unix_micros(F.col("finished_at").cast("timestamp"))
    return score.island_rows(rows.select("model", (end - F.col("ms") * 1000).alias("s"), end.alias("e")), ["model"], "s", "e")


# ---- markup and clipboard -----------------------------------------------------------------------------------------------


def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "clip_docs").where("html IS NOT NULL").select("doc_key", "html")).select("doc_key", markup.shape("html").alias("s"))
    return _each(rows, *[F.col(f"s.{c}").cast("long").alias(c) for c in ("tables", "links", "list_items")])


def shape_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every page is lost in its text alone, and in Markdown and back, where nothing is."""
    rows = spread(table(spark, sf_dir, "clip_docs").where("html IS NOT NULL").select("doc_key", "html")).select("doc_key", markup.shape("html").alias("a"), markup.shape(markup.html_of(markup.markdown_of("html"))).alias("b"))
    none = F.struct(*[F.lit(0).alias(c) for c in ("tables", "links", "list_items")])
    return _each(rows, gates.lost(F.col("a"), none).alias("of_text"), gates.lost(F.col("a"), F.col("b")).alias("of_markdown"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir, "html", "text").select("doc_key", markup.preview("html", "text").alias("preview"))


def word_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what the word diff of baseline and output says was there before and is there after."""
    diff = F.regexp_replace(markup.word_diff("baseline", "output"), "^<pre>|</pre>$", "")

    def side(gone: str, kept: str) -> Column:
        text = F.regexp_replace(F.regexp_replace(diff, f"(?s)<{gone}>.*?</{gone}>", ""), f"</?{kept}>", "")
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(sign))
        return F.md5(text.cast("binary"))

    return _bench(spark, sf_dir, side("ins", "del").alias("was"), side("del", "ins").alias("became"))


def payload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipboard payloads of every page: their bytes, and the digest of the fragment that is read back from them."""
    rows = spread(table(spark, sf_dir, "clip_docs").where("html IS NOT NULL").select("doc_key", "html")).select("doc_key", codecs.build_payload(F.col("html")).alias("payload"))
    return _each(rows, F.octet_length("payload").cast("long").alias("bytes"), F.md5(codecs.parse_payload("payload").cast("binary")).alias("fragment"))


# ---- events -------------------------------------------------------------------------------------------------------------


def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return jobs.latest_job(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 600)
    return out.select("user_id", "session", "n", F.unix_micros(F.col("started").cast("timestamp")).alias("started"))


def changed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another type than the one before of the same user."""
    return jobs.changed_only(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, id, run, b, e): benchmark rows as jobs of a session, when each began and when its result was logged, in microseconds."""
    rows = _bench(spark, sf_dir, "ms", "logged_at", "finished_at").where("ms IS NOT NULL AND logged_at IS NOT NULL AND finished_at IS NOT NULL")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select(F.col("model").alias("session"), "id", "run", (micros("finished_at") - F.col("ms") * 1000).alias("b"), micros("logged_at").alias("e"))


def _events(rows: DataFrame, *keep: str) -> DataFrame:
    """A begin and a result of each job, in the order of ``seq``."""
    kinds = F.array(F.struct(F.lit("begin").alias("kind"), (F.col("b") * 2).alias("seq")), F.struct(F.lit("result").alias("kind"), (F.col("e") * 2 + 1).alias("seq")))
    return rows.select("session", *keep, F.explode(kinds).alias("x")).select("session", *keep, "x.kind", "x.seq")


def current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows as events of a session: a start when a rewrite began, a result when it was logged; late ones are dropped."""
    rows = before(_jobs(spark, sf_dir), ["session"], ["b", "id", "run"], F.lit(1).cast("long"), "_n", "sum")
    rows = rows.withColumn("job", F.coalesce("_n", F.lit(0).cast("long")) + 1).withColumn("payload", F.concat("id", F.lit("/"), F.col("run").cast("string")))
    return jobs.current_results(_events(rows, "job", "payload")).select("session", "job", "payload")


def jobs_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each start and each result of a session, the jobs that run."""
    out = jobs.in_flight(_events(_jobs(spark, sf_dir), "id", "run"), order=["seq", "id", "run"])
    return out.select("session", "id", "run", "kind", "running")


_NAMES = [
    doc_word_count, vocab_hits_by_tier, phrase_hits, regex_findings, findings, finding_scores, tier_gates, finding_checklists, cleaned, cleaned_documents, dash_counts, fact_kinds, protected_docs, protect_roundtrip, restored_texts, restore_violations,
    chunk_sizes, too_long_docs, answer_gates, kept_paragraphs, answer_decisions, prompt_targets, latest_bench_rows, latest_docs, model_rollup, rejection_reasons, sample_means, model_tells, surviving_tells, corpus_totals, probe_totals, busy_islands,
    page_shapes, shape_losses, previews, word_diffs, payload_sizes, latest_job, idle_sessions, changed_events, current_results, jobs_in_flight, goldens.goldens, goldens.rewrite_ends,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


# ---- the same in SQL ----------------------------------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_DOCS = "docs AS (SELECT DISTINCT doc_key, text FROM clip_docs)"
_VOCAB_LIST = "vocab AS (SELECT DISTINCT * FROM rules_vocab WHERE word <> ''), listed AS (SELECT word, row_number() OVER (ORDER BY tier, seq, word) - 1 AS nth, count(*) OVER () AS n FROM vocab)"
_DERIVED = f"""{_DOCS}, derived AS (
    SELECT doc_key, text || ' ' || a.word || ' ' || b.word || ' ' || list_extract([{", ".join(map(_text, SAMPLES))}], CAST(doc_key % {len(SAMPLES)} + 1 AS BIGINT)) AS text
    FROM docs JOIN listed a ON a.nth = doc_key % a.n JOIN listed b ON b.nth = (doc_key * 7 + 3) % b.n)"""
_FOLDED = f"folded AS (SELECT doc_key, text, {FOLD.format('text')} AS f FROM derived)"
# separators are doubled, so that words beside each other don't share one
_VOCAB = f"""occ AS (SELECT doc_key, tier, word, len(regexp_extract_all(g, '[^a-z0-9_]' || regexp_replace({FOLD.format("word")}, '([^a-z0-9_])', '\\1\\1', 'g') || '[^a-z0-9_]')) AS n
    FROM (SELECT doc_key, f, ' ' || regexp_replace(f, '([^a-z0-9_])', '\\1\\1', 'g') || ' ' AS g FROM folded), vocab WHERE contains(f, {FOLD.format("word")}))"""
_RE2 = {"oxford-triple": r"[\p{L}\p{M}\p{N}_]+, [\p{L}\p{M}\p{N}_]+, and [\p{L}\p{M}\p{N}_]+"}
_EMOJI = r"[\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F300}-\x{1FAFF}]"


def _regex_sql() -> str:
    parts = []
    for i, (name, pattern, flags, category, weight) in enumerate(DETECTORS):
        if name == "emoji":
            found = f"CASE WHEN regexp_matches(text, {_text(_EMOJI)}) THEN [regexp_extract(text, {_text(_EMOJI)})] ELSE [] END"
        else:
            prefix = "(?m)" if "m" in (flags or "") else ""
            found = f"regexp_extract_all(text, {_text(prefix + _RE2.get(name, pattern))}, 0, 'i')"
        parts.append(f"SELECT doc_key, {_text(name)} AS id, {_text(category)} AS category, {weight} AS weight, {i} AS seq, trim(unnest(l), E' \\n\\t\\r') AS matched, generate_subscripts(l, 1) AS k FROM (SELECT doc_key, {found} AS l FROM derived)")
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


def _findings_sql(derived: str) -> str:
    """Common table expressions up to ``found``: the findings of ``derived`` (doc_key, text), each with its place in the pack as ``seq``."""
    return f"""WITH {_VOCAB_LIST}, {derived}, {_FOLDED}, {_VOCAB}, {_regex_sql()},
  words AS (SELECT doc_key, greatest(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}''’\\-–]+')), 1) AS w FROM derived),
  gates AS (SELECT doc_key, tier, count(*) AS words, sum(n) AS hits FROM occ WHERE n > 0 GROUP BY ALL),
  passed AS (SELECT g.doc_key, g.tier FROM gates g JOIN words w USING (doc_key) WHERE g.tier = 1 OR (g.tier = 2 AND g.words >= 2)
             OR (g.tier = 3 AND CAST(CAST(g.hits / w.w AS FLOAT) * 100::FLOAT AS FLOAT) > 1.5::FLOAT)),
  pack AS (SELECT match_text, coalesce(category, '') AS category, weight, row_number() OVER (ORDER BY octet_length(encode(match_text)) DESC, seq, phrase_id) AS nth
           FROM (SELECT *, row_number() OVER (PARTITION BY match_text ORDER BY seq, phrase_id) AS rn FROM rules_phrase WHERE match_text <> '') WHERE rn = 1),
  found AS (
    SELECT o.doc_key, 'vocab:' || o.word AS id, o.word AS matched, 'vocabulary' AS category, v.weight, o.tier AS tier, l.nth AS seq
      FROM occ o JOIN passed p ON p.doc_key = o.doc_key AND p.tier = o.tier JOIN vocab v ON v.word = o.word AND v.tier = o.tier JOIN listed l ON l.word = o.word WHERE o.n > 0
    UNION ALL SELECT doc_key, 'phrase:' || match_text, match_text, category, weight, NULL, 10000 + nth FROM folded, pack WHERE contains(f, {FOLD.format("match_text")})
    UNION ALL SELECT doc_key, id, arg_min(matched, k), any_value(category), any_value(weight), NULL, 20000 + any_value(seq) FROM hits GROUP BY doc_key, id, translate(matched, {ALPHABET}))"""


_FINDINGS = _findings_sql(_DERIVED)
_REPAIR = "(tier IN (1, 2) OR weight >= 3) AND id <> 'inline-header-list'"
_PROBE = "tier = 1 OR (id IS NOT NULL AND tier IS NULL AND weight >= 2)"
_BENCH = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, run, id ORDER BY logged_at DESC) AS rn FROM bench_rows) WHERE rn = 1)"
_BLANK = r"regexp_matches({0}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]*$')"
_COMMENTARY = " OR ".join(f"(contains(lower(output), {_text(m)}) AND NOT contains(lower(input), {_text(m)}))" for m in gates.COMMENTARY)


_LINES = "replace({0}, E'\\r\\n', E'\\n')"
_TRIMMED = r"regexp_replace({0}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')"


def _groups_sql(target: int, ceiling: int, docs: str = "docs") -> str:
    """Common table expressions up to ``step``: each paragraph of the documents with its group."""
    split = f"string_split({_LINES.format('text')}, E'\\n\\n')"
    return f"""parts AS (SELECT doc_key, unnest({split}) AS p, generate_subscripts({split}, 1) AS k FROM {docs}),
            kept AS (SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY k) AS i, length(p) AS n FROM parts WHERE NOT {_BLANK.format('p')}),
            fit AS (SELECT * FROM kept WHERE doc_key NOT IN (SELECT doc_key FROM kept WHERE n > {ceiling})),
            step AS (SELECT doc_key, i, 0 AS chunk, n AS used FROM fit WHERE i = 1 UNION ALL
                     SELECT f.doc_key, f.i, CASE WHEN s.used + 2 + f.n <= {target} THEN s.chunk ELSE s.chunk + 1 END, CASE WHEN s.used + 2 + f.n <= {target} THEN s.used + 2 + f.n ELSE f.n END FROM step s JOIN fit f ON f.doc_key = s.doc_key AND f.i = s.i + 1)"""


def _tells_sql() -> str:
    """Common table expressions up to ``counts`` (model, run, id, side, n): islands of flagged spans; ``spans`` has the spans."""
    parts = []
    for name, pattern, flags, _, _ in DETECTORS:
        pattern = r"[\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]" if name == "emoji" else _RE2.get(name, pattern)
        p = _text("(?m" + ("i" if "i" in (flags or "") else "") + ")" + pattern)
        parts.append(f"SELECT model, run, id, side, {_text(name)} AS rule, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM texts WHERE regexp_matches(t, {p})")
    for name, pattern, _ in SCORER_EXTRAS:
        p = _text("(?i)" + pattern)
        parts.append(f"SELECT model, run, id, side, {_text(name)}, regexp_extract_all(t, {p}), string_split_regex(t, {p}) FROM texts WHERE regexp_matches(t, {p})")
    parts.append("SELECT model, run, id, side, rule, regexp_extract_all(t, p), string_split_regex(t, p) FROM (SELECT texts.*, r.rule, '(?i)\\b' || regexp_escape(w) || '\\b' AS p FROM texts JOIN literal r ON contains(lower(t), lower(w)))")
    return f"""{_BENCH}, texts AS (SELECT model, run, id, unnest(['input', 'baseline', 'output']) AS side, unnest([input, baseline, output]) AS t FROM b),
            literal AS (SELECT DISTINCT 'vocab:' || word AS rule, word AS w FROM rules_vocab WHERE tier = 1 UNION
                        SELECT 'phrase:' || match_text, match_text FROM (SELECT *, row_number() OVER (PARTITION BY match_text ORDER BY seq, phrase_id) AS rn FROM rules_phrase) WHERE rn = 1 AND coalesce(fix, '') = ''),
            hits AS ({" UNION ALL ".join(parts)}),
            places AS (SELECT model, run, id, side, rule, m, g, unnest(range(1, len(m) + 1)) AS k FROM hits),
            spans AS (SELECT model, run, id, side, rule, CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[k]) AS n FROM places WHERE length(m[k]) > 0),
            ahead AS (SELECT *, max(s + n) OVER (PARTITION BY model, run, id, side ORDER BY s, s + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM spans),
            islands AS (SELECT model, run, id, side, count(*) FILTER (high IS NULL OR s >= high) AS n FROM ahead GROUP BY ALL),
            counts AS (SELECT t.model, t.run, t.id, t.side, coalesce(i.n, 0) AS n FROM texts t LEFT JOIN islands i ON (t.model, t.run, t.id, t.side) = (i.model, i.run, i.id, i.side)),
            one AS (SELECT id, side, arg_min(n, run) AS n FROM counts WHERE model = (SELECT min(model) FROM b) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return goldens.SQL | {
        "doc_word_count": f"WITH {_DOCS} SELECT doc_key, CAST(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}''’\\-–]+')) AS BIGINT) AS words, {_BLANK.format('text')} AS blank FROM docs",
        "vocab_hits_by_tier": f"WITH {_VOCAB_LIST}, {_DERIVED}, {_FOLDED}, {_VOCAB} SELECT tier, {FOLD.format('word')} AS word, count(DISTINCT doc_key) AS docs, CAST(sum(n) AS BIGINT) AS hits FROM occ WHERE n > 0 GROUP BY ALL",
        "phrase_hits": f"WITH {_DOCS}, p AS (SELECT DISTINCT match_text FROM rules_phrase) SELECT match_text, count(*) AS docs FROM (SELECT {FOLD.format('text')} AS f FROM docs), p WHERE contains(f, {FOLD.format('match_text')}) GROUP BY 1",
        "regex_findings": f"WITH {_VOCAB_LIST}, {_DERIVED}, {_regex_sql()} SELECT id AS detector, count(DISTINCT doc_key) AS docs, count(*) AS hits FROM hits GROUP BY 1",
        "findings": f"{_FINDINGS} SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY coalesce(tier IN (1, 2), false) OR weight >= 3 DESC, weight DESC, matched, seq) - 1 AS place, id, matched, category, CAST(weight AS INT) AS weight, CAST(tier AS INT) AS tier FROM found",
        "finding_scores": f"{_FINDINGS} SELECT d.doc_key, count(id) AS n, CAST(coalesce(sum(weight) FILTER ({_REPAIR}), 0) AS BIGINT) AS repair, CAST(coalesce(sum(weight) FILTER ({_REPAIR} AND tier IS NULL), 0) AS BIGINT) AS gate, count(*) FILTER (tier = 1 OR (id IS NOT NULL AND tier IS NULL AND weight >= 2)) AS probe FROM derived d LEFT JOIN found USING (doc_key) GROUP BY 1",
        "tier_gates": f"{_FINDINGS} SELECT d.doc_key, CAST(coalesce(max(g.words), 0) AS BIGINT) AS tier2_words, coalesce(bool_or(p.tier = 2), false) AS tier2_passed, coalesce(bool_or(p.tier = 3), false) AS tier3_passed FROM derived d LEFT JOIN gates g ON g.doc_key = d.doc_key AND g.tier = 2 LEFT JOIN passed p ON p.doc_key = d.doc_key GROUP BY 1",
        "finding_checklists": f"{_FINDINGS} SELECT d.doc_key, least(count(*) FILTER (weight >= 2 AND id <> 'inline-header-list'), 24) AS listed, least(count(*) FILTER ({_REPAIR}), 16) AS targets FROM derived d LEFT JOIN found USING (doc_key) GROUP BY 1",
        "dash_counts": f"WITH {_DOCS} SELECT doc_key, CAST(len(regexp_extract_all(text, '[–—]')) AS BIGINT) AS dashes, CAST(len(regexp_extract_all(text, '[-–—]')) AS BIGINT) AS hyphens, CAST(0 AS BIGINT) AS left_over FROM docs",
        "protect_roundtrip": f"WITH {_DOCS} SELECT doc_key, CASE WHEN NOT regexp_matches(text, '\\[\\[F[0-9]+\\]\\]') THEN md5(text) END AS digest FROM docs",
        "restored_texts": f"WITH {_DOCS} SELECT doc_key, md5(docs.text) AS digest FROM (SELECT DISTINCT doc_key, text, fact_values FROM protected_texts) JOIN docs USING (doc_key)",
        "restore_violations": """
            WITH p AS (SELECT DISTINCT doc_key, text, fact_values FROM protected_texts), c AS (SELECT doc_key, len(fact_values) AS n, unnest(['dropped', 'repeated', 'invented']) AS change FROM p)
            SELECT doc_key, change, CASE change WHEN 'invented' THEN 'unknown' WHEN 'dropped' THEN CASE WHEN n > 0 THEN 'missing' END ELSE CASE WHEN n > 0 THEN 'duplicated' ELSE 'unknown' END END AS kind,
                   CASE change WHEN 'invented' THEN 'unknown' WHEN 'repeated' THEN CASE WHEN n > 0 THEN 'duplicated' ELSE 'unknown' END END AS loose_kind FROM c""",
        "chunk_sizes": f"WITH RECURSIVE {_DOCS}, {_groups_sql(400, 6000)} SELECT doc_key, CAST(chunk AS BIGINT) AS chunk, CAST(max(used) AS BIGINT) AS size FROM step GROUP BY doc_key, chunk",
        "too_long_docs": f"""
            WITH RECURSIVE {_DOCS}, long AS (SELECT doc_key, text FROM docs WHERE length(text) > {rewrite.CHUNK_CHARS} AND length(text) <= {rewrite.MAX_TOTAL}), {_groups_sql(rewrite.CHUNK_CHARS, rewrite.CEILING, "long")},
            own AS (SELECT doc_key, count(DISTINCT chunk) AS n FROM step GROUP BY 1)
            SELECT CASE WHEN length(text) <= {rewrite.CHUNK_CHARS} THEN 'single' WHEN n IS NULL THEN 'too_long' ELSE 'chunked' END AS gate, count(*) AS docs, CAST(sum(CASE WHEN length(text) <= {rewrite.CHUNK_CHARS} THEN 1 ELSE coalesce(n, 0) END) AS BIGINT) AS chunks
            FROM docs LEFT JOIN own USING (doc_key) GROUP BY 1""",
        "kept_paragraphs": f"""
            WITH {_BENCH}, x AS (SELECT *, list_bool_or(list_transform(string_split({_LINES.format("baseline")}, E'\\n\\n'), lambda p: contains({_TRIMMED.format("p")}, E'\\n'))) AS broken,
                list_transform(string_split(output, E'\\n\\n'), lambda p: {{'p': p, 'l': list_transform(string_split_regex(p, E'\\r?\\n'), lambda x: {_TRIMMED.format("x")})}}) AS parts FROM b WHERE output IS NOT NULL)
            SELECT model, run, id, md5(CASE WHEN broken THEN output ELSE array_to_string(list_transform(parts, lambda q: CASE WHEN list_bool_or(list_transform(q.l, lambda y: regexp_matches(y, '^[-*+#|>]') OR (contains(y, '. ') AND regexp_matches(split_part(y, '. ', 1), '^[0-9]*$'))))
                THEN q.p ELSE array_to_string(list_filter(q.l, lambda y: y <> ''), ' ') END), E'\\n\\n') END) AS kept FROM x""",
        "answer_gates": f"""
            WITH {_BENCH} SELECT model, run, id,
              CASE WHEN {_BLANK.format('output')} THEN 'the rewrite came back empty' WHEN length(output) * 3 < length(input) THEN 'the rewrite dropped most of the text' WHEN length(output) > length(input) * 3 THEN 'the rewrite ran away' END AS length_gate,
              CASE WHEN {_BLANK.format('output')} THEN 'the summary came back empty' WHEN length(output) >= length(input) THEN 'the summary is no shorter than the text' END AS shorter_gate, {_COMMENTARY} AS commentary FROM b""",
        "prompt_targets": f"WITH {_DOCS}, w AS (SELECT doc_key, CAST(len(regexp_extract_all(text, '[^\\s\\x{{00A0}}\\x{{0085}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+')) AS BIGINT) AS words FROM docs) SELECT doc_key, words, least(greatest(words // 4, 25), words) AS target FROM w",
        "latest_bench_rows": f"WITH {_BENCH} SELECT model, run, id, ms, vram_mib, CAST(coalesce(length(output), -1) AS BIGINT) AS n_output FROM b",
        "latest_docs": "SELECT doc_key, kind, app, loaded_at, CAST(length(text) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY loaded_at DESC) AS rn FROM clip_docs) WHERE rn = 1",
        "model_rollup": f"""
            WITH {_BENCH}, f AS (SELECT *, CAST(coalesce(len(list_filter(facts, lambda x: x IS NOT NULL AND NOT contains(coalesce(output, ''), x))), 0) AS BIGINT) AS lost FROM b)
            SELECT model, CAST(max(run) + 1 AS BIGINT) AS runs, count(*) AS rewrites, count(rejected) AS rejected, CAST(sum(lost) AS BIGINT) AS facts_lost, median(ms) AS median_ms, first(load_ms ORDER BY run, id) AS load_ms, first(vram_mib ORDER BY run, id) AS vram_mib FROM f GROUP BY 1""",
        "rejection_reasons": f"WITH {_BENCH} SELECT model, rejected, count(*) AS n FROM b WHERE rejected IS NOT NULL GROUP BY ALL",
        "model_tells": f"""
            WITH {_tells_sql()}, base AS (SELECT sum(n) AS n FROM one WHERE side = 'baseline'), m AS (SELECT model, CAST(max(run) + 1 AS BIGINT) AS runs, CAST(sum(n) AS BIGINT) AS tells FROM counts WHERE side = 'output' GROUP BY 1)
            SELECT model, runs, tells, round(tells / runs, 6) AS tells_per_run, CASE WHEN base.n > 0 THEN round(100 * (1 - (tells / runs) / base.n), 6) ELSE 0.0 END AS drop_pct FROM m, base""",
        "sample_means": f"WITH {_tells_sql()} SELECT id, model, round(avg(n), 6) AS mean FROM counts WHERE side = 'output' GROUP BY ALL",
        "surviving_tells": f"""
            WITH {_tells_sql()}, k AS (SELECT model, rule, count(*) AS n FROM spans WHERE side = 'output' GROUP BY ALL)
            SELECT * FROM (SELECT model, rule, n, CAST(row_number() OVER (PARTITION BY model ORDER BY n DESC, rule) AS INT) AS place FROM k) WHERE place <= 6""",
        "corpus_totals": f"WITH {_tells_sql()} SELECT count(DISTINCT id) AS samples, CAST(sum(n) FILTER (side = 'input') AS BIGINT) AS input, CAST(sum(n) FILTER (side = 'baseline') AS BIGINT) AS baseline FROM one",
        "probe_totals": f"""
            {_findings_sql(_BENCH + ", derived AS (SELECT model || '|' || run || '|' || id || '|a' AS doc_key, input AS text FROM b UNION ALL SELECT model || '|' || run || '|' || id || '|b', output FROM b WHERE output IS NOT NULL)")},
            p AS (SELECT doc_key, count(*) AS n FROM found WHERE {_PROBE} GROUP BY 1),
            r AS (SELECT model, rejected, output, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM b LEFT JOIN p x ON x.doc_key = model || '|' || run || '|' || id || '|a' LEFT JOIN p y ON y.doc_key = model || '|' || run || '|' || id || '|b')
            SELECT model, CAST(sum(x) AS BIGINT) AS "before", CAST(sum(CASE WHEN rejected IS NOT NULL OR output IS NULL THEN x ELSE y END) AS BIGINT) AS "after", count(rejected) AS rejected FROM r GROUP BY 1""",
        "busy_islands": f"""
            WITH {_BENCH}, i AS (SELECT model, epoch_us(finished_at) - ms * 1000 AS s, epoch_us(finished_at) AS e FROM b WHERE ms IS NOT NULL AND finished_at IS NOT NULL),
            h AS (SELECT *, max(e) OVER (PARTITION BY model ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM i),
            g AS (SELECT *, sum(CASE WHEN hi IS NULL OR s >= hi THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM h)
            SELECT model, CAST(island AS BIGINT) AS island, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY model, island""",
        "page_shapes": """
            SELECT DISTINCT doc_key, CAST(len(regexp_extract_all(html, '<table[ >]')) AS BIGINT) AS tables, CAST(len(regexp_extract_all(html, '<a href="[^"]+">')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS list_items
            FROM clip_docs WHERE html IS NOT NULL""",
        "shape_losses": """
            SELECT DISTINCT doc_key, CASE WHEN regexp_matches(html, '<table[ >]') THEN 'the table was lost' WHEN regexp_matches(html, '<a href="[^"]+">') THEN 'the links were lost' WHEN regexp_matches(html, '<li[ >]') THEN 'the list was lost' END AS of_text, CAST(NULL AS VARCHAR) AS of_markdown
            FROM clip_docs WHERE html IS NOT NULL""",
        "word_diffs": f"WITH {_BENCH} SELECT model, run, id, md5(coalesce(baseline, '')) AS was, md5(coalesce(output, '')) AS became FROM b",
        "payload_sizes": f"SELECT DISTINCT doc_key, CAST({codecs.HEADER_BYTES + len(codecs.HEAD) + len(codecs.FOOT)} + octet_length(encode(html)) AS BIGINT) AS bytes, md5(html) AS fragment FROM clip_docs WHERE html IS NOT NULL",
        "latest_job": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
        "idle_sessions": """
            WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
            SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, epoch_us(min(ts)) AS started FROM s GROUP BY user_id, session""",
        "changed_events": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type",
        "jobs_in_flight": f"""
            WITH {_BENCH}, r AS (SELECT model AS session, id, run, epoch_us(finished_at) - ms * 1000 AS s, epoch_us(logged_at) AS e FROM b WHERE ms IS NOT NULL AND logged_at IS NOT NULL AND finished_at IS NOT NULL),
            v AS (SELECT session, id, run, unnest(['begin', 'result']) AS kind, unnest([2 * s, 2 * e + 1]) AS seq, unnest([1, -1]) AS step FROM r),
            t AS (SELECT *, sum(step) OVER w AS total FROM v WINDOW w AS (PARTITION BY session ORDER BY seq, id, run ROWS UNBOUNDED PRECEDING))
            SELECT session, id, run, kind, CAST(total - least(min(total) OVER (PARTITION BY session ORDER BY seq, id, run ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS running FROM t""",
        "current_results": f"""
            WITH {_BENCH}, r AS (SELECT model AS session, id, run, epoch_us(finished_at) - ms * 1000 AS s, epoch_us(logged_at) AS e FROM b WHERE ms IS NOT NULL AND logged_at IS NOT NULL AND finished_at IS NOT NULL),
            j AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY s, id, run) AS job FROM r)
            SELECT session, job, id || '/' || CAST(run AS VARCHAR) AS payload FROM j a WHERE job = (SELECT max(k.job) FROM j k WHERE k.session = a.session AND k.s <= a.e)""",
    }
