"""The rewriting plan: baseline, protection, groups of paragraphs, answers, gates, and the document put together again.

A model is either a table of answers (doc_id, chunk, stage, draw, answer, error) that is joined in, or a callable that is
run over batches of prompts (``ask``). All around it is relational; the only shuffles are the join with the answers and the
regrouping of a document's groups. Stages of answers are "edit" (draws 0 and 1) and "repair" (one for each draw).

A document is (doc_id, text) or (doc_id, html, text); with markup it is rich. A rich document is rewritten as the Markdown of its
markup; what is published is markup again, with the Markdown as its text. Prompts are made from the protected text only: what a
checklist quotes cannot hold a value that placeholders keep from the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.functions.clean import Cleaner, clean_texts
from proseloom.functions.facts import protect, restore
from proseloom.functions.markup import from_html, map_text, shape_of, to_html
from proseloom.functions.text import trimmed
from proseloom.operators.chunk import chunks, keep_paragraphs, size_gate
from proseloom.operators.detect import gate_score, repair_score, repair_targets, with_findings
from proseloom.operators.gates import answer_gate, commentary, length_gate, lost, shorter_gate, style_gate, worth_another_draw
from proseloom.plans import prompts
from proseloom.session import written
from proseloom.sources.pack import Pack

CHUNK_CHARS, CEILING, MAX_TOTAL = 1500, 6000, 30_000
#: Rounds of a summary of summaries; each but the last makes the text shorter, so few are ever needed.
MAX_ROUNDS = 12


def _halves(pack: Pack):
    """A Column function: markup and text after the mechanical fixes, with their number (of the markup, if there is any)."""
    cleaner = Cleaner(pack.phrases)

    @F.pandas_udf("html string, text string, fixes int")
    def run(html: pd.Series, text: pd.Series) -> pd.DataFrame:
        pattern = cleaner.pattern()

        def one(h: str | None, t: str | None) -> tuple:
            plain, fixes = cleaner.clean(t, pattern) if t is not None else (None, 0)
            if h is None:
                return None, plain, fixes
            n = 0

            def part(s: str) -> str:
                nonlocal n
                out, m = cleaner.clean(s, pattern)
                n += m
                return out

            return map_text(h, part), plain, n

        return pd.DataFrame([one(*x) for x in zip(html, text)], columns=["html", "text", "fixes"])

    return run


def clean_documents(docs: DataFrame, pack: Pack) -> DataFrame:
    """``docs`` (html, text, ..) with both halves cleaned; fixes of a rich one are those of its markup."""
    rest = [c for c in docs.columns if c not in ("html", "text", "fixes")]
    return docs.select(*rest, _halves(pack)("html", F.coalesce("text", F.lit(""))).alias("_c")).select(*rest, "_c.*")


@F.pandas_udf(T.StringType())
def _markdown(html: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([t if h is None else from_html(h) for h, t in zip(html, text)], dtype="object")


def markdown_text(docs: DataFrame) -> DataFrame:
    """``docs`` with ``markdown``: the text of a plain document, the converted markup of a rich one."""
    return docs.withColumn("markdown", _markdown("html", "text"))


def _finished(pack: Pack):
    """A Column function of a baseline's markup and a restored answer: the document of the same family as the baseline that the answer
    makes, after the mechanical fixes, and its Markdown. Markup is made of the answer's Markdown, which stays its text."""
    cleaner = Cleaner(pack.phrases)

    @F.pandas_udf("html string, text string, markdown string")
    def run(html: pd.Series, restored: pd.Series) -> pd.DataFrame:
        pattern = cleaner.pattern()

        def one(h: str | None, t: str | None) -> tuple:
            if t is None:
                return None, None, None
            plain = cleaner.clean(t, pattern)[0]
            if h is None:
                return None, plain, plain
            new = map_text(to_html(t), lambda s: cleaner.clean(s, pattern)[0])
            return new, plain, from_html(new)

        return pd.DataFrame([one(*x) for x in zip(html, restored)], columns=["html", "text", "markdown"])

    return run


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("tables", "links", "list_items")]))
def _shape(html: pd.Series, text: pd.Series) -> pd.DataFrame:
    """The shape of markup, or of the markup that a plain text makes as Markdown."""
    return pd.DataFrame([shape_of(h if h is not None else to_html(t or "")) for h, t in zip(html, text)], columns=["tables", "links", "list_items"])


def ask(requests: DataFrame, rewriter: Callable[[str, str], str], parallel: int | None = None) -> DataFrame:
    """(doc_id, chunk, stage, draw, answer, error) of requests (doc_id, chunk, stage, draw, system, text).

    ``rewriter`` is called for each request; an exception is that request's error. ``parallel`` bounds the calls at one time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for system, text in zip(batch["system"], batch["text"]):
                try:
                    answers.append(rewriter(system, text))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a failing model must not end the job
                    answers.append(None)
                    errors.append(str(e))
            yield batch[["doc_id", "chunk", "stage", "draw"]].assign(answer=answers, error=errors)

    asked = requests.repartition(parallel) if parallel else requests
    return asked.mapInPandas(run, "doc_id long, chunk int, stage string, draw int, answer string, error string")


def split_documents(docs: DataFrame, text: str = "text", target: int = CHUNK_CHARS, ceiling: int = CEILING, total: int = MAX_TOTAL) -> DataFrame:
    """(doc_id, gate, chunk, part, n_chunks): the groups of every document; one row with a null part where it is too long."""
    gate = size_gate(F.col(text), target, total)
    groups = F.when(gate == "too_long", F.lit(None)).when(gate == "single", F.array(F.col(text))).otherwise(chunks(F.col(text), target, ceiling))
    made = docs.select("doc_id", gate.alias("gate"), groups.alias("_g"))
    out = made.select("doc_id", "gate", F.posexplode_outer("_g").alias("chunk", "part"), F.greatest(F.coalesce(F.size("_g"), F.lit(0)), F.lit(0)).alias("n_chunks"))
    return out.withColumn("gate", F.when(F.col("part").isNull(), "too_long").otherwise(F.col("gate")))


def requests(parts: DataFrame, pack: Pack, mode: str = "edit", draws: int = 2) -> DataFrame:
    """(doc_id, chunk, stage, draw, system, text) for the groups of (doc_id, chunk, part): prompts from the protected text, and that text."""
    none = F.lit(None).cast("string")
    held = written(parts.withColumn("_p", protect("part")).withColumn("_shown", F.col("_p.text")).withColumn("_shape", _shape(none, "part")), "request-texts")
    numbered, n = F.col("part").rlike(r"(?m)^\s*\d+[.)]\s"), F.size("_p.values")
    if mode == "edit":
        held = with_findings(held, pack, "_shown", "_found")
        system = prompts.editing_prompt(F.col("_found"), F.col("_shape"), numbered, n)
    else:
        system = prompts.condense_prompt(mode, F.col("part"), F.col("_shape"), numbered, n)
    return held.select("doc_id", "chunk", F.lit("edit").alias("stage"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), system.alias("system"), F.col("_shown").alias("text"))


def repair_requests(parts: DataFrame, answers: DataFrame, pack: Pack) -> DataFrame:
    """(doc_id, chunk, stage, draw, system, text) for the answers that pass the gates of texts and still hold something to repair."""
    held = _edited(parts, answers, "edit").where("_fault IS NULL").select("doc_id", "chunk", "draw", "_edited").withColumn("_q", protect("_edited"))
    held = written(held.withColumn("_shown", F.col("_q.text")).withColumn("_shape", _shape(F.lit(None).cast("string"), "_edited")), "repair-texts")
    held = with_findings(held, pack, "_shown", "_found").where(F.size(repair_targets(F.col("_found"))) > 0)
    system = prompts.repair_prompt(F.col("_found"), F.col("_shape"), F.col("_edited").rlike(r"(?m)^\s*\d+[.)]\s"), F.size("_q.values"))
    return held.select("doc_id", "chunk", F.lit("repair").alias("stage"), "draw", system.alias("system"), F.col("_shown").alias("text"))


def _rejected(kind: str | Column, message: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(message.isNotNull(), F.struct(kind.alias("kind"), message.alias("message")))


def _edited(parts: DataFrame, answers: DataFrame, mode: str) -> DataFrame:
    """``parts`` by draw with ``_edited``, the restored answer, and ``_fault``, what its text is refused for before it is cleaned."""
    own = answers.where("stage = 'edit'").select("doc_id", "chunk", "draw", "answer", "error")
    both = parts.withColumn("_p", protect("part")).join(own, ["doc_id", "chunk"], "left").withColumn("draw", F.coalesce("draw", F.lit(0)))
    both = both.withColumn("_r", restore(trimmed(F.col("answer")), F.col("_p.values"), may_drop=mode != "edit")).withColumn("_edited", F.col("_r.text"))
    if mode == "edit":
        gate = answer_gate(F.col("part"), F.col("_edited"))
    else:
        both = both.withColumn("_edited", keep_paragraphs(F.col("part"), F.col("_edited")))
        talk = F.when(commentary(F.col("part"), F.col("_edited")), "the rewrite talked about the task instead of doing it")
        gate = F.coalesce(talk, (shorter_gate if mode == "tldr" else length_gate)(F.col("part"), F.col("_edited")))
    fault = F.when(F.col("_r.violation").isNotNull(), F.concat(F.lit("a protected value was "), F.col("_r.violation.kind")))
    model = F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("no answer")))
    return both.withColumn("_fault", F.coalesce(_rejected("model", model), _rejected("facts", fault), _rejected("structure", gate)))


def _repaired(edited: DataFrame, answers: DataFrame, pack: Pack) -> DataFrame:
    """``_edited`` with the repair of its draw in its place, where that restores, passes the gates of texts and lowers the repair score."""
    fixes = answers.where("stage = 'repair'").groupBy("doc_id", "chunk", "draw").agg(F.min("answer").alias("_fix"))
    both = edited.join(fixes, ["doc_id", "chunk", "draw"], "left").withColumn("_q", protect("_edited"))
    both = written(both.withColumn("_t", restore(trimmed(F.col("_fix")), F.col("_q.values"))["text"]), "repairs")
    both = with_findings(with_findings(both, pack, "_edited", "_f0"), pack, "_t", "_f1")
    better = F.col("_t").isNotNull() & answer_gate(F.col("_edited"), F.col("_t")).isNull() & (repair_score(F.col("_f1")) < repair_score(F.col("_f0")))
    return both.withColumn("_edited", F.when(F.coalesce(better, F.lit(False)), F.col("_t")).otherwise(F.col("_edited"))).drop("_fix", "_q", "_t", "_f0", "_f1")


def judge(parts: DataFrame, answers: DataFrame, pack: Pack, mode: str = "edit") -> DataFrame:
    """(doc_id, chunk, part, final, final_html, rejected, draw) for every group: the first draw that passes, or why the first one fails.

    ``parts`` is (doc_id, chunk, part) and, where a group is the whole of a rich document, its ``html``. In the order of the
    gates: the model, the facts, length and commentary; then, after a repair and the mechanical fixes, structure, length
    again and style. A second draw is looked at only where the first one failed in a way that another draw can mend.
    """
    parts = parts if "html" in parts.columns else parts.withColumn("html", F.lit(None).cast("string"))
    # each step is written: its Python runs once, and the next one's plan stays small
    columns = ["doc_id", "chunk", "part", "html", "draw", "_edited", "_fault"]
    both = written(_edited(parts, answers, mode).select(*columns), "edited")
    if mode == "edit":
        both = _repaired(both, answers, pack).select(*columns)
    both = written(both.withColumn("_c", _finished(pack)("html", "_edited")), "finished")
    structure = length = style = F.lit(None).cast("string")
    if mode != "tldr":
        both = both.withColumn("_before", _shape("html", "part")).withColumn("_after", _shape("_c.html", "_c.text"))
        structure = lost(F.col("_before"), F.col("_after"))
    if mode == "edit":
        both = both.withColumn("_final", F.col("_c.markdown"))
        length = length_gate(F.col("part"), F.col("_final"))
        both = with_findings(with_findings(both, pack, "part", "_f0"), pack, "_final", "_f1")
        style = style_gate(gate_score(F.col("_f0")), gate_score(F.col("_f1")))
    failed = F.coalesce("_fault", _rejected("structure", structure), _rejected("structure", length), _rejected("style", style))
    judged = both.select("doc_id", "chunk", "part", "draw", failed.alias("rejected"), F.struct("_c.text", "_c.html").alias("final"))
    by = judged.groupBy("doc_id", "chunk").agg(
        F.first("part").alias("part"), F.min_by(F.struct("rejected", "final"), "draw").alias("a"), F.max_by(F.struct("rejected", "final", "draw"), "draw").alias("b")
    )
    again = F.col("a.rejected").isNotNull() & worth_another_draw(F.col("a.rejected.kind")) & (F.col("b.draw") > 0) & F.col("b.rejected").isNull()
    final = F.when(again, F.col("b.final")).when(F.col("a.rejected").isNull(), F.col("a.final"))
    return by.select(
        "doc_id", "chunk", "part", final["text"].alias("final"), final["html"].alias("final_html"),
        F.when(~again, F.col("a.rejected")).alias("rejected"), F.when(again, F.col("b.draw")).otherwise(F.lit(0)).alias("draw"),
    )


def assemble(judged: DataFrame, parts: DataFrame, docs: DataFrame, pack: Pack, mode: str = "edit") -> DataFrame:
    """(doc_id, html, text, rejected, n_refused, n_chunks) of every document.

    Refused groups keep their baseline; a failing model, or no group that passed, rejects the document; too long ones are
    rejected before anything else. What was put together of several groups is cleaned once more, and its structure is held
    against the whole baseline.
    """
    rows = judged.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.coalesce("final", "part").alias("t")))), lambda x: x["t"]), "\n\n").alias("_joined"),
        F.max("final_html").alias("_own_html"), F.count("*").cast("int").alias("n_chunks"), F.count("rejected").alias("n_refused"),
        F.min_by("rejected", F.when(F.col("rejected").isNotNull(), F.col("chunk"))).alias("_first"),
        F.min_by("rejected", F.when(F.col("rejected.kind") == "model", F.col("chunk"))).alias("_model"),
    )
    long = parts.where("gate = 'too_long'").select("doc_id", F.struct(F.lit("too_long").alias("kind"), F.lit("the text is too long").alias("message")).alias("_long")).distinct()
    out = docs.select("doc_id", F.col("html").alias("_html"), F.col("markdown").alias("_base")).join(rows, "doc_id", "left").join(long, "doc_id", "left")
    out = out.withColumn("_c", _finished(pack)("_html", "_joined"))
    many = F.col("n_chunks") > 1
    out = out.withColumn("html", F.when(many, F.col("_c.html")).otherwise(F.col("_own_html"))).withColumn("text", F.when(many, F.col("_c.text")).otherwise(F.col("_joined")))
    structure = F.lit(None).cast("string")
    if mode != "tldr":
        out = out.withColumn("_before", _shape("_html", "_base")).withColumn("_after", _shape("html", "text"))
        structure = F.when(many, lost(F.col("_before"), F.col("_after")))
    failed = F.coalesce("_long", "_model", F.when(F.col("n_chunks") == F.col("n_refused"), F.col("_first")), _rejected("structure", structure))
    kept = lambda c: F.when(failed.isNull(), F.col(c)).alias(c)
    return out.select("doc_id", kept("html"), kept("text"), failed.alias("rejected"), F.coalesce("n_refused", F.lit(0)).cast("long").alias("n_refused"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("_first").alias("first_refusal"))


def _round(docs: DataFrame, answers: DataFrame, pack: Pack, mode: str, target: int, ceiling: int, total: int) -> DataFrame:
    docs = markdown_text(docs if "html" in docs.columns else docs.withColumn("html", F.lit(None).cast("string")))
    parts = split_documents(docs, "markdown", target, ceiling, total)
    own = parts.where("part IS NOT NULL").select("doc_id", "chunk", "part", "n_chunks").join(docs.select("doc_id", "html"), "doc_id")
    own = own.select("doc_id", "chunk", "part", F.when(F.col("n_chunks") == 1, F.col("html")).alias("html"))
    return assemble(judge(own, answers, pack, mode), parts, docs, pack, mode)


def rewrite(docs: DataFrame, answers: DataFrame, pack: Pack, mode: str = "edit", target: int = CHUNK_CHARS, ceiling: int = CEILING, total: int = MAX_TOTAL, most: int = MAX_ROUNDS) -> DataFrame:
    """(doc_id, html, text, rejected, n_refused) of (doc_id, text) or (doc_id, html, text): what is published, or why the baseline stands.

    In mode "tldr" the summaries of a document's groups are a digest, which is summarised again, and so on until one group is left; a
    digest that has not shrunk to three quarters and holds refused groups ends it. ``answers`` then has a column ``round``, from 0
    on. Each round is written, and only documents that go on are in the next one; after ``most`` rounds they are rejected.
    """
    columns = ["doc_id", "html", "text", "rejected", "n_refused"]
    if mode != "tldr":
        return _round(docs, answers, pack, mode, target, ceiling, total).select(*columns)
    answers = answers if "round" in answers.columns else answers.withColumn("round", F.lit(0))
    done: DataFrame | None = None
    for k in range(most):
        before = docs if "html" in docs.columns else docs.withColumn("html", F.lit(None).cast("string"))
        before = markdown_text(before).select("doc_id", F.length("markdown").alias("_was"))
        out = _round(docs, answers.where(F.col("round") == k).drop("round"), pack, mode, target, ceiling, total).join(before, "doc_id")
        stuck = (F.col("n_refused") > 0) & (F.length("text") * 4 > F.col("_was") * 3)
        refused = F.coalesce("rejected", F.when((F.col("n_chunks") > 1) & stuck, F.col("first_refusal")))
        out = written(out.withColumn("rejected", refused).withColumn("_on", F.col("rejected").isNull() & (F.col("n_chunks") > 1)), "tldr-round")
        ended = out.where("NOT _on").select("doc_id", *[F.when(F.col("rejected").isNull(), F.col(c)).alias(c) for c in ("html", "text")], "rejected", "n_refused")
        done = ended if done is None else done.unionByName(ended)
        docs = out.where("_on").select("doc_id", "html", "text")
        if docs.isEmpty():
            return done
    never = docs.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("html", "text")], F.struct(F.lit("too_long").alias("kind"), F.lit("the text is too long").alias("message")).alias("rejected"), F.lit(0).cast("long").alias("n_refused"))
    return done.unionByName(never)


def provider_error(provider: str, has_port: bool, remote_usable: bool, superseded: bool) -> str | None:
    """Why no model is asked, in the order in which it is checked."""
    if superseded:
        return "superseded by a newer request"
    if provider == "off":
        return "rewriting is switched off"
    if provider == "local" and not has_port:
        return "no local model server"
    if provider == "remote" and not remote_usable:
        return "the remote model is not set up"
    return None
