"""Prompts for a rewriter, as Columns. Wording is a parameter; what is computed is the counts, lists and targets in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseloom.functions.text import spaced_words
from proseloom.operators.detect import checklist, repair_targets

#: What every editing prompt asks for beside its list.
STANDING = "- Keep paragraphs, order and meaning. Keep technical terms and quotations as they are.\n- Write no dashes, no greeting, no closing remark, nothing about the task.\n- Don't trade one stock phrase for another.\n"
KEEP_ALL = "- Tokens such as [[F00]] are protected values. Copy every one through exactly once, unchanged.\n"
KEEP_SOME = "- Tokens such as [[F00]] are protected values. Copy those you keep exactly once, unchanged, and leave out the rest.\n"


def target_words(text: Column) -> Column:
    """A quarter of the words, at least 25, at most all of them."""
    words = spaced_words(text)
    return F.least(F.greatest(F.floor(words / 4), F.lit(25)), words).cast("long")


def placeholder_rule(protected: Column, may_drop: bool) -> Column:
    return F.when(protected == 0, "").otherwise(KEEP_SOME if may_drop else KEEP_ALL)


def shape_rule(shape: Column, numbered: Column) -> Column:
    """One sentence for each part of a shape that is there."""
    n = lambda name: shape[name].cast("string")
    plural = lambda name: F.when(shape[name] == 1, "").otherwise("s")
    mark = F.when(numbered, "marked as it is now").otherwise('starting with "- "')
    return F.concat(
        F.when(shape["list_items"] > 0, F.concat(F.lit("- Return the same "), n("list_items"), F.lit(" bullet points, each on its own line "), mark, F.lit(".\n"))).otherwise(""),
        F.when(shape["links"] > 0, F.concat(F.lit("- Return the same "), n("links"), F.lit(" link"), plural("links"), F.lit(" written as [text](URL).\n"))).otherwise(""),
        F.when(shape["tables"] > 0, F.concat(F.lit("- Return the same "), n("tables"), F.lit(" table"), plural("tables"), F.lit(" with the same rows and columns.\n"))).otherwise(""),
    )


def _quoted(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat(F.lit('- "'), f["matched"], F.lit('"\n'))), "")


def issue_list(findings: Column, limit: int = 24) -> Column:
    listed = checklist(findings, limit)
    return F.when(F.size(listed) == 0, "No listed phrase is left in this text. Return it as written.\n").otherwise(F.concat(F.lit("Each of these must go:\n"), _quoted(listed)))


def editing_prompt(findings: Column, shape: Column, numbered: Column, protected: Column, rules: str = STANDING) -> Column:
    return F.concat(F.lit("Rewrite the text in plain professional words. Keep every fact.\n"), issue_list(findings), F.lit(rules), shape_rule(shape, numbered), placeholder_rule(protected, False), F.lit("Return only the text."))


def repair_prompt(findings: Column, shape: Column, numbered: Column, protected: Column) -> Column:
    return F.concat(F.lit("The text still holds these:\n"), _quoted(repair_targets(findings)), shape_rule(shape, numbered), placeholder_rule(protected, False), F.lit("Return only the corrected text."))


def condense_prompt(mode: str, text: Column, shape: Column, numbered: Column, protected: Column) -> Column:
    """The prompt of a mode that shortens: "simplify" or "tldr"."""
    return summary_prompt(text, protected) if mode == "tldr" else simplify_prompt(shape, numbered, protected)


def simplify_prompt(shape: Column, numbered: Column, protected: Column) -> Column:
    return F.concat(F.lit("Rewrite the text in plain language with short sentences. Keep every point.\n"), shape_rule(shape, numbered), placeholder_rule(protected, False), F.lit("Return only the text."))


def summary_prompt(text: Column, protected: Column) -> Column:
    return F.concat(F.lit("Summarise the text in about "), target_words(text).cast("string"), F.lit(" words.\n"), placeholder_rule(protected, True), F.lit("Return only the summary."))
