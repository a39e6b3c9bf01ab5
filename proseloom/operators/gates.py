"""Gates an answer has to pass before it takes the place of a baseline. Column expressions only; null means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseloom.functions.text import is_blank

# Ways in which an answer talks about the task.
COMMENTARY = [
    "do not use", "don't use", "never use", "avoid using", "fancy word", "plain english", "keep it simple", "here is the rewritten", "here's the rewritten", "here is the edited", "here's the edited", "rewritten text",
    "rewritten version", "edited text", "edited version", "no commentary", "as an ai", "i cannot rewrite", "here is a summary", "here's a summary", "here is the summary", "here's the summary", "simplified text", "simplified version",
]


def commentary(before: Column, after: Column) -> Column:
    """Whether a marker stands in the answer that does not stand in the text before."""
    b, a = F.lower(before), F.lower(after)
    hits = [F.contains(a, F.lit(m)) & ~F.contains(b, F.lit(m)) for m in COMMENTARY]
    return reduce(lambda x, y: x | y, hits)


# The messages of the gates below.


def length_gate(before: Column, after: Column) -> Column:
    n, m = F.length(before), F.length(after)
    return (
        F.when(is_blank(after), "the rewrite came back empty")
        .when(m * 3 < n, "the rewrite dropped most of the text")
        .when(m > n * 3, "the rewrite ran away")
    )


def shorter_gate(before: Column, after: Column) -> Column:
    return F.when(is_blank(after), "the summary came back empty").when(F.length(after) >= F.length(before), "the summary is no shorter than the text")


def answer_gate(before: Column, after: Column) -> Column:
    """Length first, then commentary."""
    return F.coalesce(length_gate(before, after), F.when(commentary(before, after), "the rewrite talked about the task instead of doing it"))


def lost(before: Column, after: Column) -> Column:
    """What of a shape (struct of tables, links, list_items) fell to zero."""
    return (
        F.when((before["tables"] > 0) & (after["tables"] == 0), "the table was lost")
        .when((before["links"] > 0) & (after["links"] == 0), "the links were lost")
        .when((before["list_items"] > 0) & (after["list_items"] == 0), "the list was lost")
    )


def style_gate(baseline_score: Column, final_score: Column) -> Column:
    return F.when((baseline_score > 0) & (final_score >= baseline_score), "the style did not improve")


def worth_another_draw(kind: Column) -> Column:
    """A second draw can help where structure or facts were lost, not where the text is too long, the style stays, or the model fails."""
    return F.coalesce(kind.isin("structure", "facts"), F.lit(False))
