"""Inputs with known results for operators that SQL cannot express, as two queries that run them in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.functions import codecs, markup
from proseloom.functions.clean import clean_texts
from proseloom.functions.facts import protect, restore
from proseloom.operators import chunk, detect, gates
from proseloom.plans import prompts, rewrite
from proseloom.sources.default_pack import default_pack

_A, _B, _C = "a" * 30, "b" * 30, "c" * 30
_EMAIL = "Three vendors are done. Two are due by Friday. Budget is fine."
_LIST = "Key takeaways:\n\n- Growth: revenue rose.\n- Retention: churn fell.\n"
#: (operator, input, second input, result); results are text, null where there is none.
CASES: list[tuple[str, str | None, str | None, str | None]] = [
    ("clean", "We did it in order to ship.", None, "We did it to ship."), ("clean", "Slow due to the fact that it blocks.", None, "Slow because it blocks."), ("clean", "In order to ship, we cut scope.", None, "To ship, we cut scope."),
    ("clean", "It is important to note that the build is green.", None, "The build is green."), ("clean", "Also, it is worth noting that tests pass.", None, "Also, tests pass."), ("clean", "It works—mostly.", None, "It works - mostly."),
    ("clean", "It works — mostly.", None, "It works - mostly."), ("clean", "It works -- mostly.", None, "It works -- mostly."), ("clean", "See pages 10–12.", None, "See pages 10-12."),
    ("clean", "The reorder took time and the disorder toppled it.", None, "The reorder took time and the disorder toppled it."), ("clean", "We shipped. At the end of the day, this is fine.", None, "We shipped. This is fine."),
    ("clean", "The plan, at the end of the day, was vague.", None, "The plan was vague."), ("clean", "In order to ship—it is important to note that the table is final.", None, "To ship - the table is final."),
    ("clean", "in the realm of order to", None, "in order to"), ("clean", "— x", None, "- x"), ("clean", "x —", None, "x - "), ("clean", "a — — b", None, "a - - b"), ("clean", None, None, None), ("clean", "", None, ""),
    ("fixes", "In order to ship — we cut scope due to the fact that it slipped.", None, "3"),
    ("findings", "In today's rapidly evolving market.", None, "1"), ("findings", "In today’s rapidly evolving market.", None, "1"), ("findings", "It is not just fast but reliable.", None, "1"), ("findings", "Nothing to see here.", None, "0"),
    ("findings", "in the realm of", None, "2"), ("findings", "streamline and streamlines", None, "2"), ("findings", "streamline it", None, "0"), ("findings", "deep divers", None, "1"), ("findings", None, None, "0"),
    ("gate_score", "The stakes are high. It is a testament.", None, "4"), ("repair_score", "The stakes are high. It is a testament.", None, "9"),
    ("protect", "£1.4m", None, "[[F00]]"), ("protect", "£9 million", None, "[[F00]]"), ("protect", "£4,500", None, "[[F00]]"), ("protect", "$7k", None, "[[F00]]"), ("protect", "£5 monthly", None, "[[F00]] monthly"), ("protect", "£5 km", None, "[[F00]] km"),
    ("protect", "See https://example.com/2024-01-30/invoice/99999 today.", None, "See [[F00]] today."), ("protect", "Call at 3:30pm, again at 09:15.", None, "Call at [[F00]], again at [[F01]]."), ("protect", "We cut 3 of the 12 sections.", None, "We cut 3 of the 12 sections."),
    ("protect", "+1 (499) 555-6503%%%", None, "+1 (499) 555-[[F00]]%%"),
    ("restore", "Pay [[F00]] by [[F02]].", "£4,500|billing@example.com|March 12", "missing"), ("restore", "Pay [[F00]] [[F00]].", "£4,500", "duplicated"), ("restore", "Pay [[F99]].", "£4,500", "unknown"), ("restore", "Pay [[F0]] now.", "£4,500", "Pay £4,500 now."),
    ("restore_subset", "Pay [[F00]] by [[F02]].", "£4,500|billing@example.com|March 12", "Pay £4,500 by March 12."),
    ("chunks", f"{_A}\n\n{_B}\n\n{_C}", None, "2"), ("chunks", "x" * 101, None, None), ("chunks", "", None, "0"),
    ("keep_paragraphs", _EMAIL, _EMAIL.replace(". ", ".\n"), _EMAIL), ("keep_paragraphs", "First point. More on it.\n\nSecond point.", "First point.\nMore on it.\n\nSecond point.", "First point. More on it.\n\nSecond point."),
    ("keep_paragraphs", _EMAIL, "- one\n- two", "- one\n- two"),
    ("target", "w " * 400, None, "100"), ("target", "w w w w", None, "4"), ("target", "", None, "0"),
    ("lost", _LIST, "Key takeaways: revenue rose and churn fell.", "the list was lost"), ("lost", "[a](https://x.example)", "[a]()", "the links were lost"), ("lost", "| a |\n| --- |\n| b |", "a b", "the table was lost"), ("lost", _LIST, "- one", None),
    ("markup", "- a\n- b\n", None, "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"), ("markup", "# A *b* ~~c~~", None, "<h1>A <em>b</em> <del>c</del></h1>\n"),
    ("markdown", "<h2>A</h2><p>b <b>c</b> <a href='u'>d</a></p><table><tr><td>x</td></tr><tr><td>y</td></tr></table>", None, "## A\n\nb **c** [d](u)\n\n| x |\n| --- |\n| y |"), ("markdown", "<p>a<a href='#x'> </a></p>", None, "a"),
    ("preview", "<p onclick='x()'>a<script>b</script><img src='c'> <a href='javascript:d'>e</a></p>", None, '<p>a <a rel="noopener noreferrer">e</a></p>'), ("preview", None, "a < b", "<pre>a &lt; b</pre>"),
    ("diff", "a b c", "a x c", "<pre>a <del>b</del><ins>x</ins> c</pre>"), ("diff", "<a>", "<a>", "<pre>&lt;a&gt;</pre>"),
    ("payload", "<p>é</p>", None, "<p>é</p>"), ("payload", "", None, ""),
    ("map_text", "<p>in order to <code>in order to</code></p>", None, "<p>IN ORDER TO <code>in order to</code></p>"),
]

#: Documents and their answers by (chunk, stage, draw, answer, error), one for each way a rewrite can end, and how it ends: kind, text.
ENDS: list[tuple[str, list[tuple], str | None, str | None]] = [
    ("It stands as one. Pay £4,500.", [(0, "edit", 0, "It is one. Pay [[F00]].", None)], None, "It is one. Pay £4,500."),
    ("It stands as one. Pay £4,500.", [(0, "edit", 0, "It is one. Pay £4,500.", None)], "facts", None),
    ("It stands as one thing.", [(0, "edit", 0, "Yes it stands as one.", None)], "style", None),
    ("Some words here.", [(0, "edit", 0, "", None), (0, "edit", 1, "Some plain words in order to see.", None)], None, "Some plain words to see."),
    ("Some words here.", [(0, "edit", 0, "Here is the rewritten text.", None), (0, "edit", 1, "x", None)], "structure", None),
    ("It stands as one.", [(0, "edit", 0, None, "no server")], "model", None),
    ("x" * 30_001, [], "too_long", None),
    ("- a first thing\n- a second thing", [(0, "edit", 0, "a first thing, a second thing", None)], "structure", None),
    ("It stands as one.", [(0, "edit", 0, "Now it stands as one thing.", None), (0, "repair", 0, "It is one thing — now.", None)], None, "It is one thing - now."),
]


def goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, op, result) of every case."""
    pack = default_pack()
    rows = spark.createDataFrame([(i, op, a, b) for i, (op, a, b, _) in enumerate(CASES)], "n long, op string, a string, b string")

    def of(op: str, result: Column, df: DataFrame | None = None) -> DataFrame:
        return (rows if df is None else df).where(F.col("op") == op).select("n", "op", result.cast("string").alias("result"))

    a, b = F.col("a"), F.col("b")
    cleaned, found = clean_texts(rows, pack, "a"), detect.with_findings(rows, pack, "a")
    split = rows.withColumn("v", F.split("b", r"\|"))
    again = lambda drop: (lambda r: F.coalesce(r["text"], r["violation"]["kind"]))(restore(a, F.col("v"), may_drop=drop))
    upper = F.pandas_udf(lambda s: s.map(lambda t: markup.map_text(t, str.upper)), "string")
    parts = [
        of("clean", F.col("cleaned"), cleaned), of("fixes", F.col("fixes"), cleaned), of("findings", F.size("findings"), found), of("gate_score", detect.gate_score(F.col("findings")), found), of("repair_score", detect.repair_score(F.col("findings")), found),
        of("protect", protect("a")["text"]), of("restore", again(False), split), of("restore_subset", again(True), split), of("chunks", F.when(chunk.chunks(a, 62, 100).isNotNull(), F.size(chunk.chunks(a, 62, 100)))),
        of("keep_paragraphs", chunk.keep_paragraphs(a, b)), of("target", prompts.target_words(a)), of("lost", gates.lost(F.col("x"), F.col("y")), rows.withColumn("x", markup.shape(markup.html_of("a"))).withColumn("y", markup.shape(markup.html_of("b")))),
        of("markup", markup.html_of("a")), of("markdown", markup.markdown_of("a")), of("preview", markup.preview("a", "b")), of("diff", markup.word_diff("a", "b")), of("payload", codecs.parse_payload(codecs.build_payload(a))), of("map_text", upper("a")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rewrite_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, text): how the rewriting plan ends for each document of ENDS."""
    docs = spark.createDataFrame([(i, d) for i, (d, *_) in enumerate(ENDS)], "doc_id long, text string")
    answers = spark.createDataFrame([(i, *a) for i, (_, own, *_) in enumerate(ENDS) for a in own], "doc_id long, chunk int, stage string, draw int, answer string, error string")
    out = rewrite.rewrite(docs, answers, default_pack())
    return out.select("doc_id", F.col("rejected.kind").alias("kind"), "text")


def _sql(value: str | int | None) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


SQL = {
    "goldens": "SELECT CAST(n AS BIGINT) AS n, op, CAST(result AS VARCHAR) AS result FROM (VALUES " + ", ".join(f"({i}, {_sql(op)}, {_sql(r)})" for i, (op, _, _, r) in enumerate(CASES)) + ") t(n, op, result)",
    "rewrite_ends": "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(kind AS VARCHAR) AS kind, CAST(text AS VARCHAR) AS text FROM (VALUES " + ", ".join(f"({i}, {_sql(k)}, {_sql(t)})" for i, (_, _, k, t) in enumerate(ENDS)) + ") t(doc_id, kind, text)",
}
