"""Every core query that has SQL against that SQL, over the smallest tables."""

import glob
import numbers
import os

import pytest

import proseloom.queries as core
from proseloom.functions.clean import Cleaner
from proseloom.functions.facts import claim, protect_str
from proseloom.functions.markup import map_text, preview_str

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def _one(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType"):
        return ""
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    return ("" if v != v else f"{float(v):.6f}") if isinstance(v, numbers.Number) else str(v)


def _rows(df):
    return sorted(tuple(map(_one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, views, name):
    assert _rows(core.queries()[name](spark, SMALL).toPandas()) == _rows(views.sql(core.oracle_sql()[name]).df())


def test_what_has_no_sql():
    assert set(core.queries()) - set(core.oracle_sql()) == {"cleaned", "cleaned_documents", "fact_kinds", "protected_docs", "answer_decisions", "previews"}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_key: r for r in spark.read.parquet(f"{SMALL}/clip_docs.parquet").collect()}


def rows_of(spark, name):
    return core.queries()[name](spark, SMALL).collect()


def test_cleaning_against_the_cleaner(spark, docs):
    pack = core._pack(spark, SMALL)
    cleaner = Cleaner(pack.phrases)
    derived = {r.doc_key: r.text for r in core._derived(spark, SMALL, pack).collect()}
    got = rows_of(spark, "cleaned")
    assert len(got) == len(docs) and all((r.cleaned, r.fixes) == cleaner.clean(derived[r.doc_key]) for r in got) and sum(r.fixes for r in got) > 0
    for r in rows_of(spark, "cleaned_documents"):
        own = docs[r.doc_key]
        assert r.text == cleaner.clean(own.text)[0] and r.html == (None if own.html is None else map_text(own.html, lambda t: cleaner.clean(t)[0]))


def test_facts_against_the_claims(spark, docs):
    want = {k: protect_str(r.text) for k, r in docs.items()}
    assert {r.doc_key: (r.text, r.n_values) for r in rows_of(spark, "protected_docs")} == {k: (t, len(v)) for k, (t, v) in want.items()}
    kinds = {}
    for k, r in docs.items():
        for _, _, kind in claim(r.text):
            kinds.setdefault(kind, []).append(k)
    assert {r.kind: (r.docs, r.spans) for r in rows_of(spark, "fact_kinds")} == {k: (len(set(v)), len(v)) for k, v in kinds.items()}


def test_previews_and_decisions(spark, docs):
    assert {r.doc_key: r.preview for r in rows_of(spark, "previews")} == {k: preview_str(r.html, r.text) for k, r in docs.items()}
    decisions = {r.decision: r.rows for r in rows_of(spark, "answer_decisions")}
    assert sum(decisions.values()) == spark.read.parquet(f"{SMALL}/bench_rows.parquet").select("model", "run", "id").distinct().count() and set(decisions) <= {"accepted", "model", "facts", "structure", "style"}
