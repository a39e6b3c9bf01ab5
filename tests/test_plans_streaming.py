import os

import pytest

from proseloom.plans import prompts, providers, rewrite
from proseloom.sources import readers
from proseloom.sources.pack import DETECTORS, Phrase, Tier, _build
from proseloom.streaming import jobs
from pyspark.sql import functions as F

PACK = _build([Phrase("in order to", "to", "filler", 3)], [Tier(1, 5, ("testament",)), Tier(2, 3, ()), Tier(3, 1, ())], DETECTORS)
ANSWERS = "doc_id long, chunk int, stage string, draw int, answer string, error string"


def run(spark, docs, answers, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a = spark.createDataFrame([(i, c, "edit", n, t, e) for i, c, n, t, e in answers], ANSWERS)
    return {r.doc_id: r for r in rewrite.rewrite(d, a, PACK, **kw).collect()}


def test_whole_plan(spark):
    long = "para one is here.\n\n" * 3
    docs = [(1, "It stands as one. Pay £4,500."), (2, "It stands as one. Pay £4,500."), (3, "It stands as one thing."), (4, "Some words here."), (5, "x" * 200), (6, long), (7, "It stands as one."), (8, "Some words here.")]
    answers = [
        (1, 0, 0, "It is one. Pay [[F00]].", None), (2, 0, 0, "It is one. Pay £4,500.", None), (3, 0, 0, "Yes it stands as one.", None), (4, 0, 0, "", None), (4, 0, 1, "Some plain words in order to see.", None),
        (6, 0, 0, "para one was here.\n\npara one was here.", None), (6, 1, 0, "As an AI I can't do that.", None), (7, 0, 0, None, "no server"), (8, 0, 0, "Other plain words.", None), (8, 0, 0, "Other plain words.", None),
    ]
    out = run(spark, docs, answers, target=40, ceiling=60, total=150)
    assert out[1].text == "It is one. Pay £4,500." and out[1].rejected is None
    assert out[2].rejected.kind == "facts" and out[2].text is None
    assert out[3].rejected.kind == "style" and out[4].text == "Some plain words to see."
    assert out[5].rejected.kind == "too_long" and out[7].rejected == ("model", "no server")
    assert out[6].text == "para one was here.\n\npara one was here.\n\npara one is here." and out[6].n_refused == 1
    assert out[8].text == "Other plain words."


def test_condensing_modes(spark):
    docs = [(1, "One long sentence with a date of March 12 and more."), (2, "One long sentence here."), (3, "- a list item here\n- another list item")]
    answers = [(1, 0, 0, "One sentence.", None), (2, 0, 0, "One long sentence, not shorter at all.", None), (3, 0, 0, "a list item here, another", None)]
    out = run(spark, docs, answers, mode="tldr")
    assert out[1].text == "One sentence." and out[2].rejected.message.startswith("the summary is no shorter") and out[3].text
    out = run(spark, docs, answers, mode="simplify")
    assert out[1].rejected.message == "the rewrite dropped most of the text" and out[3].rejected.message == "the list was lost"


def test_too_long_paragraph_rejects_the_document(spark):
    parts = rewrite.split_documents(spark.createDataFrame([(1, "a\n\n" + "b" * 50), (2, ""), (3, "ok")], "doc_id long, text string"), "text", 20, 40, 100).collect()
    assert {(r.doc_id, r.gate, r.n_chunks) for r in parts} == {(1, "too_long", 0), (2, "single", 1), (3, "single", 1)}


def test_ask_and_repairs(spark):
    def model(system, text):
        if "bad" in text:
            raise RuntimeError("down")
        return text.upper()

    req = spark.createDataFrame([(1, 0, "edit", 0, "s", "good"), (2, 0, "edit", 0, "s", "bad")], "doc_id long, chunk int, stage string, draw int, system string, text string")
    got = {r.doc_id: (r.answer, r.error) for r in rewrite.ask(req, model, parallel=2).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "down")}


def test_repairs_come_before_the_gates(spark):
    docs = [(1, "It stands as one for £5."), (2, "It stands as one."), (3, "It stands as one."), (4, "It stands as one.")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(1, 0, "edit", 0, "Now it stands as one thing for [[F00]].", None), (1, 0, "repair", 0, " It is one thing — for [[F00]]. ", None)]
    rows += [(2, 0, "edit", 0, "Now it stands as one thing.", None), (2, 0, "repair", 0, "It stands as two.", None)]
    rows += [(3, 0, "edit", 0, "Now it stands as one thing.", None), (3, 0, "repair", 0, "x", None)]
    rows += [(4, 0, "edit", 0, "Now it stands as one thing.", None), (4, 0, "edit", 1, "It stands as that.", None), (4, 0, "repair", 1, "It is one thing.", None)]
    out = {r.doc_id: r for r in rewrite.rewrite(d, spark.createDataFrame(rows, ANSWERS), PACK).collect()}
    # the repaired text is cleaned and judged as any other
    assert out[1].text == "It is one thing - for £5." and out[1].rejected is None
    # no gain and a text that fails the gates: the answer stands, and its style is refused, for which no second draw is made
    assert {out[i].rejected.kind for i in (2, 3, 4)} == {"style"}


def test_prompts_hold_no_protected_value(spark):
    text = "The offer is not just £4,500 but a bargain, so email bob@example.com by 2024-05-01.\n\n1. one\n2. two"
    parts = spark.createDataFrame([(1, 0, text)], "doc_id long, chunk int, part string")
    got = rewrite.requests(parts, PACK).orderBy("draw").collect()
    assert [r.draw for r in got] == [0, 1] and "not just [[F00]] but" in got[0].system and "2 bullet points" in got[0].system
    for mode in ("edit", "simplify", "tldr"):
        for r in rewrite.requests(parts, PACK, mode, draws=1).collect():
            assert "4,500" not in r.system + r.text and "bob@" not in r.system + r.text and "[[F01]]" in r.text
    answers = spark.createDataFrame([(1, 0, "edit", 0, "It is not just [[F00]] but a bargain. Email [[F01]] by [[F02]] in time, please.\n\n1. one\n2. two", None)], ANSWERS)
    (r,) = rewrite.repair_requests(parts, answers, PACK).collect()
    assert (r.stage, r.draw) == ("repair", 0) and "not just [[F00]] but" in r.system and "4,500" not in r.system + r.text


def test_rich_documents(spark):
    html = "<p>It stands as <b>one</b> in order to go.</p><ul><li>a first</li><li>a second</li></ul>"
    docs = spark.createDataFrame([(1, html, "x"), (2, html, "x"), (3, None, "- a first thing\n- a second thing")], "doc_id long, html string, text string")
    rows = [(1, 0, "edit", 0, "It is **one** in order to go.\n\n- a first\n- a second", None), (2, 0, "edit", 0, "It is **one** to go, a first and a second.", None), (3, 0, "edit", 0, "a first thing, a second thing", None)]
    out = {r.doc_id: r for r in rewrite.rewrite(docs, spark.createDataFrame(rows, ANSWERS), PACK).collect()}
    assert out[1].rejected is None and "<strong>one</strong> to go" in out[1].html and out[1].html.count("<li>") == 2 and out[1].text.startswith("It is **one** to go.")
    assert out[2].rejected.message == out[3].rejected.message == "the list was lost" and out[2].html is None


def test_structure_of_the_whole(spark):
    # each group passes alone, since neither loses all of what it has; the whole has lost its only table
    table = "| a | b |\n| --- | --- |\n| c | d |"
    docs = spark.createDataFrame([(1, f"Some words stand here.\n\n{table}")], "doc_id long, text string")
    rows = [(1, 0, "edit", 0, "Other words stand here.", None), (1, 1, "edit", 0, "a table of c and d with some more words", None)]
    out = rewrite.rewrite(docs, spark.createDataFrame(rows, ANSWERS), PACK, target=30, ceiling=90, total=900).first()
    assert out.n_refused == 1 and out.text == f"Other words stand here.\n\n{table}"
    html = "<p>Some words stand here in a row.</p><p>More words in order to see.</p>"
    docs = spark.createDataFrame([(1, html, "x")], "doc_id long, html string, text string")
    rows = [(1, 0, "edit", 0, "Some words are here in a row.", None), (1, 1, "edit", 0, "More words — to see.", None)]
    out = rewrite.rewrite(docs, spark.createDataFrame(rows, ANSWERS), PACK, target=40, ceiling=90, total=900).first()
    assert out.rejected is None and out.html == "<p>Some words are here in a row.</p>\n<p>More words - to see.</p>\n"


def test_summaries_of_summaries(spark):
    para = "A paragraph of some forty letters is here."
    docs = spark.createDataFrame([(1, f"{para}\n\n{para}\n\n{para}"), (2, f"{para}\n\n{para}"), (3, para), (4, f"{para}\n\n{para}")], "doc_id long, text string")
    rows = [(1, c, "edit", 0, "Short words.", None, 0) for c in range(3)] + [(1, 0, "edit", 0, "Shorter.", None, 1)]
    rows += [(2, 0, "edit", 0, para + " And more.", None, 0), (2, 1, "edit", 0, "A paragraph of some forty letters here.", None, 0), (3, 0, "edit", 0, "Short.", None, 0)]
    rows += [(4, 0, "edit", 0, "Two words.", None, 0), (4, 1, "edit", 0, None, "no server", 0)]
    answers = spark.createDataFrame(rows, ANSWERS + ", round int")
    out = {r.doc_id: r for r in rewrite.rewrite(docs, answers, PACK, "tldr", target=44, ceiling=90, total=900).collect()}
    assert out[1].text == "Shorter." and out[3].text == "Short." and out[4].rejected == ("model", "no server")
    # it has barely shrunk, and one group was refused
    assert out[2].text is None and out[2].rejected.message.startswith("the summary is no shorter")
    once = rewrite.rewrite(docs.where("doc_id = 1"), answers, PACK, "tldr", target=44, ceiling=90, total=900, most=1).first()
    assert once.rejected.kind == "too_long"


def test_clean_documents(spark):
    docs = spark.createDataFrame([(1, "rich", "<p>In order to go <code>in order to</code></p>", "In order to go"), (2, "plain", None, "a — b"), (3, "plain", None, "")], "k int, kind string, html string, text string")
    got = {r.k: (r.html, r.text, r.fixes) for r in rewrite.clean_documents(docs, PACK).collect()}
    assert got == {1: ("<p>To go <code>in order to</code></p>", "To go", 1), 2: (None, "a - b", 1), 3: (None, "", 0)}


def test_prompts(spark):
    for words, want in ((400, 100), (4, 4), (60, 25), (0, 0)):
        assert spark.range(1).select(prompts.target_words(F.lit("w " * words))).first()[0] == want
    shape = F.struct(F.lit(0).alias("tables"), F.lit(1).alias("links"), F.lit(2).alias("list_items"))
    text = spark.range(1).select(prompts.editing_prompt(F.array().cast("array<struct<seq:int,id:string,matched:string,category:string,weight:int,tier:int>>"), shape, F.lit(False), F.lit(0))).first()[0]
    assert "2 bullet points" in text and "1 link written" in text and "[[F00]]" not in text and "No listed phrase" in text


def test_providers():
    assert rewrite.provider_error("off", True, True, True).startswith("superseded") and rewrite.provider_error("local", False, True, False) and rewrite.provider_error("remote", True, True, False) is None


EVENTS = [("s", 1, "begin", 1, ""), ("s", 2, "begin", 2, ""), ("s", 3, "result", 1, "late"), ("s", 4, "result", 2, "ok"), ("t", 1, "begin", 1, ""), ("t", 2, "result", 1, "fine"), ("t", 3, "begin", 2, "")]
KIND = "session string, seq long, kind string, job long, payload string"


def test_supersession_in_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, KIND)
    assert sorted(r.payload for r in jobs.current_results(df).collect()) == ["fine", "ok"]
    # files come in the order of their times
    for i, part in enumerate((EVENTS[:3], EVENTS[2:])):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (own,) = (tmp_path / f"part{i}").glob("*.parquet")
        target = own.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(target, (1_700_000_000 + 100 * i,) * 2)
    stream = jobs.current_results_stream(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("current").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.payload for r in spark.table("current").collect()) == ["fine", "ok"]


def test_changes_of_a_stream(spark, tmp_path):
    kind = "k string, n long, v string, mine boolean"
    parts = [[("a", 1, "x", None), ("a", 2, "x", None), ("a", 3, "y", True)], [("a", 3, "z", None), ("a", 4, "y", None), ("a", 5, "x", False), ("b", 1, "x", None)]]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (own,) = (tmp_path / f"p{i}").glob("*.parquet")
        os.utime(own.rename(tmp_path / "in" / f"{i}.parquet"), (1_700_000_000 + 100 * i,) * 2)
    stream = jobs.changed_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "k", "n", "v", "mine")
    q = stream.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.seq, r.value) for r in spark.table("changes").collect()) == [("a", 1, "x"), ("a", 5, "x"), ("b", 1, "x")]


def test_pauses_do_not_count_while_a_job_runs(spark):
    ts = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 01:00:00", 0), ("k", "2024-01-01 02:00:00", 0)], "k string, t string, n int").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in jobs.idle_sessions(ts, "k", "t", 600, "n").collect()) == [1, 2]
    assert sorted(r.n for r in jobs.idle_sessions(ts, "k", "t", 600).collect()) == [1, 1, 1]


def test_event_rules(spark):
    df = spark.createDataFrame(EVENTS, KIND)
    assert sorted((r.session, r.job) for r in jobs.latest_job(df, ["session"], ["seq"]).collect()) == [("s", 2), ("t", 2)]
    run = {(r.session, r.seq): r.running for r in jobs.in_flight(df).collect()}
    assert run[("s", 2)] == 2 and run[("s", 4)] == 0 and run[("t", 3)] == 1
    extra = jobs.in_flight(spark.createDataFrame([("u", 1, "result", 1, ""), ("u", 2, "begin", 2, "")], KIND)).orderBy("seq").collect()
    assert [r.running for r in extra] == [0, 1]
    ch = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")], "k string, n int, v string")
    assert [r.n for r in jobs.changed_only(ch, "k", "n", "v").orderBy("n").collect()] == [1, 3]
    ts = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:09:59"), ("k", "2024-01-01 00:19:59")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in jobs.idle_sessions(ts, "k", "t", 600).collect()) == [1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "a", "text": "t", "facts": ["x"], "more": 1}, {"id": "b", "text": "u", "facts": []}]')
    assert [r.id for r in readers.read_corpus(spark, str(tmp_path / "c.json")).collect()] == ["a", "b"]
    (tmp_path / "b.jsonl").write_text('{"model": "m", "run": 0, "id": "a", "ms": 5, "rejected": null, "facts": []}\n\n{"model": "m", "run": 1, "id": "b"}\n')
    rows = readers.read_bench(spark, str(tmp_path / "b.jsonl"))
    assert rows.count() == 2
    readers.write_jsonl(rows, str(tmp_path / "out"))
    assert readers.read_bench(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("\n one\n\ntwo \n")
    assert readers.read_whole_texts(spark, str(tmp_path / "t")).first().text == "one\n\ntwo"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.bin").write_bytes(b"<!--StartFragment-->hi<!--EndFragment-->\x00")
    assert readers.read_payloads(spark, str(tmp_path / "p")).first().fragment == "hi"
    df = spark.createDataFrame([("<p>x</p>", None, "x"), (None, "t", None), (" ", "t", None), (None, " ", None), ("<p></p>", None, "")], "h string, t string, d string")
    kinds = [r[0] and r[0].kind for r in df.select(readers.normalised(F.col("h"), F.col("t"), F.col("d"))).collect()]
    assert kinds == ["rich", "plain", "plain", None, None]


def test_samples_and_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "a", "text": "t", "facts": ["x"]}]')
    (tmp_path / "one.txt").write_text("\n some text \n")
    assert [tuple(r) for r in readers.read_samples(spark, str(tmp_path / "c.json")).collect()] == [("a", None, "t", ["x"])]
    assert [tuple(r) for r in readers.read_samples(spark, str(tmp_path / "one.txt")).collect()] == [("one.txt", None, "some text", [])]
    docs = spark.createDataFrame([(1, "<p>x</p>", "x"), (2, None, None)], "k int, html string, text string")
    readers.write_documents(docs, str(tmp_path / "out"))
    got = {r.k: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (got[2].kind, got[2].text, got[2].html, got[2].payload) == ("plain", "", None, None) and got[1].kind == "rich" and b"<p>x</p>" in bytes(got[1].payload)
    path = str(tmp_path / "s.toml")
    assert readers.load_settings(path, "a = 1\n") == ({"a": 1}, None) and readers.load_settings(path, "a = 2\n")[0] == {"a": 1}


def test_provider_notes_and_replies(spark, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k")
    none, some, env = providers.Remote("u", "m"), providers.Remote("u", "m", "key"), providers.Remote("u", "m", key_name="SOME_KEY")
    assert (none.usable, some.usable, env.usable, providers.Remote("", "m", "k").usable) == (False, True, True, False)
    assert providers.setup_note("remote", none, None, True).startswith("remote provider needs") and providers.setup_note("remote", some, "x", False) == "sending text to u"
    assert providers.setup_note("off", none, "x", False) is None and providers.setup_note("local", none, "x", False) == "x" and providers.setup_note("local", none, None, True) is None
    bodies = ['{"choices": [{"message": {"content": "hi"}}]}', '{"error": {"message": "no money"}, "choices": []}', '{"choices": []}', "nonsense", None, "{}"]
    got = [tuple(r.r) for r in spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i").select(providers.parse_reply(F.col("b")).alias("r")).collect()]
    assert got == [("hi", None), (None, "no money"), (None, "the reply contained no content"), (None, "unreadable reply"), (None, "unreadable reply"), (None, "the reply contained no content")]


def test_settings():
    base = 'a = 1\n[t]\nb = "x"\n'
    assert readers.overlay(base, '[t]\nb = "y"')[0] == {"a": 1, "t": {"b": "y"}}
    for bad in ("c = 1", "a = ", "t = 3", "[t]\nz = 1"):
        got, why = readers.overlay(base, bad)
        assert got == {"a": 1, "t": {"b": "x"}} and why
    assert readers.upsert_setting("mode = 1\nmode_x = 2\n[t]\n", "mode", "3") == "mode = 3\nmode_x = 2\n[t]\n"
    assert readers.upsert_setting("mode_x = 2\n[t]\nb = 1", "mode", "3") == "mode_x = 2\nmode = 3\n[t]\nb = 1\n" and readers.upsert_setting("", "a", "1") == "a = 1\n"


@pytest.mark.parametrize("name", ["doc_word_count", "finding_scores"])
def test_flagship_registers(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and name in __spark_entry__.oracle_sql()
