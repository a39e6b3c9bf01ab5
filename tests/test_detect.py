import random

from pyspark.sql import functions as F

from proseloom.operators import detect, score
from proseloom.sources.pack import DETECTORS, Pack, Phrase, Tier, _build

PACK = _build(
    [Phrase("in order to", "to", "filler", 3), Phrase("in today's rapidly evolving", None, "significance", 5), Phrase("best practices", None, "jargon", 2), Phrase("deep dive", None, "jargon", 3)],
    [Tier(1, 5, ("testament", "empower", "ever-evolving")), Tier(2, 3, ("paradigm", "cutting-edge"), min_distinct=2), Tier(3, 1, ("valuable",), max_density_pct=1.5)],
    DETECTORS,
)
HITS = {
    "em-dash": "It works -- mostly.", "curly-double-quotes": "a “word”", "emoji": "Go \U0001f680 now", "negative-parallelism": "It is not only fast but small.", "its-not-x-its-y": "It's not a tool, it’s a way.", "negative-listing": "Not a plan. Not an idea.",
    "ing-tail": "It grew, reflecting demand.", "copula-avoidance": "It boasts a view.", "vague-attribution": "Experts say so.", "chatbot-artifact": "Happy to help!", "cutoff-disclaimer": "As of my last training it held.", "hedging-stack": "It could possibly end.",
    "generic-conclusion": "Watch this space.", "significance-inflation": "It is deeply rooted.", "throat-clearing": "Let’s dive in.", "authority-trope": "At its core.", "vague-declarative": "The reasons are structural.", "false-agency": "The numbers tell us.",
    "inline-header-list": "x\n- **Key**: value", "oxford-triple": "rouge, été, and épic",
}


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r.findings for r in detect.with_findings(df, PACK).orderBy("k").collect()]


def test_every_detector_fires_on_its_sentence(spark):
    assert set(HITS) == {d[0] for d in DETECTORS}
    for (name, _), f in zip(HITS.items(), found(spark, *HITS.values())):
        assert name in {x.id for x in f}, name


def test_plain_prose_has_no_findings(spark):
    assert found(spark, "The old pump broke on Monday and we mended it.", "", None, "Reorder the list.", "x" * 5000) == [[]] * 5


def test_gates_and_order(spark):
    text = "The Testament went IN ORDER TO. paradigm, cutting-edge; best practices, deep divers in today’s rapidly evolving world."
    f = found(spark, text, "a paradigm only", "a paradigm and paradigm", "valuable " + "word " * 30, "valuable " + "word " * 99, "édelve testament_ testaments", "testament Testament")
    assert [(x.matched, x.weight, x.tier) for x in f[0]] == [("in today's rapidly evolving", 5, None), ("testament", 5, 1), ("cutting-edge", 3, 2), ("deep dive", 3, None), ("in order to", 3, None), ("paradigm", 3, 2), ("best practices", 2, None)]
    assert [len(x) for x in f[1:]] == [0, 0, 1, 0, 0, 1]


def test_deduplication_keeps_the_first(spark):
    f = found(spark, "It stands as one. It STANDS AS two. ☀ ☁")[0]
    assert [(x.id, x.matched) for x in f] == [("copula-avoidance", "stands as"), ("emoji", "☀")]


def test_scores(spark):
    kind = f"array<{detect.FINDING}>"
    rows = [([(0, "vocab:x", "x", "vocabulary", 5, 1), (1, "r", "y", "c", 3, None), (2, "vocab:z", "z", "vocabulary", 1, 3), (3, "inline-header-list", "h", "c", 3, None)],), ([],)]
    df = spark.createDataFrame(rows, f"f {kind}")
    got = df.select(detect.repair_score(F.col("f")), detect.gate_score(F.col("f")), detect.probe_score(F.col("f")), F.size(detect.checklist(F.col("f"))), F.size(detect.repair_targets(F.col("f")))).collect()
    assert tuple(got[0]) == (8, 3, 3, 2, 2) and tuple(got[1]) == (0, 0, 0, 0, 0)


def test_islands_and_tells(spark):
    spans = score.tell_spans(PACK)
    texts = ["A testament — in the world of — best practices", "nothing", None, "It is a Testament. Studies show it. studies show it."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", spans("t").alias("s"))
    got = {r.k: r for r in df.select("k", "s", score.islands(F.col("s")).alias("n")).collect()}
    # detectors without flags of their own mind the case here
    assert got[0].n == 4 and got[1].n == 0 and got[2].n == 0 and got[3].n == 2
    rows = [("a", 0, 5), ("a", 3, 8), ("a", 8, 9), ("b", 1, 2), ("a", 1, 2)]
    out = score.island_rows(spark.createDataFrame(rows, "k string, s int, e int"), ["k"], "s", "e").collect()
    assert sorted((r.k, r.s, r.e, r.n) for r in out) == [("a", 0, 8, 3), ("a", 8, 9, 1), ("b", 1, 2, 1)]


def test_rollups(spark):
    rows = [("m", 0, "i", 10, "abc", None, ["a", "z", None], 5, 1), ("m", 1, "i", None, None, "why", ["a"], 6, None), ("m", 1, "j", 30, "q", "why", None, 6, 3)]
    df = spark.createDataFrame(rows, "model string, run int, id string, ms long, output string, rejected string, facts array<string>, load_ms long, vram_mib long")
    df = df.withColumn("lost", score.facts_lost(F.col("facts"), F.col("output")))
    r = score.model_rollup(df).collect()[0]
    # time to load and memory are those of the first row
    assert (r.runs, r.rewrites, r.rejected, r.facts_lost, r.median_ms, r.load_ms, r.vram_mib) == (2, 3, 2, 2, 20.0, 5, 1)
    assert score.rejection_reasons(df).collect()[0].n == 2
    assert score.model_rollup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("k", 2, "new")], "k string, t int, v string")
    assert [tuple(x) for x in score.latest(twice, ["k"], "t").collect()] == [("k", 2, "new")]


def test_totals(spark):
    rows = spark.createDataFrame([("b", 0, "i", 9, 9), ("a", 1, "i", 3, 1), ("a", 0, "i", 3, 1), ("a", 0, "j", 2, 2)], "model string, run int, id string, input long, baseline long")
    own = score.samples(rows, "input", "baseline")
    assert tuple(score.corpus_totals(own).first()) == (2, 5, 3) and tuple(score.corpus_totals(score.samples(rows.limit(0), "input", "baseline")).first()) == (0, 0, 0)
    counted = spark.createDataFrame([("m", 0, 3), ("m", 1, 1), ("n", 0, 0)], "model string, run int, output long")
    assert sorted(map(tuple, score.drop_against(counted, 8).collect())) == [("m", 2, 4, 2.0, 75.0), ("n", 1, 0, 0.0, 100.0)]
    assert {r.drop_pct for r in score.drop_against(counted, 0).collect()} == {0.0}
    probe = spark.createDataFrame([("m", None, 5, 2), ("m", "why", 4, 1), ("m", None, 3, None)], "model string, rejected string, before long, after long")
    assert tuple(score.probe_totals(probe).first()) == ("m", 12, 9, 1)
    wide = score.sample_table(rows, "input", ["a", "b"]).orderBy("id").collect()
    assert (wide[0].a, wide[0].b, wide[1].b) == (3.0, 9.0, None)


def test_sql_functions(spark):
    from proseloom.functions.register import register, register_spans

    names = register(spark, PACK)
    assert len(names) == 11
    row = spark.sql("SELECT fold_text('ÀB’s') AS f, count_words('a b-c') AS n, clean_text('In order to go') AS c, count_fixes('a – b') AS x, protect_text('£5').text AS p, html_shape('<li>a</li>').list_items AS li").first()
    assert tuple(row) == ("Àb's", 2, "To go", 1, "[[F00]]", 1)
    register_spans(spark)
    assert [tuple(r) for r in spark.sql("SELECT kind, value FROM fact_rows('Pay £5 by 2024-01-30')").collect()] == [("money", "£5"), ("iso_date", "2024-01-30")]
    assert spark.sql("SELECT gate_score('The stakes are high.') AS g, gate_score(NULL) AS n").first() == (4, 0)
    rows = spark.sql("SELECT t.n, d.* FROM VALUES (1, 'The stakes are high.'), (2, 'Nothing.') AS t(n, x), LATERAL detect(t.x) d").collect()
    assert [(r.n, r.id, r.matched, r.weight) for r in rows] == [(1, "vague-declarative", "The stakes are high", 4)]


def test_columns_against_the_row_form(spark):
    from proseloom.operators.rows import Detector
    from proseloom.sources.default_pack import TIER1, TIER2, TIER3, default_pack

    rng = random.Random(4)
    parts = [*TIER1[::9], *TIER2[::7], *TIER3, "in order to", "In today’s fast-paced", "deep dives", "It's not a bug, it's a habit.", "—", "a -- b", "“", "☀", "red, été, and épic", "The stakes are high", "THE STAKES ARE HIGH", "\n- **Name**: v", "not just a but b", "word", "word", "word", "x_y", ",", "."]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(150)] + ["", None]
    got = detect.with_findings(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string"), default_pack()).collect()
    own = Detector(default_pack())
    for r in got:
        assert [(f.id, f.matched, f.category, f.weight, f.tier) for f in r.findings] == own.find(r.text), r.text


def test_patterns_are_those_of_java(spark):
    from proseloom.sources.pack import detector

    assert detector("letters", r"\p{L}+", None, "c", 1) is not None
    for bad in ("(", "(?P<a>b)(?P=a)", r"\ud83d", "[z-a]"):
        assert detector("x", bad, None, "c", 1) is None


def test_hints_stand_in_every_match():
    from proseloom.functions.patterns import required
    from proseloom.sources.pack import DETECTORS

    assert required(r"\bthe (?:data|numbers) tells? us|end\b") == ["end", "the data tell", "the numbers tell"]
    for bad in ("a", r"\w+", "(", "(?:abc)?", "x*|abcd"):
        assert required(bad) is None
    assert sum(required(d[1]) is not None for d in DETECTORS) == 17


def test_default_pack():
    from proseloom.sources.default_pack import default_pack
    from proseloom.sources.pack import pack_or_default

    pack = default_pack()
    assert [len(t.words) for t in pack.tiers] == [69, 53, 9] and len(pack.phrases) == 38 and pack.phrase_count == 16 and len(pack.detectors) == 20
    for bad in ("", "{", "{}", '{"phrases": "nonsense"}', None):
        assert pack_or_default(bad)[0] is pack
