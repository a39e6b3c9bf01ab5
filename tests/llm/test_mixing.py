import numpy as np
from pyspark.sql import functions as F

from proseloom.llm.mixing import mix_report, mix_sources, quotas, split_tree

TARGETS = "source string, target_share double, max_repeat int"


def test_split_tree_keeps_every_block():
    counts = np.array([1000, 37, 0, 4])
    tree = split_tree(counts, 13, np.random.default_rng(1))
    assert (tree.sum(0) == counts).all() and tree.sum(1).max() - tree.sum(1).min() <= 1 and tree.min() >= 0


def test_quotas():
    plan = {q.source: q for q in quotas({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2)])}
    assert round(plan["b"].want, 6) == 30 and round(plan["a"].want, 6) == 37.5 and plan["gone"].want == 0
    assert plan["b"].passes == 3
    plan = {q.source: q for q in quotas({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 3)], total=1000)}
    assert plan["a"].want == 100 and plan["b"].want == 30


def test_mix_against_its_definition(spark):
    rows = [(i, "hot" if i % 3 else "small", 5 + i % 11) for i in range(3000)] + [(9001, None, 5), (9002, "other", 5), (9003, "hot", 0), (9003, "hot", None)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("hot", 0.3, 1), ("small", 0.6, 2), ("none", 0.1, 2), (None, 0.1, 2)], TARGETS)
    mixed, plan = mix_sources(items, targets, "doc_id", "n_tokens", shards=7)
    got = mixed.collect()
    assert len({(r.doc_id, r["pass"]) for r in got}) == len(got) and {r.source for r in got} == {"hot", "small"}
    assert {r.shard for r in got} == set(range(7))
    uses = {}
    for r in got:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(uses[k] for k in uses if k % 3 == 0) <= 2 and max(uses[k] for k in uses if k % 3) == 1
    report = {r.source: r for r in mix_report(mixed, plan).collect()}
    assert abs(report["small"].actual_share - 2 / 3) < 0.002 and report["none"].mix_items == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(items.repartition(5), targets, "doc_id", "n_tokens", shards=7)[0].collect()))


def test_empty(spark):
    items = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixed, plan = mix_sources(items, targets, "doc_id", "n_tokens")
    assert mixed.count() == 0 and mix_report(mixed, plan).collect()[0].actual_share == 0
    mixed, plan = mix_sources(items, targets.where(F.lit(False)), "doc_id", "n_tokens")
    assert mixed.count() == 0
