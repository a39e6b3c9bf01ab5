import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from proseloom.operators.running import before, sliced
from proseloom.operators.score import island_rows


def test_against_plain_windows(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(-50, 5000), i, rng.choice([None, *range(9)])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o long, i long, v long")
    w = Window.partitionBy("k").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, -1)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            cut = sliced(df, ["k"], ["o", "i"])
            assert cut.where("k = 'hot'").select("_slice").distinct().count() > parts // 2
            for how, fn in (("max", F.max), ("sum", F.sum), ("min", F.min)):
                want = sorted(map(tuple, df.select("i", fn("v").over(w)).collect()), key=str)
                for frame in (df, cut):
                    got = before(frame, ["k"], ["o", "i"], F.col("v"), "x", how)
                    assert sorted(map(tuple, got.select("i", "x").collect()), key=str) == want
                assert before(df, ["k"], ["o", "i"], F.col("v"), "x", how).columns == [*df.columns, "x"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert before(df.limit(0), ["k"], ["o"], F.col("v"), "x").count() == 0


def test_skewed_order_spreads(spark):
    # nearly all rows stand in one stretch of the order
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 10, F.col("id") * 1_000_000_000).otherwise(F.col("id")).alias("o"))
    sizes = [r["count"] for r in sliced(df, ["k"], ["o"]).groupBy("_slice").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1500


def test_equal_rows_keep_one_order(spark):
    df = spark.createDataFrame([("a", 5, 5)] * 30 + [("a", 1, 9)], "k string, s long, e long")
    assert [(r.island, r.n) for r in island_rows(df, ["k"], "s", "e").collect()] == [(1, 31)]
    points = island_rows(df.where("s = 5"), ["k"], "s", "e").collect()
    assert sorted(r.island for r in points) == list(range(1, 31)) and {r.n for r in points} == {1}
