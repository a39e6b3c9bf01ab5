"""Running aggregates within keys of any size.

A window over a key is one task's work, however large the key. Here all rows are first put in the order of key and order column
by a range partitioning, whose bounds are quantiles that Spark takes from a sample, so a key that holds a third of all
rows spreads over a third of the partitions, whatever its order column looks like. A partition is a slice; slices are
aggregated, a window runs over the few slices of a key, and rows are only ordered within their slice. The sliced rows are
written once and read by each step. Their number is the session's ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.session import written

TOTALS = {"max": F.max, "min": F.min, "sum": F.sum}


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df``, written, with ``_slice``, which grows with ``order`` within each key, and ``_row``, which tells equal rows apart."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *keys, *order)
    return written(placed.withColumns({"_slice": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "slices")


def before(df: DataFrame, keys: list[str], order: list[str], value: Column, to: str, how: str = "max") -> DataFrame:
    """``df`` with the max, min or sum of ``value`` over the rows of its key that come before it in ``order``; null where there are none.

    ``df`` may be sliced already (by the same keys and order); then it stays so.
    """
    own_slices = "_slice" in df.columns
    cut = (df if own_slices else sliced(df, keys, order)).withColumn("_v", value)
    total = TOTALS[how]
    tops = cut.groupBy(*keys, "_slice").agg(total("_v").alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), total("_t").over(w).alias("_base"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] + [F.col("_slice") == F.col("_s")]
    own = Window.partitionBy(*keys, "_slice").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_own", total("_v").over(own)).join(tops, same)
    both = {"max": F.greatest, "min": F.least}.get(how, lambda a, b: F.coalesce(F.col(a) + F.col(b), a, b))("_base", "_own")
    out = out.withColumn(to, both).drop("_v", "_s", "_base", "_own", *[f"_key{i}" for i in range(len(keys))])
    return out if own_slices else out.drop("_slice", "_row")
