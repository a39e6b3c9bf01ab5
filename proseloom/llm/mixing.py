"""Mixing of sources to target shares of a total size, by a multivariate-hypergeometric splitting tree.

1. The size of the mix. ``share`` of the sources that are there is brought to a sum of one; the mix is the largest one in
   which every source can give its share by using each of its items at most ``max_repeat`` times (or the size asked for,
   in which case a source that cannot give its share gives all it may). A source of the targets without items gives
   nothing, a source without a target is left out; both are in the report.
2. Exact quotas. A source whose quota is q times its own size is used floor(q) times whole, and once more in part: its
   items in a random order, up to the rest of the quota. The random order is that of a seeded hash; its running sizes come
   from two levels (slices of the hash range, then inside a slice), so no source is ever sorted by one task.
3. Blocks. Running sizes cut every pass of a source into blocks of about ``block`` size units; the quota in blocks is
   exact. A tree over the output shards halves them again and again; at each node the number of blocks each source sends
   to the left half is one draw of the multivariate hypergeometric distribution. Leaves hold each shard's exact block
   count by source; a source's blocks, in a random order of their numbers, are dealt to the shards in ranges, so no block
   is drawn twice.
4. Inside a shard items are in the order of another hash; shards are what downstream readers shuffle locally.

What the driver holds is sources times shards numbers; shards are a parameter. Defined results: null and unknown sources
are left out; a repeated row is an item of its own; items of size 0 are left out (they add nothing to any share); empty
inputs give an empty mix and a report of zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED, SHARDS, BLOCKS_A_SHARD, SLICE_ROWS = 20240229, 16, 8, 20_000


@dataclass(frozen=True)
class Quota:
    source: str
    share: float
    max_repeat: int
    have: int
    want: float

    @property
    def passes(self) -> int:
        return int(self.want // self.have) if self.have else 0

    @property
    def rest(self) -> float:
        return self.want - self.passes * self.have if self.have else 0.0


def quotas(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Quota]:
    """What each source has to give; ``targets`` are (source, share, max_repeat)."""
    present = [(s, p, r) for s, p, r in targets if p and p > 0 and r and r > 0 and sizes.get(s, 0) > 0]
    whole = sum(p for _, p, _ in present)
    if total is None:
        total = min((sizes[s] * r * whole / p for s, p, r in present), default=0.0)
    live = {s: min(total * p / whole, float(sizes[s] * r)) for s, p, r in present}
    return [Quota(s, float(p or 0), int(r or 0), sizes.get(s, 0), live.get(s, 0.0)) for s, p, r in targets]


def split_tree(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns sum to ``blocks``, rows differ by one at most."""
    if shards == 1:
        return blocks[None, :]
    left = shards // 2
    total = int(blocks.sum())
    take = total * left // shards
    # above its method's limit numpy draws by marginals, one hypergeometric for each source
    draw = rng.multivariate_hypergeometric(blocks, take, method="marginals") if take else np.zeros_like(blocks)
    return np.concatenate([split_tree(draw, left, rng), split_tree(blocks - draw, shards - left, rng)])


def mix_sources(
    items: DataFrame, targets: DataFrame, key: str, size: str, total: float | None = None, shards: int = SHARDS, seed: int = SEED,
    max_targets: int = 10_000,
) -> tuple[DataFrame, list[Quota]]:
    """The mix as (``key``, source, pass, n_tokens, shard, place), and the quotas it was drawn for.

    ``items`` is (``key``, source, ``size``), computed already (a written table or a checkpoint): it is read twice.
    """
    rows = targets.select("source", "target_share", "max_repeat").where("source IS NOT NULL").limit(max_targets + 1).collect()
    if len(rows) > max_targets:
        raise ValueError("more targets than max_targets")
    by = {r.source: (r.source, r.target_share, r.max_repeat) for r in sorted(rows, key=str)}
    live = items.where((F.col(size) > 0) & F.col("source").isin(list(by)) if by else F.lit(False))
    live = live.select(F.col(key).alias("_key"), "source", F.col(size).cast("long").alias("n_tokens"))
    found = live.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n")).collect()
    have, n_items = {r.source: r.have for r in found}, sum(r.n for r in found)
    plan = quotas(have, list(by.values()), total)
    used = [q for q in plan if q.want > 0]
    block = max(1.0, sum(q.want for q in used) / (shards * BLOCKS_A_SHARD * max(1, len(used))))
    slices = max(1, -(-n_items // SLICE_ROWS))
    spark = items.sparkSession
    quota = spark.createDataFrame(
        [(q.source, q.passes, float(q.rest)) for q in used], "source string, passes int, rest double"
    )
    drawn = live.join(F.broadcast(quota), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    drawn = drawn.where((F.col("pass") < F.col("passes")) | (F.col("rest") > 0))
    drawn = drawn.withColumn("_h", F.xxhash64("_key", "n_tokens", "pass", F.lit(seed)))
    drawn = drawn.withColumn("slice", F.pmod(F.shiftright("_h", 32), F.lit(slices)))
    group = ["source", "pass", "slice"]
    offsets = drawn.groupBy(*group).agg(F.sum("n_tokens").alias("_size"))
    before = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*group).orderBy("_h", "_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("_own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, group)
    placed = placed.withColumn("_start", F.col("_base") + F.col("_own"))
    # the partial pass ends with the item that brings it nearest to the quota
    placed = placed.where((F.col("pass") < F.col("passes")) | (F.col("_start") + F.col("n_tokens") / 2 <= F.col("rest")))
    per_pass = {q.source: int(q.have // block) + 1 for q in used}
    counts = np.array([q.passes * per_pass[q.source] + (int(q.rest // block) + 1 if q.rest else 0) for q in used], dtype=np.int64)
    tree = split_tree(counts, shards, np.random.default_rng(seed)) if used else np.zeros((shards, 0), dtype=np.int64)
    # a source's blocks in random order: an affine step through their numbers; shard i takes its range of that order
    schema = "source string, per_pass long, n_blocks long, step long, shift long, ends array<long>"
    deal = spark.createDataFrame(
        [
            (q.source, per_pass[q.source], int(n), _step(int(n), seed + i), (seed * 31 + i) % max(1, int(n)), np.cumsum(tree[:, i]).tolist())
            for i, (q, n) in enumerate(zip(used, counts))
        ],
        schema,
    )
    placed = placed.join(F.broadcast(deal), "source")
    number = F.col("pass") * F.col("per_pass") + (F.col("_start") / F.lit(block)).cast("long")
    placed = placed.withColumn("_b", F.least(number, F.col("n_blocks") - 1))
    placed = placed.withColumn("_b", F.pmod(F.col("_b") * F.col("step") + F.col("shift"), F.col("n_blocks")))
    mixed = placed.select(
        F.col("_key").alias(key), "source", "pass", "n_tokens",
        F.size(F.filter("ends", lambda e: e <= F.col("_b"))).alias("shard"),
        F.xxhash64("_key", "pass", F.lit(seed + 1)).alias("place"),
    )
    return mixed, plan


def _step(n: int, seed: int) -> int:
    step = seed % max(1, n) or 1
    while np.gcd(step, max(1, n)) != 1:
        step += 1
    return int(step)


def mix_report(mixed: DataFrame, plan: list[Quota]) -> DataFrame:
    """For each target source: what it has, what the mix holds of it, its actual share, and its most used item."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count("*").alias("mix_items"), (F.max("pass") + 1).alias("most_used"))
    wanted = mixed.sparkSession.createDataFrame(
        [(q.source, q.share, q.max_repeat, q.have, q.want) for q in plan],
        "source string, target_share double, max_repeat int, source_tokens long, quota_tokens double",
    )
    whole = Window.partitionBy(F.lit(1))
    report = wanted.join(got, "source", "left").na.fill(0, ["mix_tokens", "mix_items", "most_used"])
    total = F.sum("mix_tokens").over(whole)
    return report.withColumn("actual_share", F.when(total > 0, F.col("mix_tokens") / total).otherwise(F.lit(0.0)))
