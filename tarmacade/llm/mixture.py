"""Mixing sources to target weights, by a splitting tree of exact block quotas.

1. Each source's documents are put in a random but fixed order (by hash); a distributed running
   sum of their sizes gives each its place, in tokens. A source that must repeat goes through
   its order again and again, at most its number of repeats.
2. The places are cut into blocks of equal size. The quota of a source is a number of blocks.
3. The quotas of all sources are split among the output shards by a tree: a node halves its
   shards and draws, multivariate hypergeometrically, how many blocks of each source the left
   half gets. Every draw is seeded by its node, so each shard walks its own path from the root
   on whatever machine it is; no quota is gathered on the driver, and the leaves add up exactly.
4. A leaf takes its blocks from a permutation of each source's blocks, disjoint from all other
   leaves, and shuffles their documents within itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmacade.session import cut_lineage

#: Documents whose order is summed up in one task.
BUCKET_ROWS = 50_000
MIXED = "shard long, position int, doc_id long, source string, copy int, repeats int, tokens long"


@dataclass(frozen=True)
class Quota:
    """What one source contributes: its supply, quota and number of blocks."""

    source: str
    supply: int
    tokens: int
    blocks: int
    factor: int
    shift: int


def quotas(supply: dict[str, int], shares: dict[str, float], repeats: dict[str, int], block: int, seed: int, total: int | None) -> list[Quota]:
    """The quotas for the total asked for, or the largest total that the sources can supply.

    Sources with nothing to give are left out and the other shares keep their proportions.
    Asking for more than can be supplied gives the largest possible total.
    """
    live = {s: w for s, w in shares.items() if w > 0 and supply.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not live:
        return []
    weight = sum(live.values())
    most = min(supply[s] * repeats[s] * weight / w for s, w in live.items())
    size = most if total is None else min(most, total)
    made, rng = [], np.random.default_rng(seed)
    for s, w in sorted(live.items()):
        tokens = min(supply[s] * repeats[s], round(size * w / weight))
        blocks = -(-tokens // block)
        factor = next(f for f in iter(lambda: int(rng.integers(1, max(2, blocks))), None) if math.gcd(f, max(1, blocks)) == 1)
        made.append(Quota(s, supply[s], tokens, blocks, factor, int(rng.integers(0, max(1, blocks)))))
    return made


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` out of good + bad are good; any counts, where the library stops at 10^9.

    Larger counts go through Devroye's generator for log-concave probabilities: a flat middle
    with exponential tails around the mode, accepted in proportion to the exact probability.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    least, most = max(0, drawn - bad), min(good, drawn)
    mode = min(most, max(least, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(drawn - k + 1) + math.lgamma(bad - drawn + k + 1))

    top = log_weight(mode)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    width = 1 + peak / 2
    while True:
        u, v, w, sign = rng.random(), rng.random(), rng.random(), rng.choice((-1, 1))
        y = v * width / peak if u <= width / (1 + width) else (width - math.log(v or 5e-324)) / peak
        k = mode + int(sign) * round(y)
        if least <= k <= most and w * min(1.0, math.exp(width - peak * y)) <= math.exp(log_weight(k) - top):
            return k


def drawn_of(rng: np.random.Generator, blocks: np.ndarray, drawn: int) -> np.ndarray:
    """A multivariate hypergeometric draw, source after source."""
    left, out = int(blocks.sum()), []
    for n in map(int, blocks):
        left -= n
        out.append(hypergeometric(rng, n, left, drawn))
        drawn -= out[-1]
    return np.array(out, dtype=np.int64)


def leaf(shard: int, shards: int, blocks: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks before, blocks of) a shard by source: the walk from the root to its leaf."""
    low, high, before, here, total = 0, shards, np.zeros_like(blocks), blocks, int(blocks.sum())
    even = lambda k: k * total // shards  # noqa: E731  # blocks of the first k shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = drawn_of(rng, here, even(middle) - even(low))
        if shard < middle:
            high, here = middle, left
        else:
            low, before, here = middle, before + left, here - left
    return before, here


def slots(spark: SparkSession, plan: list[Quota], shards: int, seed: int) -> DataFrame:
    """(source, slot, shard): the shard of every slot of every source, one row per block."""
    names, blocks = [q.source for q in plan], np.array([q.blocks for q in plan], dtype=np.int64)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard in batch["id"]:
                before, here = leaf(int(shard), shards, blocks, seed)
                rows += [(n, int(shard), int(b), int(b + h)) for n, b, h in zip(names, before, here) if h]
            yield pd.DataFrame(rows, columns=["source", "shard", "start", "stop"])

    leaves = spark.range(shards).mapInPandas(walk, "source string, shard long, start long, stop long")
    return leaves.select("source", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("slot"), "shard")


def in_order(items: DataFrame, n: int, seed: int) -> DataFrame:
    """The items with `before`, the tokens ahead of each in its source's random order."""
    buckets = max(1, n // BUCKET_ROWS)
    mixed = items.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    mixed = mixed.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = mixed.withColumn("local", F.sum("tokens").over(inside) - F.col("tokens"))
    if buckets == 1:
        return placed.withColumnRenamed("local", "before").drop("h", "bucket")
    sums = mixed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    ahead = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    return placed.join(ahead, ["source", "bucket"]).withColumn("before", F.col("ahead") + F.col("local")).drop("h", "bucket", "local", "ahead")


def mix(items: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, block_tokens: int = 16_384, shard_tokens: int = 4_194_304) -> DataFrame:
    """(shard, position, doc_id, source, copy, repeats, tokens): the mixture, one row per use.

    `items` is (doc_id, source, tokens) with unique ids, `targets` (source, target_share,
    max_repeats), one row per source; they are few and collected, the items never are. `copy`
    counts a text's uses from 0 and `repeats` is how often it is used in all, never more than
    `max_repeats`. Without `total_tokens` the mixture is as large as the sources allow. A
    source's tokens differ from its quota by at most half of its text at the quota's end. Texts
    of no size, of no source or of a source without a target are not used.
    """
    wanted = {r["source"]: r for r in targets.where("source is not null").collect()}
    usable = items.where(F.col("source").isin(*wanted) & (F.col("tokens") > 0)) if wanted else items.limit(0)
    usable = cut_lineage(usable.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")))
    supplied = usable.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    plan = quotas(
        {r["source"]: r["tokens"] for r in supplied}, {s: r["target_share"] or 0.0 for s, r in wanted.items()},
        {s: r["max_repeats"] or 0 for s, r in wanted.items()}, block_tokens, seed, total_tokens,
    )
    spark = items.sparkSession
    if not plan:
        return spark.createDataFrame([], MIXED)
    shards = max(1, round(sum(q.tokens for q in plan) / shard_tokens))
    by = lambda f: F.create_map(*[x for q in plan for x in (F.lit(q.source), F.lit(f(q)))])[F.col("source")]
    planned = in_order(usable, sum(r["n"] for r in supplied), seed).where(F.col("source").isin(*[q.source for q in plan]))
    planned = planned.withColumns({"supply": by(lambda q: q.supply), "quota": by(lambda q: q.tokens)})
    # Use k starts at before + k * supply; it is taken if at least half of it is within the quota.
    uses = F.floor((F.col("quota") - F.col("before") - F.col("tokens") / 2) / F.col("supply")).cast("int") + 1
    used = planned.withColumn("repeats", uses).where("repeats > 0").withColumn("copy", F.explode(F.expr("sequence(0, repeats - 1)")))
    block = F.expr(f"(before + copy * supply) div {block_tokens}")
    slot = F.pmod(block * by(lambda q: q.factor) + by(lambda q: q.shift), by(lambda q: q.blocks))
    # One row per block: it grows with the input though the optimizer can't see it, so no broadcast.
    placed = used.withColumn("slot", slot).join(slots(spark, plan, shards, seed).hint("merge"), ["source", "slot"])
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), "doc_id", "copy")
    return placed.withColumn("position", F.row_number().over(shuffled) - 1).select(
        "shard", "position", "doc_id", "source", "copy", "repeats", "tokens"
    )


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, actual_share, uses, texts, most_repeats).

    One row per target, with zeros for a source that gives nothing.
    """
    sums = mixed.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"),
        F.sum(F.when(F.col("copy") == 0, 1).otherwise(0)).alias("texts"), F.max("repeats").alias("most_repeats"),
    )
    joined = targets.where("source is not null").join(sums, "source", "left").na.fill(0, ["tokens", "uses", "texts", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    share = F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)
    return joined.select("source", "target_share", "max_repeats", "tokens", share.alias("actual_share"), "uses", "texts", "most_repeats")
