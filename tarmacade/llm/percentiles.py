"""Percentiles of very large numeric columns per group, exact, by distributed multi-select.

Values are first counted: (group, value, weight), summed on the map side, so that counts of
separate partitions or days add up. A percentile of rank r is then selected without sorting:

1. every partition proposes the median of its values in each open range, with the number of
   values behind it;
2. the weighted median of the proposals becomes the range's pivot;
3. the weights below, at and above the pivot are counted; each wanted rank is found at the
   pivot or continues in one of the two sides, and sides without a wanted rank are discarded;
4. repeat per range. A range of few values is settled at once by a running sum.

Local medians may be approximate (a small mergeable digest in place of a local sort): they only
choose the pivot, never the result. The weighted median of medians has a quarter of the values
on either side, and in practice about half, so the rounds are logarithmic in the values.

For keeping, `daily_sketch` stores counts of logarithmic buckets instead of values: its size is
bounded by the range of the values, sketches of any days add up, and `multi_select` over the
sum gives percentiles within the stated relative error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmacade.session import cut_lineage

#: Pivots and targets of the open ranges are broadcast; there are never more ranges than this.
MOST_RANGES = 100_000
ZERO_BUCKET = -1_000_000


def counted(frame: DataFrame, groups: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """(groups, value, w): how often each value occurs; null and NaN values are left out."""
    amount = F.col(weight) if weight else F.lit(1)
    kept = frame.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(*groups, F.col(value).cast("double").alias("value")).agg(F.sum(amount.cast("long")).alias("w"))


def rank_of(n: Column, permille: Column) -> Column:
    """The nearest rank, ceil(n * permille / 1000), in whole numbers."""
    top = n * permille + 999
    return ((top - F.pmod(top, F.lit(1000))) / 1000).cast("long")


def multi_select(values: DataFrame, groups: list[str], permilles: list[int], small: int = 20_000) -> DataFrame:
    """(groups, permille, n, value): the value at rank ceil(n * permille / 1000) of each group.

    `values` is (groups, value, w) with distinct values per group, as `counted` gives them, and
    no null among the groups. Exact for any distribution, ties and repeated values included; an
    empty table has no groups and no rows. Ranges of at most `small` distinct values are settled
    by a window, larger ones by rounds of selection; the result is the same for any `small`.
    """
    keys = [*groups, "#range"]
    active = cut_lineage(values.withColumn("#range", F.lit(0)))
    sizes = active.groupBy(*groups).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("#distinct"))
    targets = sizes.withColumn("permille", F.explode(F.array(*map(F.lit, permilles))))
    targets = cut_lineage(targets.select(*groups, F.lit(0).alias("#range"), "permille", "n", rank_of(F.col("n"), F.col("permille")).alias("#rank"), "#distinct"))
    done = None
    while True:
        while (open_ranges := targets.where(F.col("#distinct") > small).select(*keys).distinct().count()) > MOST_RANGES:
            small *= 2
        settled = _settle(active, targets.where(F.col("#distinct") <= small), keys)
        if not open_ranges:
            return (settled if done is None else done.unionByName(settled)).select(*groups, "permille", "n", "value")
        # What is settled is kept aside now, as the next round drops it from the active values.
        settled = cut_lineage(settled)
        done = settled if done is None else done.unionByName(settled)
        wanted = targets.where(F.col("#distinct") > small)
        active = active.join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")
        active, targets, found = _round(active, wanted, groups, keys)
        done = done.unionByName(found)


def _settle(active: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The targets of small ranges, each range sorted in one task."""
    ranges = targets.groupBy(*keys).agg(F.collect_list(F.struct("#rank", "permille", "n")).alias("#wanted"))
    order = Window.partitionBy(*keys).orderBy("value")
    summed = active.join(ranges, keys).withColumn("#up_to", F.sum("w").over(order))
    here = F.filter("#wanted", lambda t: (t["#rank"] <= F.col("#up_to")) & (t["#rank"] > F.col("#up_to") - F.col("w")))
    hits = summed.withColumn("#hit", F.explode(here))
    return hits.select(*keys[:-1], "#hit.permille", "#hit.n", "value")


def _round(active: DataFrame, targets: DataFrame, groups: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over the open ranges: (remaining values, remaining targets, found targets)."""
    local = active.withColumn("#part", F.spark_partition_id()).groupBy(*keys, "#part").agg(
        F.percentile_approx("value", 0.5, 100).alias("#median"), F.count(F.lit(1)).alias("#size")
    )
    pivots = cut_lineage(local.groupBy(*keys).agg(F.percentile("#median", 0.5, F.col("#size")).alias("#pivot")))
    compared = active.join(F.broadcast(pivots), keys)
    below, at, above = (F.col("value") < F.col("#pivot"), F.col("value") == F.col("#pivot"), F.col("value") > F.col("#pivot"))
    tally = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    counts = compared.groupBy(*keys, "#pivot").agg(
        tally(below, F.col("w")).alias("#below"), tally(at, F.col("w")).alias("#at"),
        tally(below, 1).alias("#low"), tally(above, 1).alias("#high"),
    )
    side = F.when(F.col("#rank") <= F.col("#below"), -1).when(F.col("#rank") <= F.col("#below") + F.col("#at"), 0).otherwise(1)
    moved = cut_lineage(
        targets.drop("#distinct").join(counts, keys).withColumn("#side", side)
        # A side is named by the lowest permille still wanted in it, unique within its group.
        .withColumn("#next", F.min("permille").over(Window.partitionBy(*keys, "#side")))
    )
    found = moved.where("`#side` = 0").select(*groups, "permille", "n", F.col("#pivot").alias("value"))
    left = moved.where("`#side` <> 0")
    rank = F.when(F.col("#side") > 0, F.col("#rank") - F.col("#below") - F.col("#at")).otherwise(F.col("#rank"))
    remaining = left.select(
        *groups, F.col("#next").alias("#range"), "permille", "n", rank.alias("#rank"),
        F.when(F.col("#side") > 0, F.col("#high")).otherwise(F.col("#low")).alias("#distinct"),
    )
    sides = left.select(*keys, "#pivot", "#side", "#next").distinct()
    kept = active.join(F.broadcast(sides), keys).where("(`#side` < 0 and value < `#pivot`) or (`#side` > 0 and value > `#pivot`)")
    return cut_lineage(kept.select(*groups, F.col("#next").alias("#range"), "value", "w")), remaining, found


def wide(selected: DataFrame, groups: list[str], permilles: dict[str, int], error: float) -> DataFrame:
    """One row per group with a column per percentile, the count and the relative error bound."""
    columns = [F.max(F.when(F.col("permille") == p, F.col("value"))).alias(name) for name, p in permilles.items()]
    return selected.groupBy(*groups).agg(F.max("n").alias("n"), *columns).withColumn("error_bound", F.lit(float(error)))


def bucket_base(error: float) -> float:
    """The ratio of neighbouring bucket borders for a relative error."""
    return (1 + error) / (1 - error)


def daily_sketch(values: DataFrame, groups: list[str], error: float = 0.01) -> DataFrame:
    """(groups, bucket, w): the counts of logarithmic buckets, which add up across days.

    Bucket b > ZERO_BUCKET holds the values above base^(b-1) up to base^b; zero and below share
    ZERO_BUCKET. A bucket's middle is within `error` of every value in it.
    """
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(bucket_base(error))).cast("int")).otherwise(ZERO_BUCKET)
    return values.groupBy(*groups, bucket.alias("bucket")).agg(F.sum("w").alias("w"))


def sketch_values(sketch: DataFrame, groups: list[str], error: float = 0.01) -> DataFrame:
    """(groups, value, w): the sum of any sketches over `groups`, as values for `multi_select`."""
    base = bucket_base(error)
    middle = F.when(F.col("bucket") > ZERO_BUCKET, F.pow(F.lit(base), F.col("bucket")) * (2 / (base + 1))).otherwise(0.0)
    return sketch.groupBy(*groups, "bucket").agg(F.sum("w").alias("w")).select(*groups, middle.alias("value"), "w")
