"""The N best items within every group, exact, whatever the size of the groups.

Method (hot-cold split): exact counts per group tell heavy groups from light ones. Light groups
go through an ordinary window, which Spark limits to N rows per group before its shuffle. A
heavy group is cut into score ranges at approximate quantiles; exact counts per range say which
ranges can hold any of the first N rows, only those are kept, each is spread over salts in
proportion to its count (so that even ties of one score spread), sorted there, and the best N
of every salt meet in a last, small window. Both parts are put together again by a union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmacade.session import cut_lineage

#: The list of heavy groups is broadcast; it never has more entries than this.
MOST_HEAVY = 10_000


def _first(frame: DataFrame, keys: list[str], score: str, item: str, n: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score), F.col(item))
    return frame.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def heavy_groups(rows: DataFrame, group: str, hot: int) -> tuple[DataFrame, int]:
    """The groups of more than `hot` rows and how many they are.

    Should more than MOST_HEAVY groups qualify, the limit doubles until they fit: the rest then
    have at most a ten-thousandth of all rows each.
    """
    counts = cut_lineage(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > hot))
    while (n := counts.where(F.col("n_rows") > hot).count()) > MOST_HEAVY:
        hot *= 2
    return counts.where(F.col("n_rows") > hot), n


def top_n(rows: DataFrame, group: str, score: str, item: str, n: int, hot: int = 50_000, ranges: int = 32) -> DataFrame:
    """The rows with the `n` lowest numeric scores of every group, with their rank `rnk`.

    Ties of the score go by `item`, which must be unique within a group to make the order total;
    whole repeated rows are then told apart arbitrarily but look the same. Rows with a null
    group or score belong nowhere and are left out; other columns pass through, except that one
    named `rnk` is replaced by the rank. Groups with
    fewer than `n` rows give what they have. The result is the same for any `hot` and `ranges`.
    """
    rows = rows.where(F.col(group).isNotNull() & F.col(score).isNotNull())
    heavy, how_many = heavy_groups(rows, group, hot)
    if not how_many:
        return _first(rows, [group], score, item, n, "rnk")
    light = rows.join(F.broadcast(heavy.select(group)), group, "left_anti")
    return _first(light, [group], score, item, n, "rnk").unionByName(_top_of_heavy(rows, heavy, group, score, item, n, hot, ranges))


def _top_of_heavy(rows: DataFrame, heavy: DataFrame, group: str, score: str, item: str, n: int, hot: int, ranges: int) -> DataFrame:
    inside = rows.join(F.broadcast(heavy.select(group)), group)
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = cut_lineage(inside.groupBy(group).agg(F.percentile_approx(score, shares, 1000).alias("#cuts")))
    ranged = inside.join(F.broadcast(cuts), group).withColumn(
        "#range", F.size(F.filter("#cuts", lambda c: c < F.col(score)))
    ).drop("#cuts")
    counts = ranged.groupBy(group, "#range").agg(F.count(F.lit(1)).alias("#n"))
    before = F.sum("#n").over(Window.partitionBy(group).orderBy("#range")) - F.col("#n")
    # At most `ranges` rows for each of at most MOST_HEAVY groups.
    needed = cut_lineage(
        counts.withColumn("#before", before).where(F.col("#before") < n).select(group, "#range", F.ceil(F.col("#n") / hot).cast("int").alias("#salts"))
    )
    salted = ranged.join(F.broadcast(needed), [group, "#range"]).withColumn("#salt", F.pmod(F.xxhash64(item), F.col("#salts")))
    local = _first(salted, [group, "#range", "#salt"], score, item, n, "#local")
    return _first(local.drop("#range", "#salt", "#salts", "#local"), [group], score, item, n, "rnk")
