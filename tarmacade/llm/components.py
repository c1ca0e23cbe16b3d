"""Connected components of a graph of any size, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmacade.session import cut_lineage, merged

#: Rounds beyond which something must be wrong: stars form within a logarithm of the nodes.
MOST_ROUNDS = 200


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the least of the node and its neighbours."""
    around = _both(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return merged(around.where("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the least of these neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = merged(edges, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    """A fingerprint of a set of edges; all of it that reaches the driver."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return int(row["n"]), int(row["s"])


def contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """(the stars of the graph as (a, b), b the least node of the component; rounds taken).

    `edges` has a > b and no repeats. Each round's edges are checkpointed; a round joins the
    edges with one row per node, so that the edges of a hub are spread by a skew join.
    """
    edges = cut_lineage(edges)
    before, rounds = _mark(edges), 0
    while rounds < MOST_ROUNDS:
        rounds += 1
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == before:
            return edges, rounds
        before = now
    raise RuntimeError(f"no stars after {MOST_ROUNDS} rounds")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node with an edge, the smallest node of its component.

    `edges` is (a, b), in any direction, with repeats and loops allowed; edges with a null end
    are none. The large-star and small-star operations alternate until every component is a
    star around its smallest node. Paths, the worst case, take a number of rounds that grows
    with the logarithm of their length whatever the order of their ids (7 rounds for 100 nodes
    in random order, 12 for 10,000). Nothing but a count and a sum of hashes reaches the driver.
    """
    edges = edges.where("a is not null and b is not null")
    nodes = _both(edges).select(F.col("u").alias("node")).distinct()
    proper = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, _ = contracted(proper)
    return merged(nodes, stars, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
