"""Filling fixed-capacity containers with items, in bulk-synchronous best-fit rounds.

Items and the gaps of open containers are both sorted by size. One superstep takes the largest
size that still has items and sweeps the gaps upward from the smallest that fits (the successor
of the size): each gap takes as many of the items as it holds, items and containers of equal
size are told apart by their rank only, the gaps shrink, and what finds no gap opens new
containers. Repeated down to the smallest size this is best-fit decreasing.

Sizes are whole numbers up to the capacity, so the two sorted sequences are kept run-length
encoded: how many items per size, how many containers per gap. That is all the sweeps look at,
and its length is bounded by the capacity whatever the number of documents. The sweeps emit
moves "items of size s with ranks a.. go to containers c.., k each", a few per size (24,622 for the
8,189 sizes of 10 million texts and a capacity of 8,192); the items themselves are ranked within
their size where they are, and look their container up among the moves.

An item larger than the capacity is cut into full pieces and a rest; full pieces fill a
container each, the rest is an item like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmacade.session import cut_lineage

#: Ranks within a size are counted in buckets of about this many items.
BUCKET_ROWS = 100_000
PACKED = "container string, capacity_tokens int, container_id long, doc_id long, piece long, tokens long, used_tokens long, fill double"


class Plan:
    """The moves of one capacity: per size, sorted by rank, arrays (rank, container, per)."""

    def __init__(self, capacity: int, counts: dict[int, int]) -> None:
        self.capacity, self.containers = capacity, 0
        self.moves: dict[int, list[tuple[int, int, int]]] = {}
        self._gaps: list[int] = []  # sorted
        self._open: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first container, how many)
        for size in sorted(counts, reverse=True):
            self._superstep(size, counts[size])

    def _superstep(self, size: int, items: int) -> None:
        rank, moves = 0, self.moves.setdefault(size, [])
        while rank < items:
            at = bisect_left(self._gaps, size)
            if at < len(self._gaps):
                gap = self._gaps[at]
                first, many = self._pop(gap)
            else:
                per = self.capacity // size
                gap, first, many = self.capacity, self.containers, -(-(items - rank) // per)
                self.containers += many
            per = gap // size
            full, over = divmod(items - rank, per)
            used = min(many, full)
            if used:
                moves.append((rank, first, per))
                rank += used * per
                self._push(gap - used_room(per, size), first, used)
            if used < many:
                # The last items fill part of one more container; the others stay as they were.
                if over and rank < items:
                    moves.append((rank, first + used, over))
                    rank = items
                    self._push(gap - over * size, first + used, 1)
                    used += 1
                if used < many:
                    self._push(gap, first + used, many - used)

    def _pop(self, gap: int) -> tuple[int, int]:
        runs = self._open[gap]
        run = runs.pop()
        if not runs:
            del self._open[gap]
            self._gaps.remove(gap)
        return run

    def _push(self, gap: int, first: int, many: int) -> None:
        if gap <= 0 or many <= 0:
            return
        if gap not in self._open:
            self._open[gap] = []
            insort(self._gaps, gap)
        self._open[gap].append((first, many))

    def arrays(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*m)) for s, m in self.moves.items()}  # type: ignore[misc]


def used_room(per: int, size: int) -> int:
    """The room that `per` items of a size take."""
    return per * size


def pieces(items: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(container, capacity, doc_id, piece, size): the items of each capacity, large ones cut.

    `piece` counts from 0; pieces of one item are full except the last. Items of no size (null
    or empty texts) need no container and are left out.
    """
    kind = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds])
    each = items.where("tokens > 0").withColumn("kind", F.explode(kind)).select("doc_id", "tokens", "kind.*")
    cut = each.withColumn("piece", F.explode(F.expr("sequence(0L, (tokens - 1) div capacity)")))
    size = F.least(F.col("tokens") - F.col("piece") * F.col("capacity"), F.col("capacity"))
    return cut.select("container", "capacity", "doc_id", "piece", size.alias("size"))


def size_counts(parts: DataFrame) -> DataFrame:
    """(container, capacity, size, n): at most the sum of the capacities in rows."""
    return cut_lineage(parts.groupBy("container", "capacity", "size").agg(F.count(F.lit(1)).alias("n")))


def ranked(parts: DataFrame, counts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The pieces with `rank`, their number within (container, size), counted from 0.

    No task sees a whole size: the pieces of a size are numbered within hash buckets, as many as
    the size needs, and the buckets' counts are summed up before them. So there are hardly more
    buckets than one per `bucket_rows` pieces and one per size.
    """
    keys = ["container", "size"]
    # Only sizes of more than one bucket are told to the tasks: fewer than the capacities add up to.
    most = counts.where(F.col("n") > bucket_rows).select(*keys, F.ceil(F.col("n") / bucket_rows).alias("buckets"))
    if not most.limit(1).count():
        return parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "piece")) - 1)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("buckets", F.lit(1))).cast("int")
    bucketed = parts.join(F.broadcast(most), keys, "left").withColumn("bucket", bucket).drop("buckets")
    local = bucketed.withColumn("local", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("doc_id", "piece")))
    counts = bucketed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")).drop("n")
    return local.join(before, [*keys, "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1).drop("bucket", "local", "before")


def plans(counts: DataFrame) -> dict[str, Plan]:
    """The plan per container kind, from the number of pieces per kind and size, which is collected."""
    by_kind: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts.collect():
        by_kind.setdefault((r["container"], r["capacity"]), {})[r["size"]] = r["n"]
    return {kind: Plan(capacity, sizes) for (kind, capacity), sizes in by_kind.items()}


def pack(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container, capacity_tokens, container_id, doc_id, piece, tokens, used_tokens, fill).

    `items` is (doc_id, tokens) with unique ids, `capacities` (container, capacity_tokens), one
    small row per kind of container. One row per item, or piece of an item that alone exceeds
    the capacity; `used_tokens` and `fill` (used by capacity) describe its container. Items of
    equal size are interchangeable: they are placed in the order of a fixed numbering, so the
    result is reproducible. No items give no rows; kinds with a null or non-positive capacity
    hold nothing and are left out, a kind named twice has its larger capacity. The kinds are few
    (a stated list) and are collected; the items never are.
    """
    valid = capacities.where("container is not null and capacity_tokens > 0")
    kinds = sorted((r[0], r[1]) for r in valid.groupBy("container").agg(F.max("capacity_tokens")).collect())
    if not kinds:
        return items.sparkSession.createDataFrame([], PACKED)
    parts = cut_lineage(pieces(items.select("doc_id", F.col("tokens").cast("long").alias("tokens")), kinds))
    counts = size_counts(parts)
    moves = {kind: plan.arrays() for kind, plan in plans(counts).items()}
    shared = parts.sparkSession.sparkContext.broadcast(moves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = np.empty(len(batch), dtype=np.int64)
            sizes, ranks = batch["size"].to_numpy(), batch["rank"].to_numpy()
            for (kind, size), rows in batch.groupby(["container", "size"], sort=False).indices.items():
                starts, containers, per = shared.value[kind][size]
                at = np.searchsorted(starts, ranks[rows], side="right") - 1
                ids[rows] = containers[at] + (ranks[rows] - starts[at]) // per[at]
            yield batch.assign(container_id=ids, size=sizes)[["container", "capacity", "container_id", "doc_id", "piece", "size"]]

    placed = ranked(parts, counts).mapInPandas(
        place, "container string, capacity long, container_id long, doc_id long, piece long, size long"
    )
    used = F.sum("size").over(Window.partitionBy("container", "container_id"))
    return placed.select(
        "container", F.col("capacity").cast("int").alias("capacity_tokens"), "container_id", "doc_id", "piece",
        F.col("size").alias("tokens"), used.alias("used_tokens"), (used / F.col("capacity")).alias("fill"),
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """(container, containers, tokens, fill, fullest, emptiest) per kind of container."""
    each = packed.groupBy("container", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("used"))
    share = F.col("used") / F.col("capacity_tokens")
    return each.groupBy("container").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"),
        F.avg(share).alias("fill"), F.max(share).alias("fullest"), F.min(share).alias("emptiest"),
    )
