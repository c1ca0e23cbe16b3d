"""What changed between consecutive full snapshots of a table.

Method: every snapshot row is unpivoted into cells (key, field, value) plus one presence
marker per key. In the pair (earlier, later) the earlier snapshot's cells count -1, the later
one's +1. Cells that are in both cancel; the groups whose sum is not zero say which keys came,
went or changed, and in which fields.

Two shuffles, whatever the number of fields: one that keeps a single row per snapshot and key
(pre-aggregated on the map side, so a key delivered a million times in one snapshot is
harmless), and one by key alone. Cells are made after the second, and all grouping of cells
reuses its partitioning, so the cells themselves never travel.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmacade.functions.clean import instant, instant_or_text, present, stripped

PRESENCE = "#present"


def snapshot_order(meta: DataFrame) -> DataFrame:
    """(snapshot_id, at, n, next_id): the snapshots in the order of their instants `generated_at`.

    Ties go by id. A snapshot without a readable instant has no place in the order and is left
    out. One row per snapshot, so ordering them in one task is bounded by their number.
    """
    from pyspark.sql import Window

    at = (
        meta.where(stripped("key") == "generated_at")
        .groupBy(stripped("snapshot_id").alias("snapshot_id"))
        .agg(F.min(instant("value")).alias("at"))
        .where("at is not null and snapshot_id is not null")
    )
    order = Window.partitionBy(F.lit(0)).orderBy("at", "snapshot_id")
    return at.select(
        "snapshot_id",
        "at",
        F.row_number().over(order).alias("n"),
        F.lead("snapshot_id").over(order).alias("next_id"),
    )


def comparable(frame: DataFrame, fields: Iterable[str], instants: Iterable[str] = ()) -> dict[str, Column]:
    """By field, the string in which it is compared: absent values null, dates as instants."""
    types, instants = dict(frame.dtypes), set(instants)
    return {
        f: instant_or_text(F.col(f"`{f}`")) if f in instants
        else present(F.col(f"`{f}`")) if types[f] == "string"
        else F.col(f"`{f}`").cast("string")
        for f in fields
    }


def rows_that_hold(
    frame: DataFrame, key: str, fields: Iterable[str], ordinal: str | None = None, instants: Iterable[str] = ()
) -> DataFrame:
    """(record_key, snapshot_id, f0, f1, ...): one row per snapshot and key.

    Of repeated keys the row with the highest ordinal holds; among equal ordinals, or without
    one, the greatest row by its compared values, so the choice never depends on file order.
    Rows with a blank or null key name no record and are left out.
    """
    values = [v.alias(f"f{i}") for i, v in enumerate(comparable(frame, fields, instants).values())]
    rank = [F.col(f"`{ordinal}`").alias("ordinal")] if ordinal else []
    rows = frame.select(
        stripped(F.col(f"`{key}`")).alias("record_key"),
        stripped("snapshot_id").alias("snapshot_id"),
        F.struct(*rank, *values).alias("row"),
    ).where("record_key <> '' and snapshot_id is not null")
    held = rows.groupBy("record_key", "snapshot_id").agg(F.max("row").alias("row"))
    return held.select("record_key", "snapshot_id", *[f"row.f{i}" for i in range(len(values))])


def signed_cells(held: DataFrame, order: DataFrame, fields: list[str]) -> DataFrame:
    """(record_key, later_id, field, value, sign): the cells of every consecutive pair."""
    placed = held.join(order.select("snapshot_id", "n", "next_id"), "snapshot_id").repartition("record_key")
    cell = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    pairs = F.array(
        F.struct(F.col("snapshot_id").alias("later_id"), F.lit(1).alias("sign"), (F.col("n") > 1).alias("real")),
        F.struct(F.col("next_id").alias("later_id"), F.lit(-1).alias("sign"), F.col("next_id").isNotNull().alias("real")),
    )
    cells = [cell(PRESENCE, F.lit(None).cast("string"))] + [cell(f, F.col(f"f{i}")) for i, f in enumerate(fields)]
    return (
        placed.withColumn("pair", F.explode(pairs))
        .where("pair.real")
        .withColumn("cell", F.explode(F.array(*cells)))
        .select("record_key", "pair.later_id", "pair.sign", "cell.field", "cell.value")
    )


def snapshot_changes(
    frame: DataFrame,
    order: DataFrame,
    key: str,
    fields: Iterable[str],
    ordinal: str | None = None,
    instants: Iterable[str] = (),
) -> DataFrame:
    """(snapshot_id, record_key, change_kind, changed_fields) for each snapshot after the first.

    `snapshot_id` is the later of the pair, `change_kind` is added, removed or changed and
    `changed_fields` lists the differing fields in alphabetical order (empty unless changed).
    Null, blank and the words null and none are one absent value; other strings are compared
    exactly once stripped, instants as instants. A record exists if it has a row, whatever is
    in it. Columns that are not named in `fields` are not looked at. An empty table has no
    changes; an absent snapshot between two others removes and adds all of its records.
    """
    fields = list(fields)
    cells = signed_cells(rows_that_hold(frame, key, fields, ordinal, instants), order, fields)
    sums = (
        cells.groupBy("record_key", "later_id", "field", "value").agg(F.sum("sign").alias("sum")).where("sum <> 0")
    )
    is_presence = F.col("field") == PRESENCE
    rows = sums.groupBy("record_key", "later_id").agg(
        F.sum(F.when(is_presence, F.col("sum")).otherwise(0)).alias("presence"),
        F.array_sort(F.collect_set(F.when(~is_presence, F.col("field")))).alias("differing"),
    )
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return rows.select(
        F.col("later_id").alias("snapshot_id"),
        "record_key",
        kind.alias("change_kind"),
        F.when(F.col("presence") == 0, F.col("differing")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )
