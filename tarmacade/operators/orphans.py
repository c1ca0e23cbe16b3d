"""References to records that do not exist.

Method: signed counts per key. References to a key and its existence are both kept as sums of
signed deltas, one table of counts per kind of key:

    (kind, key, refs, exists, first_arrival, first_ref)

A delta is +1 or -1 reference, or +1 or -1 existence. `apply_deltas` adds any number of deltas
to such a table, so it can be maintained from change feeds; keys with references and no
existence form the orphan report. The rows behind it are found by joining the references with
the orphan keys only.

Skew: counts are summed on the map side first. In the join, keys with very many references are
known from the counts; their references are salted, and the key's row is repeated per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmacade.functions.clean import present
from tarmacade.session import cut_lineage

MOST_HOT = 10_000


def latest_rows(frame: DataFrame, row_key: Column, version: Column, **columns: Column) -> DataFrame:
    """One row (id, ...) per `row_key`: the values at the latest version, ties by the greatest values.

    Aggregated on the map side: a key that holds a third of the table costs no more than others.
    """
    rows = frame.select(row_key.alias("id"), F.struct(version.alias("v"), *[c.alias(n) for n, c in columns.items()]).alias("r"))
    held = rows.where("id is not null").groupBy("id").agg(F.max("r").alias("r"))
    return held.select("id", *[f"r.{n}" for n in columns])


def references(frame: DataFrame, table: str, kind: str, row_id: str, key: str) -> DataFrame:
    """(child_table, child_id, kind, key, loaded_at): each row once, as it first came.

    A row delivered repeatedly counts at its earliest `loaded_at`, with the reference it had
    then. Rows without an id, without a time or with an absent reference refer to nothing.
    """
    first = frame.select(
        F.col(row_id).cast("long").alias("child_id"),
        F.struct(F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), present(key).alias("key")).alias("r"),
    ).where("child_id is not null and r.loaded_at is not null")
    first = first.groupBy("child_id").agg(F.min("r").alias("r"))
    return first.select(
        F.lit(table).alias("child_table"), "child_id", F.lit(kind).alias("kind"), "r.key", "r.loaded_at"
    ).where("key is not null")


def _delta(kind: Column | str, exists: Column, arrival: Column, key: str = "key", refs: int = 0, first_ref: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("timestamp_ntz")
    return [
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        F.col(key).alias("key"),
        F.lit(refs).cast("long").alias("refs"),
        exists.cast("long").alias("exists"),
        arrival.cast("timestamp_ntz").alias("first_arrival"),
        (none if first_ref is None else first_ref).alias("first_ref"),
    ]


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """One delta per reference: `sign` references to its key."""
    zero, none = F.lit(0), F.lit(None).cast("timestamp_ntz")
    return refs.select(*_delta(F.col("kind"), zero, none, refs=sign, first_ref=F.col("loaded_at")))


def snapshot_existence(rows: DataFrame, order: DataFrame, kind: str, key: str) -> DataFrame:
    """Existence deltas of a table delivered as full snapshots.

    Each snapshot in which a key is present adds one, and the snapshot after it takes that one
    away again; the sum is one exactly if the key is in the last snapshot.
    """
    here = rows.select(present(key).alias("key"), present("snapshot_id").alias("snapshot_id")).where("key is not null").distinct()
    placed = here.join(order, "snapshot_id").select(
        "key", F.col("at"), F.explode(F.when(F.col("next_id").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(-1)))).alias("sign")
    )
    return placed.select(*_delta(kind, F.col("sign"), F.col("at")))


def versioned_existence(rows: DataFrame, kind: str, row_id: str, key: str) -> DataFrame:
    """Existence deltas of a table delivered row by row, with `loaded_at` and `deleted_at`.

    Every delivery is an arrival of its key; the row that holds per id (latest `loaded_at`) adds
    one to its key's existence unless it is deleted. Rows without a key or an id are ignored.
    """
    arrivals = rows.select(present(key).alias("key"), F.col("loaded_at")).where("key is not null")
    alive = latest_rows(
        rows.where(F.col("loaded_at").isNotNull()), present(row_id), F.col("loaded_at"),
        alive=F.col("deleted_at").isNull(), key=present(key),
    ).where("alive and key is not null")
    return arrivals.select(*_delta(kind, F.lit(0), F.col("loaded_at"))).unionByName(
        alive.select(*_delta(kind, F.lit(1), F.lit(None).cast("timestamp_ntz")))
    )


def apply_deltas(*parts: DataFrame) -> DataFrame:
    """The table of counts after adding deltas, or other tables of counts, to each other."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("kind", "key").agg(
        F.sum("refs").alias("refs"),
        F.sum("exists").alias("exists"),
        F.min("first_arrival").alias("first_arrival"),
        F.min("first_ref").alias("first_ref"),
    )


def orphan_keys(counts: DataFrame) -> DataFrame:
    """The keys that orphan at least one reference, with the reason that holds for the key.

    `missing`: no parent ever had the key. `deleted`: its existence sums to zero. `late`: it
    exists, but a reference came before its first arrival.
    """
    reason = (
        F.when(F.col("first_arrival").isNull(), "missing")
        .when(F.col("exists") <= 0, "deleted")
        .when(F.col("first_arrival") > F.col("first_ref"), "late")
    )
    return counts.where("refs > 0").withColumn("orphan_kind", reason).where("orphan_kind is not null")


def orphans(refs: DataFrame, counts: DataFrame, hot: int = 200_000, salts: int = 64) -> DataFrame:
    """(child_table, child_id, orphan_kind, period): the references behind the orphan keys.

    `period` is the month `yyyy-MM` of the row's first arrival. References to keys with more
    than `hot` of them are spread over `salts` tasks. At most MOST_HOT keys are treated so (their
    list is broadcast): if more qualify, the limit is doubled until they fit, which leaves every
    other key with at most a ten-thousandth of all references. The result is the same for any
    `hot` and `salts`.
    """
    keys = cut_lineage(orphan_keys(counts).select("kind", "key", "orphan_kind", "first_arrival", "refs"))
    while (n_hot := keys.where(F.col("refs") > hot).count()) > MOST_HOT:
        hot *= 2
    rows = refs.withColumn("salt", F.lit(0))
    keyed = keys.withColumn("salt", F.lit(0))
    if n_hot:
        hot_keys = keys.where(F.col("refs") > hot).select("kind", "key", F.lit(True).alias("is_hot"))
        salt = F.pmod(F.xxhash64("child_table", "child_id"), F.lit(salts)).cast("int")
        rows = refs.join(F.broadcast(hot_keys), ["kind", "key"], "left")
        rows = rows.withColumn("salt", F.when(F.col("is_hot"), salt).otherwise(0)).drop("is_hot")
        last = F.when(F.col("refs") > hot, F.lit(salts - 1)).otherwise(0)
        keyed = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
    found = rows.join(keyed.drop("refs"), ["kind", "key", "salt"])
    is_case = (F.col("orphan_kind") != "late") | (F.col("first_arrival") > F.col("loaded_at"))
    return found.where(is_case).select(
        "child_table", "child_id", "orphan_kind", F.date_format("loaded_at", "yyyy-MM").alias("period")
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """(child_table, period, orphan_kind, n): how many orphans per table, month and kind."""
    return found.groupBy("child_table", "period", "orphan_kind").agg(F.count(F.lit(1)).alias("n"))
