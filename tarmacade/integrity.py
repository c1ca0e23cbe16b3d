"""Queries on deliveries: changes between snapshots and orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmacade.operators.orphans import (
    apply_deltas,
    orphan_report,
    orphans,
    reference_deltas,
    references,
    snapshot_existence,
    versioned_existence,
)
from tarmacade.operators.snapshot_diff import snapshot_changes, snapshot_order
from tarmacade.session import cut_lineage
from tarmacade.sources.tables import table

RALLY_FIELDS = ["event_name", "name_norm", "country", "city", "year", "start_date", "end_date", "status", "stages_count"]


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """The changes of both tables delivered as snapshots, with the differing fields."""
    meta = table(spark, sf, "meta")
    order = snapshot_order(meta)
    rallies = snapshot_changes(
        table(spark, sf, "rallies"), order, "event_id", RALLY_FIELDS, "load_ord", ("start_date", "end_date")
    )
    pairs = snapshot_changes(meta, order, "key", ["value"])
    return rallies.select(F.lit("rallies").alias("source_table"), "*").unionByName(
        pairs.select(F.lit("meta").alias("source_table"), "*")
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return changes(spark, sf).select("source_table", "snapshot_id", "record_key", "change_kind")


def p2_changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """How many records changed in each field, per table and snapshot."""
    fields = changes(spark, sf).select("source_table", "snapshot_id", F.explode("changed_fields").alias("field"))
    return fields.groupBy("source_table", "snapshot_id", "field").agg(F.count(F.lit(1)).alias("records"))


def _references(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("participation", "rally", "row_id", "event_id"), ("video_meta", "stage", "video_id", "stage_id"), ("final_results", "driver", "id", "driver_id")]
    frames = [references(table(spark, sf, t), t, kind, row_id, key) for t, kind, row_id, key in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    # Counted and looked up: written down, so that the large tables are read and aggregated once.
    refs = cut_lineage(_references(spark, sf))
    order = snapshot_order(table(spark, sf, "meta"))
    counts = apply_deltas(
        reference_deltas(refs),
        snapshot_existence(table(spark, sf, "rallies"), order, "rally", "event_id"),
        versioned_existence(table(spark, sf, "stages"), "stage", "stage_id", "stage_id"),
        versioned_existence(table(spark, sf, "people"), "driver", "person_id", "driver_id"),
    )
    return orphans(refs, counts)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """The number of orphans per table, month and kind."""
    return orphan_report(_orphans(spark, sf))


QUERIES = {"p2_found": p2_found, "p2_changed_fields": p2_changed_fields, "p3_found": p3_found, "p3_report": p3_report}


def trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def given(x: str) -> str:
    return f"CASE WHEN lower({trimmed(x)}) NOT IN ('', 'null', 'none') THEN {trimmed(x)} END"


def dated(x: str) -> str:
    return f"coalesce(CAST(epoch_us(try_cast({given(x)} AS TIMESTAMP)) AS VARCHAR), {given(x)})"


ORDER_SQL = f"""orders_ AS (
  SELECT snapshot_id, born, row_number() OVER (ORDER BY born, snapshot_id) AS n,
         lead(snapshot_id) OVER (ORDER BY born, snapshot_id) AS next_id
  FROM (SELECT {trimmed('snapshot_id')} AS snapshot_id,
               min(try_cast(regexp_replace({given('value')}, 'Z$|[+-]00:00$', '') AS TIMESTAMP)) AS born
        FROM meta WHERE {trimmed('key')} = 'generated_at' GROUP BY 1) WHERE born IS NOT NULL)"""

_FIELDS_SQL = ", ".join(
    f"{dated(f)} AS {f}" if f in ("start_date", "end_date") else f"CAST({f} AS VARCHAR) AS {f}" if f in ("year", "stages_count") else f"{given(f)} AS {f}"
    for f in RALLY_FIELDS
)

_CHANGES = f"""WITH {ORDER_SQL},
rows_ AS (
  SELECT 'rallies' AS source_table, {trimmed('event_id')} AS record_key, {trimmed('snapshot_id')} AS snapshot_id, load_ord, {_FIELDS_SQL}, CAST(NULL AS VARCHAR) AS value
  FROM rallies
  UNION ALL
  SELECT 'meta', {trimmed('key')}, {trimmed('snapshot_id')}, 0, {', '.join('NULL' for _ in RALLY_FIELDS)}, {given('value')} FROM meta),
held AS (
  SELECT r.*, o.n, o.next_id FROM (
    SELECT *, row_number() OVER (PARTITION BY source_table, record_key, snapshot_id ORDER BY load_ord DESC, value DESC NULLS LAST) AS k FROM rows_ WHERE record_key <> '') r
  JOIN orders_ o USING (snapshot_id) WHERE k = 1),
pairs AS (
  SELECT coalesce(a.source_table, b.source_table) AS source_table, coalesce(a.snapshot_id, b.next_id) AS snapshot_id,
         coalesce(a.record_key, b.record_key) AS record_key,
         CASE WHEN b.record_key IS NULL THEN 'added' WHEN a.record_key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
         CASE WHEN a.record_key IS NOT NULL AND b.record_key IS NOT NULL THEN
         list_filter([{', '.join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in [*RALLY_FIELDS, 'value'])}], lambda x: x IS NOT NULL) ELSE [] END AS fields
  FROM (SELECT * FROM held WHERE n > 1) a
  FULL OUTER JOIN (SELECT * FROM held WHERE next_id IS NOT NULL) b
    ON a.source_table = b.source_table AND a.record_key = b.record_key AND a.snapshot_id = b.next_id)"""

_ORPHANS = f"""WITH {ORDER_SQL},
refs AS (
  {' UNION ALL '.join(f"SELECT '{t}' AS child_table, CAST({i} AS BIGINT) AS child_id, '{k}' AS kind, arg_min({given(c)}, loaded_at) AS key, min(loaded_at) AS loaded_at FROM (SELECT {i}, loaded_at, coalesce({c}, '') AS {c} FROM {t}) WHERE {i} IS NOT NULL AND loaded_at IS NOT NULL GROUP BY {i}" for t, k, i, c in [("participation", "rally", "row_id", "event_id"), ("video_meta", "stage", "video_id", "stage_id"), ("final_results", "driver", "id", "driver_id")])}),
parents AS (
  SELECT 'rally' AS kind, {given('event_id')} AS key, bool_or(o.next_id IS NULL) AS alive, min(o.born) AS arrival
  FROM rallies r JOIN orders_ o ON o.snapshot_id = {trimmed('r.snapshot_id')} GROUP BY 2
  UNION ALL
  SELECT 'stage', {given('stage_id')}, arg_max(deleted_at IS NULL, loaded_at), min(loaded_at) FROM stages GROUP BY 2
  UNION ALL
  SELECT 'driver', key, bool_or(alive), min(arrival) FROM (
    SELECT {given('driver_id')} AS key, arg_max(deleted_at IS NULL, loaded_at) AS alive, min(loaded_at) AS arrival
    FROM people GROUP BY {given('person_id')}, 1) GROUP BY key),
found AS (
  SELECT child_table, child_id,
         CASE WHEN p.key IS NULL THEN 'missing' WHEN NOT p.alive THEN 'deleted' WHEN p.arrival > c.loaded_at THEN 'late' END AS orphan_kind,
         strftime(c.loaded_at, '%Y-%m') AS period
  FROM refs c LEFT JOIN parents p ON p.kind = c.kind AND p.key = c.key WHERE c.key IS NOT NULL)"""

SQL = {
    "p2_found": f"{_CHANGES} SELECT source_table, snapshot_id, record_key, change_kind FROM pairs WHERE change_kind <> 'changed' OR len(fields) > 0",
    "p2_changed_fields": f"{_CHANGES} SELECT source_table, snapshot_id, field, count(*) AS records FROM (SELECT source_table, snapshot_id, unnest(fields) AS field FROM pairs) GROUP BY ALL",
    "p3_found": f"{_ORPHANS} SELECT * FROM found WHERE orphan_kind IS NOT NULL",
    "p3_report": f"{_ORPHANS} SELECT child_table, period, orphan_kind, count(*) AS n FROM found WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
