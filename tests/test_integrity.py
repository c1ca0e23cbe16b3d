from datetime import datetime

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

META = "snapshot_id string, key string, value string"
ROWS = "snapshot_id string, load_ord long, id string, name string, day string, n int"


def order(spark, *instants):
    rows = [(f"s{i}", " generated_at", at) for i, at in enumerate(instants)]
    return snapshot_order(spark.createDataFrame(rows, META))


def changes(spark, rows, *instants):
    frame = spark.createDataFrame(rows, ROWS)
    found = snapshot_changes(frame, order(spark, *instants), "id", ["name", "day", "n"], "load_ord", ["day"])
    return sorted((r["snapshot_id"], r["record_key"], r["change_kind"], tuple(r["changed_fields"])) for r in found.collect())


def test_added_removed_changed_and_the_same(spark):
    rows = [
        ("s0", 1, "a", "x", "2025-01-01T10:00:00", 1), ("s1", 1, " a ", "x ", "2025-01-01 10:00", 1),  # the same
        ("s0", 2, "b", "x", None, 1), ("s1", 2, "b", "y", "null", 2),  # two fields changed
        ("s0", 3, "c", None, "none", None), ("s1", 4, "d", "", "", None),  # removed and added, whatever is in them
        ("s0", 4, "e", "X", "2025-01-01", 1), ("s1", 5, "e", "x", "2025-01-02", 1),
    ]
    assert changes(spark, rows, "2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z") == [
        ("s1", "b", "changed", ("n", "name")), ("s1", "c", "removed", ()), ("s1", "d", "added", ()), ("s1", "e", "changed", ("day", "name")),
    ]


def test_order_is_that_of_the_instants(spark):
    rows = [("s0", 1, "a", "late", None, 1), ("s1", 1, "a", "early", None, 1), ("s1", 2, "b", "q", None, 1)]
    assert changes(spark, rows, "2025-03-01T00:00:00+00:00", "2025-02-01T00:00:00Z") == [("s0", "a", "changed", ("name",)), ("s0", "b", "removed", ())]


def test_repeated_keys_blank_keys_and_unordered_snapshots(spark):
    rows = [("s0", 1, "a", "old", None, 1), ("s0", 9, "a", "new", None, 1), ("s1", 1, "a", "new", None, 1)]
    rows += [("s1", 2, None, "x", None, 1), ("s1", 3, "  ", "x", None, 1), ("s2", 1, "z", "x", None, 1)]
    assert changes(spark, rows, "2025-01-01", "2025-02-01", "not a date") == []


def test_empty_table_and_single_snapshot(spark):
    assert changes(spark, [], "2025-01-01", "2025-02-01") == []
    assert changes(spark, [("s0", 1, "a", "x", None, 1)], "2025-01-01") == []


def at(month, day=1):
    return datetime(2025, month, day)


def found(spark, children, parents, **options):
    refs = references(spark.createDataFrame(children, "id long, ref string, loaded_at timestamp, kind string"), "t", "k", "id", "ref")
    frame = spark.createDataFrame(parents, "row string, key string, loaded_at timestamp, deleted_at timestamp")
    counts = apply_deltas(reference_deltas(refs), versioned_existence(frame, "k", "row", "key"))
    return orphans(refs, counts, **options)


CHILDREN = [
    (1, "a", at(3), "x"), (2, "gone", at(3), "x"), (3, "never", at(4), "x"), (4, "late", at(2), "x"), (5, "late", at(9), "x"),
    (6, None, at(3), "x"), (7, " NULL ", at(3), "x"), (8, " a\t", at(3), "x"), (9, "never", at(5), "x"), (9, "never", at(4), "x"), (None, "never", at(4), "x"),
]
PARENTS = [("1", "a", at(1), None), ("2", "gone", at(1), None), ("2", "gone", at(2), at(2)), ("3", "late", at(6), None), ("3", "late", at(5), at(5)), ("4", None, at(1), None)]


def test_orphans_of_every_kind_whatever_is_hot(spark):
    for hot in (0, 1, 10**6):
        rows = found(spark, CHILDREN, PARENTS, hot=hot, salts=3).collect()
        assert sorted((r["child_id"], r["orphan_kind"], r["period"]) for r in rows) == [
            (2, "deleted", "2025-03"), (3, "missing", "2025-04"), (4, "late", "2025-02"), (9, "missing", "2025-04"),
        ]


def test_no_children_no_parents_and_the_report(spark):
    assert found(spark, [], PARENTS).collect() == []
    rows = orphan_report(found(spark, CHILDREN, [])).collect()
    assert sum(r["n"] for r in rows) == 7 and {r["orphan_kind"] for r in rows} == {"missing"}


def test_snapshots_as_existence_deltas_add_up(spark):
    rows = spark.createDataFrame([("s0", "a"), ("s1", "a"), ("s0", "b"), ("s0", "b")], "snapshot_id string, key string")
    counts = apply_deltas(snapshot_existence(rows, order(spark, "2025-01-01", "2025-02-01"), "k", "key"))
    assert {r["key"]: r["exists"] for r in counts.collect()} == {"a": 1, "b": 0}


def test_counts_of_parts_add_up(spark):
    refs = references(spark.createDataFrame(CHILDREN, "id long, ref string, loaded_at timestamp, kind string"), "t", "k", "id", "ref")
    whole = apply_deltas(reference_deltas(refs))
    parts = apply_deltas(apply_deltas(reference_deltas(refs.where("child_id < 4"))), reference_deltas(refs.where("child_id >= 4")))
    back = apply_deltas(whole, reference_deltas(refs, sign=-1))
    assert sorted(whole.collect()) == sorted(parts.collect())
    assert back.agg(F.sum(F.abs("refs"))).collect()[0][0] == 0
