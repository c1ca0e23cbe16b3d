from datetime import UTC, datetime, timedelta

import pytest

from tarmacade.operators import snapshot as M
from tarmacade.operators.snapshot import upsert, version
from tarmacade.snapshots import snapshot_version
from tarmacade.sources.store import ImportRefused, Store
from tarmacade.streaming.integrity import counts, maintain_counts, windowed_counts
from tarmacade.streaming.sessions import fold, session_states


def tables(spark, n):
    return {"rallies": spark.range(n).selectExpr("cast(id as string) event_id"), "people": spark.range(2).selectExpr("id person_id")}


def test_failed_import_keeps_the_version_before(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    assert store.current() is None and not store.has_snapshot() and store.last_sync() is None
    with pytest.raises(ImportRefused):
        store.tables()
    first = store.promote(store.stage(tables(spark, 3), "core"), {"rallies": 3, "people": 2})
    with pytest.raises(ImportRefused):
        store.promote(store.stage(tables(spark, 4), "core"), {"rallies": 5})
    with pytest.raises(ImportRefused):
        store.promote(store.stage(tables(spark, 4), "core"), {"stages": 1})
    assert store.current()["snapshot_id"] == first["snapshot_id"] and store.tables()["rallies"].count() == 3
    assert store.promote(store.stage(tables(spark, 3), "core"))["snapshot_id"] == first["snapshot_id"]
    assert store.promote(store.stage(tables(spark, 4), "core"))["counts"]["rallies"] == 4


def test_entities_of_a_snapshot_and_cases_for_others(spark, tmp_path):
    from tarmacade.operators.entities import snapshot_entities
    from tarmacade.sources.store import write_cases

    made = {
        "rallies": spark.createDataFrame([("e1", "Rally A"), ("e2", " ")], "event_id string, event_name string"), "stages": spark.createDataFrame([("s1", "Stage")], "stage_id string, stage_name string"),
        "people": spark.createDataFrame([("p1", "Ann", '["Ann", "Annie"]'), ("p2", "Bo", None)], "person_id string, display_name string, searchable_names string"),
        "uploader_stats": spark.createDataFrame([("u1", "Cy", 3)], "uploader_id string, uploader_name string, upload_count int"),
    }
    expected = [("e1", "rally", "Rally A"), ("p1", "person", "Ann"), ("p1", "person", "Annie"), ("p2", "person", "Bo"), ("s1", "stage", "Stage"), ("u1", "uploader", "Cy")]
    found = snapshot_entities(made)
    assert sorted(map(tuple, found.collect())) == expected
    write_cases(found, f"{tmp_path}/cases")
    assert sorted(map(tuple, spark.read.schema(found.schema).json(f"{tmp_path}/cases").collect())) == expected


def test_sync_only_when_stale(spark, tmp_path):
    store, builds = Store(spark, f"{tmp_path}/store"), []
    build = lambda segment: builds.append(segment) or tables(spark, 1 + len(builds))
    store.sync(build)
    store.sync(build)
    store.sync(build, now=datetime.now(UTC) + timedelta(hours=13))
    store.sync(build, force=True)
    assert len(builds) == 3


def test_version_ignores_order_and_layout(spark):
    a = spark.createDataFrame([("1", None), ("2", "x")], "k string, v string")
    same = version({"t": a.repartition(3).orderBy("v")}).collect()
    assert version({"t": a}).collect() == same != version({"t": a.unionByName(a)}).collect()


def test_upsert_takes_the_last(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, o int, v string")
    assert sorted((r["k"], r["o"], r["v"]) for r in upsert(rows, ["k"], "o").collect()) == [("a", 2, None), ("b", 1, "y")]


TURNS = [("s", 1, 1, "r1", None), ("s", 2, 2, None, "d1"), ("s", 3, 1, "r9", "d9"), ("s", 4, 2, "r2", None)]
FOLDED = [("s", 1, 1, "r1", None, False), ("s", 2, 2, "r1", "d1", False), ("s", 3, 1, "r1", "d1", True), ("s", 4, 2, "r2", "d1", False)]


def test_fold_drops_stale_turns():
    rows = [dict(zip(("session", "turn", "generation", "rally", "driver"), t)) for t in TURNS]
    assert fold(rows, (None, None, None))[0] == FOLDED


def test_streamed_sessions_and_counts(spark, tmp_path):
    schema = "session string, turn long, generation long, rally string, driver string"
    spark.createDataFrame(TURNS[:2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(TURNS[2:], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = session_states(stream, idle_ms=None).writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("folded").collect()) == FOLDED

    delta = "kind string, key string, refs long, exists long, first_arrival timestamp_ntz, first_ref timestamp_ntz"
    spark.createDataFrame([("k", "a", 1, 0, None, None), ("k", "b", 1, 1, None, None)], delta).coalesce(1).write.parquet(f"{tmp_path}/deltas/a")
    spark.createDataFrame([("k", "a", 1, 1, None, None), ("k", "b", -1, 0, None, None)], delta).coalesce(1).write.parquet(f"{tmp_path}/deltas/b")
    deltas = spark.readStream.schema(delta).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/deltas")
    maintain_counts(deltas, f"{tmp_path}/counts", f"{tmp_path}/cp").awaitTermination(60)
    held = lambda: sorted((r["key"], r["refs"], r["exists"]) for r in counts(spark, f"{tmp_path}/counts").collect())
    assert held() == [("a", 2, 1), ("b", 0, 1)]
    # The same deltas from the start, into the same table: batches that it has are left alone.
    maintain_counts(deltas, f"{tmp_path}/counts", f"{tmp_path}/cp2").awaitTermination(60)
    assert held() == [("a", 2, 1), ("b", 0, 1)]


def test_counts_per_window_are_final_after_the_watermark(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, 5), "g", i) for i, h in enumerate((0, 0, 1, 9))]
    spark.createDataFrame(rows, "at timestamp, g string, n int").coalesce(1).write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema("at timestamp, g string, n int").parquet(f"{tmp_path}/rows")
    query = windowed_counts(stream, "at", "g").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["start"].hour, r["n"]) for r in spark.table("windows").collect()) == [(0, 2), (1, 1)]


def test_registered_version_covers_every_snapshot_table(spark):
    found = {r[0] for r in snapshot_version(spark, "/root/testdata/sf0.001").select("table").collect()}
    assert found == set(M.BUILDERS)
