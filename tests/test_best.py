"""Pools that are weighed and scored in one step: the rows and values of the steps by pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmacade import analytics, understanding
from tarmacade.functions.batched import measures
from tarmacade.functions.composite import edit_similarity
from tarmacade.functions.kernels import dice, jaro_winkler
from tarmacade.operators import best
from tarmacade.operators import entities as R
from tarmacade.operators import resolution as X
from tarmacade.operators.best import best_scored


def test_measures_of_many_pairs_are_those_of_the_kernels():
    rng, pairs = random.Random(3), []
    for _ in range(1500):
        letters, n = rng.choice(["ab", "abc ", "abcdefghij kl", "äжz𝒳"]), rng.choice([0, 1, 2, 3, 9, 16, 17, 31, 32, 33, 63, 64, 70])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, n))) for _ in "ab")
        pairs += [(a, b), (a, a), (a, a[1:] + b[:2]), (a, a[: n // 2] + "x" + a[n // 2 :])]
    expected = np.array([(jaro_winkler(a, b), edit_similarity(a, b), dice(a, b, 2), dice(a, b, 3)) for a, b in pairs])
    assert (measures([a for a, _ in pairs], [b for _, b in pairs]) == expected).all()


def by_pairs(mentions, entities):
    return R.scored(mentions, entities, R.escaped(mentions, entities, R.candidates(mentions, R.postings(entities))))


@pytest.mark.parametrize("at_once", [200_000, 17])
def test_best_of_a_pool_are_those_of_all_its_pairs(spark, monkeypatch, at_once):
    rng = random.Random(5)
    syllables = ["ber", "go", "la", "nov", "ка", "xi", "st", "o"]
    names = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))).title() + " " + "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(110)]
    names += ["Bergo Lanov", "BERGO LANOV", "Bergo-Lanov", "X", "St", "Ber go la " * 9, "o go la xi st ber nov a b c d e f", "???"]
    rows = [(f"p{i:03}", rng.choice(["person", "person", "rally"]), n) for i, n in enumerate(names)] + [("p001", "person", "Bergo Nov"), ("p001", "person", "Annie Ber")]
    entities = spark.createDataFrame([(i, "person" if i == "p001" else k, n) for i, k, n in rows], "entity_id string, entity_type string, name string")
    texts = ["Bergo Lanov", "bergo lanof", "Ber", "X", "st", "zzz", "!!", "Ber go la " * 9, "o go la xi st", "Bergo", "кака", *names[:12]]
    mentions = spark.createDataFrame([(f"{k} {t}", k, t) for t in dict.fromkeys(texts) for k in ("person", "rally")], "mention_id string, entity_type string, mention string")
    for name, value in (("KEY_ROWS", at_once), ("POOL", {"person": 30}), ("OTHER_POOL", 27)):
        monkeypatch.setattr(R, name, value)
    expected, got = by_pairs(mentions, entities).localCheckpoint(), best_scored(mentions, entities, 5).localCheckpoint()
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "name", "entity_id")
    first = lambda rows: sorted(map(tuple, rows.select("mention_id", "entity_id", "name", "score").withColumn("k", F.row_number().over(order)).where("k <= 5").collect()))
    assert first(got) == first(expected) and len(first(got)) > 150
    assert sorted(R.decisions(mentions, got).collect()) == sorted(R.decisions(mentions, expected).collect())


def test_rallies_resolve_without_a_row_per_pair(spark, tmp_path, monkeypatch):
    rows = [(f"e{i:02}", f"Rally {a} {b} {y}", y) for i, (a, b, y) in enumerate((a, b, y) for a in ("Alfa", "Alva", "Zemgale") for b in ("Forest", "Lakes", "Hills") for y in (2023, 2024))]
    rows += [("e00", "Rali Alfa Forest", 2023), ("e30", "Zemgale", None)]
    spark.createDataFrame(rows, "event_id string, event_name string, year int").write.parquet(f"{tmp_path}/rallies.parquet")
    for name, schema in [("people", "person_id string, display_name string"), ("stages", "stage_id string, stage_name string")]:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    mentions, rallies = understanding._rally_mentions(spark, str(tmp_path)), understanding._rallies(spark, str(tmp_path))
    years = spark.createDataFrame(rows, "entity_id string, name string, year int").select("entity_id", "year").distinct()
    ranked = X.of_edition(mentions, X.rescored(mentions, rallies, X.looked_up(mentions, by_pairs(mentions, rallies))), years).localCheckpoint()
    expected = sorted(X.editions_asked(mentions, ranked, R.decisions(mentions, ranked)).collect())
    for step in ("candidates", "escaped", "scored", "full_scan"):
        monkeypatch.setattr(R, step, None)
    assert sorted(understanding.rally_resolution(spark, str(tmp_path)).collect()) == expected and len(expected) == 20


def test_people_resolve_without_a_row_per_pair(spark, tmp_path, monkeypatch):
    people = [(f"p{i:02}", f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in ("Ann", "Anna", "Bo", "Cy", "Rowbert", "Robert") for b in ("Berg", "Bergman", "Berkolanof", "Carl", "Carlsen"))]
    people += [("q1", "Ann Berg"), ("q2", "ann  berg")]
    typed = [(None, n) for n in ("Ann Berg", "Robert Bergolanov", "Bo", "Yyyy", "Carlson Cy")]
    for name, rows, schema in [
        ("people", people, "person_id string, display_name string"), ("participation", typed, "person_id string, driver_name string"),
        ("rallies", [], "event_id string, event_name string"), ("stages", [], "stage_id string, stage_name string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    mentions, everyone = analytics.mentions_of(spark, str(tmp_path)), analytics._people(spark, str(tmp_path))
    expected = sorted(R.decisions(mentions, by_pairs(mentions, everyone)).collect())
    for step in ("candidates", "escaped", "scored", "full_scan"):
        monkeypatch.setattr(R, step, None)
    assert sorted(analytics.entity_resolution_decisions(spark, str(tmp_path)).collect()) == expected
    assert {r["mention_id"]: r["strategy"] for r in expected}["Ann Berg"] == "duplicate_person_identity"


def test_outcomes_count_every_spelling_without_a_row_per_pair(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("e1", "Rally Alfa 2023", 2023), ("e2", "Rally Alfa 2024", 2024), ("e3", "Zemgale", None)], "event_id string, event_name string, year int").write.parquet(f"{tmp_path}/rallies.parquet")
    for name, schema in [("people", "person_id string, display_name string"), ("stages", "stage_id string, stage_name string")]:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for step in ("candidates", "escaped", "scored", "full_scan"):
        monkeypatch.setattr(R, step, None)
    found = understanding.resolution_outcomes(spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in found) == 3 and sum(r["resolved"] for r in found) == 3


@pytest.mark.parametrize("at_once", [200_000, 9])
def test_namesakes_are_one_row_and_all_come_out(spark, monkeypatch, at_once):
    rng, kept = random.Random(8), []
    names = [f"Rally {a}{b} {y}" for a in ("Bre", "Vel", "Nor") for b in ("moor", "dale", "vik") for y in (2023, 2024)]
    rows = [(f"e{i:03}", rng.choice(["rally", "stage"]), names[i % len(names)]) for i in range(140)] + [("e500", "rally", names[0]), ("e500", "rally", names[1])]
    entities = spark.createDataFrame([*rows, *rows[:30]], "entity_id string, entity_type string, name string")
    mentions = spark.createDataFrame([(f"{k} {t}", k, t) for t in [*names, "Bremoor", "veldale rali 2024", "q"] for k in ("rally", "stage", "person")], "mention_id string, entity_type string, mention string")
    for name, value in (("KEY_ROWS", at_once), ("OTHER_POOL", 28)):
        monkeypatch.setattr(R, name, value)
    monkeypatch.setattr(best, "cut_lineage", lambda frame: kept.append(frame.localCheckpoint()) or kept[-1])
    got = best_scored(mentions, entities, 5).localCheckpoint()
    assert kept[0].count() == len({(k, n) for _, k, n in rows[:-2]}) + 1
    expected = by_pairs(mentions, entities).localCheckpoint()
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "name", "entity_id")
    first = lambda rows: sorted(map(tuple, rows.select("mention_id", "entity_id", "name", "score").withColumn("k", F.row_number().over(order)).where("k <= 5").collect()))
    assert first(got) == first(expected) and len(first(got)) > 150
    assert sorted(R.decisions(mentions, got).collect()) == sorted(R.decisions(mentions, expected).collect())


def test_only_the_edition_asked_for_is_scored(spark, tmp_path, monkeypatch):
    rows = [(f"e{y}{i}", f"Rally {a} {y}", y) for y in range(2015, 2025) for i, a in enumerate(("Alfa", "Bravo", "Zemgale"))] + [("f1", "Alfa Forest", 2020), ("f1", "Alfa Forest", 2021), ("f2", "Alfa Forest", None)]
    spark.createDataFrame(rows, "event_id string, event_name string, year int").write.parquet(f"{tmp_path}/rallies.parquet")
    for name, schema in [("people", "person_id string, display_name string"), ("stages", "stage_id string, stage_name string")]:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    mentions, rallies = understanding._rally_mentions(spark, str(tmp_path)), understanding._rallies(spark, str(tmp_path))
    years = spark.createDataFrame(rows, "entity_id string, name string, year int").select("entity_id", "year").distinct()
    rescored, pools = X.rescored, []
    ranked = X.of_edition(mentions, rescored(mentions, rallies, X.looked_up(mentions, by_pairs(mentions, rallies))), years).localCheckpoint()
    expected = sorted(X.outcome_counts(X.editions_asked(mentions, ranked, R.decisions(mentions, ranked))).collect())
    monkeypatch.setattr(X, "rescored", lambda m, e, pool: pools.append(pool) or rescored(m, e, pool))
    assert sorted(understanding.resolution_outcomes(spark, str(tmp_path)).collect()) == expected
    asked = pools[0].join(years, "entity_id").withColumn("asked", F.regexp_extract("mention_id", "20[0-9]{2}", 0))
    assert asked.where("asked = '2020'").count() > 3 and not asked.where("asked <> ''").groupBy("mention_id", "entity_id").agg(F.max(F.coalesce(F.col("year") == F.col("asked").cast("int"), F.lit(False))).alias("fits")).where("not fits").count()


def test_groups_go_to_all_parts_alike(spark):
    for count, parts in ((24, 12), (7, 12), (31, 8)):
        labels = best.even_labels(spark, count, parts)
        sent = spark.createDataFrame([(x,) for x in labels], "x int").select(F.pmod(F.hash(F.lit(0), "x"), F.lit(parts)).alias("p")).groupBy("p").count().collect()
        assert len(set(labels)) == count and max(r["count"] for r in sent) == -(-count // parts)
