from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarmacade import analytics
from tarmacade.functions import kernels
from tarmacade.functions import text as T
from tarmacade.operators import entities as R
from tarmacade.operators import evaluation as V
from tarmacade.operators import strategies
from tarmacade.operators.filters import stage_number
from tarmacade.plans.parser import grounded, parse, residual_type
from tarmacade.plans.query import Intent, QueryError, Resolution, Role, SearchQuery, compile_query

DAY = datetime(2024, 5, 1)
TABLES = {
    "rally_events": ("event_id string, event_name string, status string, country string, city string, start_date timestamp, end_date timestamp, stages_count int", [
        ("1", "Rally A 2024", "done", "LV", "Riga", DAY, DAY, None), ("2", "Rally 100% B", "done", "Latvia", None, None, datetime(2023, 1, 1), 5), ("3", "Rally C", None, None, None, None, None, None)]),
    "rally_stages": ("stage_id string, event_id string, stage_name string, stage_number string", [
        ("s1", "1", "Stage 2", "2"), ("s2", "1", "Stage 10", "10"), ("s3", "1", "Unrun", "11"), ("s4", "2", "Odd", "SS3"), ("s5", "2", "None", None)]),
    "rally_sub_events": ("sub_event_id string, event_id string", [("e1", "1"), ("e2", "2")]),
    "rally_entry_list": ("id string, sub_event_id string, user_driver_id string, user_co_driver_id string, driver_link string, co_driver_link string", [
        ("n1", "e1", "d1", "c1", None, None), ("n2", "e1", "d2", None, "/p/two", None), ("n3", "e2", "d1", None, None, None)]),
    "rally_results": ("id long, rally_id string, stage_id string, entry_list_id string, crew string, pos_overall int", [
        (1, "1", "s1", "n1", "x", 1), (2, "1", "s2", "n2", "x", 1), (3, "1", "s2", "n1", "x", 2), (4, "1", "s2", None, "Crew Z", 2), (5, "1", "s2", "n1", "x", None), (6, "2", "s4", "n3", "x", 1)]),
    "user_driver_profile": ("driver_id string, account_id string, full_name string, nick_name string, country string", [("d1", None, "Ann Berg", None, "LV"), ("d2", "9", "Bo Carl", "Bobo", "LV")]),
    "user_codriver_profile": ("codriver_id string, account_id string, full_name string, nick_name string, country string", [("c1", "9", "Cy Dahl", None, "LV")]),
}


class Tables:
    def __init__(self, spark):
        for name, (schema, rows) in TABLES.items():
            setattr(self, name, spark.createDataFrame(rows, schema))


def ids(spark, key, **query):
    plan = compile_query(SearchQuery.of(query))
    found = strategies.run(Tables(spark), plan)
    return [r[key] for r in strategies.page(found, plan).collect()], found.total.collect()[0]["total"]


def test_last_classified_stage_counts_numbers_not_text(spark):
    assert ids(spark, "id", intent="GET_RALLY_TOP_FINISHERS", rallyNames=["Rally A"]) == ([2, 3, 4], 3)
    assert ids(spark, "id", intent="GET_RALLY_RESULTS", rallyNames=["Rally A"]) == ([2], 1)
    assert ids(spark, "driver_id", intent="GET_TOP_DRIVERS_BY_WINS") == (["d1", "d2"], 2)


def test_page_with_its_total(spark):
    plan = compile_query(SearchQuery.of({"intent": "SEARCH_RALLIES", "limit": 2}))
    found = strategies.run(Tables(spark), plan)
    rows = strategies.page_with_total(found, plan, "event_id").collect()
    assert [(r["event_id"], r["total"], r["stages_count"]) for r in rows] == [("1", 3, 3), ("2", 3, 5)]
    assert strategies.has_more(plan, 2, 3) and not strategies.has_more(plan, 2, 2)


def test_filtered_leaderboards_of_the_snapshot(spark):
    from tarmacade.operators import snapshot as M

    s = {n: M.BUILDERS[n](Tables(spark)) for n in ("rallies", "participation", "final_results", "driver_wins")}

    def wins(**q):
        plan = compile_query(SearchQuery.of({"intent": "GET_TOP_DRIVERS_BY_WINS"} | q))
        return [(r["driver_id"], r["win_count"]) for r in strategies.page(M.run(s, plan), plan).collect()]

    assert wins() == [("d1", 1), ("d2", 1)] and wins(years=[2024]) == [("d2", 1)] and wins(years=[1999]) == []
    with pytest.raises(QueryError):
        M.run(s, compile_query(SearchQuery.of({"intent": "GET_TOP_UPLOADERS", "years": [2024]})))


def test_filters_alternate_within_and_add_up_across(spark):
    assert ids(spark, "event_id", intent="SEARCH_RALLIES", country="lva") == (["1", "2"], 2)
    assert ids(spark, "event_id", intent="SEARCH_RALLIES", countries=["latvia"], years=[2023], yearFrom=2025) == (["2"], 1)
    assert ids(spark, "event_id", intent="SEARCH_RALLIES", rallyNames=["100%"]) == (["2"], 1)
    assert ids(spark, "event_id", intent="SEARCH_RALLIES", limit=1, offset=1) == (["2"], 3)


def test_people_any_all_and_role(spark):
    both = {"intent": "SEARCH_RALLIES", "driverIds": ["d1", "d2"]}
    assert ids(spark, "event_id", **both) == (["1", "2"], 2)
    assert ids(spark, "event_id", **both, driverMatchMode="ALL") == (["1"], 1)
    assert ids(spark, "rally_id", intent="SEARCH_DRIVER_RALLIES", driverNames=["dahl cy"], personRole="CO_DRIVER") == (["1"], 1)
    assert ids(spark, "rally_id", intent="SEARCH_DRIVER_RALLIES", driverNames=["dahl"], personRole="DRIVER") == ([], 0)
    assert ids(spark, "person_id", intent="SEARCH_DRIVER_RALLIES", driverNames=["bobo"]) == (["d2"], 1)


def test_stages_are_counted_where_the_count_is_unknown(spark):
    plan = compile_query(SearchQuery(Intent.RALLIES))
    rows = strategies.page(strategies.run(Tables(spark), plan), plan).collect()
    assert {r["event_id"]: r["stages_count"] for r in rows} == {"1": 3, "2": 5, "3": 0}


def test_unresolved_phrase_empties_the_result(spark):
    query = SearchQuery(Intent.RALLIES, rally_names=("nowhere",))
    plan = compile_query(query, [Resolution("nowhere", "rally")])
    assert strategies.run(Tables(spark), plan).total.collect()[0]["total"] == 0
    with pytest.raises(QueryError):
        compile_query(query, [Resolution("nowhere", "rally", ambiguous=True)])
    nobody = compile_query(SearchQuery(Intent.PARTICIPATIONS, driver_names=("nobody",)), [Resolution("nobody", "person")])
    assert nobody.nothing and strategies.run(Tables(spark), nobody).rows.count() == 0
    with pytest.raises(QueryError):
        compile_query(SearchQuery(Intent.RALLIES, action_types=("jump",)))


@pytest.mark.parametrize("bad", [{"intent": "X"}, {"intent": "SEARCH_RALLIES", "limit": 0}, {"intent": "SEARCH_RALLIES", "years": ["x"]}, {"intent": "SEARCH_RALLIES", "foo": 1}, {"intent": "SEARCH_RALLIES", "personRole": "COOK"}, {"intent": "SEARCH_RALLIES", "yearFrom": 2025, "yearTo": 2020}])
def test_bad_queries_are_refused(bad):
    with pytest.raises(QueryError):
        SearchQuery.of(bad)


def test_query_cleaning():
    q = SearchQuery.of({"intent": "SEARCH_RALLIES", "driverName": " ann ", "driverNames": ["null", "", "ann"], "limit": 999})
    assert q.driver_names == ("ann",) and q.limit == 999 and q.role is Role.ANY


def columns(spark, values, **exprs):
    frame = spark.createDataFrame([(v,) for v in values], "x string").select(*[e(F.col("x")).alias(n) for n, e in exprs.items()])
    return [tuple(r) for r in frame.collect()]


def test_text_functions(spark):
    assert columns(spark, ["Rallye Zemgale-2 2powerStage O’Neil Ærø", "", None], n=T.normalize) == [("rallye zemgale 2 2 powerstage o neil aero",), ("",), (None,)]
    assert columns(spark, ["Robert", "Rupert", "Ashcraft", "Aluksne", ""], s=T.soundex) == [("R163",), ("R163",), ("A226",), ("A425",), ("",)]
    assert columns(spark, ["ab", "abcab", ""], g=lambda c: T.grams(c, 2)) == [(["ab"],), (["ab", "bc", "ca"],), ([],)]
    assert columns(spark, ["SS12A", "12A", " 7", None], n=stage_number) == [(0,), (12,), (7,), (None,)]
    assert columns(spark, ["2147483647", "12345678901"], n=stage_number) == [(2147483647,), (0,)]
    assert columns(spark, ["1:02:03", "02:03", "75", "x", ""], s=strategies.seconds) == [(3723.0,), (123.0,), (75.0,), (None,), (None,)]
    assert columns(spark, ["Rally Aluksne 2024"], b=T.strip_year, c=T.strip_descriptors, y=T.extract_year) == [("rally aluksne", "aluksne 2024", 2024)]


def test_kernels():
    assert kernels.jaro_winkler("", "") == 1.0 and kernels.jaro_winkler("x", "") == 0.0
    assert round(kernels.jaro_winkler("martha", "marhta"), 6) == 0.961111 and round(kernels.jaro("dwayne", "duane"), 6) == 0.822222
    assert kernels.dice("abc", "xyz", 2) == 0.0 and kernels.dice("aaa", "aa", 2) == 2 / 3
    assert kernels.articulatory("same", "same") == 1.0 and kernels.articulatory("bad", "pat") > kernels.articulatory("bad", "sam")
    assert kernels.word_error_rate("a b c", "a x c d") == 2 / 3


def test_index_finds_what_a_full_scan_finds_and_decides_safely(spark):
    people = [("p1", "person", "Ann Berg"), ("p2", "person", "Anna Bergman"), ("p3", "person", "Bo Carl"), ("p4", "person", "Bo Carl"), ("p5", "person", " ")]
    mentions = [("m1", "person", "Bo Carl"), ("m2", "person", "Ann Berg"), ("m3", "person", "zzz"), ("m4", "person", "ann")]
    e = spark.createDataFrame(people, "entity_id string, entity_type string, name string")
    m = spark.createDataFrame(mentions, "mention_id string, entity_type string, mention string")
    pool = R.candidates(m, R.postings(e))
    full = m.join(e.where("trim(name) <> ''"), "entity_type").select("mention_id", "entity_id")
    best = lambda p: {r["mention_id"]: r["entity_id"] for r in R.scored(m, e, p).groupBy("mention_id").agg(F.max_by("entity_id", F.struct("score", "entity_id")).alias("entity_id")).collect() if r["mention_id"] != "m3"}
    assert best(pool) == best(full)
    decided = {r["mention_id"]: (r["strategy"], r["entity_id"]) for r in R.decisions(m, R.scored(m, e, pool)).collect()}
    assert decided["m1"] == ("duplicate_person_identity", None) and decided["m3"] == ("none", None)
    assert decided["m4"][0] == "partial_name_ambiguity" and decided["m2"][1] in ("p1", None)


def test_parity_and_scores(spark):
    left = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1", "2"]), ("c", ["1"]), ("d", ["1"])], "case_id string, ids array<string>")
    right = spark.createDataFrame([("a", ["1", "2"]), ("b", ["2", "1"]), ("c", ["2"]), ("e", [])], "case_id string, ids array<string>")
    assert {r[0]: r[1] for r in V.parity(left, right).collect()} == {"a": "EXACT", "b": "UNDEFINED_ORDERING", "c": "MISMATCH", "d": "MISSING_RIGHT", "e": "MISSING_LEFT"}
    pairs = spark.createDataFrame([("g", ["x", "y"], ["x", "z", "z"]), ("g", None, None), ("h", [], None)], "g string, expected_f array<string>, actual_f array<string>")
    rows = {r["g"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in V.field_scores(pairs, ["f"], ["g"]).collect()}
    assert rows == {"g": (1, 1, 1, 0.5), "h": (0, 0, 0, 1.0)}


def test_parser():
    p = parse("Show me jumps in Latvia between 2024 and 2022")
    assert p.query.intent is Intent.VIDEO_ACTIONS and p.query.countries == ("latvia",) and (p.query.year_from, p.query.year_to) == (2022, 2024)
    assert parse("who won rally aluksne 2024").residual == ("aluksne",) and parse("hello!").special == "greeting" and parse("What  is the capital of Peru?").special == "unsupported" and parse("who is the best rally driver").special == "opinion"
    assert parse("purple monkeys").query is None
    assert grounded(SearchQuery(Intent.RALLIES, years=(2023, 2024)), "rallies in 2024").years == (2024,)
    assert residual_type(("berg",), "videos featuring berg", Intent.VIDEO_ACTIONS) == "person"


def test_recall_asks_only_for_the_wanted_ranks(spark, tmp_path, monkeypatch):
    rows = [("p1", "Ann Berg", "driver", ["Ann Berg", "Annie Berg"]), ("p2", "Annie Berg", "driver", ["Bergie"]), ("p3", "Bo Carl", None, ["null", "Zzz"])]
    spark.createDataFrame(rows, "person_id string, display_name string, role string, searchable_names array<string>").write.parquet(f"{tmp_path}/people.parquet")
    for table, schema in [("rallies", "event_id string, event_name string"), ("stages", "stage_id string, stage_name string")]:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    sizes, found = [], R.candidates

    def counted(*args, **kwargs):
        pool = found(*args, **kwargs)
        sizes.append((pool.count(), found(*args).count()))
        return pool

    monkeypatch.setattr(R, "candidates", counted)
    got = {r["group"]: (r["cases"], r["recall_1"], r["recall_5"]) for r in analytics.recall_mrr(spark, str(tmp_path)).collect()}
    assert got == {"driver": (3, 0.666667, 1.0), "none": (1, 0.0, 0.0)} and sizes[0][0] == 3 < sizes[0][1]


def test_parser_takes_no_year_out_of_range():
    assert parse("Rally Lunporto 2062").query.years == () and parse("rallies 1912, 2024").query.years == (2024,)
    q = parse("rallies between 1900 and 1960").query
    assert (q.years, q.year_from, q.year_to) == ((), None, 1960)
    assert parse("rallies since 1949").query.year_from is None and parse("rallies before 2051").query.year_to is None
    assert parse("lunporto 2062").query is None and parse("rallies 1950-2050").query.year_from == 1950


def test_parser_batch_reads_a_slipped_year(spark, tmp_path):
    spark.createDataFrame([("Rally Lunporto 2062", "LV"), ("Rally Lunporto 2026", "LV")], "event_name string, country string").write.parquet(f"{tmp_path}/rallies.parquet")
    assert {r["text"]: r["years"] for r in analytics.parser_batch(spark, str(tmp_path)).collect()} == {"Rally Lunporto 2062 LV": [], "Rally Lunporto 2026 LV": [2026]}


def test_decisions_score_the_whole_pool_and_all_where_it_is_small(spark, tmp_path):
    rally = ("e1", "Rally A")
    people = [(f"p{i:02}", f"Bergolanov {a}{b}") for i, (a, b) in enumerate((a, b) for a in ("Xu", "Zo", "Wy", "Qua", "Vi", "Ju") for b in ("dak", "jin", "sup", "kal", "mod", "fas", "zem", "wog", "nib", "hyt"))]
    for name, rows, schema in [
        ("people", [*people, ("q1", "Rowbert Berkolanof")], "person_id string, display_name string"), ("rallies", [rally], "event_id string, event_name string"),
        ("stages", [("s1", "Stage 1")], "stage_id string, stage_name string"), ("participation", [(None, "Robert Bergolanov"), (None, "Yyyy")], "person_id string, driver_name string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    mentions, everyone = analytics.mentions_of(spark, str(tmp_path)), analytics._people(spark, str(tmp_path))
    pool = R.candidates(mentions, R.postings(everyone))
    sizes = {r["mention_id"]: r["count"] for r in pool.groupBy("mention_id").count().collect()}
    assert sizes["Robert Bergolanov"] == 61 and sizes.get("Yyyy", 0) < R.LEAST_POOL
    expected = sorted(R.decisions(mentions, R.scored(mentions, everyone, R.full_scan(mentions, everyone))).collect())
    assert sorted(analytics.entity_resolution_decisions(spark, str(tmp_path)).collect()) == expected
    assert pool.where("mention_id = 'Robert Bergolanov' and entity_id = 'q1'").first()["rank"] > 50
    assert next(r for r in expected if r["mention_id"] == "Robert Bergolanov")["entity_id"] == "q1"
    assert R.escaped(mentions, everyone, pool).where("mention_id = 'Yyyy'").count() == 61
