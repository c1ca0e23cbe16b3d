from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tarmacade import understanding
from tarmacade.functions import display as D
from tarmacade.functions.composite import composited, formed, latin_variants
from tarmacade.functions.countries import CODES
from tarmacade.operators import entities as R
from tarmacade.operators import evaluation as V
from tarmacade.operators import resolution as X
from tarmacade.operators.filters import country_spellings
from tarmacade.plans import conversation as C
from tarmacade.plans.query import Intent, QueryError, Role, SearchQuery
from tarmacade.plans.router import CAPABILITIES, may_recover, route


def scores(spark, *pairs):
    frame = spark.createDataFrame([(i, a, b, p) for i, (a, b, *r) in enumerate(pairs) for p in [bool(r and r[0])]], "i int, a string, b string, p boolean")
    frame = formed(formed(frame, "a", "q"), "b", "c")
    return [r["s"] for r in composited(frame, F.col("p"), "s").orderBy("i").collect()]


def test_composite_ladder_people_and_scripts(spark):
    ladder = [("West Cork Rally", "west cork rally"), ("West Cork Rally 2024", "West Cork Rally"), ("WestCork Rally", "West Cork Rally"), ("West Cork", "Rally West Cork"), ("Alexa Fox", "Rally Aleksa Foks")]
    assert scores(spark, *ladder) == [1.0, 0.96, 0.95, 0.94, 0.93]
    assert scores(spark, ("Rally X 1999", "Rally X 2026"), ("", "x"), ("x", ""), (None, "x"), ("x", None)) == [0.25, 0.0, 0.0, 0.0, 0.0]
    other_given, other, near, family, nobody, alone = scores(
        spark, ("Ann Berg", "Cy Berg", True), ("Ann Berg", "Bo Carl", True), ("Ann Bergg", "Ann Berg", True), ("Bergg", "Ann Berg", True), ("Zzz", "Ann Berg", True), ("Berg", "Ann Berg", True)
    )
    assert other_given <= 0.60 and other <= 0.55 < near and family > 0.7 and nobody == 0.0 and alone == 0.9
    assert latin_variants("محمد")[0] == "mhmd" and scores(spark, ("محمد", "Mhmd")) == [0.94]
    same_year, without = scores(spark, ("Weste Cork 2024", "West Cork 2024"), ("Weste Cork", "West Cork"))
    assert same_year == 1.0 > without > 0.8


MENTIONS = "mention_id string, entity_type string, mention string, year int, video boolean"


def test_editions_of_a_rally(spark):
    rallies = [("e1", "rally", "Rally Alfa 2023"), ("e2", "rally", "Rally Alfa 2024"), ("e3", "rally", "Zemgale Winter Sprint 2024")]
    e = spark.createDataFrame(rallies, "entity_id string, entity_type string, name string")
    years = spark.createDataFrame([("e1", 2023), ("e2", 2024), ("e3", 2024)], "entity_id string, year int")
    rows = [("named", "rally", "rally alfa 2024", None, False), ("given", "rally", "rally alfa", 2023, False), ("open", "rally", "rally alfa", None, False), ("film", "rally", "rally alfa", None, True), ("none", "rally", "rally alfa 1999", None, False)]
    m = spark.createDataFrame(rows, MENTIONS)
    ranked = X.of_edition(m, X.rescored(m, e, R.full_scan(m, e)), years)
    found = {r["mention_id"]: r for r in X.editions_asked(m, ranked, R.decisions(m, ranked)).collect()}
    assert found["named"]["entity_id"] == "e2" and found["given"]["entity_id"] == "e1"
    assert found["open"]["strategy"] == "multi_year_ambiguity" and found["open"]["entity_id"] is None and set(found["open"]["options"][:2]) == {"e1", "e2"}
    assert found["film"]["strategy"] != "multi_year_ambiguity" and found["none"]["entity_id"] is None


def test_cities_recovery_and_fallback(spark):
    m = spark.createDataFrame([("a", "Alfa"), ("b", "Riga"), ("c", "Beta rally"), ("d", "zz")], "mention_id string, mention string")
    rallies = spark.createDataFrame([("e1", "Alfa"), ("e2", "RIGA"), ("e3", None)], "entity_id string, city string")
    ranked = spark.createDataFrame([("a", "e1", "Alfa", 0.9), ("c", "e3", "Beta", 0.8), ("d", "e3", "Beta", 0.3)], "mention_id string, entity_id string, name string, score double")
    found = {r["mention_id"]: (r["strategy"], r["city"], r["rally_id"]) for r in X.cities(m, rallies, ranked).collect()}
    assert found == {"a": ("location_vs_event_ambiguity", "Alfa", "e1"), "b": ("unique_match", "RIGA", None), "c": ("clear_winner", None, "e3"), "d": ("none", None, None)}

    decided = "mention_id string, strategy string, entity_id string, confidence double, options array<string>"
    phrases = spark.createDataFrame([(i, "SEARCH_RALLIES", i != "4", i == "3") for i in "12345"], "mention_id string, intent string, may_recover boolean, has_driver boolean")
    rally = spark.createDataFrame([("1", "none", None, 0.0, []), ("2", "clear_winner", "e1", 0.9, []), ("3", "none", None, 0.0, []), ("4", "none", None, 0.0, []), ("5", "insufficient_gap", None, 0.8, ["e1", "e2"])], decided)
    person = spark.createDataFrame([(i, "clear_winner", "p1", 0.8, []) for i in "12345"], decided)
    turned = {r["mention_id"]: (r["intent"], r["entity_type"], r["entity_id"]) for r in X.recovered(phrases, rally, person).collect()}
    assert turned["1"] == ("SEARCH_DRIVER_RALLIES", "person", "p1") and turned["2"] == ("SEARCH_RALLIES", "rally", "e1")
    assert all(turned[i] == ("SEARCH_RALLIES", None, None) for i in "345")

    for mode, voice, expected in (("OFF", False, (None, "first")), ("SHADOW", False, (None, "first")), ("FALLBACK", False, ("p1", "second")), ("FALLBACK", True, (None, "second"))):
        r = {x["mention_id"]: x for x in X.fallback(rally, person, mode, voice).collect()}
        assert (r["1"]["entity_id"], r["1"]["origin"]) == expected and r["2"]["entity_id"] == "e1"
        assert not voice or (r["1"]["options"] == ["p1"] and r["1"]["strategy"] == "voice_clarification")
    with pytest.raises(ValueError):
        X.fallback(rally, person, "X")


def test_context_and_several_names(spark):
    e = spark.createDataFrame([("p1", "person", "Ann Berg"), ("p1", "person", "Annie Bergman"), ("p2", "person", "Bo Carl")], "entity_id string, entity_type string, name string")
    m = spark.createDataFrame([("m", "person", "annie bergman", "LV", None)], "mention_id string, entity_type string, mention string, country string, year int")
    at = spark.createDataFrame([("p1", "LV", 2024), ("p2", "FI", 2024)], "entity_id string, country string, year int")
    context = R.context_score(m, at, ("country", "year"))
    assert [tuple(r) for r in context.collect()] == [("m", "p1", 1.0)]
    row = R.scored(m, e, R.full_scan(m, e), context).where("entity_id = 'p1'").collect()
    assert len(row) == 1 and row[0]["name"] == "Annie Bergman" and "token" in row[0]["matched_by"] and row[0]["score"] > R.scored(m, e, R.full_scan(m, e)).where("entity_id = 'p1'").first()["score"] - 1e-9


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    e = spark.createDataFrame([(f"p{i}", "person", f"Berg {i}") for i in range(60)], "entity_id string, entity_type string, name string")
    m = spark.createDataFrame([("m1", "person", "Berg 7"), ("m2", "person", "Carl")], "mention_id string, entity_type string, mention string")
    whole = sorted(R.candidates(m, R.postings(e)).collect())
    monkeypatch.setattr(R, "KEY_ROWS", 7)
    assert sorted(R.candidates(m, R.postings(e)).collect()) == whole and len(whole) == 60


def test_routes():
    r = route(SearchQuery(Intent.RALLY_RESULTS, rally_names=("Alfa",), driver_names=("Ann",), years=(2024,)), "who won alfa 2024")
    assert r.entities == (("rally", "Alfa"),) and r.direct == ("years",) and r.refused == (("person", "Ann"),) and r.residual == ()
    r = route(SearchQuery(Intent.VIDEO_ACTIONS, action_types=("jump",), countries=("latvia",)), "jumps in Latvia featuring Berg")
    assert r.residual == ("featuring", "berg") or r.residual == ("berg",)
    assert r.residual_type == "person" and route(SearchQuery(Intent.TOP_DRIVERS), "top drivers berg").residual == ()
    assert set(CAPABILITIES) == set(Intent) and may_recover(Intent.RALLIES, "stage") == "rally" and may_recover(Intent.RALLY_RESULTS, "rally") is None


def test_filters_are_added_and_removed():
    q = SearchQuery(Intent.RALLIES, countries=("Latvia",), driver_names=("Ann",))
    assert C.with_filter(q, "country", "LATVIA") == q and C.with_filter(q, "countries", " Estonia ").countries == ("Latvia", "Estonia")
    assert C.with_filter(q, "action", "Jump").intent is Intent.VIDEO_ACTIONS and C.with_filter(q, "years", 2024).years == (2024,) and C.with_filter(q, "year", "x") == q
    left, now = C.without_filter(q, C.Referents(driver="ann", driver_id="d1", winner="Bo"), "driver", "ANN")
    assert left.driver_names == () and now == C.Referents()
    with pytest.raises(QueryError):
        C.with_filter(q, "colour", "red")


def test_referents_of_answers():
    rows = [{"driver_name": "Ann", "driver_id": "d1", "event_name": "Alfa", "rally_id": "e1"}, {"driver_name": "Bo", "driver_id": "d2", "event_name": "Alfa", "rally_id": "e1"}]
    r = C.referents_after(SearchQuery(Intent.TOP_FINISHERS), rows)
    assert (r.winner, r.driver_id, r.rally, r.rally_id) == ("Ann", "d1", "Alfa", "e1")
    assert C.referents_after(SearchQuery(Intent.VIDEO_ACTIONS), rows, C.Referents(driver="Cy")) == C.Referents(driver="Cy", rally="Alfa")
    old = C.Referents(driver="Cy", driver_id="d3")
    assert C.referents_after(SearchQuery(Intent.RALLIES, driver_names=("Di",)), [], old).driver_id is None
    two = [{"event_id": "e1", "event_name": "Alfa"}, {"event_id": "e2", "event_name": "Beta"}]
    assert C.referents_after(SearchQuery(Intent.RALLIES), two).rallies == ("Alfa", "Beta") and C.referents_after(SearchQuery(Intent.RALLIES), two).rally is None
    assert C.referents_after(SearchQuery(Intent.RALLIES), two[:1]).rally_id == "e1" and C.referents_after(SearchQuery(Intent.TOP_UPLOADERS), rows, old) == old
    assert C.referents_after(SearchQuery(Intent.RALLIES, role=Role.DRIVER), []).role is Role.DRIVER


def test_a_turn_is_completed_from_text_and_conversation():
    done = C.completed(SearchQuery(Intent.RALLIES, years=(2023, 2024)), "rallies in Latvia 2024")
    assert done.query.years == (2024,) and done.query.countries == ("latvia",) and done.steps == ("years", "filters")
    assert C.completed(SearchQuery(Intent.RALLIES), "aluksne winter").query.rally_names == ("aluksne winter",)
    inside = C.completed(SearchQuery(Intent.RALLIES, rally_names=("Rally Ireland 2024",)), "show Rally Ireland 2024").query
    assert inside.countries == () and inside.years == ()
    films = C.completed(SearchQuery(Intent.RALLIES), "show me the jumps of that one please", C.Referents(rally="Alfa")).query
    assert films.intent is Intent.VIDEO_ACTIONS and films.action_types == ("jump",) and films.rally_names == ("Alfa",)
    assert C.completed(SearchQuery(Intent.RALLY_RESULTS), "who won it?", C.Referents(rally="Alfa", driver="Ann")).query.rally_names == ("Alfa",)
    his = C.completed(SearchQuery(Intent.DRIVER_VIDEOS), "his videos", C.Referents(driver="Ann", driver_id="d1", winner="Bo"))
    assert his.query.driver_ids == ("d1",) and his.query.driver_names == () and his.steps == ("referent", "ids") and his.missing is None
    assert C.completed(SearchQuery(Intent.RALLY_RESULTS), "who won it then, tell me").missing == "rally" and C.completed(SearchQuery(Intent.DRIVER_WINS), "how often did they win so far").missing == "driver"


def test_choices():
    asked = C.Clarification("person", "berg", (("d1", "Ann Berg"), ("d2", "Bo Berg")), 4)
    q, ids = C.chosen(SearchQuery(Intent.DRIVER_WINS, driver_names=("Berg",), years=(2024,)), asked, "d2", 4)
    assert q.driver_names == () and q.driver_ids == ("d2",) and q.years == (2024,) and ids == {"person": ("d2",)}
    for option, generation in (("d2", 5), ("d9", 4)):
        with pytest.raises(QueryError):
            C.chosen(q, asked, option, generation)


def test_country_groups():
    assert {"uk", "gbr", "wales", "england", "scotland", "great britain"} <= set(country_spellings("Wales")) and "nl" in country_spellings("holland")
    assert CODES["QATAR"] == "QA" and country_spellings("nowhere") == ["nowhere"]


def test_display(spark):
    frame = spark.createDataFrame([(0.0, "near_miss_segments"), (12.34, "jump"), (60.0, ""), (3725.0, None), (None, "_x")], "s double, a string")
    got = frame.select(D.duration(F.col("s")).alias("d"), D.clock(F.col("s")).alias("c"), D.action_title(F.col("a")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("0.0s", "00:00", "Near Miss"), ("12.3s", "00:12", "Jump"), ("1m 0.0s", "01:00", "Action"), ("62m 5.0s", "1:02:05", None), (None, None, " X")]
    q = SearchQuery(Intent.VIDEO_ACTIONS, action_types=("jump",), driver_names=("Ann", "Bo"), countries=("latvia",), year_from=2020, year_to=2022)
    assert D.summary(q) == "Showing jump highlights | Drivers: Ann, Bo | Countries: latvia | Years: 2020–2022" and D.summary(SearchQuery(Intent.RALLIES)) == "Searching rally events"
    assert D.summary(replace(q, action_types=(), driver_names=(), countries=(), year_from=None)).endswith("highlights | Years: <= 2022")


def test_scores_and_outcomes(spark):
    pairs = spark.createDataFrame([("both", ["Ann", "Bo"], [], ["ann "], ["bo"], "ann and bo"), ("made up", ["x"], None, ["x", "zed"], [], "just x"), ("right", ["x"], ["y"], ["X"], ["Y"], None)], "id string, expected_d array<string>, expected_r array<string>, actual_d array<string>, actual_r array<string>, said string")
    got = {r["id"]: r for r in V.query_scores(pairs, ["d", "r"], F.col("said")).collect()}
    pick = lambda i: tuple(got[i][c] for c in ("tp", "fp", "fn", "extra", "hallucinated", "misplaced", "complete", "exact"))
    assert pick("both") == (1, 1, 1, 1, 0, 1, False, False) and pick("made up") == (1, 1, 0, 0, 1, 0, True, False) and pick("right") == (2, 0, 0, 0, 0, 0, True, True)
    turns = spark.createDataFrame([("CLARIFY", True, 0, False, True), ("CLARIFY", False, 3, False, True), ("NO_MATCH", False, 0, False, True), ("RESOLVED", False, 0, True, True), ("RESOLVED", True, 0, True, False)], "expected string, clarified boolean, total int, resolved_all boolean, ran boolean")
    assert [(r["correct"], r["success"], r["false_confident"]) for r in V.system_outcomes(turns).collect()] == [(True, True, False), (False, False, True), (True, True, False), (True, True, False), (False, False, False)]
    stages = spark.createDataFrame([(1000.0, True, True), (9000.0, True, True), (9000.0, True, False), (40000.0, True, False), (None, False, True), (None, None, False)], "ms double, ok boolean, local boolean")
    assert [r[0] for r in stages.select(V.answer_stage(F.col("ms"), F.col("ok"), F.col("local"))).collect()] == ["online", "local_offered", "online_late", "unavailable", "local", "unavailable"]


def test_latencies_of_a_large_group(spark):
    import random

    rng = random.Random(4)
    data = {"a": [rng.lognormvariate(5, 2) for _ in range(900)], "b": [0.0] * 30 + [5.0] * 30 + [7.0], "c": [3.25]}
    frame = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", -1.0)], "g string, v double").repartition(5)
    got = {r["g"]: r for r in V.latency_summary(frame, ["g"], F.col("v")).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        s = sorted(vs)
        assert got[g]["n"] == len(s) and got[g]["max"] == s[-1] and abs(got[g]["mean"] - sum(s) / len(s)) < 1e-5
        assert [got[g][f"p{p}"] for p in V.PERCENTS] == [s[-(-len(s) * p // 100) - 1] for p in V.PERCENTS]


def test_router_batch_reads_a_slipped_year(spark, tmp_path):
    spark.createDataFrame([("Rally Lunporto 2062",), ("Rally Lunporto 2026",)], "event_name string").write.parquet(f"{tmp_path}/rallies.parquet")
    rows = {r["text"]: (r["intent"], list(r["direct"]), r["residual"]) for r in understanding.router_batch(spark, str(tmp_path)).collect()}
    assert rows["who won Rally Lunporto 2062"] == ("GET_RALLY_RESULTS", [], "lunporto") and rows["who won Rally Lunporto 2026"] == ("GET_RALLY_RESULTS", ["years"], "lunporto")
    assert len(rows) == 4


def test_first_and_wanted_candidates_have_the_ranks_of_the_pool(spark, monkeypatch):
    e = spark.createDataFrame([(f"p{i:02}", "person", f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in ("Ann", "Bo", "Cy") for b in ("Berg", "Bergman", "Carl", "Berg"))], "entity_id string, entity_type string, name string")
    m = spark.createDataFrame([(x, "person", x) for x in ("Ann Berg", "Bo Bergmann", "Carl", "zzz")], "mention_id string, entity_type string, mention string")
    index = R.postings(e)
    pool = sorted(map(tuple, R.candidates(m, index).collect()))
    weights = {"prefix": lambda k: 5 * len(k)} | {f: lambda k, w=w: w for f, w in R.WEIGHTS.items()}
    held = {(r["family"], r["key"], r["entity_id"]) for r in index.collect()}
    keyed = m.select("mention_id", F.explode(R._keys(F.col("mention"), R.T.normalize(F.col("mention")))).alias("k")).select("mention_id", "k.*").distinct().collect()
    total = {}
    for r in keyed:
        for f, k, p in held:
            if (f, k) == (r["family"], r["key"]):
                total[r["mention_id"], p] = total.get((r["mention_id"], p), 0) + weights[f](k)
    ranked = {x: sorted((-w, p) for (y, p), w in total.items() if y == x) for x in {y for y, _ in total}}
    assert pool == sorted((x, p, -w, k) for x, rows in ranked.items() for k, (w, p) in enumerate(rows, 1)) and len(pool) > 20
    wanted = spark.createDataFrame([("Ann Berg", "p01"), ("Carl", "p10"), ("Carl", "p00"), ("zzz", "p00")], "mention_id string, entity_id string")
    pairs = {tuple(r) for r in wanted.collect()}
    for most_at_once in (R.KEY_ROWS, 5):
        monkeypatch.setattr(R, "KEY_ROWS", most_at_once)
        assert sorted(map(tuple, R.candidates(m, index, most=2).collect())) == [r for r in pool if r[3] <= 2]
        assert [r for r in sorted(map(tuple, R.candidates(m, index, wanted=wanted).collect())) if r[:2] in pairs] == [r for r in pool if r[:2] in pairs]
