"""Routing, conversation, resolution and their evaluation as queries over the rally tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmacade.analytics import CODE_SQL, PAIRS_SQL, RUNS_SQL, SOUND_SQL, entities_of, mentions_of, name_pairs, norm_sql, runs_of, trim_sql
from tarmacade.functions import display as D
from tarmacade.functions import text as T
from tarmacade.functions.clean import language_code, present, stripped
from tarmacade.functions.countries import CODES_SQL, country_code
from tarmacade.operators import entities as R
from tarmacade.operators import evaluation as V
from tarmacade.operators import resolution as X
from tarmacade.operators.best import best_scored
from tarmacade.plans.conversation import page_referents
from tarmacade.plans.parser import SMALL
from tarmacade.plans.router import ABOUT, residual_words
from tarmacade.session import cut_lineage, spread
from tarmacade.sources.projection import Catalog, common_tables
from tarmacade.sources.tables import table

# --- routing and conversation


def router_residual(spark: SparkSession, sf: str) -> DataFrame:
    """The words of every rally name that name its rally, i.e. neither common words nor its city."""
    rows = table(spark, sf, "rallies").select(F.col("event_name").alias("text"), F.coalesce("city", F.lit("")).alias("city")).where("text is not null").distinct()
    known = F.split(F.lower("city"), r"[^\p{L}\p{N}]+")
    return rows.select("text", "city", F.array_join(F.array_sort(residual_words(F.col("text"), known)), " ").alias("residual"))


def router_batch(spark: SparkSession, sf: str) -> DataFrame:
    """How a question about the videos or the winner of every rally is routed, after its reading."""
    from tarmacade.plans.parser import parse
    from tarmacade.plans.router import route

    names = table(spark, sf, "rallies").select(F.trim("event_name").alias("name")).where("name <> ''").distinct()
    texts = names.select(F.explode(F.array(F.concat(F.lit("videos of "), "name"), F.concat(F.lit("who won "), "name"))).alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                query = parse(text).query
                r = route(query, text) if query else None
                rows.append((text, query.intent.value if query else None, list(r.direct) if r else [], " ".join(r.residual) if r else "", r.residual_type if r else None))
            yield pd.DataFrame(rows, columns=["text", "intent", "direct", "residual", "residual_type"])

    return spread(texts).mapInPandas(read, "text string, intent string, direct array<string>, residual string, residual_type string")


def result_referents(spark: SparkSession, sf: str) -> DataFrame:
    """What the results of each rally refer to: the first driver, and the driver if there is one only."""
    rows = table(spark, sf, "final_results").select(stripped("event_id").alias("event_id"), "id", "pos_overall", stripped("driver_id").alias("driver_id"), stripped("driver_name").alias("driver_name"))
    rows = rows.where("event_id is not null and pos_overall >= 1").distinct()
    return page_referents(rows, "event_id", [F.col("pos_overall"), F.col("id")], "driver_id", "driver_name")


def clip_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Actions of videos as they are shown: title, range of time and duration."""
    c = Catalog(spark, sf)
    names = c.rally_video_actions.select(F.col("id").alias("action_id"), "action_name")
    from tarmacade.operators.strategies import seconds

    start, end = seconds(F.col("start_action")), seconds(F.col("end_action"))
    return c.rally_video_metadata.join(names, "action_id").select("id", D.action_title(F.col("action_name")).alias("title"), D.clock(start).alias("start"), D.clock(end).alias("end"), D.duration(end - start).alias("duration"))


def speech_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Per country the rally names, then the cities, that a speech recogniser should know."""
    rows = table(spark, sf, "rallies").select(country_code("country").alias("country"), F.trim("event_name").alias("name"), F.trim("city").alias("city")).where("country is not null")
    sets = rows.groupBy("country").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("city")).alias("cities"))
    return sets.select("country", D.vocabulary(F.col("names"), F.col("cities")).alias("words"))


# --- evaluation


def query_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Names and countries of people records, scored against their first delivery."""
    rows = table(spark, sf, "people").select(stripped("person_id").alias("id"), F.array(F.coalesce("display_name", F.lit(""))).alias("names"), F.array(F.coalesce(country_code("country"), F.lit("none"))).alias("countries"), F.coalesce("searchable_names", F.array()).alias("others"), "loaded_at").where("id is not null")
    first = rows.groupBy("id").agg(F.min(F.struct("loaded_at", "names", "countries")).alias("f")).select("id", F.col("f.names").alias("expected_names"), F.col("f.countries").alias("expected_countries"))
    pairs = rows.join(first, "id").select("id", "loaded_at", "expected_names", "expected_countries", F.filter("others", lambda x: x.isNotNull()).alias("actual_names"), F.col("countries").alias("actual_countries"), F.col("names")[0].alias("said"))
    scored = V.query_scores(pairs, ["names", "countries"], F.col("said"))
    return scored.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "extra", "hallucinated", "misplaced")], F.count_if("exact").alias("exact"))


def _success() -> Column:
    return present("error_message").isNull()


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    return runs_of(spark, sf).withColumn("language", F.coalesce(language_code("language"), F.lit("und")))


def system_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Voice runs as turns of three kinds of expectation: how many were right, and how many falsely confident."""
    kind = F.element_at(F.array(F.lit("RESOLVED"), F.lit("CLARIFY"), F.lit("NO_MATCH")), (F.pmod("id", F.lit(3)) + 1).cast("int"))
    turns = _spoken(spark, sf).select("language", kind.alias("expected"), (F.coalesce(F.col("db_latency_ms"), F.lit(0)) == 0).alias("clarified"), F.coalesce(F.col("db_latency_ms"), F.lit(0)).alias("total"), (F.coalesce(F.col("entity_resolution_latency_ms"), F.lit(0)) > 50).alias("resolved_all"), _success().alias("ran"))
    return V.system_outcomes(turns).groupBy("language", "expected").agg(F.count(F.lit(1)).alias("turns"), *[F.count_if(c).alias(c) for c in ("correct", "success", "false_confident")])


def conditional_success(spark: SparkSession, sf: str) -> DataFrame:
    """How often runs succeed given quick speech recognition, a quick database, and both."""
    quick = {"stt": F.col("stt_latency_ms").between(0, 800), "db": F.col("db_latency_ms").between(0, 80)}
    found = V.conditional_rates(_spoken(spark, sf), ["language"], _success(), quick | {"both": quick["stt"] & quick["db"]})
    return found.select(*[F.round(c, 6).alias(c) if c.startswith("p_") else F.col(c) for c in found.columns])


def case_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.case_counts(_spoken(spark, sf).withColumn("failed", ~_success()), ["language", "failed", "case_id"])


def case_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of one run."""
    return V.duplicates(table(spark, sf, "voice_results"), F.col("result_id"))


def answer_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Which answer is shown for each run, if languages with a snapshot have one from nearby."""
    local = F.col("language").isin("en", "de", "fi")
    return _spoken(spark, sf).groupBy("language", V.answer_stage(F.col("total_latency_ms"), _success(), local).alias("stage")).agg(F.count(F.lit(1)).alias("runs"))


def entity_preservation(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a rally's shortest spelling each other spelling keeps, in words."""
    pairs = name_pairs(spark, sf)
    return pairs.select("id", "a", "b", F.round(V.entity_preservation(F.col("b"), T.words(F.col("a"))), 6).alias("kept"))


# --- resolution


def _rally_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling of a rally's name that was delivered, once, as a mention of a rally."""
    names = table(spark, sf, "rallies").select(F.trim("event_name").alias("mention")).where("mention <> ''").distinct()
    none = F.lit(None)
    return names.select(F.col("mention").alias("mention_id"), F.lit("rally").alias("entity_type"), "mention", none.cast("int").alias("year"), F.lit(False).alias("video"))


def _rallies(spark: SparkSession, sf: str) -> DataFrame:
    return entities_of(spark, sf).where("entity_type = 'rally'")


def _rally_ranked(spark: SparkSession, sf: str, mentions: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """The rallies that the mentions find by the composite score; with `years` only those that `of_edition` keeps."""
    rallies = cut_lineage(_rallies(spark, sf))
    found = X.looked_up(mentions, best_scored(mentions, rallies, X.LOOKED_UP["rally"]))
    if years is not None:  # the edition depends on no score, so the others need none
        found = X.of_edition(mentions, found, years).distinct()
    return cut_lineage(X.rescored(mentions, rallies, cut_lineage(found)))


def rally_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """What each spelling of a rally resolves to by the composite score, its edition or a question for the year."""
    mentions = cut_lineage(_rally_mentions(spark, sf))
    years = cut_lineage(table(spark, sf, "rallies").select(stripped("event_id").alias("entity_id"), "year").where("entity_id is not null").distinct())
    ranked = cut_lineage(X.of_edition(mentions, _rally_ranked(spark, sf, mentions, years), years))
    return X.editions_asked(mentions, ranked, R.decisions(mentions, ranked))


def city_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """What each delivered city means: a city, a rally of its name, or a question which."""
    rows = table(spark, sf, "rallies").select(stripped("event_id").alias("entity_id"), stripped("city").alias("city")).where("city <> ''")
    mentions = cut_lineage(rows.select(F.col("city").alias("mention_id"), F.lit("rally").alias("entity_type"), F.col("city").alias("mention")).distinct())
    return X.cities(mentions, rows, _rally_ranked(spark, sf, mentions))


def resolution_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return X.outcome_counts(rally_resolution(spark, sf))


def role_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """How many people can be meant as driver, co-driver or either."""
    people = table(spark, sf, "people").select(present("person_id").alias("id"), present("driver_id").alias("driver_id"), present("codriver_id").alias("codriver_id")).where("id is not null").distinct()
    parts = [X.eligible(people, role).select(F.lit(role).alias("role"), "id") for role in ("DRIVER", "CO_DRIVER", "ANY")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("role").agg(F.countDistinct("id").alias("people"))


def candidate_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Which people a typed name finds by its spelling, by its sound, or both."""
    mentions, people = mentions_of(spark, sf), entities_of(spark, sf).where("entity_type = 'person'")

    def met(form) -> DataFrame:  # noqa: ANN001
        m, e = mentions.select("mention_id", form(F.col("mention")).alias("k")), people.select("entity_id", form(F.col("name")).alias("k"))
        return m.join(e.where("k <> ''"), "k").select("mention_id", "entity_id")

    return X.origins(met(T.normalize), met(T.phonetic_key)).groupBy("origin").agg(F.count(F.lit(1)).alias("pairs"))


QUERIES = {
    "router_residual": router_residual, "router_batch": router_batch, "result_referents": result_referents, "clip_titles": clip_titles, "speech_vocabulary": speech_vocabulary,
    "query_scores": query_scores, "system_outcomes": system_outcomes, "conditional_success": conditional_success, "case_counts": case_counts, "case_duplicates": case_duplicates,
    "answer_stages": answer_stages, "entity_preservation": entity_preservation, "rally_resolution": rally_resolution, "city_resolution": city_resolution,
    "resolution_outcomes": resolution_outcomes, "role_eligibility": role_eligibility, "candidate_origins": candidate_origins,
}

# --- SQL

_SPLIT = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(SMALL | ABOUT)) + "]"
_PRESENT = "CASE WHEN lower({0}) NOT IN ('', 'null', 'none') THEN {0} END"
_GIVEN = lambda c: _PRESENT.format(trim_sql(c))
_ERROR = "lower(trim(coalesce(error_message, ''))) IN ('', 'null', 'none')"
_RUN = f"{RUNS_SQL}, r AS (SELECT *, coalesce({CODE_SQL}, 'und') AS lang, {_ERROR} AS ok FROM runs)"
_CLOCK = "CASE WHEN {0} >= 3600 THEN concat(CAST(floor({0} / 3600) AS BIGINT), ':') ELSE '' END || printf('%02d:%02d', CAST(floor({0} % 3600 / 60) AS BIGINT), CAST(floor({0} % 60) AS BIGINT))"

SQL = {
    "router_residual": f"""SELECT text, city, array_to_string(list_sort(list_filter({_SPLIT.format('text')}, lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_STOP}, w) AND NOT list_contains(string_split_regex(lower(city), '[^\\p{{L}}\\p{{N}}]+'), w))), ' ') AS residual
      FROM (SELECT DISTINCT event_name AS text, coalesce(city, '') AS city FROM rallies WHERE event_name IS NOT NULL)""",
    "result_referents": f"""WITH rows_ AS (SELECT DISTINCT {trim_sql('event_id')} AS event_id, id, pos_overall, {trim_sql('driver_id')} AS driver_id, {trim_sql('driver_name')} AS driver_name FROM final_results WHERE event_id IS NOT NULL AND pos_overall >= 1),
      k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos_overall, id, driver_id NULLS FIRST, driver_name NULLS FIRST) AS k FROM rows_)
      SELECT event_id, count(*) AS n, max(driver_id) FILTER (k = 1) AS first_driver_id, max(driver_name) FILTER (k = 1) AS first_driver_name,
        CASE WHEN count(DISTINCT driver_id) = 1 THEN max(driver_id) END AS only_driver_id, CASE WHEN count(DISTINCT driver_name) = 1 THEN max(driver_name) END AS only_driver_name FROM k GROUP BY event_id""",
    "clip_titles": f"""{common_tables('rally_video_metadata', 'rally_video_actions')}, t AS (SELECT m.id, action_name, epoch(CAST(start_action AS TIME)) AS s, epoch(CAST(end_action AS TIME)) AS e FROM rally_video_metadata m JOIN rally_video_actions a ON a.id = action_id)
      SELECT id, array_to_string(list_transform(string_split(replace(action_name, '_segments', ''), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title, {_CLOCK.format('s')} AS start, {_CLOCK.format('e')} AS "end",
        CASE WHEN e - s <= 0 THEN '0.0s' WHEN e - s < 60 THEN printf('%.1fs', e - s) ELSE printf('%dm %.1fs', CAST(floor((e - s) / 60) AS BIGINT), (e - s) % 60) END AS duration FROM t""",
    "speech_vocabulary": f"""WITH n AS (SELECT coalesce(code, u) AS country, trim(event_name) AS name, trim(city) AS city FROM (SELECT *, upper({_GIVEN('country')}) AS u FROM rallies) LEFT JOIN {CODES_SQL} ON spelling = u WHERE u IS NOT NULL),
      w AS (SELECT country, 1 AS p, name AS x FROM n UNION SELECT country, 2, city FROM n), o AS (SELECT country, x, min(p) AS p FROM w WHERE trim(x) <> '' GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY p, x) AS k FROM o) SELECT c.country, coalesce(string_agg(x, ', ' ORDER BY k.k) FILTER (k.k <= 30), '') AS words FROM (SELECT DISTINCT country FROM n) c LEFT JOIN k USING (country) GROUP BY c.country""",
    "system_outcomes": f"""{_RUN}, t AS (SELECT lang AS language, ['RESOLVED', 'CLARIFY', 'NO_MATCH'][1 + result_id % 3] AS expected, coalesce(db_latency_ms, 0) AS total, coalesce(entity_resolution_latency_ms, 0) > 50 AS meant, ok FROM r),
      f AS (SELECT *, total = 0 AS asked, expected <> 'RESOLVED' AND total > 0 AND NOT meant AS wrong FROM t)
      SELECT language, expected, count(*) AS turns, count(*) FILTER (CASE expected WHEN 'CLARIFY' THEN asked WHEN 'NO_MATCH' THEN FALSE ELSE NOT asked AND meant END) AS correct,
        count(*) FILTER (CASE expected WHEN 'CLARIFY' THEN asked WHEN 'NO_MATCH' THEN FALSE ELSE ok END) AS success, count(*) FILTER (wrong) AS false_confident FROM f GROUP BY ALL""",
    "conditional_success": f"""{_RUN}, q AS (SELECT lang AS language, ok, coalesce(stt_latency_ms BETWEEN 0 AND 800, FALSE) AS a, coalesce(db_latency_ms BETWEEN 0 AND 80, FALSE) AS b FROM r)
      SELECT language, count(*) AS cases, {', '.join(f"count(*) FILTER ({c}) AS n_{n}, round(coalesce(avg(CAST(ok AS INT)) FILTER ({c}), 0), 6) AS p_{n}" for n, c in (('stt', 'a'), ('db', 'b'), ('both', 'a AND b')))} FROM q GROUP BY language""",
    "case_counts": f"""{_RUN} SELECT dimension, value, count(*) AS cases FROM (SELECT 'language' AS dimension, lang AS value FROM r UNION ALL SELECT 'failed', CAST(NOT ok AS VARCHAR) FROM r UNION ALL SELECT 'case_id', coalesce(case_id, 'none') FROM r) GROUP BY ALL""",
    "case_duplicates": "SELECT result_id AS key, count(*) AS times FROM voice_results WHERE result_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "answer_stages": f"""{_RUN}, s AS (SELECT lang AS language, ok AND coalesce(total_latency_ms <= 4000, FALSE) AS quick, ok AND coalesce(total_latency_ms <= 35000, FALSE) AS late, lang IN ('en', 'de', 'fi') AS near FROM r)
      SELECT language, CASE WHEN quick THEN 'online' WHEN near AND late THEN 'local_offered' WHEN near THEN 'local' WHEN late THEN 'online_late' ELSE 'unavailable' END AS stage, count(*) AS runs FROM s GROUP BY ALL""",
    "entity_preservation": f"""{PAIRS_SQL}, w AS (SELECT *, list_filter(list_distinct(string_split(a, ' ')), lambda x: x <> '') AS parts FROM pairs)
      SELECT id, a, b, round(CASE WHEN len(parts) = 0 THEN 1 ELSE len(list_filter(parts, lambda x: contains(b, x))) / len(parts) END, 6) AS kept FROM w""",
    "role_eligibility": f"""WITH p AS (SELECT {_GIVEN('person_id')} AS id, {_GIVEN('driver_id')} AS d, {_GIVEN('codriver_id')} AS c FROM people)
      SELECT role, count(DISTINCT id) AS people FROM (SELECT 'DRIVER' AS role, id FROM p WHERE d IS NOT NULL UNION ALL SELECT 'CO_DRIVER', id FROM p WHERE c IS NOT NULL UNION ALL SELECT 'ANY', id FROM p WHERE coalesce(d, c) IS NOT NULL) WHERE id IS NOT NULL GROUP BY role""",
    "candidate_origins": f"""WITH m0 AS (SELECT DISTINCT trim(driver_name) AS mention FROM participation WHERE person_id IS NULL AND trim(driver_name) <> ''), m AS (SELECT mention, {norm_sql('mention')} AS t FROM m0),
      e AS (SELECT id, {norm_sql('name')} AS t FROM (SELECT {_GIVEN('person_id')} AS id, min(display_name) AS name FROM people WHERE trim(display_name) <> '' GROUP BY 1) WHERE id IS NOT NULL),
      ms AS (SELECT mention, t, upper({SOUND_SQL}) AS s FROM m), es AS (SELECT id, t, upper({SOUND_SQL}) AS s FROM e),
      hits AS (SELECT mention, id, ms.t = es.t AS spelt, ms.s = es.s AS heard FROM ms JOIN es ON ms.t = es.t AND es.t <> '' UNION SELECT mention, id, ms.t = es.t, TRUE FROM ms JOIN es ON ms.s = es.s AND es.s <> '')
      SELECT origin, count(*) AS pairs FROM (SELECT DISTINCT mention, id, CASE WHEN spelt AND heard THEN 'both' WHEN spelt THEN 'sql' ELSE 'index' END AS origin FROM hits) GROUP BY origin""",
}
