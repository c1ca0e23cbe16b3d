"""The nine searches as queries with fixed filters, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmacade.operators.strategies import Search, final_stages, page, run
from tarmacade.plans.query import SearchPlan, SearchQuery, compile_query
from tarmacade.sources.projection import Catalog, common_tables


def planned(**values: Any) -> SearchPlan:
    return compile_query(SearchQuery.of(values))


def _search(spark: SparkSession, sf: str, plan: SearchPlan) -> Search:
    return run(Catalog(spark, sf), plan)


CASES: dict[str, dict[str, Any]] = {
    "rallies_country_year": {"intent": "SEARCH_RALLIES", "countries": ["NATION_7", "nation_12"], "years": [1996, 1997], "limit": 50},
    "rallies_year_range": {"intent": "SEARCH_RALLIES", "yearFrom": 1995, "yearTo": 1996, "years": [1999], "limit": 100},
    "rallies_open_range": {"intent": "SEARCH_RALLIES", "yearFrom": 1998, "cities": ["build"], "limit": 100},
    "rallies_city": {"intent": "SEARCH_RALLIES", "cities": ["machin", "AUTO"], "limit": 60},
    "rallies_name": {"intent": "SEARCH_RALLIES", "rallyNames": ["red widget rally 1997", "77"], "limit": 200},
    "rallies_page2": {"intent": "SEARCH_RALLIES", "countries": ["NATION_3"], "limit": 10, "offset": 10},
    "rallies_person_any": {"intent": "SEARCH_RALLIES", "driverIds": ["d3", "c14"], "personRole": "ANY", "limit": 100},
    "rallies_person_all": {"intent": "SEARCH_RALLIES", "driverIds": ["d3", "d4"], "driverMatchMode": "ALL", "personRole": "DRIVER", "limit": 100},
    "participations_driver": {"intent": "SEARCH_DRIVER_RALLIES", "driverNames": ["supplier#000000008"], "personRole": "DRIVER", "limit": 100},
    "participations_codriver": {"intent": "SEARCH_DRIVER_RALLIES", "driverNames": ["customer#000000042"], "personRole": "CO_DRIVER", "limit": 100},
    "participations_any": {"intent": "SEARCH_DRIVER_RALLIES", "driverNames": ["nick8"], "years": [1996], "limit": 100},
    "driver_wins": {"intent": "SEARCH_DRIVER_WINS", "driverIds": ["d5"], "limit": 100},
    "rally_winner": {"intent": "GET_RALLY_RESULTS", "rallyNames": ["red widget rally 1996"]},
    "top_finishers": {"intent": "GET_RALLY_TOP_FINISHERS", "countries": ["NATION_1"], "years": [1997], "limit": 100},
    "top_finishers_person": {"intent": "GET_RALLY_TOP_FINISHERS", "driverNames": ["crew 9", "nick4"], "years": [1997], "limit": 100},
    "video_actions": {"intent": "SEARCH_VIDEO_ACTIONS", "actionTypes": ["near miss", "crash"], "limit": 100},
    "video_actions_stage": {"intent": "SEARCH_VIDEO_ACTIONS", "stageNumbers": ["SS1"], "stageNames": ["small"], "limit": 100},
    "video_actions_person": {"intent": "SEARCH_VIDEO_ACTIONS", "driverIds": ["d11"], "limit": 100},
    "driver_videos": {"intent": "SEARCH_DRIVER_VIDEOS", "driverIds": ["d12", "c20"], "limit": 100},
    "driver_videos_rally": {"intent": "SEARCH_DRIVER_VIDEOS", "countries": ["NATION_5"], "limit": 100},
    "top_uploaders": {"intent": "GET_TOP_UPLOADERS", "limit": 25},
    "top_uploaders_country": {"intent": "GET_TOP_UPLOADERS", "countries": ["NATION_2"], "limit": 25},
    "top_drivers_by_wins": {"intent": "GET_TOP_DRIVERS_BY_WINS", "limit": 30},
    "top_drivers_year": {"intent": "GET_TOP_DRIVERS_BY_WINS", "years": [1996], "limit": 30},
}


def _page(values: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        plan = planned(**values)
        return page(_search(spark, sf, plan), plan)

    return query


def _total(values: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _search(spark, sf, planned(**values)).total

    return query


def final_stage_semi(spark: SparkSession, sf: str) -> DataFrame:
    """The last classified stage of each rally, by an aggregate and a semi join."""
    return final_stages(Catalog(spark, sf))


def final_stage_window(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a window over the rally's classified stages."""
    from pyspark.sql import Window

    from tarmacade.operators.filters import stage_number

    c = Catalog(spark, sf)
    classified = c.rally_results.select("stage_id", F.col("rally_id").alias("event_id")).distinct()
    stages = c.rally_stages.join(classified, ["stage_id", "event_id"], "left_semi").withColumn("number", stage_number(F.col("stage_number")))
    top = F.max("number").over(Window.partitionBy("event_id"))
    return stages.withColumn("final_number", top).where("final_number is not null").select("event_id", "final_number").distinct()


def final_stage_anti(spark: SparkSession, sf: str) -> DataFrame:
    """The same as the stages after which no classified stage comes."""
    from tarmacade.operators.filters import stage_number

    c = Catalog(spark, sf)
    classified = c.rally_results.select("stage_id", F.col("rally_id").alias("event_id")).distinct()
    stages = c.rally_stages.join(classified, ["stage_id", "event_id"], "left_semi").select("event_id", stage_number(F.col("stage_number")).alias("number"))
    later = stages.select(F.col("event_id").alias("e"), F.col("number").alias("n"))
    last = stages.join(later, (F.col("e") == F.col("event_id")) & (F.col("n") > F.col("number")), "left_anti")
    return last.where("number is not null").select("event_id", F.col("number").alias("final_number")).distinct()


TOTALS = ("rallies_country_year", "rallies_person_any", "participations_any", "driver_wins", "rally_winner", "top_finishers", "video_actions", "driver_videos", "top_uploaders", "top_drivers_by_wins")

QUERIES = {name: _page(values) for name, values in CASES.items()}
QUERIES |= {f"{name}_total": _total(CASES[name]) for name in TOTALS}
QUERIES |= {"final_stage_semi": final_stage_semi, "final_stage_window": final_stage_window, "final_stage_anti": final_stage_anti}

# --- SQL

NUMBER = "CASE WHEN {0} IS NOT NULL THEN coalesce(try_cast(nullif(regexp_extract({0}, '^\\s*(\\d+)', 1), '') AS INT), 0) END"
_YEAR = "coalesce(year(start_date), year(end_date))"
TABLES = common_tables()
#: What the searches are said in, one definition per thing: SQL of (name, those it needs before it).
PARTS = {
    "stage_counts": ("SELECT event_id, count(DISTINCT stage_id) AS n FROM rally_stages GROUP BY event_id", ()),
    "crews": ("""SELECT id AS entry_id, sub_event_id, user_driver_id, user_co_driver_id, driver_link, co_driver_link, driver_id, d.full_name AS driver, d.nick_name AS nick, codriver_id, k.full_name AS codriver
        FROM rally_entry_list LEFT JOIN user_driver_profile d ON user_driver_id = driver_id LEFT JOIN user_codriver_profile k ON user_co_driver_id = codriver_id""", ()),
    "started": ("SELECT * FROM crews JOIN rally_sub_events USING (sub_event_id)", ("crews",)),
    "numbered": (f"""SELECT r.id, r.rally_id AS event_id, r.crew AS crew_name, r.pos_overall, r.entry_list_id AS entry_id, {NUMBER.format('s.stage_number')} AS number
        FROM rally_results r, rally_stages s WHERE (s.event_id, s.stage_id) = (r.rally_id, r.stage_id)""", ()),
    "last_ones": ("SELECT * FROM numbered QUALIFY number = max(number) OVER (PARTITION BY event_id)", ("numbered",)),
    "decided": ("""SELECT o.id, event_id, event_name, country, start_date, end_date, pos_overall, crew_name, driver_id, user_driver_id, driver, nick, coalesce(driver, crew_name) AS driver_name
        FROM last_ones o JOIN rally_events USING (event_id) LEFT JOIN crews USING (entry_id)""", ("last_ones", "crews")),
    "shown": ("""SELECT video_id, min(id) AS stream_id, min(on_demand_url) AS video_url FROM rally_streams
        WHERE length(on_demand_url) > 0 AND video_type IS DISTINCT FROM 'instantReplay' GROUP BY video_id""", ()),
    "films": ("""SELECT v.id AS video_id, stage_id, uploader_user_id, thumbnail, video_length_seconds, created_at, event_id, stage_name, stage_number, event_name, country, start_date, end_date
        FROM rally_videos v LEFT JOIN rally_stages USING (stage_id) LEFT JOIN rally_events USING (event_id)""", ()),
    "moments": ("""SELECT m.id, m.video_id, m.entry_list_id AS entry_id, m.points, action_id AS action_type_id, action_name AS action_type,
        CAST(epoch(CAST(m.start_action AS TIME)) AS DOUBLE) AS start_action, CAST(epoch(CAST(m.end_action AS TIME)) AS DOUBLE) AS end_action
        FROM rally_video_metadata m SEMI JOIN shown USING (video_id) JOIN rally_video_actions a ON a.id = action_id""", ("shown",)),
}


def over(query: str, *names: str) -> str:
    """A query over some parts, with those that they need."""
    needed: dict[str, None] = {}

    def need(name: str) -> None:
        for other in PARTS[name][1]:
            need(other)
        needed[name] = None

    for name in names:
        need(name)
    return ",\n".join([TABLES, *[f"{n} AS ({PARTS[n][0]})" for n in needed]]) + "\n" + query


def _rallies_sql(where: str, limit: int, offset: int = 0, *parts: str) -> str:
    return over(
        f"""SELECT event_id, event_name, status, country, city, start_date, end_date, CAST(coalesce(stages_count, n, 0) AS BIGINT) AS stages_count
        FROM (FROM rally_events WHERE {where} ORDER BY start_date DESC NULLS LAST, event_id LIMIT {limit} OFFSET {offset}) LEFT JOIN stage_counts USING (event_id)""",
        "stage_counts", *parts,
    )


_ROLE = "CASE WHEN codriver_id IS NULL THEN 'Driver' WHEN driver_id IS NULL THEN 'Co-Driver' ELSE 'Driver / Co-Driver' END"


def _part_sql(where: str) -> str:
    return over(
        f"""SELECT event_id AS rally_id, event_name, coalesce(driver_id, codriver_id) AS person_id, coalesce(driver, codriver, 'Competitor') AS driver_name, {_ROLE} AS role, start_date
        FROM started JOIN rally_events USING (event_id) WHERE {where} GROUP BY ALL ORDER BY start_date DESC NULLS LAST, rally_id, person_id NULLS FIRST, driver_name, role LIMIT 100""",
        "started",
    )


def _class_sql(where: str, limit: int, person: str = "driver_id") -> str:
    return over(f"SELECT id, event_id AS rally_id, event_name, driver_id AS {person}, driver_name, pos_overall FROM decided WHERE {where} GROUP BY ALL ORDER BY pos_overall, id LIMIT {limit}", "decided")


_PERSON_SHOWN = "coalesce(driver, codriver) AS driver_name"


def _video_sql(where: str) -> str:
    return over(
        f"""SELECT id, video_id, stream_id, video_url, action_type_id, action_type, start_action, end_action, points, thumbnail AS thumbnail_url, stage_name, stage_number, event_name, country AS event_country, {_PERSON_SHOWN}
        FROM moments JOIN shown USING (video_id) LEFT JOIN films USING (video_id) LEFT JOIN crews USING (entry_id) WHERE {where} GROUP BY ALL ORDER BY id DESC, driver_name NULLS FIRST LIMIT 100""",
        "moments", "films", "crews",
    )


_SEEN = "FROM films JOIN rally_video_metadata m USING (video_id) JOIN crews ON entry_id = entry_list_id JOIN shown USING (video_id)"


def _dvideo_sql(where: str) -> str:
    return over(
        f"""SELECT video_id, stream_id, video_url, thumbnail AS thumbnail_url, event_name, stage_name, stage_number, coalesce(driver_id, codriver_id) AS driver_id, {_PERSON_SHOWN}, video_length_seconds, created_at
        {_SEEN} WHERE {where} GROUP BY ALL ORDER BY 1 DESC, 8 NULLS FIRST LIMIT 100""",
        "films", "crews", "shown",
    )


def _uploaders_sql(where: str) -> str:
    return over(
        f"""SELECT uploader_user_id AS uploader_id, account_id, coalesce(nullif(trim(user_name), ''), nullif(trim(full_name), ''), 'Rally Contributor') AS uploader_name, n AS upload_count
        FROM (SELECT uploader_user_id, count(*) AS n FROM films WHERE uploader_user_id IS NOT NULL AND {where} GROUP BY uploader_user_id)
        LEFT JOIN user_fan_profile ON fan_id = uploader_user_id LEFT JOIN user_account a ON a.id = account_id ORDER BY upload_count DESC, uploader_id LIMIT 25""",
        "films",
    )


def _drivers_sql(where: str) -> str:
    return over(
        f"""SELECT driver_id, driver_name, coalesce(driver_id, driver_name) AS person_id, count(DISTINCT event_id) AS win_count
        FROM decided WHERE pos_overall = 1 AND {where} GROUP BY driver_id, driver_name ORDER BY win_count DESC, person_id LIMIT 30""",
        "decided",
    )


def _count(what: str, rest: str, *parts: str) -> str:
    return over(f"SELECT count(DISTINCT {what}) AS total {rest}", *parts)


def _has(word: str, *columns: str) -> str:
    """Whether one of the columns contains a word, whatever the case."""
    return "(" + " OR ".join(f"contains(lower({c}), '{word}')" for c in columns) + ")"


def _entered(who: str) -> str:
    return f"EXISTS (FROM started s WHERE s.event_id = rally_events.event_id AND ({who}))"


_COUNTRY_YEAR = f"({_has('nation_7', 'country')} OR {_has('nation_12', 'country')}) AND {_YEAR} IN (1996, 1997)"
_ANY = "user_driver_id IN ('d3', 'c14') OR user_co_driver_id IN ('d3', 'c14')"
_D3, _D4 = "user_driver_id = 'd3'", "user_driver_id = 'd4'"
_D12 = "(user_driver_id IN ('d12', 'c20') OR user_co_driver_id IN ('d12', 'c20'))"
_NICK = f"{_has('nick8', 'driver', 'nick', 'driver_link', 'codriver', 'co_driver_link')} AND {_YEAR} = 1996"
_ACTIONS = "replace(action_type, '_segments', '') IN ('near_miss', 'crash')"

SQL = {
    "rallies_country_year": _rallies_sql(_COUNTRY_YEAR, 50),
    "rallies_year_range": _rallies_sql(f"{_YEAR} IN (1995, 1996, 1999)", 100),
    "rallies_open_range": _rallies_sql(f"{_YEAR} > 1997 AND {_has('build', 'city')}", 100),
    "rallies_city": _rallies_sql(f"{_has('machin', 'city')} OR {_has('auto', 'city')}", 60),
    "rallies_name": _rallies_sql(f"event_id IN (SELECT event_id FROM rally_events WHERE {_has('red widget rally 1997', 'event_name')} OR {_has('77', 'event_name')} OR event_id = '77' ORDER BY 1)", 200),
    "rallies_page2": _rallies_sql(_has("nation_3", "country"), 10, 10),
    "rallies_person_any": _rallies_sql(_entered(_ANY), 100, 0, "started"),
    "rallies_person_all": _rallies_sql(_entered(_D3) + " AND " + _entered(_D4), 100, 0, "started"),
    "participations_driver": _part_sql(_has("supplier#000000008", "driver", "nick", "driver_link")),
    "participations_codriver": _part_sql(_has("customer#000000042", "codriver", "co_driver_link")),
    "participations_any": _part_sql(_NICK),
    "driver_wins": _class_sql("pos_overall = 1 AND user_driver_id = 'd5'", 100, "person_id"),
    "rally_winner": _class_sql(f"pos_overall = 1 AND {_has('red widget rally 1996', 'event_name')}", 1),
    "top_finishers": _class_sql(f"pos_overall > 0 AND {_has('nation_1', 'country')} AND {_YEAR} = 1997", 100),
    "top_finishers_person": _class_sql(f"pos_overall > 0 AND {_YEAR} = 1997 AND ({_has('crew 9', 'crew_name', 'driver', 'nick')} OR {_has('nick4', 'crew_name', 'driver', 'nick')})", 100),
    "video_actions": _video_sql(_ACTIONS),
    "video_actions_stage": _video_sql(f"(stage_number = '1' OR {_has('stage 1', 'stage_name')}) AND {_has('small', 'stage_name')}"),
    "video_actions_person": _video_sql("'d11' IN (user_driver_id, user_co_driver_id)"),
    "driver_videos": _dvideo_sql(_D12),
    "driver_videos_rally": _dvideo_sql(_has("nation_5", "country")),
    "top_uploaders": _uploaders_sql("TRUE"),
    "top_uploaders_country": _uploaders_sql(_has("nation_2", "country")),
    "top_drivers_by_wins": _drivers_sql("TRUE"),
    "top_drivers_year": _drivers_sql(f"{_YEAR} = 1996"),
    "rallies_country_year_total": _count("event_id", f"FROM rally_events WHERE {_COUNTRY_YEAR}"),
    "rallies_person_any_total": _count("event_id", f"FROM rally_events WHERE {_entered(_ANY)}", "started"),
    "participations_any_total": _count("event_id", f"FROM started JOIN rally_events USING (event_id) WHERE {_NICK}", "started"),
    "driver_wins_total": _count("id", "FROM decided WHERE pos_overall = 1 AND user_driver_id = 'd5'", "decided"),
    "rally_winner_total": over(f"SELECT CAST(count(*) > 0 AS BIGINT) AS total FROM decided WHERE pos_overall = 1 AND {_has('red widget rally 1996', 'event_name')}", "decided"),
    "top_finishers_total": _count("id", f"FROM decided WHERE pos_overall > 0 AND {_has('nation_1', 'country')} AND {_YEAR} = 1997", "decided"),
    "video_actions_total": _count("id", f"FROM moments WHERE {_ACTIONS}", "moments"),
    "driver_videos_total": _count("video_id", f"{_SEEN} WHERE {_D12}", "films", "crews", "shown"),
    "top_uploaders_total": _count("uploader_user_id", "FROM rally_videos"),
    "top_drivers_by_wins_total": _count("coalesce(driver_id, crew_name)", "FROM decided WHERE pos_overall = 1", "decided"),
} | {f"final_stage_{form}": over("SELECT event_id, max(number) AS final_number FROM numbered WHERE number IS NOT NULL GROUP BY event_id", "numbered") for form in ("semi", "window", "anti")}
