"""The snapshot's tables and the searches over them as queries, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmacade.functions.clean import present, stripped
from tarmacade.functions.countries import CODES_SQL
from tarmacade.integrity import ORDER_SQL, given, trimmed
from tarmacade.operators import snapshot as M
from tarmacade.operators.strategies import page
from tarmacade.searches import PARTS, over, planned
from tarmacade.sources.projection import BASE, Catalog, state, written_once
from tarmacade.sources.tables import table


def _builder(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: M.BUILDERS[name](Catalog(spark, sf))


class _Kept(dict):
    """The snapshot of a directory: a table is built and written when first asked for, then read."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        super().__init__()
        self.catalog, self.state = Catalog(spark, sf), state(spark, sf, BASE)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = written_once(self.catalog.spark, f"snapshot-{name}-{self.state}", lambda: M.BUILDERS[name](self.catalog))
        return self[name]


CASES: dict[str, dict[str, Any]] = {
    "rallies": {"intent": "SEARCH_RALLIES", "countries": ["NATION_4"], "yearFrom": 1997, "driverIds": ["d6"], "limit": 100},
    "participations": {"intent": "SEARCH_DRIVER_RALLIES", "driverIds": ["d8"], "years": [1996], "limit": 100},
    "driver_wins": {"intent": "SEARCH_DRIVER_WINS", "driverIds": ["d5"], "limit": 100},
    "rally_results": {"intent": "GET_RALLY_RESULTS", "countries": ["NATION_9"]},
    "top_finishers": {"intent": "GET_RALLY_TOP_FINISHERS", "countries": ["NATION_9"], "years": [1998], "limit": 100},
    "video_actions": {"intent": "SEARCH_VIDEO_ACTIONS", "actionTypes": ["spin"], "countries": ["NATION_8"], "limit": 100},
    "driver_videos": {"intent": "SEARCH_DRIVER_VIDEOS", "driverIds": ["d9"], "limit": 100},
    "top_uploaders": {"intent": "GET_TOP_UPLOADERS", "limit": 15},
    "top_drivers": {"intent": "GET_TOP_DRIVERS_BY_WINS", "limit": 15},
}


def _executed(values: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        plan = planned(**values)
        return page(M.run(_Kept(spark, sf), plan), plan)

    return query


def snapshot_version(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all snapshot tables, with the video tables."""
    return M.version(M.build(Catalog(spark, sf)))


def snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The rallies of every delivered snapshot, the last row of each repeated id."""
    rows = table(spark, sf, "rallies").select(stripped("snapshot_id").alias("snapshot_id"), stripped("event_id").alias("event_id"), "load_ord", "event_name", "year")
    return M.upsert(rows, ["snapshot_id", "event_id"], "load_ord")


def delivered_rallies(spark: SparkSession, sf: str) -> DataFrame:
    """The rallies of the last delivered snapshot, cleaned, as a snapshot table."""
    from tarmacade.functions.clean import instant
    from tarmacade.operators.snapshot_diff import snapshot_order

    order = snapshot_order(table(spark, sf, "meta"))
    rows = table(spark, sf, "rallies").withColumns({"snapshot_id": stripped("snapshot_id"), "event_id": stripped("event_id")})
    last = rows.join(order.where("next_id is null").select("snapshot_id"), "snapshot_id", "left_semi")
    held = M.upsert(last.drop("snapshot_id"), ["event_id"], "load_ord")
    text = {c: present(c) for c in ("event_name", "name_norm", "country", "city", "status")}
    return held.withColumns(text | {c: instant(c) for c in ("start_date", "end_date")}).drop("load_ord")


def delivered_top_countries(spark: SparkSession, sf: str) -> DataFrame:
    """Rallies and their participants per country code over the last snapshot, whatever the spelling."""
    from tarmacade.functions.countries import country_code

    rallies = delivered_rallies(spark, sf).select("event_id", country_code("country").alias("country"))
    entered = table(spark, sf, "participation").select(present("event_id").alias("event_id"), present("person_id").alias("person"))
    counts = entered.where("event_id is not null").groupBy("event_id").agg(F.countDistinct("person").alias("people"))
    return rallies.join(counts, "event_id", "left").groupBy("country").agg(F.count(F.lit(1)).alias("rallies"), F.coalesce(F.sum("people"), F.lit(0)).alias("entries"))


QUERIES = {f"snapshot_{name}": _builder(name) for name in M.BUILDERS}
QUERIES |= {f"snapshot_exec_{name}": _executed(values) for name, values in CASES.items()}
QUERIES |= {"snapshot_version": snapshot_version, "snapshot_upsert": snapshot_upsert, "delivered_rallies": delivered_rallies, "delivered_top_countries": delivered_top_countries}

# --- SQL

_SPACED = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_INSTANT = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
_PERSON = "coalesce(driver_id, codriver_id) AS person_id, driver_id, codriver_id"

PARTS |= {
    "s_rallies": (f"""SELECT event_id, event_name, {_SPACED.format('event_name')} AS name_norm, country, city, year(coalesce(start_date, end_date)) AS year,
        {_INSTANT.format('start_date')} AS start_date, {_INSTANT.format('end_date')} AS end_date, status, CAST(coalesce(stages_count, n, 0) AS BIGINT) AS stages_count
        FROM rally_events LEFT JOIN stage_counts USING (event_id)""", ("stage_counts",)),
    "profiles": ("""SELECT *, CASE WHEN account_id IS NULL THEN concat('person:', side, ':', profile) ELSE concat('person:account:', account_id) END AS person_id
        FROM (SELECT 'driver' AS side, driver_id AS profile, account_id, trim(full_name) AS name, country FROM user_driver_profile
              UNION ALL SELECT 'codriver', codriver_id, account_id, trim(full_name), country FROM user_codriver_profile) WHERE name <> ''""", ()),
    "grouped": ("""SELECT person_id, max(profile) FILTER (side = 'driver') AS driver_id, max(profile) FILTER (side = 'codriver') AS codriver_id,
        coalesce(min(name) FILTER (side = 'driver'), min(name)) AS display_name, list_sort(list(DISTINCT name)) AS searchable_names, max(account_id) AS account_id, min(country) AS country
        FROM profiles GROUP BY person_id""", ("profiles",)),
    "s_people": (f"""SELECT person_id, display_name, {_SPACED.format('display_name')} AS name_norm, searchable_names,
        CASE WHEN codriver_id IS NULL THEN 'driver' WHEN driver_id IS NULL THEN 'co_driver' ELSE 'both' END AS role, driver_id, codriver_id, account_id, country FROM grouped""", ("grouped",)),
    "s_stages": (f"SELECT stage_id, event_id, stage_name, {_SPACED.format('stage_name')} AS name_norm, stage_number FROM rally_stages", ()),
    "s_participation": ("""SELECT event_id, person_id, driver_id, codriver_id, driver_name, role FROM (
        SELECT event_id, coalesce(user_driver_id, user_co_driver_id) AS person_id, user_driver_id AS driver_id, user_co_driver_id AS codriver_id, coalesce(driver, codriver, 'Competitor') AS driver_name,
          CASE WHEN user_co_driver_id IS NULL THEN 'Driver' WHEN user_driver_id IS NULL THEN 'Co-Driver' ELSE 'Driver / Co-Driver' END AS role
        FROM started WHERE coalesce(user_driver_id, user_co_driver_id) IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY event_id, person_id, role ORDER BY driver_name, driver_id, codriver_id) = 1""", ("started",)),
    "s_final_results": ("SELECT DISTINCT id, event_id, driver_id, driver_name, pos_overall FROM decided WHERE pos_overall > 0", ("decided",)),
    "s_driver_wins": ("SELECT coalesce(driver_id, driver_name) AS person_id, driver_id, driver_name, count(DISTINCT event_id) AS win_count FROM decided WHERE pos_overall = 1 GROUP BY ALL", ("decided",)),
    "s_uploader_stats": ("""SELECT uploader_user_id AS uploader_id, account_id, coalesce(nullif(trim(user_name), ''), nullif(trim(full_name), ''), 'Rally Contributor') AS uploader_name, n AS upload_count
        FROM (SELECT uploader_user_id, count(*) AS n FROM rally_videos WHERE uploader_user_id IS NOT NULL GROUP BY ALL) LEFT JOIN user_fan_profile ON fan_id = uploader_user_id LEFT JOIN user_account a ON a.id = account_id""", ()),
    "s_video_meta": (f"""SELECT DISTINCT video_id, event_id, CASE WHEN event_id IS NOT NULL THEN stage_id END AS stage_id, {_PERSON}, coalesce(driver, codriver) AS driver_name, event_name, stage_name, stage_number,
        thumbnail AS thumbnail_url, video_url AS on_demand_url, video_length_seconds AS length_seconds, created_at
        FROM films JOIN rally_video_metadata m USING (video_id) JOIN crews ON entry_id = entry_list_id JOIN shown USING (video_id)""", ("films", "crews", "shown")),
    "s_video_actions": (f"""SELECT DISTINCT id, video_id, event_id, CASE WHEN event_id IS NOT NULL THEN stage_id END AS stage_id, {_PERSON}, action_type, action_type_id, coalesce(driver, codriver) AS driver_name, event_name,
        country AS event_country, stage_name, stage_number, start_action, end_action, points, thumbnail AS thumbnail_url, video_url AS on_demand_url
        FROM moments JOIN shown USING (video_id) LEFT JOIN films USING (video_id) LEFT JOIN crews USING (entry_id)""", ("moments", "films", "crews")),
}


#: The rows that hold of the last delivered snapshot.
_LAST = f"""{ORDER_SQL}, last_rows AS (SELECT * REPLACE ({trimmed('event_id')} AS event_id) FROM rallies WHERE {trimmed('snapshot_id')} IN (SELECT snapshot_id FROM orders_ WHERE next_id IS NULL)
  QUALIFY row_number() OVER (PARTITION BY {trimmed('event_id')} ORDER BY load_ord DESC) = 1)"""
_AT = "try_cast(regexp_replace({0}, 'Z$|[+-]00:00$', '') AS TIMESTAMP)"


def _over(query: str, *names: str) -> str:
    """A query over snapshot tables, which are named `s_<table>`."""
    return over(query, *[f"s_{n}" for n in names])


SQL = {f"snapshot_{name}": _over(f"SELECT * FROM s_{name}", name) for name in M.BUILDERS} | {
    "snapshot_exec_rallies": _over("SELECT event_id, event_name, status, country, city, start_date, end_date, stages_count, year FROM s_rallies WHERE lower(country) LIKE '%nation_4%' AND year >= 1997 AND event_id IN (SELECT event_id FROM s_participation WHERE driver_id = 'd6' OR codriver_id = 'd6') ORDER BY start_date DESC NULLS LAST, event_id LIMIT 100", "rallies", "participation"),
    "snapshot_exec_participations": _over("SELECT p.event_id AS rally_id, r.event_name, p.person_id, p.driver_name, p.role, r.country, r.city, r.start_date FROM s_participation p JOIN s_rallies r ON p.event_id = r.event_id WHERE (p.driver_id = 'd8' OR p.codriver_id = 'd8') AND r.year = 1996 ORDER BY r.start_date DESC NULLS LAST, rally_id, person_id, role LIMIT 100", "rallies", "participation"),
    "snapshot_exec_driver_wins": _over("SELECT f.id, f.event_id AS rally_id, r.event_name, f.driver_id AS person_id, f.driver_name, f.pos_overall, r.start_date FROM s_final_results f JOIN s_rallies r ON f.event_id = r.event_id WHERE f.pos_overall = 1 AND f.driver_id = 'd5' ORDER BY r.start_date DESC NULLS LAST, f.id LIMIT 100", "rallies", "final_results"),
    "snapshot_exec_rally_results": _over("SELECT f.id, f.event_id AS rally_id, r.event_name, f.driver_id, f.driver_name, f.pos_overall FROM s_final_results f JOIN s_rallies r ON f.event_id = r.event_id WHERE f.pos_overall = 1 AND lower(r.country) LIKE '%nation_9%' ORDER BY f.pos_overall, f.id LIMIT 1", "rallies", "final_results"),
    "snapshot_exec_top_finishers": _over("SELECT f.id, f.event_id AS rally_id, r.event_name, f.driver_id, f.driver_name, f.pos_overall FROM s_final_results f JOIN s_rallies r ON f.event_id = r.event_id WHERE lower(r.country) LIKE '%nation_9%' AND r.year = 1998 ORDER BY f.pos_overall, f.id LIMIT 100", "rallies", "final_results"),
    "snapshot_exec_video_actions": _over("SELECT id, video_id, action_type_id, action_type, event_name, driver_name, start_action, end_action, points, on_demand_url AS video_url, thumbnail_url, stage_name, stage_number, event_country FROM s_video_actions WHERE action_type IN ('spin', 'spin_segments') AND event_id IN (SELECT event_id FROM s_rallies WHERE lower(country) LIKE '%nation_8%') ORDER BY id DESC, driver_name NULLS FIRST LIMIT 100", "rallies", "video_actions"),
    "snapshot_exec_driver_videos": _over("SELECT video_id, on_demand_url AS video_url, thumbnail_url, event_name, stage_name, stage_number, person_id AS driver_id, driver_name, length_seconds AS video_length_seconds, created_at FROM s_video_meta WHERE driver_id = 'd9' OR codriver_id = 'd9' ORDER BY video_id DESC, driver_id NULLS FIRST LIMIT 100", "video_meta"),
    "snapshot_exec_top_uploaders": _over("SELECT * FROM s_uploader_stats ORDER BY upload_count DESC, uploader_id LIMIT 15", "uploader_stats"),
    "snapshot_exec_top_drivers": _over("SELECT * FROM s_driver_wins ORDER BY win_count DESC, person_id LIMIT 15", "driver_wins"),
    "delivered_rallies": f"WITH {_LAST} SELECT event_id, {', '.join(f'{given(c)} AS {c}' for c in ('event_name', 'name_norm', 'country', 'city', 'status'))}, year, {', '.join(f'{_AT.format(given(c))} AS {c}' for c in ('start_date', 'end_date'))}, stages_count FROM last_rows",
    "delivered_top_countries": f"""WITH {_LAST}, e AS (SELECT {given('event_id')} AS event_id, count(DISTINCT {given('person_id')}) AS people FROM participation GROUP BY 1),
      c AS (SELECT event_id, coalesce(code, u) AS country FROM (SELECT event_id, upper({given('country')}) AS u FROM last_rows) LEFT JOIN {CODES_SQL} ON spelling = u)
      SELECT country, count(*) AS rallies, CAST(coalesce(sum(people), 0) AS BIGINT) AS entries FROM c LEFT JOIN e USING (event_id) GROUP BY country""",
    "snapshot_upsert": "SELECT snapshot_id, event_id, load_ord, event_name, year FROM (SELECT trim(snapshot_id) AS snapshot_id, trim(event_id) AS event_id, load_ord, event_name, year, row_number() OVER (PARTITION BY trim(snapshot_id), trim(event_id) ORDER BY load_ord DESC) AS k FROM rallies) WHERE k = 1",
}
