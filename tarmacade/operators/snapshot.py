"""The snapshot: nine denormalised and pre-aggregated tables, and the searches over them.

Builders turn the operational tables into snapshot tables; a `Snapshot` holds the tables by name,
whether just built or read from a store; the searches answer the same structured query as the
operational ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmacade.functions.clean import present
from tarmacade.operators import filters as P
from tarmacade.operators.strategies import Search, display_name, entries, final_results, role_label, seconds, streams
from tarmacade.plans.query import Intent, QueryError, Role, SearchPlan, SearchQuery
from tarmacade.sources.projection import Catalog

CORE = ("rallies", "people", "stages", "participation", "final_results", "driver_wins", "uploader_stats")
FULL = (*CORE, "video_meta", "video_actions")

Snapshot = Mapping[str, DataFrame]

_EVERYTHING = SearchPlan(SearchQuery(Intent.RALLIES))


def name_norm(name: Column) -> Column:
    """The stored search form of a name: lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def iso(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")


def rallies(c: Catalog) -> DataFrame:
    counts = c.rally_stages.groupBy("event_id").agg(F.countDistinct("stage_id").alias("n"))
    named = c.rally_events.where(present("event_id").isNotNull() & (F.trim("event_name") != ""))
    return named.join(counts, "event_id", "left").select(
        "event_id", "event_name", name_norm(F.col("event_name")).alias("name_norm"), "country", "city",
        P.event_year(F.col("start_date"), F.col("end_date")).alias("year"),
        iso(F.col("start_date")).alias("start_date"), iso(F.col("end_date")).alias("end_date"), "status",
        F.coalesce(F.col("stages_count").cast("long"), F.col("n"), F.lit(0)).alias("stages_count"),
    )


def people(c: Catalog) -> DataFrame:
    """One record per account, or per profile without one; profiles are never merged by name.

    The shown name is the first driver name in order, else the first co-driver name.
    """
    profile = lambda t, key, role: t.select("account_id", F.col(key).alias("profile_id"), "full_name", "country", F.lit(role).alias("role"))
    both = profile(c.user_driver_profile, "driver_id", "driver").unionByName(profile(c.user_codriver_profile, "codriver_id", "co_driver"))
    both = both.where(F.col("profile_id").isNotNull() & (F.trim("full_name") != ""))
    account = present("account_id")
    key = F.coalesce(F.concat(F.lit("person:account:"), account), F.concat(F.lit("person:"), F.replace("role", F.lit("_"), F.lit("")), F.lit(":"), F.col("profile_id")))
    is_driver = F.col("role") == "driver"
    name = F.trim("full_name")
    grouped = both.groupBy(key.alias("person_id")).agg(
        F.max(F.when(is_driver, F.col("profile_id"))).alias("driver_id"),
        F.max(F.when(~is_driver, F.col("profile_id"))).alias("codriver_id"),
        F.min(F.when(is_driver, name)).alias("driver_name"), F.min(F.when(~is_driver, name)).alias("codriver_name"),
        F.array_sort(F.collect_set(name)).alias("searchable_names"), F.max(account).alias("account_id"), F.min("country").alias("country"),
    )
    role = F.when(F.col("driver_id").isNotNull() & F.col("codriver_id").isNotNull(), "both").when(F.col("driver_id").isNotNull(), "driver").otherwise("co_driver")
    shown = F.coalesce("driver_name", "codriver_name")
    return grouped.select("person_id", shown.alias("display_name"), name_norm(shown).alias("name_norm"), "searchable_names", role.alias("role"), "driver_id", "codriver_id", "account_id", "country")


def stages(c: Catalog) -> DataFrame:
    named = c.rally_stages.where(F.trim("stage_name") != "")
    return named.select("stage_id", "event_id", "stage_name", name_norm(F.col("stage_name")).alias("name_norm"), "stage_number")


def participation(c: Catalog) -> DataFrame:
    """One row per rally, person and role; of several names the first in order."""
    entered = entries(c).where("user_driver_id is not null or user_co_driver_id is not null").join(c.rally_sub_events, "sub_event_id")
    rows = entered.select(
        "event_id", F.coalesce("user_driver_id", "user_co_driver_id").alias("person_id"), F.col("user_driver_id").alias("driver_id"),
        F.col("user_co_driver_id").alias("codriver_id"), F.coalesce("driver_full_name", "codriver_full_name", F.lit("Competitor")).alias("driver_name"),
        role_label(F.col("user_driver_id"), F.col("user_co_driver_id")).alias("role"),
    )
    first = F.min(F.struct("driver_name", "driver_id", "codriver_id")).alias("first")
    return rows.groupBy("event_id", "person_id", "role").agg(first).select("event_id", "person_id", "first.driver_id", "first.codriver_id", "first.driver_name", "role")


def final_result_rows(c: Catalog) -> DataFrame:
    found = final_results(c, _EVERYTHING, F.col("pos_overall").isNotNull())
    return found.select("id", "event_id", "driver_id", F.coalesce("driver_full_name", "crew").alias("driver_name"), "pos_overall").distinct()


def driver_wins(c: Catalog) -> DataFrame:
    won = final_results(c, _EVERYTHING, F.col("pos_overall") == 1).withColumn("driver_name", F.coalesce("driver_full_name", "crew"))
    counts = won.groupBy("driver_id", "driver_name").agg(F.countDistinct("event_id").alias("win_count"))
    return counts.select(F.coalesce("driver_id", "driver_name").alias("person_id"), "driver_id", "driver_name", "win_count")


def uploader_stats(c: Catalog) -> DataFrame:
    counts = c.rally_videos.where("uploader_user_id is not null").groupBy(F.col("uploader_user_id").alias("uploader_id")).agg(F.count("id").alias("upload_count"))
    fans = c.user_fan_profile.select(F.col("fan_id").alias("uploader_id"), "account_id", "full_name")
    accounts = c.user_account.select(F.col("id").alias("account_id"), "user_name")
    joined = counts.join(fans, "uploader_id", "left").join(accounts, "account_id", "left")
    return joined.select("uploader_id", "account_id", display_name(F.col("user_name"), F.col("full_name")).alias("uploader_name"), "upload_count")


def _crews(c: Catalog) -> DataFrame:
    return entries(c).select("entry_id", "driver_id", "codriver_id", F.coalesce("driver_full_name", "codriver_full_name").alias("driver_name"))


def _placed(c: Catalog) -> DataFrame:
    placed = c.rally_stages.join(c.rally_events.select("event_id", "event_name", F.col("country").alias("event_country")), "event_id", "left")
    return c.rally_videos.withColumnRenamed("id", "video_id").join(placed, "stage_id", "left")


def video_meta(c: Catalog) -> DataFrame:
    moments = c.rally_video_metadata.select("video_id", F.col("entry_list_id").alias("entry_id"))
    joined = _placed(c).join(moments, "video_id").join(_crews(c), "entry_id").join(streams(c), "video_id")
    return joined.select(
        "video_id", "event_id", F.when(F.col("event_id").isNotNull(), F.col("stage_id")).alias("stage_id"), F.coalesce("driver_id", "codriver_id").alias("person_id"),
        "driver_id", "codriver_id", "driver_name", "event_name", "stage_name", "stage_number", F.col("thumbnail").alias("thumbnail_url"),
        F.col("video_url").alias("on_demand_url"), F.col("video_length_seconds").alias("length_seconds"), "created_at",
    ).distinct()


def video_actions(c: Catalog) -> DataFrame:
    actions = c.rally_video_actions.select(F.col("id").alias("action_type_id"), F.col("action_name").alias("action_type"))
    moments = c.rally_video_metadata.select("id", "video_id", F.col("action_id").alias("action_type_id"), F.col("entry_list_id").alias("entry_id"), "start_action", "end_action", "points")
    joined = moments.join(actions, "action_type_id").join(streams(c), "video_id").join(_placed(c), "video_id", "left").join(_crews(c), "entry_id", "left")
    return joined.select(
        "id", "video_id", "event_id", F.when(F.col("event_id").isNotNull(), F.col("stage_id")).alias("stage_id"), F.coalesce("driver_id", "codriver_id").alias("person_id"), "driver_id", "codriver_id",
        "action_type", "action_type_id", "driver_name", "event_name", "event_country", "stage_name", "stage_number",
        seconds(F.col("start_action")).alias("start_action"), seconds(F.col("end_action")).alias("end_action"), "points",
        F.col("thumbnail").alias("thumbnail_url"), F.col("video_url").alias("on_demand_url"),
    ).distinct()


BUILDERS: dict[str, Callable[[Catalog], DataFrame]] = {
    "rallies": rallies, "people": people, "stages": stages, "participation": participation, "final_results": final_result_rows,
    "driver_wins": driver_wins, "uploader_stats": uploader_stats, "video_meta": video_meta, "video_actions": video_actions,
}

#: What names a row of each table, for the order in which tables are hashed and deduplicated.
KEYS = {
    "rallies": ["event_id"], "people": ["person_id"], "stages": ["stage_id"], "participation": ["event_id", "person_id", "role"],
    "final_results": ["id"], "driver_wins": ["person_id"], "uploader_stats": ["uploader_id"], "video_meta": ["video_id", "person_id"], "video_actions": ["id", "person_id"],
}


def build(c: Catalog, segment: str = "full") -> dict[str, DataFrame]:
    """The tables of a segment, `core` (without videos) or `full`."""
    return {name: BUILDERS[name](c) for name in (CORE if segment == "core" else FULL)}


def version(tables: Snapshot) -> DataFrame:
    """(table, rows, hash): a fingerprint of each table that no order or layout of rows changes.

    Row hashes are added up, so tables are hashed where they lie and no sort is needed.
    """
    parts = []
    for name, frame in sorted(tables.items()):
        columns = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(frame.columns)]
        row = F.xxhash64(*columns).cast("decimal(38,0)")
        parts.append(frame.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("s")).select(F.lit(name).alias("table"), "rows", F.substring(F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("s").cast("string")), 256), 1, 16).alias("hash")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def upsert(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The last row of each key by `ordinal`; ties go to the greatest row. Map-side combined."""
    held = rows.groupBy(*key).agg(F.max(F.struct(F.col(ordinal), *[c for c in rows.columns if c not in (*key, ordinal)])).alias("row"))
    return held.select(*key, *[f"row.{c}" for c in rows.columns if c not in key])


# --- searches over the snapshot


def _rally_filters(plan: SearchPlan) -> Column:
    q = plan.query
    return P.all_of([
        P.country_filter(q, F.col("country")), P.city_filter(q, F.col("city")), P.year_filter(q, F.col("year")),
        P.rally_filter(plan, F.col("event_id"), F.col("event_name")), F.lit(False) if plan.nothing else None,
    ])


def _person(q: SearchQuery, driver_only: bool = False) -> Column | None:
    role = Role.DRIVER if driver_only else q.role
    has = lambda c, x: F.coalesce(F.col(c) == x, F.lit(False))
    ids = [P.by_role(role, has("driver_id", x), F.lit(False) if driver_only else has("codriver_id", x)) for x in q.driver_ids]
    names = [P.all_of(F.coalesce(F.lower("driver_name").contains(w), F.lit(False)) for w in x.lower().split()) for x in q.driver_names]
    return P.any_of(ids + names)


def _where(frame: DataFrame, condition: Column | None) -> DataFrame:
    return frame if condition is None else frame.where(condition)


def _scoped(frame: DataFrame, s: Snapshot, plan: SearchPlan) -> DataFrame:
    """The rows whose rally passes the filters; all rows where there are none."""
    q = plan.query
    if not (plan.nothing or plan.event_ids or q.countries or q.cities or q.years or q.year_from or q.year_to or q.rally_names or q.event_names):
        return frame
    return frame.join(s["rallies"].where(_rally_filters(plan)).select("event_id"), "event_id", "left_semi")


def _counted(frame: DataFrame, column: Column | None = None) -> DataFrame:
    return frame.agg((F.count(F.lit(1)) if column is None else F.countDistinct(column)).alias("total"))


def find_rallies(s: Snapshot, plan: SearchPlan) -> Search:
    found = s["rallies"].where(_rally_filters(plan))
    person = _person(plan.query)
    if person is not None:
        found = found.join(s["participation"].where(person).select("event_id"), "event_id", "left_semi")
    rows = found.select("event_id", "event_name", "status", "country", "city", "start_date", "end_date", "stages_count", "year")
    return Search(rows, [F.desc_nulls_last("start_date"), F.col("event_id")], _counted(found))


def find_participations(s: Snapshot, plan: SearchPlan) -> Search:
    chosen = s["rallies"].where(_rally_filters(plan)).select("event_id", "event_name", F.col("country").alias("c"), "city", "start_date")
    joined = _where(s["participation"], _person(plan.query)).join(chosen, "event_id")
    rows = joined.select(F.col("event_id").alias("rally_id"), "event_name", "person_id", "driver_name", "role", F.col("c").alias("country"), "city", "start_date")
    return Search(rows, [F.desc_nulls_last("start_date"), F.col("rally_id"), F.col("person_id"), F.col("role")], _counted(joined, F.col("event_id")))


def _classified(s: Snapshot, plan: SearchPlan, condition: str) -> DataFrame:
    chosen = s["rallies"].where(_rally_filters(plan)).select("event_id", "event_name", "start_date")
    return _where(s["final_results"].where(condition), _person(plan.query, driver_only=True)).join(chosen, "event_id")


def find_wins(s: Snapshot, plan: SearchPlan) -> Search:
    joined = _classified(s, plan, "pos_overall = 1")
    rows = joined.select("id", F.col("event_id").alias("rally_id"), "event_name", F.col("driver_id").alias("person_id"), "driver_name", "pos_overall", "start_date")
    return Search(rows, [F.desc_nulls_last("start_date"), F.col("id")], _counted(joined))


def find_finishers(s: Snapshot, plan: SearchPlan) -> Search:
    joined = _classified(s, plan, "pos_overall is not null")
    rows = joined.select("id", F.col("event_id").alias("rally_id"), "event_name", "driver_id", "driver_name", "pos_overall")
    return Search(rows, [F.col("pos_overall"), F.col("id")], _counted(joined))


def find_winner(s: Snapshot, plan: SearchPlan) -> Search:
    joined = _classified(s, plan, "pos_overall = 1")
    rows = joined.select("id", F.col("event_id").alias("rally_id"), "event_name", "driver_id", "driver_name", "pos_overall")
    return Search(rows, [F.col("pos_overall"), F.col("id")], _counted(joined.limit(1)))


def find_actions(s: Snapshot, plan: SearchPlan) -> Search:
    found = _where(_where(s["video_actions"], P.action_filter(plan.query, F.col("action_type"))), _person(plan.query))
    found = _where(_scoped(found, s, plan), P.stage_filter(plan, F.col("stage_id"), F.col("stage_name"), F.col("stage_number")))
    rows = found.select("id", "video_id", "action_type_id", "action_type", "event_name", "driver_name", "start_action", "end_action", "points", F.col("on_demand_url").alias("video_url"), "thumbnail_url", "stage_name", "stage_number", "event_country")
    return Search(rows, [F.desc("id"), F.asc_nulls_first("driver_name")], _counted(found))


def find_videos(s: Snapshot, plan: SearchPlan) -> Search:
    found = _scoped(_where(s["video_meta"], _person(plan.query)), s, plan)
    found = _where(found, P.stage_filter(plan, F.col("stage_id"), F.col("stage_name"), F.col("stage_number")))
    rows = found.select("video_id", F.col("on_demand_url").alias("video_url"), "thumbnail_url", "event_name", "stage_name", "stage_number", F.col("person_id").alias("driver_id"), "driver_name", F.col("length_seconds").alias("video_length_seconds"), "created_at")
    return Search(rows, [F.desc("video_id"), F.asc_nulls_first("driver_id")], _counted(found))


def _filtered(plan: SearchPlan) -> bool:
    q = plan.query
    return bool(plan.nothing or plan.event_ids or plan.stage_ids or q.countries or q.cities or q.years or q.year_from or q.year_to or q.rally_names or q.event_names or q.stage_names or q.stage_numbers or q.driver_ids or q.driver_names)


def find_uploaders(s: Snapshot, plan: SearchPlan) -> Search:
    """Uploaders by uploads; the snapshot counts them over all rallies, so filters are refused."""
    if _filtered(plan):
        raise QueryError("UNSUPPORTED_QUERY", "the snapshot has no uploads by rally")
    return Search(s["uploader_stats"], [F.desc("upload_count"), F.col("uploader_id")], _counted(s["uploader_stats"]))


def find_top_drivers(s: Snapshot, plan: SearchPlan) -> Search:
    """Drivers by rallies won; with filters counted from the classified rows of the chosen rallies."""
    if _filtered(plan):
        won = _classified(s, plan, "pos_overall = 1")
        rows = won.groupBy("driver_id", "driver_name").agg(F.countDistinct("event_id").alias("win_count"))
        rows = rows.select(F.coalesce("driver_id", "driver_name").alias("person_id"), "driver_id", "driver_name", "win_count")
        return Search(rows, [F.desc("win_count"), F.col("person_id")], _counted(rows))
    return Search(s["driver_wins"], [F.desc("win_count"), F.col("person_id")], _counted(s["driver_wins"]))


SEARCHES: dict[Intent, Callable[[Snapshot, SearchPlan], Search]] = {
    Intent.RALLIES: find_rallies, Intent.PARTICIPATIONS: find_participations, Intent.DRIVER_WINS: find_wins,
    Intent.RALLY_RESULTS: find_winner, Intent.TOP_FINISHERS: find_finishers, Intent.VIDEO_ACTIONS: find_actions,
    Intent.DRIVER_VIDEOS: find_videos, Intent.TOP_UPLOADERS: find_uploaders, Intent.TOP_DRIVERS: find_top_drivers,
}


def run(s: Snapshot, plan: SearchPlan) -> Search:
    """The search of a plan over a snapshot, by its intent."""
    return SEARCHES[plan.query.intent](s, plan)
