"""The nine searches over the operational tables.

Each strategy builds one lazy frame of all its rows and one of its total; `page` sorts by a total
order and cuts the page. Filters sit on the narrow tables before joins, so they reach the scans;
what only adds columns to a row (stage counts) is joined to the page, not to all rows. Join sides
are left to the optimizer, which broadcasts those that are small at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmacade.operators import filters as P
from tarmacade.plans.query import Intent, MatchMode, SearchPlan
from tarmacade.session import cut_lineage
from tarmacade.sources.projection import Catalog


@dataclass(frozen=True)
class Search:
    """All rows of a search, the order of its pages, and its total as a frame of one row."""

    rows: DataFrame
    order: list[Column]
    total: DataFrame
    #: Adds columns that the order doesn't need, one row for each row.
    finish: Callable[[DataFrame], DataFrame] | None = None


def page(search: Search, plan: SearchPlan) -> DataFrame:
    """The page that the plan asks for."""
    cut = search.rows.orderBy(*search.order).offset(plan.query.offset).limit(plan.query.limit)
    return search.finish(cut).orderBy(*search.order) if search.finish else cut


def page_with_total(search: Search, plan: SearchPlan, key: str) -> DataFrame:
    """The page with `total`, the number of distinct `key` over all rows.

    The joins of the search run once: its rows are written down, and page and total read them.
    """
    rows = cut_lineage(search.rows)
    total = rows.agg(F.countDistinct(key).alias("total"))
    return page(Search(rows, search.order, search.total, search.finish), plan).withColumn("total", total.scalar())


def _total(column: Column) -> list[Column]:
    return [F.countDistinct(column).alias("total")]


def entries(c: Catalog) -> DataFrame:
    """Entries with their driver and co-driver profiles, where they have them."""
    driver = c.user_driver_profile.select("driver_id", F.col("full_name").alias("driver_full_name"), F.col("nick_name").alias("driver_nick_name"))
    codriver = c.user_codriver_profile.select("codriver_id", F.col("full_name").alias("codriver_full_name"), F.col("nick_name").alias("codriver_nick_name"))
    return (
        c.rally_entry_list.withColumnRenamed("id", "entry_id")
        .join(driver, F.col("user_driver_id") == F.col("driver_id"), "left")
        .join(codriver, F.col("user_co_driver_id") == F.col("codriver_id"), "left")
    )


def events(c: Catalog, plan: SearchPlan) -> DataFrame:
    return c.rally_events.where(P.event_filters(plan))


def rallies(c: Catalog, plan: SearchPlan) -> Search:
    """Rallies, newest first, optionally those with any or with all of some people."""
    found = events(c, plan)
    people = P.people_filters(plan.query)
    if people:
        conditions = people if plan.query.match_mode is MatchMode.ALL else [P.any_of(people)]
        entered = entries(c).join(c.rally_sub_events, "sub_event_id")
        for condition in conditions:
            found = found.join(entered.where(condition).select("event_id"), "event_id", "left_semi")
    rows = found.select("event_id", "event_name", "status", "country", "city", "start_date", "end_date", F.col("stages_count").cast("long").alias("stages_count"))

    def counted(shown: DataFrame) -> DataFrame:
        unknown = shown.where("stages_count is null").select("event_id")
        counts = c.rally_stages.join(unknown, "event_id", "left_semi").groupBy("event_id").agg(F.countDistinct("stage_id").alias("n_stages"))
        return shown.join(counts, "event_id", "left").withColumn("stages_count", F.coalesce("stages_count", "n_stages", F.lit(0))).drop("n_stages")

    return Search(rows, [F.desc_nulls_last("start_date"), F.col("event_id")], found.agg(*_total(F.col("event_id"))), counted)


def role_label(driver: Column, codriver: Column) -> Column:
    return F.when(driver.isNotNull() & codriver.isNotNull(), "Driver / Co-Driver").when(codriver.isNotNull(), "Co-Driver").otherwise("Driver")


def participations(c: Catalog, plan: SearchPlan) -> Search:
    """Who entered which rally in which role; the total counts rallies."""
    joined = entries(c).join(c.rally_sub_events, "sub_event_id").join(events(c, plan), "event_id")
    person = P.any_of(P.people_filters(plan.query))
    joined = joined.where(person) if person is not None else joined
    rows = joined.select(
        F.col("event_id").alias("rally_id"), "event_name", F.coalesce("driver_id", "codriver_id").alias("person_id"),
        F.coalesce("driver_full_name", "codriver_full_name", F.lit("Competitor")).alias("driver_name"),
        role_label(F.col("driver_id"), F.col("codriver_id")).alias("role"), "start_date",
    ).distinct()
    order = [F.desc_nulls_last("start_date"), F.col("rally_id"), F.asc_nulls_first("person_id"), F.col("driver_name"), F.col("role")]
    return Search(rows, order, joined.agg(*_total(F.col("event_id"))))


def final_stages(c: Catalog, chosen: DataFrame | None = None) -> DataFrame:
    """(event_id, final_number): the highest stage number that has results, per rally.

    Results are reduced to the stages they have before anything is joined; with `chosen` rallies
    (event_id) only theirs are looked at.
    """
    classified = c.rally_results.select("stage_id", F.col("rally_id").alias("event_id"))
    numbered = c.rally_stages.where("stage_number is not null").select("stage_id", "event_id", P.stage_number(F.col("stage_number")).alias("number"))
    if chosen is not None:
        numbered = numbered.join(chosen, "event_id", "left_semi")
    return numbered.join(classified, ["stage_id", "event_id"], "left_semi").groupBy("event_id").agg(F.max("number").alias("final_number"))


def final_results(c: Catalog, plan: SearchPlan, condition: Column) -> DataFrame:
    """Results of each rally's last classified stage, with rally and driver.

    The rallies are chosen first, so that stages and results of others are never shuffled.
    """
    chosen = events(c, plan).select("event_id", "event_name")
    filtered = not _everywhere(plan)
    only = chosen.select("event_id") if filtered else None
    stages = c.rally_stages.select("stage_id", "event_id", P.stage_number(F.col("stage_number")).alias("number"))
    last = stages.join(final_stages(c, only), "event_id").where(F.col("number") == F.col("final_number")).select("stage_id", "event_id")
    last = last.join(chosen, "event_id")
    drivers = c.user_driver_profile.select("driver_id", F.col("full_name").alias("driver_full_name"), F.col("nick_name").alias("driver_nick_name"))
    entered = c.rally_entry_list.select(F.col("id").alias("entry_list_id"), "user_driver_id")
    person = P.classified_filter(plan.query)
    joined = (
        c.rally_results.where(condition).withColumnRenamed("rally_id", "event_id")
        .join(last, ["stage_id", "event_id"])
        .join(entered, "entry_list_id", "left")
        .join(drivers, F.col("user_driver_id") == F.col("driver_id"), "left")
    )
    return joined.where(person) if person is not None else joined


WON, CLASSIFIED = "pos_overall = 1", "pos_overall is not null"


def top_finishers(c: Catalog, plan: SearchPlan, condition: str = CLASSIFIED) -> Search:
    joined = final_results(c, plan, F.expr(condition))
    rows = joined.select(
        "id", F.col("event_id").alias("rally_id"), "event_name", "driver_id",
        F.coalesce("driver_full_name", "crew").alias("driver_name"), "pos_overall",
    ).distinct()
    return Search(rows, [F.col("pos_overall"), F.col("id")], joined.agg(*_total(F.col("id"))))


def rally_winner(c: Catalog, plan: SearchPlan) -> Search:
    """The winner; the total is the number of rows, 0 or 1."""
    found = top_finishers(c, plan, WON)
    return Search(found.rows, found.order, found.rows.limit(1).agg(F.count(F.lit(1)).alias("total")))


def driver_wins(c: Catalog, plan: SearchPlan) -> Search:
    found = top_finishers(c, plan, WON)
    rows = found.rows.select("id", "rally_id", "event_name", F.col("driver_id").alias("person_id"), "driver_name", "pos_overall")
    return Search(rows, found.order, found.total)


def seconds(time: Column) -> Column:
    """A duration text as seconds: a plain number, `mm:ss` or `hh:mm:ss`; null if it is none."""
    parts = F.reverse(F.split(F.trim(time), ":"))
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    readable = F.trim(time).rlike(r"^\d+(:\d{1,2}){0,2}(\.\d+)?$")
    return F.when(readable, part(1) + part(2) * 60 + part(3) * 3600)


def streams(c: Catalog, wanted: DataFrame | None = None) -> DataFrame:
    """(video_id, stream_id, video_url): the first playable stream of each (wanted) video."""
    shown = c.rally_streams.where(P.playable(F.col("on_demand_url"), F.col("video_type")))
    shown = shown if wanted is None else shown.join(wanted, "video_id", "left_semi")
    return shown.groupBy("video_id").agg(F.min("id").alias("stream_id"), F.min("on_demand_url").alias("video_url"))


def placed_videos(c: Catalog, plan: SearchPlan) -> DataFrame:
    """Videos with their stage and rally where known; rally and stage filters need them."""
    stages = c.rally_stages.select("stage_id", "event_id", "stage_name", "stage_number")
    stage_wanted = P.stage_filter(plan, F.col("stage_id"), F.col("stage_name"), F.col("stage_number"))
    placed = stages.join(c.rally_events.drop("status", "stages_count"), "event_id", "left")
    videos = c.rally_videos.withColumnRenamed("id", "video_id").join(placed, "stage_id", "left").where(P.event_filters(plan))
    return videos.where(stage_wanted) if stage_wanted is not None else videos


def video_actions(c: Catalog, plan: SearchPlan) -> Search:
    actions = c.rally_video_actions.select(F.col("id").alias("action_type_id"), F.col("action_name").alias("action_type"))
    wanted = P.action_filter(plan.query, F.col("action_type"))
    actions = actions.where(wanted) if wanted is not None else actions
    moments = c.rally_video_metadata.withColumnRenamed("action_id", "action_type_id").withColumnRenamed("entry_list_id", "entry_id")
    # Action, place and person decide which moments are left; streams come last, for those only.
    person = P.any_of(P.people_filters(plan.query))
    joined = moments.join(actions, "action_type_id").join(placed_videos(c, plan), "video_id", "left" if _unfiltered(plan) else "inner")
    joined = joined.join(entries(c), "entry_id", "left") if person is None else joined.join(entries(c).where(person), "entry_id")
    joined = joined.join(streams(c), "video_id")
    rows = joined.select(
        "id", "video_id", "stream_id", "video_url", "action_type_id", "action_type",
        seconds(F.col("start_action")).alias("start_action"), seconds(F.col("end_action")).alias("end_action"), "points",
        F.col("thumbnail").alias("thumbnail_url"), "stage_name", "stage_number", "event_name",
        F.col("country").alias("event_country"), F.coalesce("driver_full_name", "codriver_full_name").alias("driver_name"),
    ).distinct()
    return Search(rows, [F.desc("id"), F.asc_nulls_first("driver_name")], joined.agg(*_total(F.col("id"))))


def _everywhere(plan: SearchPlan) -> bool:
    """Whether no filter chooses rallies."""
    q = plan.query
    return not (plan.nothing or plan.event_ids or q.countries or q.cities or q.years or q.year_from or q.year_to or q.rally_names or q.event_names)


def _unfiltered(plan: SearchPlan) -> bool:
    q = plan.query
    return _everywhere(plan) and not (plan.stage_ids or q.stage_names or q.stage_numbers)


def driver_videos(c: Catalog, plan: SearchPlan) -> Search:
    """Videos with a known crew, one row per video and person."""
    moments = c.rally_video_metadata.select("video_id", F.col("entry_list_id").alias("entry_id"))
    person = P.any_of(P.people_filters(plan.query))
    crews = entries(c) if person is None else entries(c).where(person)
    joined = placed_videos(c, plan).join(moments, "video_id").join(crews, "entry_id").join(streams(c), "video_id")
    rows = joined.select(
        "video_id", "stream_id", "video_url", F.col("thumbnail").alias("thumbnail_url"), "event_name", "stage_name", "stage_number",
        F.coalesce("driver_id", "codriver_id").alias("driver_id"), F.coalesce("driver_full_name", "codriver_full_name").alias("driver_name"),
        "video_length_seconds", "created_at",
    ).distinct()
    return Search(rows, [F.desc("video_id"), F.asc_nulls_first("driver_id")], joined.agg(*_total(F.col("video_id"))))


def display_name(*names: Column) -> Column:
    """The first name that is not blank; never an address, which is private."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names], F.lit("Rally Contributor"))


def top_uploaders(c: Catalog, plan: SearchPlan) -> Search:
    """Uploaders by their number of videos. Counts come before the joins with profiles."""
    videos = (c.rally_videos.withColumnRenamed("id", "video_id") if _unfiltered(plan) else placed_videos(c, plan)).where("uploader_user_id is not null")
    counts = videos.groupBy("uploader_user_id").agg(F.count("video_id").alias("upload_count"))
    fans = c.user_fan_profile.select(F.col("fan_id").alias("uploader_user_id"), "account_id", "full_name")
    accounts = c.user_account.select(F.col("id").alias("account_id"), "user_name")
    rows = counts.join(fans, "uploader_user_id", "left").join(accounts, "account_id", "left").select(
        F.col("uploader_user_id").alias("uploader_id"), "account_id", display_name(F.col("user_name"), F.col("full_name")).alias("uploader_name"), "upload_count"
    )
    return Search(rows, [F.desc("upload_count"), F.col("uploader_id")], counts.agg(F.count(F.lit(1)).alias("total")))


def top_drivers(c: Catalog, plan: SearchPlan) -> Search:
    """Drivers by the number of rallies won; crews without a profile count under their crew name."""
    won = final_results(c, plan, F.expr(WON)).withColumn("driver_name", F.coalesce("driver_full_name", "crew"))
    rows = won.groupBy("driver_id", "driver_name").agg(F.countDistinct("event_id").alias("win_count"))
    rows = rows.select("driver_id", "driver_name", F.coalesce("driver_id", "driver_name").alias("person_id"), "win_count")
    return Search(rows, [F.desc("win_count"), F.col("person_id")], won.agg(*_total(F.coalesce("driver_id", "crew"))))


STRATEGIES: dict[Intent, Callable[[Catalog, SearchPlan], Search]] = {
    Intent.RALLIES: rallies,
    Intent.PARTICIPATIONS: participations,
    Intent.DRIVER_WINS: driver_wins,
    Intent.RALLY_RESULTS: rally_winner,
    Intent.TOP_FINISHERS: top_finishers,
    Intent.VIDEO_ACTIONS: video_actions,
    Intent.DRIVER_VIDEOS: driver_videos,
    Intent.TOP_UPLOADERS: top_uploaders,
    Intent.TOP_DRIVERS: top_drivers,
}


def run(c: Catalog, plan: SearchPlan) -> Search:
    """The search of a plan, by its intent."""
    return STRATEGIES[plan.query.intent](c, plan)


def has_more(plan: SearchPlan, returned: int, total: int) -> bool:
    return plan.query.offset + returned < total
