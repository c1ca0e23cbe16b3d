"""What is shown of rows and queries: durations, times, titles, summaries. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmacade.plans.query import Intent, MatchMode, SearchQuery

# How a search is announced.
TITLES = {
    Intent.RALLIES: "Searching rally events", Intent.PARTICIPATIONS: "Searching driver participations", Intent.DRIVER_WINS: "Searching driver victories",
    Intent.RALLY_RESULTS: "Getting 1st place rally winner", Intent.TOP_FINISHERS: "Getting rally leaderboard", Intent.VIDEO_ACTIONS: "Showing action highlights",
    Intent.DRIVER_VIDEOS: "Searching driver videos", Intent.TOP_UPLOADERS: "Getting top uploaders", Intent.TOP_DRIVERS: "Getting career wins leaderboard",
}
# The filters of a summary in their order.
LABELS = {"rally_names": "Rallies", "countries": "Countries", "cities": "Cities", "stage_names": "Stages", "stage_numbers": "Stage Numbers"}


def duration(seconds: Column) -> Column:
    """`12.3s` below a minute, `2m 3.4s` above, `0.0s` for nothing or less; null stays null."""
    tenth = lambda c: F.format_string("%.1f", c)
    return (
        F.when(seconds.isNull() | F.isnan(seconds), None).when(seconds <= 0, "0.0s").when(seconds < 60, F.concat(tenth(seconds), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), tenth(F.pmod(seconds, F.lit(60.0))), F.lit("s")))
    )


def clock(seconds: Column) -> Column:
    """`mm:ss`, or `h:mm:ss` from an hour on, of the whole seconds; null stays null."""
    whole = F.floor(seconds).cast("long")
    hours, two = F.floor(whole / 3600), lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    short = F.concat(two(F.floor(F.pmod(whole, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(whole, F.lit(60))))
    return F.when(whole.isNull(), None).when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), short)).otherwise(short)


def action_name(raw: Column) -> Column:
    """An action's plain name: lower case, without the suffix `_segments`."""
    return F.regexp_replace(F.lower(F.trim(raw)), "_segments$", "")


def action_title(raw: Column) -> Column:
    """`near_miss_segments` as `Near Miss`; `Action` for an empty one."""
    plain = action_name(raw)
    words = F.transform(F.split(plain, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
    return F.when(plain == "", "Action").otherwise(F.array_join(words, " "))


def vocabulary(*priorities: Column, most: int = 30) -> Column:
    """The first `most` distinct names of some arrays, the most important first, as one text."""
    names = F.array_distinct(F.filter(F.concat(*priorities), lambda n: n.isNotNull() & (F.trim(n) != "")))
    return F.array_join(F.slice(names, 1, most), ", ")


def summary(q: SearchQuery) -> str:
    """A query in words: what it searches and by which filters."""
    title = f"Showing {', '.join(q.action_types)} highlights" if q.intent is Intent.VIDEO_ACTIONS and q.action_types else TITLES[q.intent]
    parts = [f"Drivers: {(' AND ' if q.match_mode is MatchMode.ALL else ', ').join(q.driver_names)}"] if q.driver_names else []
    values = {"rally_names": (*q.rally_names, *q.event_names)}
    parts += [f"{label}: {', '.join(v)}" for f, label in LABELS.items() if (v := values.get(f, getattr(q, f)))]
    low, high = q.year_from, q.year_to
    years = ", ".join(map(str, q.years)) or (f"{low}–{high}" if low is not None and high is not None else f">= {low}" if low is not None else f"<= {high}" if high is not None else "")
    return " | ".join([title, *parts, *([f"Years: {years}"] if years else [])])
