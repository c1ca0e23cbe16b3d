"""Predicates of the structured query: alternatives within a filter, all filters together.

Every function returns a boolean Column, or None where the filter is not set. Text is matched
literally: `%` and `_` in a filter stand for themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmacade.functions.clean import leading_number
from tarmacade.functions.countries import CODES
from tarmacade.plans.query import Role, SearchPlan, SearchQuery


def any_of(conditions: Iterable[Column]) -> Column | None:
    found = list(conditions)
    return reduce(lambda a, b: a | b, found) if found else None


def all_of(conditions: Iterable[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def country_spellings(country: str) -> list[str]:
    """All spellings of a country in lower case, itself if it is not listed."""
    code = CODES.get(country.strip().upper())
    same = [s.lower() for s, c in CODES.items() if c == code] if code else []
    return same or [country.strip().lower()]


def country_filter(q: SearchQuery, country: Column) -> Column | None:
    """Any spelling of the country, or, for names of three letters and more, a part of the text."""
    wanted = [c for c in q.countries if c.upper() != "ALL"]
    exact = sorted({s for c in wanted for s in country_spellings(c)})
    parts = [F.lower(country).contains(c.lower()) for c in wanted if len(c) > 2]
    return any_of(([F.lower(country).isin(exact)] if exact else []) + parts)


def city_filter(q: SearchQuery, city: Column) -> Column | None:
    return any_of(F.lower(city).contains(c.lower()) for c in q.cities if c.upper() != "ALL")


def event_year(start: Column, end: Column) -> Column:
    return F.coalesce(F.year(start), F.year(end))


def year_filter(q: SearchQuery, year: Column) -> Column | None:
    """One of the years, or within the range, which may be open at either end."""
    found = [year.isin(*q.years)] if q.years else []
    if q.year_from is not None and q.year_to is not None:
        found.append(year.between(q.year_from, q.year_to))
    elif q.year_from is not None:
        found.append(year >= q.year_from)
    elif q.year_to is not None:
        found.append(year <= q.year_to)
    return any_of(found)


def rally_filter(plan: SearchPlan, event_id: Column, event_name: Column) -> Column | None:
    q = plan.query
    named = [F.lower(event_name).contains(x.lower()) | (event_id == x.lower()) for x in (*q.rally_names, *q.event_names)]
    return any_of(named + ([event_id.isin(*plan.event_ids)] if plan.event_ids else []))


def stage_filter(plan: SearchPlan, stage_id: Column, name: Column, number: Column) -> Column | None:
    """Both the name and the number filter; a number also matches `stage <n>` within the name."""
    q = plan.query
    bare = [n.lower().replace("ss", "").strip() for n in q.stage_numbers]
    names = any_of([F.lower(name).contains(x.lower()) for x in q.stage_names] + ([stage_id.isin(*plan.stage_ids)] if plan.stage_ids else []))
    numbers = any_of((number == n) | F.lower(name).contains(f"stage {n}") for n in bare)
    return all_of([names, numbers]) if names is not None or numbers is not None else None


def action_filter(q: SearchQuery, action: Column) -> Column | None:
    """An action with or without the suffix `_segments`; blanks in its name count as `_`."""
    plain = [a.lower().removesuffix("_segments").replace(" ", "_") for a in q.action_types]
    return action.isin(*plain, *[f"{a}_segments" for a in plain]) if plain else None


def by_role(role: Role, driver: Column, codriver: Column) -> Column:
    return driver if role is Role.DRIVER else codriver if role is Role.CO_DRIVER else driver | codriver


def people_filters(q: SearchQuery) -> list[Column]:
    """One condition per person, on entries joined with both profiles.

    By id: the profile's or the entry's. By name: all words of it in the full name, or the whole
    in the nickname or the link.
    """
    c = F.col
    found = [
        by_role(q.role, (c("driver_id") == x) | (c("user_driver_id") == x), (c("codriver_id") == x) | (c("user_co_driver_id") == x))
        for x in q.driver_ids
    ]

    def named(x: str, full: str, nick: str, link: str) -> Column:
        words = all_of(F.lower(c(full)).contains(w) for w in x.lower().split())
        return words | F.lower(c(nick)).contains(x.lower()) | F.lower(c(link)).contains(x.lower())

    found += [
        by_role(q.role, named(x, "driver_full_name", "driver_nick_name", "driver_link"), named(x, "codriver_full_name", "codriver_nick_name", "co_driver_link"))
        for x in q.driver_names
    ]
    # A condition on absent values is unknown; among alternatives it must count as false.
    return [F.coalesce(x, F.lit(False)) for x in found]


def classified_filter(q: SearchQuery) -> Column | None:
    """Classified drivers only: by id, or by full name, nickname or crew."""
    c, has = F.col, lambda column, x: F.coalesce(F.lower(F.col(column)).contains(x.lower()), F.lit(False))
    ids = [(c("driver_id") == x) | (c("user_driver_id") == x) for x in q.driver_ids]
    names = [has("driver_full_name", x) | has("driver_nick_name", x) | has("crew", x) for x in q.driver_names]
    return any_of(ids + names)


def event_filters(plan: SearchPlan, prefix: Callable[[str], Column] = F.col) -> Column:
    """The filters on rallies: country, city, year and name or id."""
    q = plan.query
    return all_of([
        country_filter(q, prefix("country")), city_filter(q, prefix("city")),
        year_filter(q, event_year(prefix("start_date"), prefix("end_date"))),
        rally_filter(plan, prefix("event_id"), prefix("event_name")),
        F.lit(False) if plan.nothing else None,
    ])


def playable(url: Column, kind: Column) -> Column:
    """A stream that can be shown: it has an address and is no instant replay."""
    return (url != "") & (kind.isNull() | (kind != "instantReplay"))


def stage_number(number: Column) -> Column:
    """A stage number as an int: its leading digits, 0 if there are none, null for null."""
    return F.when(number.isNotNull(), leading_number(number))
