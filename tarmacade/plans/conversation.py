"""Turns of a conversation: filters edited one by one, what earlier answers refer to, recoveries.

A turn's query is completed in a fixed order by `completed`; every step only adds what the text
or the conversation says, and names what it added.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmacade.functions.countries import CODES
from tarmacade.plans.parser import ACTIONS
from tarmacade.plans.query import Intent, QueryError, Role, SearchQuery


@dataclass(frozen=True)
class Referents:
    """What `it`, `he` or `there` mean: the last rally, driver, stage and winner, with ids where known."""

    rally: str | None = None
    rally_id: str | None = None
    rallies: tuple[str, ...] = ()
    driver: str | None = None
    driver_id: str | None = None
    role: Role | None = None
    stage: str | None = None
    winner: str | None = None
    winner_id: str | None = None


# --- editing filters

#: The field behind each name of a filter, and the referents that go with its values.
_FILTERS = {
    "country": "countries", "city": "cities", "year": "years", "rally": "rally_names", "driver": "driver_names",
    "action": "action_types", "stage": "stage_names",
}
_NAMED = {"rally_names": ("rally",), "driver_names": ("driver", "winner"), "stage_names": ("stage",)}


def _field(name: str) -> str:
    plain = name.lower().replace("_", "")
    for one, field in _FILTERS.items():
        if plain in (one, field.replace("_", ""), field.split("_")[0], f"{one}s", f"{one}name", "rallies" if one == "rally" else one):
            return field
    raise QueryError("INVALID_FILTER", f"no such filter: {name}")


def with_filter(query: SearchQuery, name: str, value: Any) -> SearchQuery:
    """The query with one more value of a filter, unless it has it in any case of letters.

    An action makes it a search for video actions. Blank values change nothing.
    """
    field, text = _field(name), "" if value is None else str(value).strip()
    held = getattr(query, field)
    if not text or text.lower() in (str(x).lower() for x in held):
        return query
    if field == "years":
        return replace(query, years=(*held, int(text))).checked() if text.isdigit() else query
    if field == "action_types":
        return replace(query, action_types=(*held, text.lower()), intent=Intent.VIDEO_ACTIONS)
    return replace(query, **{field: (*held, text)})


def without_filter(query: SearchQuery, referents: Referents, name: str, value: Any) -> tuple[SearchQuery, Referents]:
    """The query without a value of a filter, and the referents without what that value named."""
    field, text = _field(name), "" if value is None else str(value).strip().lower()
    query = replace(query, **{field: tuple(x for x in getattr(query, field) if str(x).lower() != text)})
    slots = _NAMED.get(field, ())
    if any((getattr(referents, s) or "").lower() == text for s in slots):
        gone = {k: None for s in slots for k in (s, f"{s}_id") if k in Referents.__dataclass_fields__}
        referents = replace(referents, **gone)
    return query, referents


# --- what answers refer to


def _one(rows: Sequence[Mapping[str, Any]], key: str) -> Any:
    """The only value of a column over some rows, None if there is none or more than one."""
    seen = {r.get(key) for r in rows} - {None, ""}
    return seen.pop() if len(seen) == 1 else None


def referents_after(query: SearchQuery, rows: Sequence[Mapping[str, Any]], before: Referents = Referents(), ids: Mapping[str, str] | None = None) -> Referents:
    """The referents after an answer of one page.

    Names in the query come first; a new driver without an id (`ids` maps names to ids) drops the
    old one. Then, if there are rows: winners and finishers set all from the first row, rallies
    are listed and set if there is one, participations and wins fill an unset driver and set a
    single rally, videos set what is the same on the whole page, the leaderboard of drivers
    sets winner and driver, that of uploaders nothing.
    """
    ids, now = ids or {}, before
    if query.role is not Role.ANY:
        now = replace(now, role=query.role)
    if names := (*query.rally_names, *query.event_names):
        now = replace(now, rally=names[0], rallies=tuple(dict.fromkeys(names)), rally_id=ids.get(names[0], now.rally_id if now.rally == names[0] else None))
    if query.driver_names:
        now = replace(now, driver=query.driver_names[0], driver_id=ids.get(query.driver_names[0]))
    if query.stage_names:
        now = replace(now, stage=query.stage_names[0])
    if not rows:
        return now
    first, only = rows[0], rows[0] if len(rows) == 1 else {}
    match query.intent:
        case Intent.RALLY_RESULTS | Intent.TOP_FINISHERS:
            now = replace(now, winner=first.get("driver_name"), winner_id=first.get("driver_id"), driver=first.get("driver_name"), driver_id=first.get("driver_id"), rally=first.get("event_name"), rally_id=first.get("rally_id"))
        case Intent.RALLIES:
            now = replace(now, rallies=tuple(r["event_name"] for r in rows if r.get("event_name")))
            now = replace(now, rally=only["event_name"], rally_id=only.get("event_id")) if only else now
        case Intent.PARTICIPATIONS | Intent.DRIVER_WINS:
            now = now if now.driver else replace(now, driver=first.get("driver_name"), driver_id=first.get("person_id"))
            now = replace(now, rally=only.get("event_name"), rally_id=only.get("rally_id")) if only else now
        case Intent.VIDEO_ACTIONS:
            now = replace(now, driver=_one(rows, "driver_name") or now.driver, rally=_one(rows, "event_name") or now.rally)
        case Intent.DRIVER_VIDEOS:
            now = replace(now, driver=_one(rows, "driver_name") or now.driver, driver_id=_one(rows, "driver_id") or now.driver_id)
        case Intent.TOP_DRIVERS:
            now = replace(now, winner=first.get("driver_name"), winner_id=first.get("driver_id"), driver=first.get("driver_name"), driver_id=first.get("driver_id"))
    return now


def page_referents(pages: DataFrame, page: str, order: list[Column], *names: str) -> DataFrame:
    """(page, n, first_<name>..., only_<name>...) over many pages: the first row's values and those
    that a whole page shares (null if there are several)."""
    values = F.struct(*names)
    first = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], values.alias("v")))
    shared = [F.when(F.countDistinct(n) == 1, F.max(n)).alias(f"only_{n}") for n in names]
    found = pages.groupBy(page).agg(F.count(F.lit(1)).alias("n"), first.alias("first"), *shared)
    return found.select(page, "n", *[F.col(f"first.v.{n}").alias(f"first_{n}") for n in names], *[f"only_{n}" for n in names])


# --- recoveries of one turn

# Words that ask for videos.
VIDEO_CUES = frozenset("video videos footage clip clips highlight highlights moment moments".split())
_ACTION_FORMS = {form: a for a in ACTIONS if " " not in a for form in (a, f"{a}s", f"{a}es", f"{a}ing", f"{a}ed", f"{a}{a[-1]}ing")}
_COUNTRIES = {name.lower(): name.lower() for name in CODES if len(name) > 3}
_YEAR = re.compile(r"(?<!\d)(?:19|20)\d{2}(?!\d)")
_OF_RALLY = (Intent.RALLY_RESULTS, Intent.TOP_FINISHERS)
_OF_DRIVER = (Intent.PARTICIPATIONS, Intent.DRIVER_WINS, Intent.DRIVER_VIDEOS)
#: A text of at most so many words that filters nothing is taken for a rally's name.
SHORT_TEXT = 4


def _phrases(query: SearchQuery) -> str:
    return " ".join((*query.rally_names, *query.event_names, *query.driver_names, *query.stage_names)).lower()


def rescued(query: SearchQuery, text: str) -> SearchQuery:
    """A short text without any filter asks for the rally it names."""
    filters = ("countries", "cities", "years", "rally_names", "event_names", "stage_names", "stage_numbers", "driver_names", "driver_ids", "action_types", "uploaders")
    bare = not any(getattr(query, f) for f in filters) and query.year_from is None and query.year_to is None
    short = 0 < len(text.split()) <= SHORT_TEXT
    return replace(query, rally_names=(text.strip(),)) if bare and short and query.intent is Intent.RALLIES else query


def grounded_filters(query: SearchQuery, text: str) -> SearchQuery:
    """Countries that the text names in full and, for a query without any time, its years; none
    that is part of an entity's name."""
    inside, lower = _phrases(query), text.lower()
    held = {c.lower() for c in query.countries}
    found = [n for n in sorted(_COUNTRIES, key=len, reverse=True) if re.search(rf"\b{re.escape(n)}\b", lower) and n not in inside and n not in held]
    query = replace(query, countries=(*query.countries, *found)) if found else query
    if query.years or query.year_from is not None or query.year_to is not None:
        return query
    years = tuple(dict.fromkeys(int(y) for y in _YEAR.findall(text) if y not in inside))
    return replace(query, years=years) if years else query


def video_intent(query: SearchQuery, text: str, referents: Referents) -> SearchQuery:
    """A search for rallies that speaks of videos or actions of one rally is a search for video actions."""
    words = re.findall(r"[a-z]+", text.lower())
    actions = tuple(dict.fromkeys(_ACTION_FORMS[w] for w in words if w in _ACTION_FORMS))
    cued = actions or VIDEO_CUES & set(words) or query.action_types
    names = query.rally_names or query.event_names or ((referents.rally,) if referents.rally else ())
    if query.intent is not Intent.RALLIES or not cued or not names:
        return query
    kept = query.rally_names or (() if query.event_names else names)
    return replace(query, intent=Intent.VIDEO_ACTIONS, action_types=query.action_types or actions, rally_names=kept)


def referred(query: SearchQuery, referents: Referents) -> SearchQuery:
    """A query that lacks its subject takes the referent of the same type; the driver before the last winner."""
    if query.intent in _OF_RALLY and not (query.rally_names or query.event_names or query.stage_names) and referents.rally:
        return replace(query, rally_names=(referents.rally,))
    who = referents.driver or referents.winner
    if query.intent in _OF_DRIVER and not (query.driver_names or query.driver_ids) and who:
        return replace(query, driver_names=(who,))
    return query


def missing_subject(query: SearchQuery) -> str | None:
    """`rally` or `driver` if the query can't be run without one."""
    if query.intent in _OF_RALLY and not (query.rally_names or query.event_names or query.stage_names):
        return "rally"
    return "driver" if query.intent in _OF_DRIVER and not (query.driver_names or query.driver_ids) else None


def committed(query: SearchQuery, referents: Referents) -> SearchQuery:
    """The query with the ids of referents in place of their names, so that they aren't looked up again."""
    names, ids = query.driver_names, query.driver_ids
    for name, held in ((referents.driver, referents.driver_id), (referents.winner, referents.winner_id)):
        if name and held and name.lower() in (n.lower() for n in names):
            names, ids = tuple(n for n in names if n.lower() != name.lower()), tuple(dict.fromkeys((*ids, held)))
    return replace(query, driver_names=names, driver_ids=ids)


@dataclass(frozen=True)
class Completed:
    """A turn's query after all recoveries, the steps that changed it, and the subject it lacks."""

    query: SearchQuery
    steps: tuple[str, ...]
    missing: str | None


def completed(query: SearchQuery, text: str, referents: Referents = Referents(), active: SearchQuery | None = None) -> Completed:
    """A query read from a text, completed: ungrounded years go, then what the text and the
    conversation ground is added, in this order."""
    from tarmacade.plans.parser import grounded

    steps = []
    for name, step in (
        ("years", lambda q: grounded(q, text, active)), ("rescue", lambda q: rescued(q, text)), ("filters", lambda q: grounded_filters(q, text)),
        ("video", lambda q: video_intent(q, text, referents)), ("referent", lambda q: referred(q, referents)), ("ids", lambda q: committed(q, referents)),
    ):
        after = step(query)
        steps += [name] if after != query else []
        query = after
    return Completed(query, tuple(steps), missing_subject(query))


# --- questions back


@dataclass(frozen=True)
class Clarification:
    """A question back: which of some entities (id, name) a phrase of one type means."""

    entity_type: str
    phrase: str
    options: tuple[tuple[str, str], ...]
    generation: int


def chosen(query: SearchQuery, asked: Clarification, option_id: str, generation: int) -> tuple[SearchQuery, dict[str, tuple[str, ...]]]:
    """The query and ids (by type) after a choice: the phrase is gone, the chosen id takes its place.

    A choice for an older generation, or one that was not offered, is refused.
    """
    if generation != asked.generation:
        raise QueryError("VALIDATION_ERROR", "the question has been overtaken")
    if option_id not in (i for i, _ in asked.options):
        raise QueryError("VALIDATION_ERROR", f"not offered: {option_id}")
    fields = {"rally": ("rally_names", "event_names"), "stage": ("stage_names",), "person": ("driver_names",)}[asked.entity_type]
    query = replace(query, **{f: tuple(x for x in getattr(query, f) if x.lower() != asked.phrase.lower()) for f in fields})
    if asked.entity_type == "person":
        query = replace(query, driver_ids=tuple(dict.fromkeys((*query.driver_ids, option_id))))
    return query, {asked.entity_type: (option_id,)}
