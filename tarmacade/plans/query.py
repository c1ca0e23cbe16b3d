"""The structured query and the plan it is compiled to."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from enum import StrEnum
from typing import Any


class Intent(StrEnum):
    RALLIES = "SEARCH_RALLIES"
    PARTICIPATIONS = "SEARCH_DRIVER_RALLIES"
    DRIVER_WINS = "SEARCH_DRIVER_WINS"
    RALLY_RESULTS = "GET_RALLY_RESULTS"
    TOP_FINISHERS = "GET_RALLY_TOP_FINISHERS"
    VIDEO_ACTIONS = "SEARCH_VIDEO_ACTIONS"
    DRIVER_VIDEOS = "SEARCH_DRIVER_VIDEOS"
    TOP_UPLOADERS = "GET_TOP_UPLOADERS"
    TOP_DRIVERS = "GET_TOP_DRIVERS_BY_WINS"


class MatchMode(StrEnum):
    ANY = "ANY"
    ALL = "ALL"


class Role(StrEnum):
    ANY = "ANY"
    DRIVER = "DRIVER"
    CO_DRIVER = "CO_DRIVER"


class QueryError(ValueError):
    """A query that can't be run; `code` names the reason."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


DEFAULT_LIMIT = 20
YEARS = range(1950, 2051)

#: The plural field that a legacy singular key stands for.
_SINGULAR = {
    "country": "countries", "city": "cities", "year": "years", "rally_name": "rally_names", "event_name": "event_names",
    "stage_name": "stage_names", "stage_number": "stage_numbers", "driver_name": "driver_names",
    "driver_id": "driver_ids", "action_type": "action_types", "uploader": "uploaders",
}


@dataclass(frozen=True)
class SearchQuery:
    """What is asked: an intent and filters. Values of one filter are alternatives."""

    intent: Intent
    countries: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    rally_names: tuple[str, ...] = ()
    event_names: tuple[str, ...] = ()
    stage_names: tuple[str, ...] = ()
    stage_numbers: tuple[str, ...] = ()
    driver_names: tuple[str, ...] = ()
    driver_ids: tuple[str, ...] = ()
    action_types: tuple[str, ...] = ()
    uploaders: tuple[str, ...] = ()
    match_mode: MatchMode = MatchMode.ANY
    role: Role = Role.ANY
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    @staticmethod
    def of(values: Mapping[str, Any]) -> SearchQuery:
        """A query from a mapping with camel-case or snake-case keys, singular or plural."""
        known = {f.name for f in fields(SearchQuery)}
        renamed = {"driver_match_mode": "match_mode", "person_role": "role"}
        out: dict[str, Any] = {}
        for raw, value in values.items():
            key = re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), raw)
            key = _SINGULAR.get(renamed.get(key, key), renamed.get(key, key))
            if key not in known:
                raise QueryError("VALIDATION_ERROR", f"unknown field {raw}")
            if isinstance(SearchQuery.__dataclass_fields__[key].default, tuple):
                items = value if isinstance(value, (list, tuple, set)) else [value]
                value = (*out.get(key, ()), *items)
            out[key] = value
        return SearchQuery(**out).checked()

    def checked(self) -> SearchQuery:
        """The query with blanks dropped and types set; raises QueryError if it makes no sense."""
        try:
            intent = Intent(self.intent)
        except ValueError:
            raise QueryError("UNSUPPORTED_INTENT", f"no such intent: {self.intent}") from None
        try:
            role, mode = Role(self.role), MatchMode(self.match_mode)
        except ValueError as e:
            raise QueryError("INVALID_PERSON_ROLE", str(e)) from None
        if not isinstance(self.limit, int) or not isinstance(self.offset, int) or self.limit < 1 or self.offset < 0:
            raise QueryError("INVALID_PAGINATION", "limit must be positive and offset not negative")
        clean: dict[str, Any] = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "years":
                clean[f.name] = tuple(dict.fromkeys(_year(y) for y in value))
            elif isinstance(f.default, tuple):
                clean[f.name] = without_blanks(value)
        years = {k: None if v is None else _year(v) for k, v in (("year_from", self.year_from), ("year_to", self.year_to))}
        if None not in years.values() and years["year_from"] > years["year_to"]:
            raise QueryError("INVALID_FILTER", f"year range runs backwards: {years['year_from']} to {years['year_to']}")
        return SearchQuery(**clean, **years, intent=intent, role=role, match_mode=mode, limit=self.limit, offset=self.offset)


def without_blanks(values: Iterable[Any]) -> tuple[str, ...]:
    """The values as stripped strings, once each, without blanks and the word null."""
    stripped = (str(v).strip() for v in values if v is not None)
    return tuple(dict.fromkeys(s for s in stripped if s.lower() not in ("", "null", "none")))


def _year(value: Any) -> int:
    try:
        year = int(value)
    except (TypeError, ValueError):
        raise QueryError("INVALID_FILTER", f"no year: {value}") from None
    if year not in YEARS:
        raise QueryError("INVALID_FILTER", f"year out of range: {year}")
    return year


@dataclass(frozen=True)
class Resolution:
    """What an entity resolver made of a phrase: an id, an ambiguity or nothing."""

    phrase: str
    entity_type: str
    resolved_id: str | None = None
    ambiguous: bool = False
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class SearchPlan:
    """A query ready to run: only filters its strategy uses, and ids in place of resolved names."""

    query: SearchQuery
    event_ids: tuple[str, ...] = ()
    stage_ids: tuple[str, ...] = ()
    #: A phrase that had to name something named nothing: the result is empty.
    nothing: bool = False
    dropped: tuple[str, ...] = field(default=())


def compile_query(query: SearchQuery, resolutions: Iterable[Resolution] = ()) -> SearchPlan:
    """The plan of a query.

    Ambiguous phrases are refused, resolved ones become ids, and a phrase of any type that
    resolved to nothing empties the result instead of silently widening it. The winner intent
    asks for one row; action types are refused for anything but video actions.
    """
    from dataclasses import replace

    query = query.checked()
    if query.action_types and query.intent is not Intent.VIDEO_ACTIONS:
        raise QueryError("INVALID_FILTER", f"action types are not supported for {query.intent}")
    resolutions = list(resolutions)
    events, stages, drivers, nothing, dropped = [], [], list(query.driver_ids), False, []
    for r in resolutions:
        if r.ambiguous:
            raise QueryError("INVALID_FILTER", f"ambiguous: {r.phrase}")
        if r.resolved_id is None:
            dropped.append(r.phrase)
            nothing = True
        else:
            {"rally": events, "stage": stages, "person": drivers}[r.entity_type].append(r.resolved_id)
    done = {r.phrase for r in resolutions}
    keep = lambda names: tuple(n for n in names if n not in done)
    query = replace(
        query,
        rally_names=keep(query.rally_names), stage_names=keep(query.stage_names), driver_names=keep(query.driver_names),
        driver_ids=tuple(dict.fromkeys(drivers)),
    )
    if query.intent is Intent.RALLY_RESULTS:
        query = replace(query, limit=1, offset=0)
    return SearchPlan(query, tuple(events), tuple(stages), nothing, tuple(dropped))
