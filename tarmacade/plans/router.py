"""What each intent may search for, and how a question's words are spread over its fields.

Words of a question that neither its fields nor common language explain are the residual; it is
an entity nobody has filed yet, whose type follows from words beside it or from the intent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmacade.plans.parser import ACTIONS, SMALL, residual_type
from tarmacade.plans.query import Intent, SearchQuery


@dataclass(frozen=True)
class Capability:
    """The entity an intent is about, those that filter it, and the types a phrase may turn out to be."""

    primary: str | None
    filters: frozenset[str]
    recovers: tuple[tuple[str, str], ...] = ()


def _can(primary: str | None, filters: str, recovers: str = "") -> Capability:
    return Capability(primary, frozenset(filters.split()), tuple((a, b) for a, b in (x.split(">") for x in recovers.split())))


# Per intent the primary entity, filters, and recoveries from one type to another.
CAPABILITIES = {
    Intent.RALLIES: _can("rally", "stage person uploader", "stage>rally person>person"),
    Intent.PARTICIPATIONS: _can("person", "rally stage", "rally>person"),
    Intent.DRIVER_WINS: _can("person", "rally stage", "rally>person"),
    Intent.RALLY_RESULTS: _can("rally", "stage"),
    Intent.TOP_FINISHERS: _can("rally", "stage"),
    Intent.VIDEO_ACTIONS: _can(None, "rally person stage uploader", "stage>rally rally>person"),
    Intent.DRIVER_VIDEOS: _can("person", "rally stage uploader", "rally>person"),
    Intent.TOP_UPLOADERS: _can("uploader", "rally"),
    Intent.TOP_DRIVERS: _can("person", "rally"),
}
# The fields that hold entities, by type, and those that filter directly.
ENTITY_FIELDS = {"rally": ("rally_names", "event_names"), "stage": ("stage_names",), "person": ("driver_names",), "uploader": ("uploaders",)}
DIRECT_FIELDS = ("countries", "cities", "years", "year_from", "year_to", "stage_numbers", "driver_ids", "action_types")
# Words about a search that name nothing.
ABOUT = frozenset("rally rallies rallye event events race races stage stages ss driver drivers codriver co person winner winners won win wins result results finisher finishers podium video videos clip clips footage highlight highlights moment moments uploader uploaders contributor contributors top best most successful participation participated entered competed".split())


@dataclass(frozen=True)
class Route:
    """Phrases to resolve as (type, phrase), fields that filter at once, and the unexplained rest."""

    entities: tuple[tuple[str, str], ...]
    direct: tuple[str, ...]
    residual: tuple[str, ...] = ()
    residual_type: str | None = None
    refused: tuple[tuple[str, str], ...] = ()


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def explained(query: SearchQuery) -> frozenset[str]:
    """The words that the fields of a query account for."""
    fields = [*[f for fs in ENTITY_FIELDS.values() for f in fs], "countries", "cities", "action_types", "stage_numbers"]
    return frozenset(w for f in fields for value in getattr(query, f) for w in _words(value))


_ACTION = re.compile(rf"(?:{'|'.join(w for a in ACTIONS for w in a.split())})(?:e?s|ed|ing|p?ing)?")


def route(query: SearchQuery, text: str) -> Route:
    """How a question is answered: what to resolve, what filters directly, and what is left over.

    Phrases of a type that the intent neither is about nor filters by are refused. The residual
    is only looked for if the query names no entity, and not for the two leaderboards.
    """
    can = CAPABILITIES[query.intent]
    named = [(kind, phrase) for kind, fields in ENTITY_FIELDS.items() for f in fields for phrase in getattr(query, f)]
    allowed = {can.primary, *can.filters, *[a for a, _ in can.recovers]}
    direct = tuple(f for f in DIRECT_FIELDS if getattr(query, f))
    rest: tuple[str, ...] = ()
    if not named and query.intent not in (Intent.TOP_UPLOADERS, Intent.TOP_DRIVERS):
        known = explained(query) | SMALL | ABOUT
        rest = tuple(dict.fromkeys(w for w in _words(text) if w not in known and not w.isdigit() and not _ACTION.fullmatch(w)))
    return Route(
        tuple(x for x in named if x[0] in allowed), direct, rest, residual_type(rest, text, query.intent) if rest else None,
        tuple(x for x in named if x[0] not in allowed),
    )


def may_recover(intent: Intent, kind: str) -> str | None:
    """The type that a phrase filed as `kind` may turn out to be, for an intent."""
    return dict(CAPABILITIES[intent].recovers).get(kind)


def residual_words(text: Column, known: Column) -> Column:
    """The residual of many texts at once: distinct words that are neither in the array `known`, common, nor numbers."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return F.array_except(words, F.array_union(known, F.array(*map(F.lit, sorted(SMALL | ABOUT)))))
