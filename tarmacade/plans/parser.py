"""Deterministic reading of short questions: years, countries, actions, roles, intent, the rest.

What a text says outright is taken into the query; words that neither a filter nor common
language explains are the residual, which names an entity. A text that gives no ground for any
query is declined (None), never guessed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from tarmacade.functions.countries import CODES
from tarmacade.plans.query import YEARS, Intent, Role, SearchQuery

# Actions in videos.
ACTIONS = ("jump", "drift", "crash", "spin", "donut", "hairpin", "water splash", "start line", "near miss", "mechanical failure", "offroad", "stuck")
# Words that ask for an intent, the most special first.
CUES = [
    (Intent.TOP_UPLOADERS, r"\b(uploaders?|contributors?)\b"),
    (Intent.TOP_DRIVERS, r"\b(most wins|most successful|top drivers?|best drivers?|leaderboard)\b"),
    (Intent.RALLY_RESULTS, r"\b(who won|winner of|winner)\b"),
    (Intent.TOP_FINISHERS, r"\b(results?|finishers?|podium|classification|standings?|top (?:three|five|ten|\d+))\b"),
    (Intent.DRIVER_WINS, r"\b(wins|victories|won by)\b"),
    (Intent.DRIVER_VIDEOS, r"\b(videos?|footage|clips?|highlights?)\b"),
    (Intent.PARTICIPATIONS, r"\b(participat\w+|entered|driven by|drove in|competed)\b"),
    (Intent.RALLIES, r"\b(rallies|rally|events?|races?)\b"),
]
# Small words that name nothing.
SMALL = frozenset("a an and any are all at about as be by can did do does for from give find get had has have he her him his how i in is it its list me my of on or out please she show tell than that the their them then there these they this those to up was were what when where which who whose will with year years you your between since before after until show us many much new latest recent".split())
# Texts that ask for no search, by kind; whole texts, then patterns of whole texts.
SPECIAL = {
    "greeting": {"hi", "hello", "hey", "good morning", "good afternoon", "good evening"},
    "thanks": {"thanks", "thank you", "cheers", "thanks a lot"},
    "identity": {"who are you", "what are you", "what is your name"},
    "capabilities": {"help", "what can you do", "how can you help", "what do you do"},
    "alive": {"are you alive", "are you real"},
    "joke": {"tell me a joke", "say something funny", "rally joke"},
    "weather": {"weather", "what's the weather", "what is the weather", "how is the weather"},
}
SPECIAL_PATTERNS = [
    ("opinion", re.compile(r"who (is|was) the (best|greatest) rally (driver|racer)( of all time)?")),
    ("unsupported", re.compile(r"(what is|what's) the capital of [a-z ]+|(how do i|how to) (cook|bake|make)\b.*")),
]

_YEAR = r"((?:19|20)\d{2})"
_RANGE = re.compile(rf"\b{_YEAR}\s*(?:-|–|to|until|and)\s*{_YEAR}\b")
_FROM = re.compile(rf"\b(?:since|after|from)\s+{_YEAR}\b")
_TO = re.compile(rf"\b(?:before|until|up to)\s+{_YEAR}\b")
_ONE = re.compile(rf"\b{_YEAR}\b")
_STAGE = re.compile(r"\b(?:ss|stage)\s?(\d{1,2})\b")
_NAMES = {s.lower(): c for s, c in CODES.items() if len(s) > 3}


@dataclass(frozen=True)
class Parsed:
    """A query with the words it leaves over, or the kind of a text that asks nothing."""

    query: SearchQuery | None
    residual: tuple[str, ...] = ()
    special: str | None = None


def special_kind(text: str) -> str | None:
    """The kind of a text that asks for no search, whatever its case, blanks and final punctuation."""
    plain = " ".join(text.lower().rstrip("?!.,;: ").split())
    exact = next((kind for kind, phrases in SPECIAL.items() if plain in phrases), None)
    return exact or next((kind for kind, pattern in SPECIAL_PATTERNS if pattern.fullmatch(plain)), None)


def read_years(text: str) -> tuple[dict[str, object], str]:
    """The year filters of a text and the text without them; reversed ranges are turned round.

    A number outside YEARS (a slip such as 2062 for 2026) filters nothing; of a range with such
    an end the other end counts.
    """
    if m := _RANGE.search(text):
        low, high = sorted((int(m[1]), int(m[2])))
        return {n: y for n, y in (("year_from", low), ("year_to", high)) if y in YEARS}, text[: m.start()] + " " + text[m.end() :]
    for pattern, name in ((_FROM, "year_from"), (_TO, "year_to")):
        if m := pattern.search(text):
            return {name: int(m[1])} if int(m[1]) in YEARS else {}, text[: m.start()] + " " + text[m.end() :]
    years = tuple(y for y in dict.fromkeys(map(int, _ONE.findall(text))) if y in YEARS)
    return ({"years": years} if years else {}), _ONE.sub(" ", text)


def read_countries(text: str) -> tuple[tuple[str, ...], str]:
    """The countries named in full, longest names first, and the text without them."""
    found = []
    for name in sorted(_NAMES, key=len, reverse=True):
        if re.search(rf"\b{name}\b", text):
            found.append(name)
            text = re.sub(rf"\b{name}\b", " ", text)
    return tuple(found), text


def parse(text: str) -> Parsed:
    """The query that a text asks, with its residual words; nothing if it gives no ground for one."""
    if kind := special_kind(text):
        return Parsed(None, special=kind)
    rest = " " + re.sub(r"[^\w\s#-]", " ", text.lower()) + " "
    filters, rest = read_years(rest)
    countries, rest = read_countries(rest)
    actions = tuple(a for a in ACTIONS if re.search(rf"\b{a}(?:e?s|ed|ing)?\b", rest))
    for a in actions:
        rest = re.sub(rf"\b{a}(?:e?s|ed|ing)?\b", " ", rest)
    stages = tuple(_STAGE.findall(rest))
    rest = _STAGE.sub(" ", rest)
    role = Role.CO_DRIVER if re.search(r"\bco-?\s?drivers?\b", rest) else Role.DRIVER if re.search(r"\bdrivers?\b", rest) else Role.ANY
    intent = Intent.VIDEO_ACTIONS if actions else next((i for i, cue in CUES if re.search(cue, rest)), None)
    for _, cue in CUES:
        rest = re.sub(cue, " ", rest)
    rest = re.sub(r"\bco-?\s?drivers?\b|\bdrivers?\b", " ", rest)
    residual = tuple(w for w in rest.split() if w not in SMALL and not w.isdigit())
    if intent is None and not (filters or countries or stages):
        return Parsed(None, residual)
    query = SearchQuery(intent or Intent.RALLIES, countries=countries, action_types=actions, stage_numbers=stages, role=role, **filters)  # type: ignore[arg-type]
    return Parsed(query.checked(), residual)


def grounded(query: SearchQuery, text: str, earlier: SearchQuery | None = None) -> SearchQuery:
    """The query with only those years that the text or the query before it has."""
    known = {int(y) for y in _ONE.findall(text)} | set(earlier.years if earlier else ())
    return replace(query, years=tuple(y for y in query.years if y in known))


def residual_type(residual: tuple[str, ...], text: str, intent: Intent) -> str | None:
    """The type of entity that the residual names: by a word beside it, else by the intent."""
    if not residual:
        return None
    lower = text.lower()
    if re.search(r"\bss ?\d+\b", lower):
        return "stage"
    if re.search(r"\b(featuring|with|by|driver)\b", lower):
        return "person"
    if re.search(r"\b(rally|rallye|rali)\b", lower):
        return "rally"
    people = (Intent.PARTICIPATIONS, Intent.DRIVER_WINS, Intent.DRIVER_VIDEOS, Intent.TOP_DRIVERS)
    return "person" if intent in people else "uploader" if intent is Intent.TOP_UPLOADERS else None if intent is Intent.VIDEO_ACTIONS else "rally"
