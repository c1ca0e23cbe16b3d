"""The composite score of a mention against an entity's name.

A name is reduced to its forms (`formed`) once, however many pairs it is in. A pair's score (`composited`)
is then made of expressions over the two sets of forms: a ladder of equalities, and below it blends of
similarities, which BLENDS lists as weights. Only Jaro-Winkler and multiset Dice need Python;
`likeness` computes them for all forms of a pair in one vectorised call, and everything that
decides stays in generated code.

Names in Arabic script are compared by their Latin readings (`latin_variants`), a bounded list
that is made once per mention.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmacade.functions import text as T
from tarmacade.functions.batched import measures
from tarmacade.functions.kernels import dice, jaro_winkler

# Scores of equal forms, best first.
EQUAL = {"norm": 1.0, "base": 0.96, "flat": 0.95, "core": 0.94, "core_heard": 0.93, "flat_heard": 0.93}
# Factor, then weights of Jaro-Winkler, edit similarity, Dice of pairs and of triples.
BLENDS = {
    "norm": (1.0, 0.35, 0.25, 0.20, 0.10),
    "base": (1.0, 0.45, 0.30, 0.25, 0.0),
    "core": (1.0, 0.45, 0.30, 0.25, 0.0),
    "flat": (0.90, 0.60, 0.0, 0.40, 0.0),
    "flat_heard": (0.92, 0.50, 0.30, 0.20, 0.0),
    "core_heard": (0.94, 0.50, 0.30, 0.20, 0.0),
}
# The blend of given or family names, that of a phrase within a name, and its factors.
PERSON, PHRASE = (1.0, 0.50, 0.30, 0.20, 0.0), (0.55, 0.30, 0.15)
WINDOW, JOINED, JOINED_WEIGHTS, SHORTEST_WORD, SHORTEST_JOINED = 0.98, 0.95, (0.50, 0.30, 0.20), 3, 4
# Bounds and weights of people's names, boosts, and scores of other years and scripts.
LEAST_FAMILY, OTHER_FAMILY, LEAST_GIVEN, OTHER_GIVEN, PART_OF_FAMILY, HEARD_FAMILY = 0.78, 0.55, 0.75, 0.60, 0.95, 0.95
FAMILY_WEIGHT, GIVEN_WEIGHT, ONLY_FAMILY, LEAST_ONLY_FAMILY = 0.65, 0.35, 0.90, 0.80
SAME_WORDS, SAME_SOUND, BEGINS, WITHIN, LONGEST_WITHIN = 0.10, 0.03, 0.12, 0.08, 100
OTHER_YEAR, SAME_YEAR, IN_CONTEXT, BOOSTED_FROM = 0.25, 0.20, 0.15, 0.45
READ_EQUAL, READ_FLAT, READ_WITHIN = 0.94, 0.93, 6
# Additions to a family name that don't tell people apart.
SUFFIXES = ("jr", "jnr", "junior", "sr", "snr", "senior", "ii", "iii", "iv")

# Latin readings of Arabic and Urdu letters, the most usual first.
READINGS = {
    "ا": ("a", ""), "ب": ("b", "p"), "پ": ("p",), "ت": ("t",), "ٹ": ("t",), "ث": ("th", "s"), "ج": ("j", "g"), "چ": ("ch",), "ح": ("h",), "خ": ("kh", "h"),
    "د": ("d",), "ڈ": ("d",), "ذ": ("dh", "z"), "ر": ("r",), "ڑ": ("r",), "ز": ("z",), "ژ": ("zh",), "س": ("s",), "ش": ("sh",), "ص": ("s",), "ض": ("d",),
    "ط": ("t",), "ظ": ("z",), "ع": ("a", ""), "غ": ("gh", "g"), "ف": ("f", "v"), "ق": ("q", "k"), "ک": ("k",), "گ": ("g",), "ل": ("l",), "م": ("m",), "ن": ("n",),
    "ں": ("n",), "و": ("w", "u", "o"), "ہ": ("h", "a"), "ھ": ("h",), "ی": ("y", "i"), "ے": ("e",), "ئ": ("y", ""), "ء": ("",),
}
#: Variants kept per word and per phrase.
PER_WORD, PER_PHRASE = 25, 60
# Letters of other shapes of the same letter.
_SHAPES = str.maketrans("أإآٱىيكةؤ", "ااااییکہو")
ARABIC = r"[؀-ۿݐ-ݿ]"

_FORMS = tuple(BLENDS)


def formed(frame: DataFrame, name: str, out: str) -> DataFrame:
    """The frame with the struct `out`: what is compared of the column `name`; its texts are empty, never null.

    Forms that others build on are columns of their own for a while, so that each is made once.
    """
    c, flat = F.col, lambda x: F.replace(x, F.lit(" "), F.lit(""))
    staged = frame.withColumn("#text", F.coalesce(name, F.lit(""))).withColumn("#norm", T.normalize(c("#text")))
    staged = staged.withColumn("#base", T.without_year(c("#norm"))).withColumns({"#bare": T.without_descriptors(c("#base")), "#flat": flat(c("#norm"))})
    phrase = F.when(c("#bare") != "", c("#bare")).when(c("#base") != "", c("#base")).otherwise(c("#norm"))
    staged = staged.withColumns({"#core": flat(c("#bare")), "#words": F.filter(F.split(phrase, " "), lambda w: w != ""), "#read": _readings(F.when(c("#text").rlike(ARABIC), c("#text")))})
    staged = staged.withColumn("#own", F.filter("#words", lambda w: ~w.isin(*SUFFIXES)))
    fields = F.struct(
        c("#norm").alias("norm"), c("#base").alias("base"), c("#flat").alias("flat"), c("#core").alias("core"),
        T.acoustic_fold(c("#core")).alias("core_heard"), T.acoustic_fold(c("#flat")).alias("flat_heard"),
        c("#words").alias("words"), F.when(F.size("#own") > 0, c("#own")).otherwise(c("#words")).alias("names"),
        c("#norm").rlike(rf"\b({T.DESCRIPTORS})\b").alias("generic"), T.extract_year(c("#text")).alias("year"),
        T.soundex(c("#norm")).alias("soundex"), c("#read").alias("readings"),
    )
    return staged.withColumn(out, fields).drop("#text", "#norm", "#base", "#bare", "#flat", "#core", "#words", "#read", "#own")


def likeness(a: Column, b: Column) -> Column:
    """Jaro-Winkler, edit similarity and Dice of pairs and triples for each two texts of two lists."""

    @F.pandas_udf("array<array<double>>")
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        each = a.map(len).to_numpy()
        found = _measured([x for xs in a for x in xs], [y for ys in b for y in ys])
        return pd.Series([m.tolist() for m in np.split(found, np.cumsum(each)[:-1])], dtype=object)

    return measure(a, b)


def closest(phrase: Column, options: Column, weights: tuple[float, ...]) -> Column:
    """The best blend (weights of Jaro-Winkler, edits, Dice of pairs) of a phrase and some options; 0 for none."""

    @F.pandas_udf("double")
    def best(phrases: pd.Series, options: pd.Series) -> pd.Series:
        each = options.map(len).to_numpy()
        found = _measured([p for p, n in zip(phrases, each) for _ in range(n)], [o for os in options for o in os], triples=False)
        blends, most = sum(w * found[:, i] for i, w in enumerate(weights)), np.zeros(len(each))
        np.maximum.at(most, np.repeat(np.arange(len(each)), each), blends)
        return pd.Series(most)

    return best(phrase, options)


def _measured(a: list[str], b: list[str], triples: bool = True) -> np.ndarray:
    """`measures` of each two texts, the same two measured once."""
    once: dict[tuple[str, str], int] = {}
    at = [once.setdefault(pair, len(once)) for pair in zip(a, b)]
    return measures([x for x, _ in once], [y for _, y in once], triples)[at]


@lru_cache(maxsize=200_000)
def _measures(a: str, b: str) -> list[float]:
    return [jaro_winkler(a, b), edit_similarity(a, b), dice(a, b, 2), dice(a, b, 3)]


def edit_similarity(a: str, b: str) -> float:
    """1 - edits / longer length; 0 if either is empty."""
    if not a or not b:
        return 0.0
    costs = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b):
            row.append(costs[j] if x == y else 1 + min(costs[j], costs[j + 1], row[j]))
        costs = row
    return 1.0 - costs[-1] / max(len(a), len(b))


def _readings(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([latin_variants(t) if t else [] for t in texts], dtype=object)

    # Texts in other scripts are null here; the list is empty for them.
    return read(text)


def latin_variants(text: str) -> list[str]:
    """Latin readings of a text in Arabic or Urdu script, bounded per word and in all; vowels that
    the script leaves out stay out."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text).translate(_SHAPES) if not unicodedata.combining(c))
    each = []
    for word in plain.split():
        word = word.removeprefix("ال") if len(word) > 4 else word
        readings = [""]
        for c in word:
            readings = [r + x for r in readings for x in READINGS.get(c, (c if c.isascii() else "",))][: 2 * PER_WORD]
        each.append(list(dict.fromkeys(readings))[:PER_WORD])
    return list(dict.fromkeys(" ".join(p).strip() for p, _ in zip(product(*each), range(PER_PHRASE)))) if each else []


def _by_reading(reading: str, norm: str, base: str, core: str, flat: str) -> float:
    joined = reading.replace(" ", "")
    if reading in (norm, base) or (core and joined == core):
        return READ_EQUAL
    if joined == flat or (len(joined) >= READ_WITHIN and joined in flat):
        return READ_FLAT
    jw, edit, two, _ = _measures(reading, norm)
    return max(0.40 * jw + 0.30 * edit + 0.30 * two, 0.90 * jaro_winkler(reading, base), 0.90 * jaro_winkler(joined, core), 0.85 * jaro_winkler(joined, flat))


def by_readings(readings: Column, *forms: Column) -> Column:
    """The best score of a mention's Latin readings against a name's forms; 0 without readings."""

    @F.pandas_udf("double")
    def best(readings: pd.Series, norm: pd.Series, base: pd.Series, core: pd.Series, flat: pd.Series) -> pd.Series:
        return pd.Series([max((_by_reading(r, *row) for r in rs if r), default=0.0) for rs, *row in zip(readings, norm, base, core, flat)], dtype="float64")

    return best(readings, *forms)


def _blend(measured: Column, weights: tuple[float, ...]) -> Column:
    factor, *each = weights
    return factor * sum((w * measured[i] for i, w in enumerate(each) if w), F.lit(0.0))


def _within(q: Column, c: Column) -> Column:
    """The best likeness of the mention's words to as many neighbouring words of the name."""
    mine, theirs = q["words"], c["words"]
    n, m = F.size(mine), F.size(theirs)
    long = F.filter(theirs, lambda w: F.length(w) >= SHORTEST_WORD)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(theirs, i, F.greatest(n, F.lit(1))), " "))
    none = F.array().cast("array<string>")
    options = F.when((n == 1) & (F.length(F.try_element_at(mine, F.lit(1))) >= SHORTEST_WORD), long).when((n > 1) & (n <= m), runs).otherwise(none)
    heard = F.transform(F.filter(theirs, lambda w: F.length(w) >= SHORTEST_JOINED), T.acoustic_fold)
    joined = F.when(n >= 2, heard).otherwise(none)
    return F.greatest(
        closest(F.array_join(mine, " "), options, PHRASE),
        JOINED * closest(T.acoustic_fold(F.array_join(mine, "")), joined, JOINED_WEIGHTS),
    )


def composited(pairs: DataFrame, person: Column, name: str = "score") -> DataFrame:
    """The pairs (q, c, ...) of forms of a mention and of a name with their score in 0..1, to three decimals.

    0 for an empty side, OTHER_YEAR if both name different years. `person` says whether the name
    is a person's, which are compared name by name unless a generic word is about. What several
    branches need is a column of its own, so that it is computed once.
    """
    q, c, at = F.col("q"), F.col("c"), {f: F.get("#like", F.lit(i)) for i, f in enumerate((*_FORMS, "first", "last", "last_heard"))}
    first, last = (lambda s: F.coalesce(F.try_element_at(s["names"], F.lit(1)), F.lit(""))), (lambda s: F.coalesce(F.try_element_at(s["names"], F.lit(-1)), F.lit("")))
    # Given and family names are measured of people only.
    sides = [F.when(person, F.array(*[s[f] for f in _FORMS], first(s), last(s), T.acoustic_fold(last(s)))).otherwise(F.array(*[s[f] for f in _FORMS])) for s in (q, c)]
    readings = F.coalesce(q["readings"], F.array().cast("array<string>"))
    measured = pairs.withColumns({"#like": likeness(*sides), "#within": _within(q, c), "#read": by_readings(readings, c["norm"], c["base"], c["core"], c["flat"])})

    equal = F.lit(None).cast("double")
    for form, score in reversed(EQUAL.items()):
        equal = F.when((q[form] == c[form]) & (q[form] != ""), F.lit(score)).otherwise(equal)

    mine, theirs = F.array_distinct(F.split(q["norm"], " ")), F.array_distinct(F.split(c["norm"], " "))
    one_word = (F.size(mine) == 1) | (F.size(theirs) == 1)
    begins = F.startswith(q["norm"], c["norm"]) | F.startswith(c["norm"], q["norm"])
    part = WITHIN * F.length(q["norm"]) / F.least(F.lit(LONGEST_WITHIN), F.greatest(F.lit(1), F.length(c["norm"])))
    bonus = F.when(one_word & begins, F.lit(BEGINS)).when(one_word & F.contains(c["norm"], q["norm"]), part).otherwise(0.0)
    bonus += F.when(q["soundex"] == c["soundex"], F.lit(SAME_SOUND)).otherwise(0.0)
    whole = _blend(at["norm"], BLENDS["norm"]) + SAME_WORDS * T.jaccard(mine, theirs) + bonus

    a, b = last(q), last(c)
    heard = HEARD_FAMILY * (at["last_heard"][0] + at["last_heard"][1]) / 2
    family = F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), F.lit(PART_OF_FAMILY)).otherwise(F.greatest(_blend(at["last"], PERSON), heard))
    staged = measured.withColumns({
        "#equal": equal, "#general": F.greatest(whole, *[_blend(at[f], BLENDS[f]) for f in _FORMS if f != "norm"], WINDOW * F.col("#within")),
        "#given": _blend(at["first"], PERSON), "#family": family, "#last": _blend(at["last"], PERSON),
    })
    given, family = F.col("#given"), F.col("#family")
    full = (
        F.when(family < LEAST_FAMILY, F.least(F.lit(OTHER_FAMILY), given * family))
        .when(given < LEAST_GIVEN, F.least(F.lit(OTHER_GIVEN), 0.60 * family + 0.40 * given))
        .otherwise(FAMILY_WEIGHT * family + GIVEN_WEIGHT * given)
    )
    # The mention's only word is measured as its last one.
    alone = F.when(F.col("#last") >= LEAST_ONLY_FAMILY, ONLY_FAMILY * F.col("#last")).otherwise(0.0)
    named = person & ~q["generic"] & ~c["generic"] & (F.size(c["names"]) >= 2)
    similar = F.when(named & (F.size(q["names"]) >= 2), full).when(named & (F.size(q["names"]) == 1), alone).otherwise(F.col("#general"))
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("#equal"), F.greatest(similar, F.col("#read")))))
    boosted = F.when((F.col("#raw") >= BOOSTED_FROM) & (q["year"] == c["year"]), F.least(F.lit(1.0), F.col("#raw") + SAME_YEAR)).otherwise(F.col("#raw"))
    score = F.when((q["norm"] == "") | (c["norm"] == ""), 0.0).when(q["year"] != c["year"], F.lit(OTHER_YEAR)).otherwise(boosted)
    return staged.withColumn("#raw", raw).withColumn(name, F.round(score, 3)).drop("#like", "#within", "#read", "#equal", "#general", "#given", "#family", "#last", "#raw")
