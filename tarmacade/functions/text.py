"""Text normalisation, grams and phonetic codes as built-in expressions.

Every function takes and returns Columns and stays in generated code. Input is taken to be in
composed form (NFC), as all sources deliver it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a canonical decomposition, and those that become two letters.
SINGLE = {"đ": "d", "ð": "d", "ħ": "h", "ł": "l", "ŀ": "l", "ŋ": "n", "ŧ": "t", "ø": "o", "ı": "i"}
DOUBLE = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}
# Generic words of rally names.
DESCRIPTORS = "rally|rallies|rallye|rali|rajd|rallijsprints|stages|stage|forestry|championship"
# Spellings and what they sound like, in order.
SOUNDS = [
    ("ph", "f"), ("gh", "g"), ("ck", "k"), ("qu", "kw"), ("x", "ks"), ("c", "k"), ("z", "s"), ("v", "f"), ("oo", "u"),
    ("ee", "i"), ("ea", "i"), ("ay", "e"), ("ey", "e"), ("ai", "e"), ("ei", "e"), ("ou", "u"), ("ow", "o"), ("aw", "o"),
]
# Soundex digits; letters without one break a run.
SOUNDEX = {"B": "1", "F": "1", "P": "1", "V": "1", "C": "2", "G": "2", "J": "2", "K": "2", "Q": "2", "S": "2", "X": "2", "Z": "2", "D": "3", "T": "3", "L": "4", "M": "5", "N": "5", "R": "6"}


def _marked_letters() -> dict[str, str]:
    """Lower-case Latin letters with marks, by their base letter."""
    found = dict(SINGLE)
    for code in range(0xC0, 0x250):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c.islower() and base != c and base.isascii():
            found[c] = base
    return found


MARKED = _marked_letters()
_FROM, _TO = "".join(MARKED), "".join(MARKED.values())


def normalize(text: Column) -> Column:
    """Lower case, no marks, hyphens and punctuation as blanks, digits apart from letters.

    Null stays null; a text without letters and digits becomes empty.
    """
    t = F.translate(F.lower(text), _FROM, _TO)
    for letter, two in DOUBLE.items():
        t = F.replace(t, F.lit(letter), F.lit(two))
    t = F.regexp_replace(t, r"([0-9])([a-z])", "$1 $2")
    t = F.regexp_replace(t, r"([a-z])([0-9])", "$1 $2")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def collapse(text: Column) -> Column:
    """The normalised text without blanks."""
    return F.replace(normalize(text), F.lit(" "), F.lit(""))


def strip_year(text: Column) -> Column:
    """The normalised text without years from 1900 to 2099."""
    return without_year(normalize(text))


def without_year(normalized: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalized, r"\b(19|20)[0-9]{2}\b", " "), " +", " "))


def extract_year(text: Column) -> Column:
    """The first year from 1900 to 2099 in the text, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\b((19|20)[0-9]{2})\b", 1), F.lit("")).try_cast("int")


def strip_descriptors(text: Column) -> Column:
    """The normalised text without generic words such as rally or stage."""
    return without_descriptors(normalize(text))


def without_descriptors(normalized: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalized, rf"\b({DESCRIPTORS})\b", " "), " +", " "))


def acoustic_fold(text: Column) -> Column:
    """x as ks, ph as f, ck as k, and doubled consonants once."""
    t = F.lower(text)
    for a, b in (("x", "ks"), ("ph", "f"), ("ck", "k")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"([b-df-hj-np-tv-z])\1+", "$1")


def phonetic_key(text: Column) -> Column:
    """The text as it sounds: normalised, respelt by SOUNDS, runs once, upper case, words apart."""
    t = normalize(text)
    for a, b in SOUNDS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.upper(F.regexp_replace(t, r"([^ ])\1+", "$1"))


def soundex(text: Column) -> Column:
    """Soundex in which vowels, h, w and y all end a run of one digit; empty without letters."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    digits = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(SOUNDEX.get(chr(65 + i), "0") for i in range(26)))
    tail = F.replace(F.substring(F.regexp_replace(digits, r"(.)\1+", "$1"), 2, 1_000_000), F.lit("0"), F.lit(""))
    return F.when(letters == "", "").otherwise(F.concat(F.substring(letters, 1, 1), F.rpad(F.substring(tail, 1, 3), 3, "0")))


def consonant_skeleton(text: Column) -> Column:
    return F.regexp_replace(normalize(text), "[aeiou ]", "")


def words(text: Column) -> Column:
    """The distinct words of a normalised text, none for an empty one."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def grams(text: Column, n: int) -> Column:
    """The distinct character n-grams; the whole text if it is not longer than n; none if empty."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))


def gram_anchors(text: Column, n: int = 3, most: int = 6) -> Column:
    """The start gram, sliding grams and, if there is room, the end gram: at most `most`."""
    clean = collapse(text)
    all_ = grams(clean, n)
    end = F.substring(clean, F.length(clean) - n + 1, F.lit(n))
    return F.when(F.length(clean) < n, F.filter(F.array(clean), lambda x: x != "")).otherwise(
        F.slice(F.array_distinct(F.concat(F.slice(all_, 1, most - 1), F.array(end))), 1, most)
    )


def prefixes(word: Column, shortest: int = 2, longest: int = 5) -> Column:
    top = F.least(F.length(word), F.lit(longest))
    return F.when(F.length(word) < shortest, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(shortest), F.greatest(top, F.lit(shortest))), lambda n: F.substring(word, F.lit(1), n))
    )


def set_dice(a: Column, b: Column) -> Column:
    """2 |A & B| / (|A| + |B|) of two arrays of distinct items, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    """|A & B| / |A or B| of two arrays, 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 0 if either is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def token_score(a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """The best of set-Dice, share of words that begin one another, and ratio of prefix phrases."""
    begins = lambda x, y: (F.length(x) >= 3) & (F.length(y) >= 3) & (F.startswith(x, y) | F.startswith(y, x))
    hits = F.size(F.filter(a, lambda x: F.exists(b, lambda y: begins(x, y)))) / F.greatest(F.size(a), F.size(b))
    shorter, longer = F.least(F.length(a_text), F.length(b_text)), F.greatest(F.length(a_text), F.length(b_text))
    phrase = F.when(F.startswith(a_text, b_text) | F.startswith(b_text, a_text), shorter / longer).otherwise(0.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(set_dice(a, b), hits, phrase))
