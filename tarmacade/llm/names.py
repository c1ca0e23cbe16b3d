"""Linking the spellings of one name: kernels on single names and pairs of names.

A name is reduced to its tokens: no marks, titles, numbers or punctuation, in sorted order, so
that reordered parts are the same name. Letters of every script are kept; Cyrillic and Greek ones
are written in Latin. Tokens are blocked by their phonetic codes; two names are compared token by
token with Jaro-Winkler similarity, edit distance and a table of short given names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import permutations

import numpy as np
import regex

# Cyrillic letters as they are written in Latin ones, letter by letter.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "ju", "я": "ja",
    "і": "i", "ї": "i", "є": "e",
}
# Greek letters as they are written in Latin ones, letter by letter.
GREEK = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}
# Letters that do not come apart into a base letter and a mark.
LETTERS = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}
# Words around a name that are no part of it, and entries that stand for no name.
TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "sir", "jr", "sr", "jnr", "snr", "ii", "iii", "car", "the"}
NOBODY = {"tba", "tbc", "tbd", "unknown", "null", "none", "na", "nn", "anonymous", "driver", "codriver", "test", "xxx", "placeholder"}
# Spellings of one sound, in the order in which they are replaced.
RESPELT = [("ph", "f"), ("ck", "k"), ("x", "ks"), ("c", "k"), ("q", "k"), ("w", "v"), ("y", "i"), ("th", "t")]

_DOUBLE = re.compile(r"(.)\1+")

# Rows of a keyboard, each half a key to the right of the one above, and letters of
# one sound or nearly so. Letters beside each other or in one group are typed for one another.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
ONE_SOUND = ("aeiouy", "bp", "ckq", "dt", "fv", "gk", "ij", "mn", "sz", "vw", "lr")

#: Jaro-Winkler similarity from which tokens can be alike.
SIMILAR = 0.80

#: A text of more words, or with a longer word, is no spelling of a name; it only links to the very
#: same words.
MOST_TOKENS, MOST_LETTERS = 8, 30

_PLAIN = str.maketrans(CYRILLIC | GREEK)
_FOLD = str.maketrans(LETTERS | {"'": "", "’": "", "‘": "", "`": "", "´": "", "-": "", "‐": "", "‑": ""})
_TAIL = re.compile(r"\([^)]*\)|\[[^\]]*\]|#\s*\d+|[-–—,]?\s*\bcar\s*\d+", re.I)
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})")
_WORD = re.compile(r"[^\W\d_]+")


def tokens(name: str | None) -> list[str]:
    """The tokens of a name in sorted order; none for null and blank names, for stand-ins (all
    words say that there is no name) and for nothing but initials of an alphabet.

    Titles are left out where at least two other words remain.
    """
    if not name:
        return []
    name = "".join(c for c in unicodedata.normalize("NFKC", name) if unicodedata.category(c) != "Cf")
    name = _CAMEL.sub(" ", _TAIL.sub(" ", name)).lower().translate(_FOLD)
    # Marks come off after й has become a plain letter of its own, accents of Greek before.
    name = "".join(c for c in unicodedata.normalize("NFD", name.translate(_PLAIN)) if not unicodedata.combining(c))
    words = _WORD.findall(name.translate(_PLAIN))
    if all(w in NOBODY for w in words) or all(len(w) == 1 and w.isascii() for w in words):
        return []
    bare = [w for w in words if w not in TITLES]
    return sorted(bare if len(bare) >= 2 else words)


def unspelt(name: list[str]) -> bool:
    """Whether a text is too long to be a spelling of a name."""
    return len(name) > MOST_TOKENS or any(len(w) > MOST_LETTERS for w in name)


@lru_cache(maxsize=100_000)
def sound(token: str) -> str:
    """A token in one spelling of its sounds: doubled letters once, c and q as k, ph as f, ..."""
    for spelt, heard in RESPELT:
        token = token.replace(spelt, heard)
    return _DOUBLE.sub(r"\1", token)


class Nicknames:
    """Full forms of given names by their short forms, both folded."""

    def __init__(self, pairs: Iterable[tuple[str | None, str | None]]) -> None:
        self.full: dict[str, frozenset[str]] = {}
        found: dict[str, set[str]] = {}
        for full, short in pairs:
            f, s = tokens(full), tokens(short)
            if f and s:
                found.setdefault("".join(s), set()).add("".join(f))
        self.full = {s: frozenset(f | {s}) for s, f in found.items()}
        self._given = frozenset(self.full).union(*self.full.values())

    def given(self, token: str) -> bool:
        """Whether a token is a full or short form of the table."""
        return token in self._given

    def forms(self, token: str) -> frozenset[str]:
        return self.full.get(token) or frozenset((token,))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four letters."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    taken = [False] * lb
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (b[j] for j in range(lb) if taken[j]))) / 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _confused() -> frozenset[tuple[str, str]]:
    """The pairs of letters that are typed or heard for one another, in both orders."""
    near = [row[i : i + 2] for row in KEYBOARD for i in range(len(row) - 1)]
    near += [upper[i + k] + c for upper, lower in zip(KEYBOARD, KEYBOARD[1:]) for i, c in enumerate(lower) for k in (0, 1) if i + k < len(upper)]
    return frozenset((x, y) for group in (*near, *ONE_SOUND) for x in group for y in group if x != y)


CONFUSED = _confused()


def edits(a: str, b: str, most: int, unlike: int = 1) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; most + 1 if there are more.

    A substitution of letters that aren't CONFUSED counts `unlike`.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            change = 0 if x == y else 1 if unlike == 1 or (x, y) in CONFUSED else unlike
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + change)
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def tolerance(a: str, b: str) -> int:
    """The edits allowed between two tokens."""
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 7 else 2


@lru_cache(maxsize=200_000)
def alike(a: str, b: str, slack: int = 0) -> bool:
    """Whether two tokens are one token but for typing errors, as written or as heard.

    `slack` allows more edits than `tolerance`.
    """
    return a == b or _near(a, b, slack) or _near(sound(a), sound(b), slack)


def _near(a: str, b: str, slack: int) -> bool:
    if a == b:
        return True
    t = tolerance(a, b)
    t += slack if t else 0
    # More letters of one than t that the other lacks means more than t edits.
    if not t or abs(len(a) - len(b)) > t or (Counter(a) - Counter(b)).total() > t:
        return False
    if jaro_winkler(a, b) < SIMILAR - 0.05 * slack or edits(a, b, t) > t:
        return False
    # One error may be any; of two, none may put a letter for one that has nothing to do with it.
    return slack > 0 or t < 2 or edits(a, b, t, unlike=2) <= t


def fits(a: str, b: str, nicknames: Nicknames, slack: int = 0) -> bool:
    """Whether two tokens can stand for one given name: initial, short form, or misspelt."""
    if a == b:
        return True
    fa, fb = nicknames.forms(a), nicknames.forms(b)
    if len(a) == 1 or len(b) == 1:
        return bool({x[0] for x in fa} & {x[0] for x in fb})
    if fa & fb or any(alike(x, y, slack) for x in fa for y in fb):
        return True
    short, long = sorted((a, b), key=len)
    if len(short) < 3:
        return False
    if len(short) == 3 and a[0] == b[0] and edits(a, b, 1) <= 1:
        return True
    if nicknames.given(short) and not nicknames.given(long):
        return False  # the table knows what it is short for
    return long.startswith(short) or (len(short) >= 4 and long.endswith(short))


def given_fit(a: list[str], b: list[str], nicknames: Nicknames, slack: int = 0) -> bool:
    """Whether every token of the shorter list fits a different one of the longer list.

    An initial of the longer list only counts if no whole name is left over beside it: it is
    then a middle initial, and what it seems to fit is another family name. For the same reason
    initials of both lists don't count for whole names of the other.
    """
    if len(a) > len(b):
        a, b = b, a
    return bool(a) and _fit(a, b, False, False, nicknames, slack)


def _fit(a: list[str], b: list[str], by_theirs: bool, by_mine: bool, nicknames: Nicknames, slack: int) -> bool:
    if not a:
        return not (by_theirs and (by_mine or any(len(x) > 1 for x in b)))
    for i, x in enumerate(b):
        if fits(a[0], x, nicknames, slack):
            theirs = by_theirs or (len(x) == 1 and len(a[0]) > 1)
            mine = by_mine or (len(x) > 1 and len(a[0]) == 1)
            if _fit(a[1:], b[:i] + b[i + 1 :], theirs, mine, nicknames, slack):
                return True
    return False


def same_name(a: list[str], b: list[str], nicknames: Nicknames, slack: int = 0) -> bool:
    """Whether two names, as sorted tokens, can be one: one token alike, the others fitting.

    Names of different numbers of tokens are also tried with two tokens written as one. Texts
    that are no spelling of a name are the same only if they are equal.
    """
    if unspelt(a) or unspelt(b):
        return a == b
    if _anchored(a, b, nicknames, slack):
        return True
    if len(a) == len(b):
        return False
    short, long = sorted((a, b), key=len)
    for i in range(len(long)):
        for j in range(len(long)):
            if i != j and len(long[i]) > 1 and len(long[j]) > 1:
                joined = [x for k, x in enumerate(long) if k not in (i, j)] + [long[i] + long[j]]
                if len(joined) >= 2 and _anchored(short, joined, nicknames, slack):
                    return True
    return False


def _anchored(a: list[str], b: list[str], nicknames: Nicknames, slack: int) -> bool:
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if _anchor(x, y, nicknames, slack) and given_fit(a[:i] + a[i + 1 :], b[:j] + b[j + 1 :], nicknames, slack):
                return True
    return False


def _anchor(x: str, y: str, nicknames: Nicknames, slack: int) -> bool:
    """Whether two tokens can be one family name: alike, or if short, equal and no known given name."""
    if min(len(x), len(y)) >= 4:
        return alike(x, y, slack)
    return x == y and len(x) >= 2 and not nicknames.given(x)


# The powers of a hash's base and of its inverse, modulo 2**64.
_BASE, _LONGEST = 0x9E3779B97F4A7C15, 2 * MOST_LETTERS + 2
_UP = np.array([pow(_BASE, k, 1 << 64) for k in range(_LONGEST)], dtype=np.uint64)
_DOWN = [np.uint64(pow(_BASE, -k, 1 << 64)) for k in range(3)]


def spelt_keys(words: Sequence[str]) -> list[np.ndarray]:
    """For each word keys that words share if they are alike: the word as written and as heard,
    with as many letters left out as `tolerance` allows edits.

    Keys are hashes; a collision adds a candidate. A word may have a key twice.
    """
    spelt = [(i, x) for i, w in enumerate(words) for x in {w, sound(w)}]
    by_length: dict[int, list[int]] = {}
    for k, (_, x) in enumerate(spelt):
        by_length.setdefault(len(x), []).append(k)
    found: list[list[np.ndarray]] = [[] for _ in words]
    for n, group in by_length.items():
        codes = np.frombuffer("".join(spelt[k][1] for k in group).encode("utf-32-le"), np.uint32).reshape(len(group), n)
        for k, keys in zip(group, _shortened(codes.astype(np.uint64), tolerance("x" * n, "x" * n)).view(np.int64)):
            found[spelt[k][0]].append(keys)
    return [np.concatenate(f) for f in found]


def _shortened(codes: np.ndarray, most: int) -> np.ndarray:
    """The hashes of words of one length, one per row, with up to `most` letters left out, from sums of their prefixes."""
    n = codes.shape[1]
    upto = np.zeros((len(codes), n + 1), np.uint64)
    np.cumsum(codes * _UP[:n], axis=1, dtype=np.uint64, out=upto[:, 1:])
    whole = upto[:, -1:]
    found = [whole]
    if most > 0:
        found.append(upto[:, :-1] + (whole - upto[:, 1:]) * _DOWN[1])
    if most > 1:
        i, j = np.triu_indices(n, 1)
        found.append(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * _DOWN[1] + (whole - upto[:, j + 1]) * _DOWN[2])
    return np.concatenate(found, axis=1)


def anchors(name: list[str]) -> set[tuple[bool, str, str]]:
    """(joined, anchor, other token) of a name as `same_name` tries them.

    Those with two tokens written as one are marked joined: they only meet names that have none.
    Texts that are no spelling of a name have none.
    """
    if unspelt(name):
        return set()
    found = {(False, x, y) for i, x in enumerate(name) for j, y in enumerate(name) if i != j}
    for i, j in permutations(range(len(name)), 2):
        if len(name[i]) > 1 and len(name[j]) > 1:
            both = name[i] + name[j]
            for k, other in enumerate(name):
                if k not in (i, j):
                    found |= {(True, both, other), (True, other, both)}
    return {(w, x, y) for w, x, y in found if len(x) >= 2}


def short_keys(word: str) -> set[str]:
    """Keys that words of three or four letters share if they differ in one letter or one is a
    letter longer."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) in (3, 4) else set()
