"""Per-document text statistics, and rules on them that tell prose from lists, tables and junk.

Statistics are counted per line with array operations: the lines of many texts lie in one array
of code points, a lookup table gives each its class, and sums between line starts give lengths,
letters, vowels, symbols, separators. Words are recognised as common by a rolling hash. Fixed
thresholds then give every line a kind and a reason; a text is what most of its characters are,
and the reasons of its lines are recorded with it. Texts of several kinds are told apart by
characters, so the published thresholds for web text (symbols per word, mean word length, words
with a letter, bullets, lines of fewer than five words, duplicate lines) are applied to lines, each
a small text; failures of whole texts are recorded as well. General rules of our own add what
the published ones don't name: tables, markup, logs, broken encodings, filler. RULES tells which
is which.

Lines are judged whatever their length, and each text as a whole; there are no prefixes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French, Spanish, Italian, Finnish.
COMMON_WORDS = """
the of and to in a is that for it on was as with by at from be are this have has had not but
they he she which an or after before although because if were no
der die das und den von zu mit ist im auf für nicht ein eine dem des als nach bei wurde aber wie
la les du et un une dans que qui pour pas sur est au aux par plus avec
el los las y en se una con por más como pero su al del es era
il lo gli di che è e per non si della dei nella alla più ma ha hanno sono
ja oli ei että joka ovat mutta kun kuin ennen alle niin sekä
""".split()

LETTER, LATIN, VOWEL, DIGIT, SPACE, SYMBOL, BROKEN, UPPER = (1 << i for i in range(8))
KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)

#: Characters handled at once; bounds the memory of a worker, except for single longer texts.
CHUNK = 400_000

# Thresholds of the published heuristics for web text.
MOST_SYMBOLS = 0.1  # per word
LEAST_WORD, MOST_WORD = 3, 10  # mean word length
LEAST_ALPHABETIC = 0.8  # tokens with a letter
SHORT_ITEM_WORDS = 5  # a line of fewer words without final punctuation is no sentence
MOST_DUPLICATE_LINES = 0.3

# Fixed thresholds of the other rules.
LONG_TOKEN = 35
FEWEST_VOWELS = 0.25
BROKEN_SHARE = 0.03
TOP_WORD_SHARE = 0.15
MOST_COMMON = 0.55
RULING_SHARE = 0.3
CONSONANT_RUNS = 0.3

_LOG = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S* ")
_CODE = re.compile(
    r"</?(?:div|span|img|br|script|style|a|p|ul|li|iframe|nav)\b[^>]*>|&(?:nbsp|gt|lt|amp|quot);|\bfunction\s*\w*\(|\bvar\s+\w+\s*="
    r"|[.#][\w-]+\{[^}]*\}|^\s*[\[{]+\"\w+\":|\b\w+\([^)]*\)\s*[;{]"
)
_MARKUP_TABLE = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_RULER = re.compile(r"^[\s|+=:_-]{4,}$")
_HEX = re.compile(r"^\s*[0-9a-fA-F]{6,16}:?\s+(?:[0-9a-fA-F]{2,4}\s+){4}")
_BULLET = re.compile(r"^\s*(?:[-–—•*+>▪◦·‣●○■□✓✔→]|\[[ xX]\]|\(?[1-9]\d{0,3}[.)]|\(?[A-Za-z][.)]|[ivxIVX]{1,5}[.)])\s+\S")
_PAIR = re.compile(r"^\s*[^\W\d_][\w ]{0,24}:\s+\S.{0,45}$")
_GLOSS = re.compile(r"^\s*[^\W\d_][\w' -]{1,30}(?: [–=—-] \S|: (?:an?|the) ).*[^.!?…\s]\s*$")
_ITEMS = re.compile(r" / | · |; | \| | • |, ")
_SENTENCE_END = frozenset(".!?…")

_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point up to 0xFFFF: the flags, and the lower-case code. 0xFFFF stands for all above."""
    flags, lower = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint64)
    for code in range(0x10000):
        c = chr(code)
        category = unicodedata.category(c)
        if category[0] in "LM":
            base = unicodedata.normalize("NFD", c)[0].lower()
            flags[code] |= LETTER
            if code < 0x250:
                flags[code] |= LATIN
                if base in "aeiouyæøœı":
                    flags[code] |= VOWEL
            if category == "Lu":
                flags[code] |= UPPER
            if len(low := c.lower()) == 1:
                lower[code] = ord(low)
        elif category == "Nd":
            flags[code] |= DIGIT
        elif c.isspace():
            flags[code] |= SPACE
        elif c not in ".,;:!?'\"()-–—“”„«»’‘…/%&":
            flags[code] |= SYMBOL
    for c in "ÃÂâ€Å\x82\x9c\x9d\x94¤¬�œžŸ™Ä‡„":
        flags[ord(c)] |= BROKEN
    flags[0xFFFF] = SYMBOL
    return flags, lower


_cache: dict[str, object] = {}


def _lookup() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "tables" not in _cache:
        _cache["tables"] = _tables()
        hashes = [_hash_word(w) for w in COMMON_WORDS]
        _cache["common"] = np.array(sorted(set(hashes)), dtype=np.uint64)
    flags, lower = _cache["tables"]  # type: ignore[misc]
    return flags, lower, _cache["common"]  # type: ignore[return-value]


def _hash_word(word: str) -> int:
    return sum(ord(c) * pow(_BASE, i, 1 << 64) for i, c in enumerate(word)) & _MASK


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base, and their inverses modulo 2**64."""
    if len(_cache.get("powers", ((),))[0]) < n:
        n = max(n, 2 * CHUNK)
        both = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, x, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _cache["powers"] = tuple(both)
    return _cache["powers"]  # type: ignore[return-value]


class Lines:
    """The lines of some texts with their counts, one array entry per line that is not blank."""

    def __init__(self, texts: list[str]) -> None:
        split = [t.replace("\r\n", "\n").replace("\r", "\n").split("\n") for t in texts]
        flat = [x for lines in split for x in lines]
        of = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        # Surrogates that stand alone count as one code point each.
        codes = np.frombuffer(("\n".join(flat) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        flag_of, lower_of, common = _lookup()
        capped = np.minimum(codes, 0xFFFF)
        self.flags, low = flag_of[capped], lower_of[capped]
        self.codes, self.starts = codes, starts
        self.chars = lengths - (self.total((self.flags & SPACE) > 0) - 1)
        keep = np.flatnonzero(self.chars > 0)
        self.keep, self.doc, self.n_docs = keep, of[keep], len(texts)
        self.text = [flat[i] for i in keep]
        self.length = self.chars[keep].astype(np.float64)
        self._words(low, common)
        self._tokens()
        self._sentences()

    def total(self, mask: np.ndarray) -> np.ndarray:
        """The sum of a mask over each line, blank lines included."""
        return np.add.reduceat(mask.view(np.int8) if mask.dtype == bool else mask, self.starts, dtype=np.int64)

    def flagged(self, flag: int) -> np.ndarray:
        return self.total((self.flags & flag) > 0)[self.keep]

    def has(self, char: str) -> np.ndarray:
        return self.total(self.codes == ord(char))[self.keep]

    def _line_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def _runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts and ends of the runs of a mask (which is false at every line's end)."""
        edge = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)

    def _hash(self, low: np.ndarray) -> None:
        powers, self.inverse = _powers(len(low) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(low * powers[: len(low)])])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]

    def _words(self, low: np.ndarray, common: np.ndarray) -> None:
        self._hash(low)
        s, e = self._runs((self.flags & LETTER) > 0)
        h = self.hashes(s, e)
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        is_common = common[at] == h
        line = self._line_of(s)
        n = len(self.starts)
        self.words = np.bincount(line, minlength=n)[self.keep]
        self.common = np.bincount(line, weights=is_common, minlength=n)[self.keep]
        self.word_chars = np.bincount(line, weights=e - s, minlength=n)[self.keep]
        rs, re_ = self._runs((self.flags & (LATIN | VOWEL)) == LATIN)
        hard = re_ - rs >= 4
        self.hard = np.bincount(self._line_of(rs[hard]), minlength=n)[self.keep]
        capital = (self.flags[s] & UPPER) > 0
        self.capitals = np.bincount(line, weights=capital, minlength=n)[self.keep]
        # The most frequent word that is not common, in lines where few words are.
        few = np.zeros(n, bool)
        few[self.keep] = (self.words >= 8) & (self.common < 0.3 * self.words)
        pick = few[line] & ~is_common
        top = np.zeros(n)
        if pick.any():
            order = np.lexsort((h[pick], line[pick]))
            ls, hs = line[pick][order], h[pick][order]
            new = np.flatnonzero(np.concatenate([[True], (ls[1:] != ls[:-1]) | (hs[1:] != hs[:-1])]))
            np.maximum.at(top, ls[new], np.diff(np.append(new, len(ls))))
        self.top_word = top[self.keep]

    def _tokens(self) -> None:
        """Runs of anything but white space: how many, the long ones, gaps, leading punctuation."""
        s, e = self._runs((self.flags & SPACE) == 0)
        line, n = self._line_of(s), len(self.starts)
        self.tokens = np.bincount(line, minlength=n)[self.keep]
        size = e - s
        self.long_chars = np.bincount(line, weights=np.where(size >= LONG_TOKEN, size, 0), minlength=n)[self.keep]
        first, second = self.codes[s], self.codes[np.minimum(s + 1, len(self.codes) - 1)]
        letters = np.concatenate([[0], np.cumsum((self.flags & LETTER) > 0)])
        self.alphabetic = np.bincount(line, weights=letters[e] > letters[s], minlength=n)[self.keep]
        is_letter = (self.flags[np.minimum(s + 1, len(self.codes) - 1)] & LETTER) > 0
        leading = ((first == 46) | (first == 44)) & is_letter & (second > 0)
        self.leading = np.bincount(line, weights=leading, minlength=n)[self.keep]
        gap = np.zeros(len(s))
        if len(s) > 1:
            gap[1:] = np.where(line[1:] == line[:-1], s[1:] - e[:-1], 0)
        self.gaps = np.bincount(line, weights=gap >= 2, minlength=n)[self.keep]
        self.wide_gaps = np.bincount(line, weights=gap >= 3, minlength=n)[self.keep]

    def _sentences(self) -> None:
        codes, flags = self.codes, self.flags
        after = np.append(flags[1:], np.uint8(SPACE))
        after2 = np.append(after[1:], np.uint8(SPACE))
        stop = np.isin(codes, [ord(c) for c in _SENTENCE_END])
        quote = np.isin(np.append(codes[1:], 10), [ord(c) for c in "\"'”’»)“"])
        ends = stop & (((after & SPACE) > 0) | (quote & ((after2 & SPACE) > 0)))
        self.stops = self.total(ends)[self.keep]
        last = self._last_visible()
        self.ends_sentence = stop[last] | (np.isin(codes[last], [ord(c) for c in "\"'”’»)“"]) & stop[np.maximum(last - 1, 0)])
        self.ends_ellipsis = (codes[last] == ord("…")) | ((codes[last] == 46) & (codes[np.maximum(last - 1, 0)] == 46))
        # Separators glued to what follows, as in rows of cells, but not within numbers.
        glued = ((codes == 44) | (codes == 59)) & ((after & (SPACE | DIGIT)) == 0)
        glued |= ((codes == 44) | (codes == 59)) & ((after & DIGIT) > 0) & ((np.append(np.uint8(0), flags[:-1]) & DIGIT) == 0)
        glued |= (codes == 59) & ((after & DIGIT) > 0)
        closing = quote & ((after2 & SPACE) > 0)
        self.glued = self.total(glued & ~closing)[self.keep]
        self._repeats(ends)

    def _last_visible(self) -> np.ndarray:
        visible = np.where((self.flags & SPACE) == 0, np.arange(len(self.flags)), 0)
        return np.maximum.reduceat(visible, self.starts)[self.keep]

    def _repeats(self, ends: np.ndarray) -> None:
        """Per line, the characters of sentences that the text repeats at once or over and over,
        and how often the whole line is in the text."""
        e = np.flatnonzero(ends | (self.codes == 10))
        s = np.concatenate([[0], e[:-1] + 1])
        # The white space before a sentence is no part of it.
        skip = (self.flags[np.minimum(s, len(self.flags) - 1)] & SPACE) > 0
        s = np.minimum(np.where(skip, s + 1, s), e)
        ok = e - s >= 2
        s, e = s[ok], e[ok]
        line, size = self._line_of(s), e - s + 1
        doc_of_line = np.full(len(self.starts), -1)
        doc_of_line[self.keep] = self.doc
        h, doc = self.hashes(s, e), doc_of_line[line]
        again, many = _grouped(doc, h)
        first = np.ones(len(s), bool)
        first[again] = False
        at_once = np.zeros(len(s), bool)
        at_once[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        visible = np.bincount(self.doc, weights=self.length, minlength=self.n_docs)
        ruling = (many >= 4) & (many * size >= RULING_SHARE * visible[doc])
        self.repeated = np.bincount(line, weights=np.where((at_once | ruling) & ~first, size, 0), minlength=len(self.starts))[self.keep]
        lengths = np.diff(np.append(self.starts, len(self.codes)))[self.keep] - 1
        whole = self.hashes(self.starts[self.keep], self.starts[self.keep] + lengths)
        self.times = _grouped(self.doc, whole)[1]


def _grouped(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places that repeat an earlier one, how often each (doc, h) occurs)."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((np.arange(len(h)), h, doc))
    hs, ds = h[order], doc[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])
    group = np.cumsum(new) - 1
    many = np.empty(len(h), np.int64)
    many[order] = np.bincount(group)[group]
    return order[~new], many


#: The rules of lines in the order in which they are tried: the reason recorded, what a line that
#: fails it is, and whether its threshold is one of the published ones or an addition of ours.
RULES = (
    ("prose", PROSE, False),
    ("log line", JUNK, False), ("code or page markup", JUNK, False), ("memory dump", JUNK, False), ("unbroken token", JUNK, False),
    ("broken encoding", JUNK, False), ("symbols", JUNK, False),
    ("table markup", TABLE, False), ("cells between bars", TABLE, False), ("cells between tabs", TABLE, False), ("cells between separators", TABLE, False),
    ("double gaps", JUNK, False), ("aligned cells", TABLE, False), ("repeated word", JUNK, False),
    ("bullet", LIST, True), ("few vowels", JUNK, False), ("reversed", JUNK, False), ("inline items", LIST, False),
    ("more than 0.1 symbols per word", JUNK, True), ("mean word length outside 3 to 10", JUNK, True), ("fewer than 0.8 of words with a letter", JUNK, True),
    ("more common words than prose has", JUNK, False), ("duplicate lines", JUNK, True),
    ("name and value", LIST, False), ("definition", LIST, False), ("fewer than 5 words and no end of a sentence", LIST, True),
    ("repeated sentence", JUNK, False),
)
REASONS = tuple(reason for reason, _, _ in RULES)
KIND_OF = np.array([kind for _, kind, _ in RULES])


def judge(lines: Lines) -> np.ndarray:
    """The number of the reason (see REASONS) of each line; 0 is prose."""
    n = len(lines.text)
    length, words, tokens = lines.length, np.maximum(lines.words, 1), np.maximum(lines.tokens, 1)
    letters, latin, digits = lines.flagged(LETTER), lines.flagged(LATIN), lines.flagged(DIGIT)
    match = lambda pattern, where: _each(pattern, lines.text, where)
    share = lines.common / words
    bars, tabs = lines.has("|"), lines.has("\t")
    sure_prose = (share >= 0.3) & (lines.words >= 8) & (lines.flagged(BROKEN) == 0) & (bars == 0) & (tabs == 0) & (lines.glued == 0) & (lines.has("<") == 0)
    sure_prose &= (lines.leading == 0) & (lines.gaps == 0) & (lines.has("{") == 0)
    open_ = ~sure_prose
    odd = open_ & ((lines.flagged(SYMBOL) > 0) | (digits > 0))
    reason = np.zeros(n, np.int64)

    def rule(name: str, mask: np.ndarray) -> None:
        reason[(reason == 0) & mask] = REASONS.index(name)

    rule("log line", match(_LOG, open_ & (digits >= 14)))
    markup = match(_MARKUP_TABLE, open_ & (lines.has("<") > 0))
    rule("code or page markup", ~markup & match(_CODE, odd | (open_ & (lines.has("(") > 0))))
    rule("memory dump", match(_HEX, open_ & (digits >= 6)))
    ruler = match(_RULER, open_ & (letters == 0) & (length >= 4))
    rule("unbroken token", open_ & (lines.long_chars > 0.5 * length) & (bars < 2) & ~markup & ~ruler)
    broken = lines.flagged(BROKEN)
    rule("broken encoding", (broken > BROKEN_SHARE * length) & (broken >= 2))
    rule("symbols", open_ & (letters + digits < 0.25 * length) & ~ruler & ~markup)
    rule("table markup", markup)
    rule("cells between bars", open_ & ((bars >= 2) | ruler))
    rule("cells between tabs", open_ & (tabs >= 1) & (lines.tokens >= 2))
    rule("cells between separators", open_ & (lines.glued >= 1) & (length < 45.0 * (lines.glued + 1)) & (lines.stops <= 1))
    double = lines.gaps >= 0.8 * (tokens - 1)
    rule("double gaps", open_ & (lines.tokens >= 9) & double & (lines.wide_gaps <= 0.2 * tokens) & (latin > 0) & (lines.flagged(VOWEL) < 0.3 * np.maximum(latin, 1)))
    rule("aligned cells", open_ & ((lines.wide_gaps >= 1) | ((lines.gaps >= 1) & (lines.tokens <= 24))))
    rule("repeated word", open_ & (lines.words >= 8) & (lines.top_word >= 4) & (lines.top_word >= TOP_WORD_SHARE * words))
    bullet = match(_BULLET, np.ones(n, bool))
    rule("bullet", bullet)
    gibberish = (lines.flagged(VOWEL) < FEWEST_VOWELS * latin) | ((share < 0.1) & (lines.hard >= CONSONANT_RUNS * words))
    rare = lines.total(np.isin(lines.codes, [ord(c) for c in "jkqwxz"]))[lines.keep]
    lower = (lines.capitals == 0) & (lines.common == 0) & (lines.words >= 3) & (digits == 0) & (lines.stops == 0)
    gibberish |= lower & ((lines.hard >= 1) | (rare > 0.08 * letters))
    rule("few vowels", open_ & (latin >= 15) & gibberish)
    rule("reversed", open_ & (lines.leading >= 1) & (lines.leading >= lines.stops) & (share < 0.25))
    items = np.array([len(_ITEMS.findall(t)) if m else 0 for t, m in zip(lines.text, open_ & (share < 0.15) & (lines.words >= 4))])
    rule("inline items", (items >= 4) & (tokens < 5.0 * (items + 1)) & (lines.stops <= 1))
    loose = ~lines.ends_sentence
    full = lines.words >= 8
    rule("more than 0.1 symbols per word", full & (lines.flagged(SYMBOL) > MOST_SYMBOLS * words))
    mean = lines.word_chars / words
    # Languages that join words have longer ones, but their prose has common words all the same.
    rule("mean word length outside 3 to 10", full & ((mean < LEAST_WORD) | (mean > MOST_WORD)) & ((share < 0.1) | (share > MOST_COMMON)))
    rule("fewer than 0.8 of words with a letter", full & loose & (lines.alphabetic < LEAST_ALPHABETIC * tokens) & (share < 0.2))
    # A wrapped line of prose may be full of common words; its text is not.
    of_text = np.bincount(lines.doc, weights=lines.common, minlength=lines.n_docs) / np.maximum(np.bincount(lines.doc, weights=lines.words, minlength=lines.n_docs), 1)
    rule("more common words than prose has", (share > MOST_COMMON) & ((lines.words >= 25) | ((lines.words >= 12) & (of_text[lines.doc] > MOST_COMMON - 0.05))))
    rule("duplicate lines", loose & (lines.times >= 4) & (lines.words <= 12) & ~match(_PAIR, loose & (lines.times >= 4)))
    rule("name and value", match(_PAIR, loose & (lines.words <= 8) & (share < 0.35)))
    rule("definition", match(_GLOSS, loose & (lines.words <= 20)))
    names = (lines.capitals == lines.words) | (lines.words <= 2)
    rule("fewer than 5 words and no end of a sentence", loose & (lines.words <= SHORT_ITEM_WORDS) & names & (lines.words + digits > 0) & (share < 0.3) & (length < 60))
    rule("repeated sentence", lines.repeated > 0.5 * length)
    return _as_headings(lines, reason)


def _as_headings(lines: Lines, reason: np.ndarray) -> np.ndarray:
    """Single short lines next to prose only, such as headings and ends of wrapped lines, are prose."""
    weak = np.isin(reason, [REASONS.index("fewer than 5 words and no end of a sentence"), REASONS.index("name and value")])
    n = len(reason)
    if not n:
        return reason
    no, yes = np.zeros(1, bool), np.ones(1, bool)
    same = lines.doc[1:] == lines.doc[:-1]
    edge_before, edge_after = np.concatenate([yes, ~same]), np.concatenate([~same, yes])
    prose_before = np.concatenate([no, (reason[:-1] == 0)]) & ~edge_before
    prose_after = np.concatenate([(reason[1:] == 0), no]) & ~edge_after
    alone = (prose_before & (prose_after | edge_after)) | (edge_before & prose_after)
    return np.where(weak & alone, 0, reason)


def _each(pattern: re.Pattern, texts: list[str], where: np.ndarray) -> np.ndarray:
    found = np.zeros(len(texts), bool)
    for i in np.flatnonzero(where):
        found[i] = pattern.search(texts[i]) is not None
    return found


COLUMNS = {
    "n_words": "long", "mean_word_length": "double", "symbol_ratio": "double", "punctuated_lines": "double",
    "bullet_lines": "double", "ellipsis_lines": "double", "common_words": "double", "prose_chars": "long",
    "list_chars": "long", "table_chars": "long", "junk_chars": "long", "form": "string", "reasons": "array<string>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())


def published_failures(f: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
    """The published document rules for web prose that a text fails, with their thresholds."""
    return [
        ("fewer than 50 or more than 100000 words", (f["n_words"] < 50) | (f["n_words"] > 100_000)),
        ("mean word length outside 3 to 10", (f["mean_word_length"] < LEAST_WORD) | (f["mean_word_length"] > MOST_WORD)),
        ("more than 0.1 symbols per word", f["symbol_ratio"] > MOST_SYMBOLS),
        ("more than 0.9 of lines are bullets", f["bullet_lines"] > 0.9),
        ("more than 0.3 of lines end in an ellipsis", f["ellipsis_lines"] > 0.3),
        ("fewer than 2 common words", f["common"] < 2),
        ("fewer than 0.8 of words with a letter", f["alphabetic"] < LEAST_ALPHABETIC),
        ("more than 0.3 of lines are duplicates", f["duplicates"] > MOST_DUPLICATE_LINES),
    ]


def document_statistics(texts: list[str]) -> pd.DataFrame:
    """The statistics of some texts, one row per text, with the columns of COLUMNS."""
    lines = Lines(texts)
    reason = judge(lines)
    kind, n = KIND_OF[reason], lines.n_docs
    by = lambda weights: np.bincount(lines.doc, weights=weights, minlength=n)
    chars = np.stack([by(np.where(kind == k, lines.length, 0)) for k in range(4)])
    n_lines, words = np.maximum(by(np.ones(len(reason))), 1), by(lines.words)
    f = {
        "n_words": words.astype(np.int64),
        "mean_word_length": by(lines.word_chars) / np.maximum(words, 1),
        "symbol_ratio": by(lines.flagged(SYMBOL)) / np.maximum(words, 1),
        "punctuated_lines": by(lines.ends_sentence) / n_lines,
        "bullet_lines": by(reason == REASONS.index("bullet")) / n_lines,
        "ellipsis_lines": by(lines.ends_ellipsis) / n_lines,
        "common": by(lines.common),
        "alphabetic": by(lines.alphabetic) / np.maximum(by(lines.tokens), 1),
        "duplicates": by(1 - 1 / np.maximum(lines.times, 1)) / n_lines,
    }
    total = chars.sum(axis=0)
    form = np.where(chars[0] * 2 >= total, PROSE, 1 + np.argmax(chars[1:], axis=0))
    reasons: list[list[str]] = [[] for _ in range(n)]
    for d, r in np.unique(np.stack([lines.doc, reason], axis=1)[reason > 0], axis=0):
        reasons[d].append(f"{KINDS[KIND_OF[r]]}: {REASONS[r]}{' (published)' if RULES[r][2] else ''}")
    for name, mask in published_failures(f):
        for d in np.flatnonzero(mask & (total > 0)):
            reasons[d].append(f"rule: {name}")
    frame = pd.DataFrame({k: f[k] for k in COLUMNS if k in f} | {"common_words": f["common"] / np.maximum(words, 1)})
    for k, name in enumerate(KINDS):
        frame[f"{name}_chars"] = chars[k].astype(np.int64)
    frame["form"] = np.where(total > 0, np.array(KINDS, dtype=object)[form], None)
    frame["reasons"] = reasons
    return frame[list(COLUMNS)]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK characters in all."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def text_statistics(text: Column | str) -> Column:
    """The statistics of a text as a struct with the fields of COLUMNS.

    `form` is prose, list, table or junk by the larger part of the visible characters (prose if
    half of them are), null for null, empty and blank texts, whose counts are 0 and whose
    reasons are empty.
    """

    @F.pandas_udf(SCHEMA)
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            parts = [document_statistics(part) for part in chunks(texts)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=list(COLUMNS))

    return statistics(F.col(text) if isinstance(text, str) else text)


def quality(documents: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, *columns, statistics...): one row per document, texts left behind."""
    return documents.select("doc_id", *columns, text_statistics("text").alias("s")).select("doc_id", *columns, "s.*")
