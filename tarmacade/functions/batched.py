"""The kernels of many pairs of texts at once, on bits: exactly the values of `kernels` and `composite.edit_similarity`.

A text of up to LONGEST letters is a row of code points, and a letter's places in it are the bits of a
word. So jaro's greedy matching, edits and multisets of n-grams are a few operations on words per letter, for all pairs at
a time. Longer texts go to the kernels one by one.
"""

from __future__ import annotations

import numpy as np

from tarmacade.functions.kernels import dice, jaro_winkler

#: Letters of a text that fit into a word of bits.
LONGEST = 63
_NONE, _ONE = np.uint64(0), np.uint64(1)
#: The lowest n bits.
FULL = np.array([(1 << n) - 1 for n in range(LONGEST + 1)], np.uint64)
#: By letter and reach + 1: the places that a letter may match.
_WINDOW = np.array([[sum(1 << j for j in range(max(0, i - r), min(LONGEST, i + r + 1))) for r in range(-1, LONGEST)] for i in range(LONGEST)], np.uint64)


def lettered(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points + 1 of each text, 0 beyond its end, and lengths; a text longer than `width` is left empty."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    fits = size <= width
    short = texts if fits.all() else [t if f else "" for t, f in zip(texts, fits)]
    out = np.zeros((len(texts), width), np.uint32)
    out[np.arange(width) < np.where(fits, size, 0)[:, None]] = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32) + 1
    return out, size


def places(equal: np.ndarray) -> np.ndarray:
    """Rows of truths, a multiple of 32 and at most 64, as bits."""
    width = equal.shape[1]
    return np.packbits(equal, axis=1, bitorder="little").view(np.uint32 if width == 32 else np.uint64)[:, 0].astype(np.uint64)


def winkler(masks: list[np.ndarray], la: np.ndarray | int, lb: np.ndarray, prefix: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Jaro-Winkler from the places of each letter of a in b, lengths, common leading letters up to four, and equality."""
    reach, whole = np.maximum(la, lb) // 2, FULL[lb]
    free, lows = whole.copy(), []
    for i, m in enumerate(masks):
        hit = m & free & _WINDOW[i][reach]
        low = hit & (~hit + _ONE)
        free ^= low
        lows.append(low)
    used = whole & ~free
    matched = np.bitwise_count(used).astype(np.float64)
    wrong = np.zeros(len(lb), np.int64)
    for m, low in zip(masks, lows):
        first = np.where(low != _NONE, used & (~used + _ONE), _NONE)
        wrong += (first != _NONE) & ((m & first) == _NONE)
        used ^= first
    with np.errstate(divide="ignore", invalid="ignore"):
        j = (matched / la + matched / lb + (matched - wrong // 2) / matched) / 3
    j = np.where(equal, 1.0, np.where(matched > 0, j, 0.0))
    return np.where(j < 0.70, j, j + prefix * 0.1 * (1 - j))


def gram_places(masks: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The places in b of each n-gram of a."""
    found = []
    for i in range(len(masks) - n + 1):
        m = masks[i]
        for k in range(1, n):
            m = m & (masks[i + k] >> np.uint64(k))
        found.append(m)
    return found


def shared_grams(grams: list[np.ndarray], n: int, lb: np.ndarray) -> np.ndarray:
    """How many n-grams the multisets have in common: each of a takes one place of b."""
    free, shared = FULL[np.maximum(lb - n + 1, 0)], np.zeros(len(lb), np.int64)
    for m in grams:
        hit = m & free
        low = hit & (~hit + _ONE)
        free = free ^ low
        shared += low != _NONE
    return shared


def multiset_dice(masks: list[np.ndarray], n: int, la: np.ndarray | int, lb: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """`kernels.dice` of n-grams."""
    total = np.maximum(la - n + 1, 0) + np.maximum(lb - n + 1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.where(total > 0, 2 * shared_grams(gram_places(masks, n), n, lb) / total, 0.0)
    if n > 2 and ((short := np.minimum(la, lb) < n) & ~equal).any():
        found = np.where(short, multiset_dice(masks, n - 1, la, lb, equal), found)
    return np.where(equal, np.where(np.asarray(lb) > 0, 1.0, 0.0), found)


def _edits(masks: list[np.ndarray], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edits between a and b, a column of the table at a time as differences in bits."""
    plus, minus, edits = FULL[lb].copy(), np.zeros(len(lb), np.uint64), lb.astype(np.int64)
    last = np.where(lb > 0, _ONE << np.maximum(lb - 1, 0).astype(np.uint64), _NONE)
    for i, m in enumerate(masks):
        down = m | minus
        right = (((m & plus) + plus) ^ plus) | m
        up = minus | ~(right | plus)
        fall = plus & right
        edits += (i < la) * (((up & last) != _NONE).astype(np.int64) - ((fall & last) != _NONE))
        up, fall = (up << _ONE) | _ONE, fall << _ONE
        plus, minus = fall | ~(down | up), up & down
    return edits


def measures(a: list[str], b: list[str], triples: bool = True) -> np.ndarray:
    """Jaro-Winkler, edit similarity and Dice of pairs and (0 without `triples`) of triples of each two texts."""
    from tarmacade.functions.composite import edit_similarity

    out = np.zeros((len(a), 4))
    longer = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b)), np.int64, len(a))
    for low, high in ((-1, 16), (16, 32), (32, LONGEST)):
        if not len(at := np.flatnonzero((longer > low) & (longer <= high))):
            continue
        width = 32 if high <= 32 else 64
        (x, la), (y, lb) = (lettered([t[i] for i in at], width) for t in (a, b))
        equal = (x == y).all(axis=1)
        masks = [places(y == x[:, i : i + 1]) for i in range(int(la.max(initial=0)))]
        prefix = np.cumprod((x[:, :4] == y[:, :4]) & (x[:, :4] > 0), axis=1).sum(axis=1)
        out[at, 0] = winkler(masks, la, lb, prefix, equal)
        out[at, 1] = np.where((la > 0) & (lb > 0), 1.0 - _edits(masks, la, lb) / np.maximum(np.maximum(la, lb), 1), 0.0)
        out[at, 2] = multiset_dice(masks, 2, la, lb, equal)
        if triples:
            out[at, 3] = multiset_dice(masks, 3, la, lb, equal)
    for i in np.flatnonzero(longer > LONGEST):
        out[i] = jaro_winkler(a[i], b[i]), edit_similarity(a[i], b[i]), dice(a[i], b[i], 2), dice(a[i], b[i], 3) if triples else 0.0
    return out
