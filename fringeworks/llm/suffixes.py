"""Suffix arrays by induced sorting, and permuted longest-common-prefix arrays, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour.
Leftmost S suffixes (LMS) are sorted first: their substrings by one induction from
text order, then, where substrings are equal, by the order of the reduced string of
their names. From them two linear scans induce all others, the L suffixes bucket by
bucket upwards and the S suffixes downwards; a bucket's entries are handled as one
array, and those that lead into the same bucket as the next. Characters of 16 bits
sort by radix; comparisons take ``AHEAD`` characters at a time.
"""

from __future__ import annotations

import numpy as np

#: Characters, all under 512, in one 63-bit word.
AHEAD = 7


def words_ahead(s: np.ndarray) -> np.ndarray:
    """For each position the next ``AHEAD`` characters in one word, the first in the upper bits; 0 after the end."""
    padded = np.zeros(len(s) + AHEAD - 1, np.int64)
    padded[: len(s)] = s
    out = padded[: len(s)].copy()
    for k in range(1, AHEAD):
        out <<= 9
        out |= padded[k : k + len(s)]
    return out


def leading_equal(x: np.ndarray) -> np.ndarray:
    """How many characters two words have in common at their begin, from the words' exclusive or."""
    bits = np.frexp((x >> 9).astype(np.float64))[1]  # of 54 bits, of which the last is rounded: 55 at most
    return np.where(x >> 9 == 0, AHEAD - (x != 0), np.maximum(0, AHEAD - 1 - (bits + 8) // 9))


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is S; ``s`` ends in its only 0."""
    up = s[:-1] < s[1:]
    differs = np.r_[s[:-1] != s[1:], True]
    at = np.where(differs, np.arange(len(s)), len(s))
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next position whose neighbour differs
    return np.r_[up, True][nearest]


def _spread(found: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends each of ``found`` to the list of its character, in order."""
    order = np.argsort(chars, kind="stable")
    found, chars = found[order], chars[order]
    edges = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    for lo, hi in zip(edges, np.r_[edges[1:], len(chars)]):
        into[chars[lo]].append(found[lo:hi])


def induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order."""
    larger: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    first: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    _spread(lms, s[lms], first)

    def before(found: np.ndarray, want_s: bool) -> np.ndarray:
        found = found[found > 0] - 1
        return found[is_s[found] == want_s]

    for c in range(alphabet):
        batch = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64)
        larger[c] = []
        while len(batch):
            larger[c].append(batch)
            found = before(batch, False)
            chars = s[found]
            same = chars == c
            if not same.all():
                _spread(found[~same], chars[~same], larger)
            batch = found[same]
        if first[c]:
            found = before(np.concatenate(first[c]), False)
            if len(found):
                _spread(found, s[found], larger)
    for c in range(alphabet - 1, -1, -1):
        batch = np.concatenate(smaller[c]) if smaller[c] else np.zeros(0, np.int64)
        smaller[c] = []
        while len(batch):
            smaller[c].append(batch)
            found = before(batch, True)
            chars = s[found]
            same = chars == c
            if not same.all():
                _spread(found[~same], chars[~same], smaller)
            batch = found[same]
        if larger[c]:
            found = before(np.concatenate(larger[c])[::-1], True)
            if len(found):
                _spread(found, s[found], smaller)
    out = [np.array([len(s) - 1])]
    for c in range(1, alphabet):
        out += larger[c]
        if smaller[c]:
            out.append(np.concatenate(smaller[c])[::-1])
    return np.concatenate(out)


def names_of(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings (equal substrings, equal ranks), in text order."""
    end = np.full(len(s), len(s) - 1)
    end[lms[:-1]] = lms[1:]
    a, b = by_substring[:-1], by_substring[1:]
    size = end[a] - a + 1
    equal = size == end[b] - b + 1  # with the same characters, types are the same too: both end in an S suffix
    active, ahead = np.flatnonzero(equal), words_ahead(s)
    k = 0
    while len(active):
        differs = ahead[a[active] + k] ^ ahead[b[active] + k]
        unused = 9 * np.maximum(0, AHEAD - (size[active] - k))
        same = differs >> unused == 0
        equal[active[~same]] = False
        k += AHEAD
        active = active[same & (size[active] > k)]
    rank = np.empty(len(s), np.int64)
    rank[by_substring] = np.r_[0, np.cumsum(~equal)]
    return rank[lms]


def order_of_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of the reduced string in order: ranks of twice as many names at a time, of those that are still alike."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    key = names[order]
    rank = np.empty(n + 1, np.int64)  # where the suffixes alike begin in the order
    rank[n] = -1
    alike, idx, span = np.arange(n), order, 1
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        rank[idx] = np.repeat(alike[first], np.diff(np.r_[first, len(idx)]))
        more = ~(new & np.r_[new[1:], True])
        alike = alike[more]
        if not len(alike):
            return order
        idx = order[alike]
        key = rank[idx] * (n + 1) + rank[np.minimum(idx + span, n)] + 1
        by = np.argsort(key)
        idx, key = idx[by], key[by]
        order[alike] = idx
        span *= 2


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Order of the suffixes of ``s``, which ends in its only 0."""
    is_s = classify(s)
    lms = np.flatnonzero(is_s & np.r_[False, ~is_s[:-1]])
    if len(lms) > 1:
        found = induce(s, is_s, lms, alphabet)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        names = names_of(s, is_s, lms, found[is_lms[found]])
        lms = lms[order_of_names(names)]
    return induce(s, is_s, lms, alphabet)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position its predecessor in suffix order and their common prefix, which ends before characters up to ``stop``.

    Only where the characters to the left differ is the prefix measured; elsewhere it
    is one shorter than the neighbour's.
    """
    n = len(s)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    left = np.r_[-1, s[:-1].astype(np.int64)]
    at = np.arange(n)
    reducible = (before > 0) & (left == left[np.maximum(before, 0)]) & (left > stop) & (before >= 0)
    starts = np.flatnonzero(~reducible)
    stops = np.r_[np.flatnonzero(s <= stop), n]
    size = np.zeros(n, np.int64)
    active = starts[before[starts] >= 0]
    other, ahead = before[active], words_ahead(s)
    most = np.minimum(stops[np.searchsorted(stops, active)] - active, stops[np.searchsorted(stops, other)] - other)
    k = 0
    while len(active):
        equal = leading_equal(ahead[np.minimum(active + k, n - 1)] ^ ahead[np.minimum(other + k, n - 1)])
        size[active] = np.minimum(k + equal, most)
        k += AHEAD
        on = (equal == AHEAD) & (most > k)
        active, other, most = active[on], other[on], most[on]
    source = np.maximum.accumulate(np.where(reducible, -1, at))
    return before, np.maximum(size[source] - (at - source), 0)
