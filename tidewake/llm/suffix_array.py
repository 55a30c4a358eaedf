"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classed as larger (L) or smaller (S) than the next one. The leftmost smaller ones (LMS) are sorted by their
substrings, named, and if names repeat, sorted recursively; all others are induced in two linear scans. With a byte
alphabet a scan goes bucket by bucket in numpy, whole runs at a time; the recursive strings, whose alphabet is large, are
scanned element by element.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The last character is the unique least one."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    small = np.zeros(n, bool)
    small[-1] = True
    lengths = np.diff(np.concatenate([[-1], change]))
    small[:n - 1] = np.repeat(s[change] < s[change + 1], lengths)
    return small


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes from an order of the LMS ones, a bucket at a time."""
    n = len(s)
    sizes = np.bincount(s, minlength=alphabet)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    order = np.empty(n, np.int32)
    used = np.flatnonzero(sizes).tolist()

    def place(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Append suffixes to their buckets, in the order given, upwards or downwards."""
        chars = s[found]
        by = np.argsort(chars, kind="stable")
        found, chars = found[by], chars[by]
        first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        counts = np.diff(np.append(first, len(chars)))
        rank = np.arange(len(chars)) - np.repeat(first, counts)
        order[at[chars] + step * rank] = found
        at[chars[first]] += step * counts

    lms_chars = s[lms]
    by = np.argsort(lms_chars, kind="stable")
    seeds, bounds = lms[by], np.searchsorted(lms_chars[by], np.arange(alphabet + 1))
    head = starts.copy()
    for c in used:
        done = starts[c]
        while done < head[c]:
            now = order[done:head[c]]
            done = head[c]
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                place(before, head, 1)
        now = seeds[bounds[c]:bounds[c + 1]]
        before = now[now > 0] - 1
        if len(before):
            place(before, head, 1)
    tail = ends - 1
    large_end = head
    order[0] = n - 1
    for c in reversed(used):
        done = ends[c] - 1
        while tail[c] < done:
            now = order[tail[c] + 1:done + 1][::-1]
            done = tail[c]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                place(before, tail, -1)
        now = order[starts[c]:large_end[c]][::-1] if c else np.array([n - 1], np.int32)
        before = now[now > 0] - 1
        before = before[small[before]]
        if len(before):
            place(before, tail, -1)
    return order


def _induce_plain(s: list, small: list, lms: list, alphabet: int) -> list:
    """The same, one suffix at a time."""
    n = len(s)
    counts = [0] * (alphabet + 1)
    for c in s:
        counts[c + 1] += 1
    for c in range(alphabet):
        counts[c + 1] += counts[c]
    order = [-1] * n
    tail = counts[1:]
    for i in reversed(lms):
        c = s[i]
        tail[c] -= 1
        order[tail[c]] = i
    head = counts[:-1]
    for k in range(n):
        j = order[k] - 1
        if j >= 0 and not small[j]:
            c = s[j]
            order[head[c]] = j
            head[c] += 1
    tail = counts[1:]
    for k in range(n - 1, -1, -1):
        j = order[k] - 1
        if j >= 0 and small[j]:
            c = s[j]
            tail[c] -= 1
            order[tail[c]] = j
    return order


def _name(s: np.ndarray, ranked: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, in text order, from their sorted order. Equal substrings share a name."""
    n = len(s)
    length = np.zeros(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ranked[:-1], ranked[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        live = live[length[a[live]] > step]
        equal = s[a[live] + step] == s[b[live] + step]
        same[live[~equal]] = False
        live = live[equal]
        step += 1
    names = np.empty(n, np.int32)
    names[ranked] = np.concatenate([[0], np.cumsum(~same)])
    return names[lms]


def _sort(s: np.ndarray, alphabet: int) -> np.ndarray:
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if alphabet <= 1 << 10:
        s = s.astype(np.uint16)

        def induce(seeds: np.ndarray) -> np.ndarray:
            return _induce(s, small, seeds, alphabet)
    else:
        plain, plain_small = s.tolist(), small.tolist()

        def induce(seeds: np.ndarray) -> np.ndarray:
            return np.array(_induce_plain(plain, plain_small, seeds.tolist(), alphabet), np.int32)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        first = induce(lms)
        ranked = first[is_lms[first]]
        names = _name(s, ranked, lms)
        kinds = int(names.max()) + 1
        if kinds < len(lms):
            lms = lms[_sort(names, kinds)]
        else:
            lms = ranked
    return induce(lms)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an array of values 0 to 256; a suffix that is a prefix of another comes first."""
    if not len(text):
        return np.empty(0, np.int32)
    s = np.zeros(len(text) + 1, np.uint16)
    s[:-1] = text
    s[:-1] += 1
    return _sort(s, 258)[1:]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each suffix, in text order, what it shares with the one before it in suffix order.

    A value is one less than that of the position before wherever the two suffixes follow equal values. So only the others
    are compared, all together and four values at a time; the rest is filled in.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:] - 1, 0)])
    heads = np.flatnonzero(~reducible)
    shared = np.zeros(len(heads), np.int64)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = text
    words = np.zeros(n + 1, np.uint64)
    for k in range(4):
        words |= padded[k:k + n + 1] << np.uint64(16 * k)
    live = np.flatnonzero(before[heads] >= 0)
    while len(live):
        a, b = heads[live] + shared[live], before[heads[live]] + shared[live]
        equal = (a + 4 <= n) & (b + 4 <= n) & (words[np.minimum(a, n)] == words[np.minimum(b, n)])
        shared[live[equal]] += 4
        rest, live = live[~equal], live[equal]
        while len(rest):
            a, b = heads[rest] + shared[rest], before[heads[rest]] + shared[rest]
            inside = (a < n) & (b < n)
            rest, a, b = rest[inside], a[inside], b[inside]
            rest = rest[text[a] == text[b]]
            shared[rest] += 1
    total = np.zeros(n, np.int64)
    total[heads] = shared + heads
    last = np.maximum.accumulate(np.where(reducible, 0, place))
    return np.maximum(total[last] - place, 0)
