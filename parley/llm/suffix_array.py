"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def _buckets(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum(sizes)
    return end - sizes, end


def _induce(text: np.ndarray, is_s: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffixes sorted by what the order of ``lms`` (sorted by whatever key)
    induces: leftmost-smaller positions at their buckets' ends, then larger-type
    suffixes from the left, then smaller-type ones from the right.

    A bucket's entries are scanned together; those they put into the bucket
    itself (runs of one symbol) are scanned in the next step.
    """
    n = len(text)
    head, tail = _buckets(sizes)
    sa = np.full(n, -1, dtype=np.int64)
    sym = text[lms]
    count = np.bincount(sym, minlength=len(sizes))
    first = np.cumsum(count) - count
    order = np.argsort(sym, kind="stable")
    sa[tail[sym[order]] - count[sym[order]] + np.arange(len(lms)) - first[sym[order]]] = lms[order]

    free = head.copy()
    sa_l = np.full(n, -1, dtype=np.int64)  # larger-type suffixes only

    def put(at: np.ndarray) -> None:
        """Append to the heads of their buckets, in order."""
        if not at.size:
            return
        s = text[at]
        o = np.argsort(s, kind="stable")
        s, at = s[o], at[o]
        new = np.r_[True, s[1:] != s[:-1]]
        start = np.flatnonzero(new)
        run = np.diff(np.r_[start, len(s)])
        offset = np.arange(len(s)) - np.repeat(start, run)
        sa_l[free[s] + offset] = at
        free[s[start]] += run

    def before(at: np.ndarray, smaller: bool) -> np.ndarray:
        j = at[at > 0] - 1
        return j[is_s[j] == smaller]

    if not is_s[n - 1]:
        put(np.array([n - 1]))
    used = np.flatnonzero(sizes)
    for c in used:
        lo = head[c]
        while lo < free[c]:  # larger types of c come first, and may grow
            hi = free[c]
            put(before(sa_l[lo:hi], False))
            lo = hi
        block = sa[tail[c] - count[c]:tail[c]]
        put(before(block, False))

    free = tail.copy()
    sa_s = np.full(n, -1, dtype=np.int64)

    def put_back(at: np.ndarray) -> None:
        """Prepend to the tails of their buckets; ``at`` is in scan order."""
        if not at.size:
            return
        s = text[at]
        o = np.argsort(s, kind="stable")
        s, at = s[o], at[o]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        run = np.diff(np.r_[start, len(s)])
        offset = np.arange(len(s)) - np.repeat(start, run)
        sa_s[free[s] - 1 - offset] = at
        free[s[start]] -= run

    larger_end = head + np.bincount(text[sa_l[sa_l >= 0]], minlength=len(sizes))
    for c in used[::-1]:
        hi = tail[c]
        while hi > free[c]:
            lo = free[c]
            put_back(before(sa_s[lo:hi][::-1], True))
            hi = lo
        put_back(before(sa_l[head[c]:larger_end[c]][::-1], True))
    out = sa_l
    s_at = sa_s >= 0
    out[s_at] = sa_s[s_at]
    return out


def _by_doubling(text: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array of a text over an alphabet about as large as itself (the
    names of a recursion), whose suffixes mostly differ early: sorted by as many
    symbols as a word holds, then those still equal by twice as many each time."""
    n = len(text)
    bits = int(alphabet).bit_length()  # 0 is what lies past the end
    span = max(1, min(n, 62 // bits))
    key = np.zeros(n, dtype=np.int64)
    for j in range(span):
        key <<= bits
        key[:n - j] |= text[j:] + 1
    sa = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)  # the first place of those still equal
    tied, at, key = np.arange(n), sa, key[sa]
    while True:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        run = np.diff(np.r_[first, len(at)])
        rank[at] = np.repeat(tied[first], run)
        tied = tied[np.repeat(run > 1, run)]
        if not tied.size:
            return sa
        at = sa[tied]
        after = at + span
        inside = after < n
        key = rank[at] * (n + 1)
        key[inside] += rank[after[inside]] + 1
        o = np.argsort(key)
        at, key = at[o], key[o]
        sa[tied] = at
        span *= 2


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings, in text order; equal ones
    (compared symbol by symbol, all still equal at once) get one name."""
    n = len(text)
    end = np.r_[lms[1:], n - 1] + 1  # a substring reaches to the next such position
    length = end - lms
    at = np.searchsorted(lms, order)
    a, b = order[:-1], order[1:]
    la, lb = length[at[:-1]], length[at[1:]]
    differ = la != lb
    open_ = np.flatnonzero(~differ)
    step = 0
    while open_.size:
        open_ = open_[la[open_] > step]
        ne = text[a[open_] + step] != text[b[open_] + step]
        differ[open_[ne]] = True
        open_ = open_[~ne]
        step += 1
    name = np.r_[0, np.cumsum(differ)]
    out = np.empty(len(lms), dtype=np.int64)
    out[at] = name
    return out, int(name[-1]) + 1


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Start positions of the suffixes in order. A suffix that is a prefix of
    another comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    if alphabet > 4 * 256:
        return _by_doubling(text, alphabet)
    # Smaller type: text[i:] < text[i + 1:]; the last suffix is of the larger
    # type (the end of the text is the smallest symbol).
    less = np.r_[text[:-1] < text[1:], False]
    equal = np.r_[text[:-1] == text[1:], False]
    decided = np.flatnonzero(~equal)
    is_s = np.repeat(less[decided], np.diff(np.r_[-1, decided]))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sizes = np.bincount(text, minlength=alphabet)
    sa = _induce(text, is_s, sizes, lms)
    if len(lms) > 1:
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        names, k = _names(text, lms, order)
        order = lms[suffix_array(names, k)] if k < len(lms) else order
        sa = _induce(text, is_s, sizes, order)
    return sa


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each text position, how many symbols its suffix shares with the one
    before it in the order, ``limit`` at most.

    Where the symbols before the two positions are equal too, the value is one
    less than that of the position before; only the others are compared, all
    still equal at once, and their values carried on.
    """
    n = len(text)
    prev = np.empty(n, dtype=np.int64)
    prev[sa[1:]] = sa[:-1]
    prev[sa[0]] = -1
    at = np.arange(n)
    follows = np.zeros(n, dtype=bool)
    ok = np.flatnonzero((prev[1:] > 0) & (prev[:-1] >= 0)) + 1
    follows[ok] = (text[ok - 1] == text[prev[ok] - 1]) & (prev[ok - 1] == prev[ok] - 1)
    start = np.flatnonzero(~follows)
    value = np.zeros(len(start), dtype=np.int64)
    runs = np.diff(np.r_[start, n])
    most = limit + runs - 1  # symbols to look at: up to the limit past the run's end
    open_ = np.flatnonzero(prev[start] >= 0)
    step = 0
    while open_.size:
        i = start[open_] + step
        j = prev[start[open_]] + step
        inside = (i < n) & (j < n) & (step < most[open_])
        open_, i, j = open_[inside], i[inside], j[inside]
        same = text[i] == text[j]
        open_ = open_[same]
        step += 1
        value[open_] = step
    whole = np.repeat(value, runs) - (at - np.repeat(start, runs))
    return np.clip(whole, 0, limit)
