"""Suffix arrays by induced sorting, in numpy.

Suffixes are classified as L (larger than the next one) or S; an S suffix after
an L one is leftmost-smaller (LMS).  The substrings between LMS places are sorted
by one round of induction and named; names of neighbours are paired and renamed
until they are distinct or cover ``depth`` symbols; the order of LMS suffixes
then induces that of all L and all S suffixes.

Induction runs bucket by bucket instead of suffix by suffix: all that a finished
part of a bucket induces is placed at once, and what falls into the same bucket
(runs of one symbol) follows in further waves.
"""

from __future__ import annotations

import numpy as np


def _place(sa: np.ndarray, at: np.ndarray, found: np.ndarray, symbol: np.ndarray, down: bool) -> None:
    """Append ``found`` to its buckets in order; ``at`` are the bucket ends."""
    order = np.argsort(symbol, kind="stable")
    ordered = symbol[order]
    counts = np.bincount(symbol, minlength=len(at))
    first = np.cumsum(counts) - counts
    offset = np.arange(len(ordered)) - first[ordered]
    if down:
        sa[at[ordered] - 1 - offset] = found[order]
        at -= counts
    else:
        sa[at[ordered] + offset] = found[order]
        at += counts


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes, given the LMS places in their order."""
    k = len(ends) - 1
    sa = np.full(len(s), -1, np.int64)
    heads = ends[:-1].copy()
    of = s[lms]
    lms_first = np.searchsorted(of, np.arange(k + 1))
    for c in range(k):
        done = int(ends[c])
        while done < heads[c]:  # L suffixes of this bucket, in waves
            now, done = sa[done : heads[c]], int(heads[c])
            prior = now[now > 0] - 1
            prior = prior[~is_s[prior]]
            if len(prior):
                _place(sa, heads, prior, s[prior], False)
        part = lms[lms_first[c] : lms_first[c + 1]]
        prior = part[part > 0] - 1
        if len(prior):
            _place(sa, heads, prior, s[prior], False)
    tails = ends[1:].copy()
    for c in range(k - 1, -1, -1):
        done = int(ends[c + 1])
        while done > tails[c]:  # S suffixes of this bucket, from the end
            now, done = sa[tails[c] : done][::-1], int(tails[c])
            prior = now[now > 0] - 1
            prior = prior[is_s[prior]]
            if len(prior):
                _place(sa, tails, prior, s[prior], True)
        now = sa[ends[c] : heads[c]][::-1]
        prior = now[now > 0] - 1
        prior = prior[is_s[prior]]
        if len(prior):
            _place(sa, tails, prior, s[prior], True)
        if c == 0 and tails[0] > ends[0]:
            sa[ends[0]] = len(s) - 1
    return sa


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end marker is."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    at = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(s[:-1] < s[1:], True)
    return smaller[following]


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Places of suffixes in the order of (at least) their first ``depth`` symbols.

    ``s`` ends with 0, which occurs nowhere else.  Ties beyond the depth stand
    next to each other in some order.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    k = int(s.max()) + 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=k))])
    is_s = _types(s)
    lms = np.flatnonzero(is_s & np.append(False, ~is_s[:-1]))
    by_first = lms[np.argsort(s[lms], kind="stable")]
    sa = _induce(s, is_s, by_first, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    names = _named(s, lms, ordered)
    rank = _ranked(names, np.diff(np.append(lms, n)), depth)
    return _induce(s, is_s, lms[np.argsort(rank, kind="stable")], ends)


def _named(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Equal LMS substrings get equal names, in their order; in text order."""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live, off = np.flatnonzero(same), 0
    while len(live):
        equal = s[a[live] + off] == s[b[live] + off]
        same[live[~equal]] = False
        off += 1
        live = live[equal & (length[a[live]] > off)]
    name = np.empty(len(s), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _ranked(names: np.ndarray, span: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of the names: neighbours are paired and renamed
    until all differ or every name covers the depth."""
    rank, step, cover = names, 1, span
    while rank.max(initial=0) + 1 < len(rank) and cover.min() < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
        more = np.full(len(cover), depth, np.int64)  # beyond the end marker nothing is left to compare
        more[:-step] = cover[step:]
        cover = np.minimum(cover + more, depth)
        step *= 2
        if step >= len(rank):
            break
    return rank


def common_prefixes(s: np.ndarray, sa: np.ndarray, limit: int, where: np.ndarray | None = None) -> np.ndarray:
    """Per text place, the length (up to ``limit``) it shares with the suffix
    sorted just before it: common prefixes permuted to text order.  With
    ``where``, only for those places; 0 elsewhere."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([s, np.zeros(limit, s.dtype)])
    shared = np.zeros(n, np.int64)
    live, off = np.flatnonzero(phi >= 0 if where is None else (phi >= 0) & where), 0
    while len(live) and off < limit:
        width = min(8, limit - off)
        equal = np.ones(len(live), bool)
        count = np.zeros(len(live), np.int64)
        for j in range(width):
            equal &= padded[live + off + j] == padded[phi[live] + off + j]
            count += equal
        shared[live] += count
        live = live[equal]
        off += width
    return shared
