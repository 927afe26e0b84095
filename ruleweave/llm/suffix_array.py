"""Suffix arrays of byte strings by induced sorting, and permuted common
prefixes, in whole-array steps.

Suffixes are classified as smaller (S) or larger (L) than the next one.  The
substrings between leftmost S positions (LMS) are sorted by one induction over
the buckets of first bytes, and named; where names repeat, the named string (a
third as long) has its suffixes sorted in turn, by rank doubling, because a
bucket per name would leave nothing to do at once.  A second induction, from
the sorted LMS suffixes, gives the array in linear time.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes.  ``t`` ends with a byte 0 that is nowhere else."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    smaller = t[differs] < t[differs + 1]
    out = np.empty(n, bool)
    out[-1] = True
    out[:-1] = smaller[np.searchsorted(differs, np.arange(n - 1))]
    return out


def _place(sa, t, j, edge, step):
    """Put suffixes ``j``, in order, at the free edges of their buckets."""
    c = t[j]
    order = np.argsort(c, kind="stable")
    c, j = c[order], j[order]
    count = np.bincount(c, minlength=len(edge))
    first = np.cumsum(count) - count
    nth = np.arange(len(c)) - first[c]
    sa[edge[c] + nth if step > 0 else edge[c] - 1 - nth] = j
    edge += step * count


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Array of all suffixes from LMS suffixes in order (as far as known)."""
    n = len(t)
    count = np.bincount(t, minlength=256)
    ends = np.cumsum(count)
    starts = ends - count
    present = np.flatnonzero(count)
    sa = np.full(n, -1, np.int32)
    seeds = ends.copy()
    _place(sa, t, lms[::-1], seeds, -1)
    heads = starts.copy()
    for c in present:
        done = starts[c]
        while done < heads[c]:   # runs of one byte induce into their own bucket
            j = sa[done:heads[c]] - 1
            done = heads[c]
            j = j[j >= 0]
            _place(sa, t, j[~small[j]], heads, 1)
        j = sa[seeds[c]:ends[c]] - 1
        j = j[j >= 0]
        _place(sa, t, j[~small[j]], heads, 1)
    tails = ends.copy()
    tails[0], sa[0] = 0, n - 1
    for c in present[::-1]:
        done = ends[c]
        while done > tails[c]:
            j = sa[tails[c]:done][::-1] - 1
            done = tails[c]
            j = j[j >= 0]
            _place(sa, t, j[small[j]], tails, -1)
        j = sa[starts[c]:heads[c]][::-1] - 1
        j = j[j >= 0]
        _place(sa, t, j[small[j]], tails, -1)
    return sa


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of the named string; names are dense from 0 and in order."""
    n = len(names)
    sa = np.argsort(names, kind="stable")
    rank = (np.cumsum(np.bincount(names)) - np.bincount(names))[names]   # first place of the group
    size = np.bincount(rank, minlength=n)
    open_, step = np.flatnonzero(size[rank] > 1), 1
    while len(open_):
        after = open_ + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_] * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        base = rank[open_]
        group = np.concatenate([[True], base[1:] != base[:-1]])
        nth = np.arange(len(open_))
        place = base + nth - np.maximum.accumulate(np.where(group, nth, 0))
        sa[place] = open_
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(fresh, nth, 0))
        rank[open_] = place[first]
        alone = np.concatenate([fresh[1:], [True]]) & fresh
        open_ = open_[~alone]
        step *= 2
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes (uint8, each from 1 to 255)."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int32)
    t = np.concatenate([text, [0]]).astype(np.uint8)
    small = _types(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    order = _induce(t, small, lms)
    order = order[is_lms[order]]
    # name the LMS substrings; each ends with the next LMS position
    place = np.empty(n + 1, np.int32)
    place[lms] = np.arange(len(lms))
    size = np.diff(lms, append=n) + 1
    a, b = order[:-1], order[1:]
    same = size[place[a]] == size[place[b]]
    going, k = np.flatnonzero(same), 0
    lengths = size[place[a]]
    while len(going):
        differ = t[a[going] + k] != t[b[going] + k]
        same[going[differ]] = False
        k += 1
        going = going[~differ & (lengths[going] > k)]
    names = np.empty(len(lms), np.int64)
    names[place[order]] = np.cumsum(np.concatenate([[0], ~same]))
    if len(lms) > 1 and names.max() + 1 < len(lms):
        order = lms[_sort_names(names)]
    return _induce(t, small, order)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): the common prefix of each suffix with the one before it in
    the array, and that one (-1 for the first), both in text order.  Prefixes
    are compared only where they can't be told from the suffix before in the
    text."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = (phi > 0) & (at > 0)
    follows[follows] = text[at[follows] - 1] == text[phi[follows] - 1]
    start = np.flatnonzero(~follows)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    p, q = start, phi[start]
    known = np.zeros(len(start), np.int64)
    limit = np.where(q >= 0, n - np.maximum(p, q), 0)
    going = np.flatnonzero(limit > 0)
    while len(going):
        x = words[p[going] + known[going]] ^ words[q[going] + known[going]]
        low = x & (~x + np.uint64(1))   # lowest differing bit
        step = np.where(x == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 8).astype(np.int64))
        known[going] = np.minimum(known[going] + step, limit[going])
        going = going[(x == 0) & (known[going] < limit[going])]
    # plcp + place stays the same from a comparison up to the next one
    total = known + start
    return total[np.searchsorted(start, at, side="right") - 1] - at, phi
