"""Suffix arrays by induced sorting, and permuted longest common prefixes.  Arrays only; a task's shard is the input."""

from __future__ import annotations

import numpy as np

from scriptorium.llm.common import span_hashes


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes (or of LMS substrings) from an order of the leftmost smaller ones.

    One pass over the character buckets upwards places larger suffixes, one downwards smaller ones; within a bucket the
    suffixes placed so far go on together, so the work is linear and done in whole arrays.
    """
    n = len(t)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    small: list[list[np.ndarray]] = [[] for _ in range(256)]
    nothing = np.zeros(0, np.int32)

    def deal(at: np.ndarray, to: list[list[np.ndarray]]) -> None:
        c = t[at]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        cuts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            to[c[i]].append(at[i:j])

    seeds = np.split(lms, np.cumsum(np.bincount(t[lms], minlength=256))[:-1]) if len(lms) else [nothing] * 256
    large[t[n - 1]].append(np.array([n - 1], np.int32))  # the end is the least suffix
    for c in range(256):
        done = 0
        while done < len(large[c]):
            at = np.concatenate(large[c][done:])
            done = len(large[c])
            at = at[at > 0] - 1
            at = at[~smaller[at]]
            if len(at):
                deal(at, large)
        if len(seeds[c]):
            deal(seeds[c][seeds[c] > 0] - 1, large)
    heads = [np.concatenate(x) if x else nothing for x in large]
    for c in range(255, -1, -1):
        done = 0
        while done < len(small[c]):
            at = np.concatenate(small[c][done:])
            done = len(small[c])
            at = at[at > 0] - 1
            at = at[smaller[at]]
            if len(at):
                deal(at, small)
        at = heads[c][::-1]
        at = at[at > 0] - 1
        at = at[smaller[at]]
        if len(at):
            deal(at, small)
    return np.concatenate([x for c in range(256) for x in (heads[c], np.concatenate(small[c])[::-1] if small[c] else nothing)])


def _rank_reduced(names: np.ndarray) -> np.ndarray:
    """Order of the reduced string's suffixes.  Its alphabet is about as long as itself, so ranks are doubled instead of
    inducing once more over as many buckets; only suffixes whose rank is still shared are sorted again."""
    m = len(names)
    _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
    counts = np.bincount(inverse)
    rank = (np.cumsum(counts) - counts)[inverse].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    open_ = np.flatnonzero(counts[inverse] > 1)
    step = 1
    while len(open_):
        ahead = np.where(open_ + step < m, rank[np.minimum(open_ + step, m - 1)], -1)
        by = np.lexsort((ahead, rank[open_]))
        at, ahead = open_[by], ahead[by]
        group = rank[at]
        order[group + _within(group)] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        inside = _within(group)
        rank[at] = group + np.repeat(inside[starts], sizes)
        open_ = at[np.repeat(sizes, sizes) > 1]
        step *= 2
    return order


def _within(group: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal values."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(new)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a byte string; a suffix that is a prefix of another comes first."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    # a suffix is smaller than the next if the next different character is larger; the end counts as least
    turn = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    rises = np.append(t[turn[:-1] + 1] > t[turn[:-1]], False)
    smaller = np.repeat(rises, np.diff(np.concatenate(([-1], turn))))
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if len(lms):
        by_char = lms[np.argsort(t[lms], kind="stable")]
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = _induce(t, smaller, by_char)
        sorted_lms = found[is_lms[found]]
        ends = np.append(np.minimum(lms[1:] + 1, n), n)
        h = np.zeros(n, np.uint64)
        h[lms] = span_hashes(t, lms.astype(np.int64), ends.astype(np.int64))
        h[lms[-1]] = 0  # the last reaches the end, so it equals no other
        names_in_order = np.cumsum(np.concatenate(([0], h[sorted_lms[1:]] != h[sorted_lms[:-1]])))
        name = np.zeros(n, np.int64)
        name[sorted_lms] = names_in_order
        lms = lms[_rank_reduced(name[lms])]
    return _induce(t, smaller, lms.astype(np.int32))


def neighbour_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in order, the common prefix with the one before it.

    In text order (permuted), a value is one less than the one before where the characters before both suffixes agree;
    only the others are found by comparing, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    plain = (before > 0) & (at > 0)
    plain[plain] = t[before[plain] - 1] == t[at[plain] - 1]
    plain[1:] &= before[:-1] >= 0
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 1]
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    own = np.flatnonzero(~plain & (before >= 0))
    length = np.zeros(n, np.int64)
    left, i, j, k = own, own, before[own], np.zeros(len(own), np.int64)
    while len(left):
        room = n - np.maximum(i, j) - k
        x = words[np.minimum(i + k, n)] ^ words[np.minimum(j + k, n)]
        same = np.where(x == 0, 8, 0)
        some = x != 0
        low = x[some] & (~x[some] + np.uint64(1))
        same[some] = (np.log2(low.astype(np.float64)) // 8).astype(np.int64)
        k = k + np.minimum(same, room)
        over = (same < 8) | (room <= 8)
        length[left[over]] = k[over]
        left, i, j, k = left[~over], i[~over], j[~over], k[~over]
    start = np.where(~plain, at, 0)
    start = np.maximum.accumulate(start)
    permuted = np.where(before >= 0, length[start] + start - at, 0)
    return permuted[order]


def repeated(t: np.ndarray, size: int) -> np.ndarray:
    """True where the `size` bytes that start here start elsewhere in t too."""
    order = suffix_array(t)
    out = np.zeros(len(t), bool)
    if len(order) > 1:
        long = neighbour_prefixes(t, order)[1:] >= size
        out[order[1:][long]] = True
        out[order[:-1][long]] = True
    return out
