"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, binary search."""

from __future__ import annotations

import numpy as np

#: Characters in a first key, of nine bits each.
FIRST = 7
#: Positions of a text that one lane of Kasai's algorithm goes through.
LANE = 256


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of codes from 1, a 0 behind each; and where each begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    codes = np.zeros(int(sizes.sum()), np.uint16)
    flat = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    codes[:] = flat
    codes += 1
    codes[starts + sizes - 1] = 0
    return codes, starts


def first_keys(codes: np.ndarray) -> np.ndarray:
    """FIRST codes from each position as one number; beyond the end there is 0."""
    n = len(codes)
    padded = np.concatenate((codes, np.zeros(FIRST, np.uint16))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(FIRST):
        key = (key << 9) | padded[k : k + n]
    return key


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes, and the rank of each suffix. Groups of equal beginnings are refined by the rank of what
    follows, over twice the length each time; suffixes alone in a group are left as they are."""
    n = len(codes)
    key = first_keys(codes)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    h = FIRST
    alone = new & np.concatenate((new[1:], [True]))
    open_ = np.flatnonzero(~alone)
    while len(open_):
        some = order[open_]
        after = some + h
        inside = after < n
        follow = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        key = rank[some] * (n + 1) + follow
        sort = np.argsort(key)
        order[open_] = some = some[sort]
        key = key[sort]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[some] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.concatenate((new[1:], [True])))]
        h *= 2
    return order, rank


def common_prefixes(codes: np.ndarray, starts: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Kasai's algorithm, in lanes of LANE positions of a text, side by side: the length, up to `most`, that the suffix
    at each position has in common with the one before it in sorted order. No common part goes beyond a text's end."""
    n = len(codes)
    out = np.zeros(n, np.int32)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((codes, [0]))
    keys = np.concatenate((first_keys(codes), [0]))
    ends = np.concatenate((starts[1:], [n]))
    times = -(-(ends - starts) // LANE)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, end = np.repeat(starts, times) + LANE * nth, np.repeat(ends, times)
    stop, length = np.minimum(at + LANE, end), np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        length[other < 0] = 0
        # as long as FIRST codes of the lane's own text are left, so many are compared at once
        last = np.minimum(end - 1 - at, most) - FIRST
        grow = np.flatnonzero((other >= 0) & (length <= last))
        while len(grow):
            grow = grow[keys[at[grow] + length[grow]] == keys[np.minimum(other[grow] + length[grow], n)]]
            length[grow] += FIRST
            grow = grow[length[grow] <= last[grow]]
        grow = np.flatnonzero((other >= 0) & (length < most))
        while len(grow):
            a = padded[at[grow] + length[grow]]
            b = padded[np.minimum(other[grow] + length[grow], n)]
            grow = grow[(a == b) & (a > 0)]
            length[grow] += 1
            grow = grow[length[grow] < most]
        out[at] = length
        length = np.maximum(length - 1, 0)
        at = at + 1
        left = at < stop
        if not left.all():
            at, end, stop, length = at[left], end[left], stop[left], length[left]
    return out


def repeats_inside(codes: np.ndarray, starts: np.ndarray, order: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """Positions whose `size` codes, all of one text, start elsewhere as well."""
    common = common_prefixes(codes, starts, order, rank, size)
    flags = common >= size
    hit = np.flatnonzero(flags)
    flags[order[rank[hit] - 1]] = True
    return flags


def found_in(codes: np.ndarray, at: np.ndarray, others: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Which of the `size`-code strings at the positions `at` occur in `others`, by binary search in its suffix array:
    first by the first FIRST codes, then, between the suffixes that have those, by the rest."""
    mine, theirs = first_keys(codes), first_keys(others)
    heads = theirs[order]
    low, high = np.searchsorted(heads, mine[at], "left"), np.searchsorted(heads, mine[at], "right")
    end = high.copy()
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        less = _compare(theirs, order[middle], mine, at[live], size) < 0
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
    out = np.zeros(len(at), bool)
    inside = np.flatnonzero(low < end)
    out[inside] = _compare(theirs, order[low[inside]], mine, at[inside], size) == 0
    return out


def _compare(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Sign of the comparison of `size` codes of which the first FIRST are equal. a, b: first_keys of the codes."""
    sign = np.zeros(len(i), np.int8)
    live = np.arange(len(i))
    for k in [*range(FIRST, size - FIRST, FIRST), max(0, size - FIRST)]:
        ia, jb = i[live] + k, j[live] + k
        x = np.where(ia < len(a), a[np.minimum(ia, len(a) - 1)], 0)
        y = np.where(jb < len(b), b[np.minimum(jb, len(b) - 1)], 0)
        differ = x != y
        sign[live[differ]] = np.where(x[differ] < y[differ], -1, 1)
        live = live[~differ]
        if not len(live):
            break
    return sign
