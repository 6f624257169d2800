"""Suffix arrays in numpy: ranks doubled only inside groups that are still tied (Larsson and Sadakane).

Arrays are those of one shard. Sort keys and positions are packed into one 64-bit word while they fit, since
sorting words is several times faster than sorting an index.
"""

from __future__ import annotations

import numpy as np


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of ``key`` (values below ``2**bits``)."""
    n = len(key)
    place = max(1, int(n - 1).bit_length()) if n else 1
    if bits + place <= 64:
        packed = (key.astype(np.uint64) << np.uint64(place)) | np.arange(n, dtype=np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << place) - 1)).astype(np.int64)
    return np.argsort(key, kind="stable")


def refine(rank: np.ndarray, depth: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of all suffixes by their first ``wanted`` symbols.

    ``rank`` orders suffixes by their first ``depth`` symbols: 0 is the rank of a sentinel, which no match may hold;
    equal ranks mean equal symbols. Suffixes that begin with the sentinel stay untied and unsorted. Each round compares two neighbouring stretches of known rank and touches only
    groups with several members. A final rank is the place of the group's first member, so equal ranks are equal
    strings; the array lists ties by position.
    """
    n = len(rank)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = _order(rank, max(1, int(rank.max()).bit_length()))
    named = _heads(rank[order])
    place = np.empty(n, np.int64)
    place[order] = named
    bits = int(n).bit_length()
    tied = _tied(named)  # places in the order that share their rank with a neighbour
    tied = tied[rank[order[tied]] > 0]
    while depth < wanted and len(tied):
        shift = min(depth, wanted - depth)
        members = order[tied]
        ahead = members + shift
        second = np.zeros(len(members), np.int64)
        fits = ahead < n
        second[fits] = place[ahead[fits]] + 1
        first = named[tied]
        if 3 * bits + 1 <= 64:
            key = (first.astype(np.uint64) << np.uint64(bits + 1)) | second.astype(np.uint64)
            moved = _order(key, 2 * bits + 1)
        else:
            moved = np.lexsort((second, first))
            key = None
        members, first, second = members[moved], first[moved], second[moved]
        order[tied] = members
        fresh = np.ones(len(members), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        named[tied] = heads
        place[members] = heads
        again = np.zeros(len(tied), bool)
        same = ~fresh[1:]
        again[1:] |= same
        again[:-1] |= same
        tied = tied[again]
        depth += shift
    return order, place


def _heads(sorted_rank: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(sorted_rank), bool)
    fresh[1:] = sorted_rank[1:] != sorted_rank[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(sorted_rank)), 0))


def _tied(named: np.ndarray) -> np.ndarray:
    same = named[1:] == named[:-1]
    tied = np.zeros(len(named), bool)
    tied[1:] |= same
    tied[:-1] |= same
    return np.flatnonzero(tied)


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in the array (0 for the first), symbols below 1 never match.

    Kasai's walk in text order: where the predecessor of position i + 1 is the predecessor of i moved by one, the
    prefix is one shorter. So only positions that leave their diagonal are compared, all at once and in growing
    strides; the rest follow by counting down.
    """
    n = len(order)
    found = np.zeros(n, np.int64)
    if n < 2:
        return found
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (before[1:] < 0)
    starts = np.flatnonzero(head)
    length = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(before[starts] >= 0)
    while len(live):
        left, right = starts[live] + length[live], before[starts[live]] + length[live]
        inside = (left < n) & (right < n)
        live, left, right = live[inside], left[inside], right[inside]
        same = (symbols[left] == symbols[right]) & (symbols[left] > 0)
        live = live[same]
        length[live] += 1
    own = np.cumsum(head) - 1
    by_text = np.maximum(length[own] - (np.arange(n) - starts[own]), 0)
    # a diagonal may go on beyond a first mismatch: positions past it are compared for themselves
    spent = np.flatnonzero((by_text == 0) & ~head & (before >= 0))
    left, right = spent, before[spent]
    while len(spent):
        step = by_text[spent]
        inside = (left + step < n) & (right + step < n)
        spent, left, right, step = spent[inside], left[inside], right[inside], step[inside]
        same = (symbols[left + step] == symbols[right + step]) & (symbols[left + step] > 0)
        spent, left, right = spent[same], left[same], right[same]
        by_text[spent] += 1
    return by_text[order]


def search(symbols: np.ndarray, order: np.ndarray, queries: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
           right: bool) -> np.ndarray:
    """Binary search of many query strings at once: the first place whose suffix is not below (``right``: is above) it.

    A query is ``queries[start:start + length]``; a suffix is compared by its first ``length`` symbols only, so the
    places between both searches are the query's occurrences.
    """
    n, m = len(order), len(starts)
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        text, asked, left = order[middle], starts[open_], lengths[open_]
        verdict = np.zeros(len(open_), np.int8)  # of the suffix against the query
        alive = np.arange(len(open_))
        step = 0
        while len(alive):
            alive = alive[left[alive] > step]
            at = text[alive] + step
            value = np.where(at < n, symbols[np.minimum(at, n - 1)], -1)
            wanted = queries[asked[alive] + step]
            verdict[alive] = np.where(value < wanted, -1, (value > wanted).astype(np.int8))
            alive = alive[value == wanted]
            step += 1
        above = verdict > 0 if right else verdict >= 0
        high[open_[above]] = middle[above]
        low[open_[~above]] = middle[~above] + 1
