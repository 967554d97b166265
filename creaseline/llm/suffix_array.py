"""Suffix sorting by induction, on numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. An S after an L is leftmost-smaller
(LMS). The text between one LMS and the next is a chain of runs of equal symbols; two chains first differ at a run,
or are equal and end together. So LMS substrings are named by their chains, the string of names is sorted by
recursion, and the order of any other suffix follows from its chain and the rank of the LMS suffix that ends it.
Runs of one symbol count as one step, so a chain is short whatever the text.
"""

from __future__ import annotations

import numpy as np


class Classes:
    """Types, runs and LMS places of a string, with a smallest symbol thought behind its end."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        change = np.flatnonzero(s[:-1] != s[1:]) if n else np.zeros(0, np.int64)
        ends = np.append(change + 1, n)  # of runs
        starts = np.concatenate([[0], change + 1]) if n else np.zeros(0, np.int64)
        lengths = ends[: len(starts)] - starts
        rising = np.append(s[change] < s[change + 1], False)[: len(starts)]  # the last run falls to the end
        #: start of the next run
        self.next = np.append(np.repeat(ends[: len(starts)], lengths), n)
        smaller = np.repeat(rising, lengths)
        left = self.next[:-1] - np.arange(n)
        most = int(lengths.max(initial=0)) + 1
        # by symbol; L before S; a longer run is larger in an L and smaller in an S
        symbol = s.astype(np.int64) * 2 + smaller
        if n and int(symbol.max()) + 1 > (1 << 62) // most:
            symbol = np.unique(symbol, return_inverse=True)[1]
        self.token = np.append(symbol * most + np.where(smaller, most - 1 - left, left) + 1, 0)
        first = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1 if n else np.zeros(0, np.int64)
        self.lms = starts[first]
        #: where a chain ends: an LMS or the end of the string
        self.stop = np.zeros(n + 1, bool)
        self.stop[self.lms] = self.stop[n] = True


def _ranked(key: np.ndarray, old: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each member how many of its group ``old`` (one group by default) have a smaller key, and whether others have its own."""
    if old is None:
        order = np.argsort(key)
        split = np.append(True, np.diff(key[order]) != 0)
        fresh = None
    else:
        span = int(key.max()) + 1
        if int(old.max()) + 1 <= (1 << 62) // span:
            joint = old * span + key
            order = np.argsort(joint)
            split = np.append(True, np.diff(joint[order]) != 0)
        else:
            order = np.lexsort((key, old))
            split = np.append(True, (np.diff(old[order]) != 0) | (np.diff(key[order]) != 0))
        fresh = np.flatnonzero(np.append(True, np.diff(old[order]) != 0))
    runs = np.flatnonzero(split)
    sizes = np.diff(np.append(runs, len(order)))
    base = 0 if fresh is None else np.repeat(fresh, np.diff(np.append(fresh, len(order))))
    smaller, others = np.empty(len(order), np.int64), np.empty(len(order), bool)
    smaller[order] = np.repeat(runs, sizes) - base
    others[order] = np.repeat(sizes > 1, sizes)
    return smaller, others


def _packed(of: Classes, at: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to four tokens, if they fit in a key, from ``at`` to the end of the chain at most.

    Also the place behind them, or the chain's end where it is reached, and whether it is. The first token of a
    suffix never ends its own chain. A chain cannot be the beginning of another, so what pads it does not matter.
    """
    bits = max(1, int(of.token.max()).bit_length())
    key = of.token[at]
    ended = np.zeros(len(at), bool) if first else of.stop[at]
    at = np.where(ended, at, of.next[at])
    for _ in range(min(62 // bits, 4) - 1):
        key = (key << bits) | np.where(ended, 0, of.token[at])
        ended = ended | of.stop[at]
        at = np.where(ended, at, of.next[at])
        if ended.all():
            break
    return key, at, ended


def _by_chain(of: Classes, wanted: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """For each of ``wanted`` how many of them are smaller, by chain and then, if given, by the rank at its end."""
    if len(wanted) == 0:
        return np.zeros(0, np.int64)
    key, at, ended = _packed(of, wanted, True)
    group, more = _ranked(key, None)
    active = np.arange(len(wanted))
    while True:
        active, at, ended = active[more], at[more], ended[more]
        if rank is not None and ended.any():
            done = active[ended]
            group[done] += _ranked(rank[at[ended]], group[done])[0]
        active, at = active[~ended], at[~ended]
        if len(active) == 0:
            return group
        key, at, ended = _packed(of, at, False)
        smaller, more = _ranked(key, group[active])
        group[active] += smaller


def _lms_rank(s: np.ndarray, of: Classes) -> np.ndarray:
    """Ranks of the LMS suffixes at their places (one behind the end for the empty suffix, which is smallest)."""
    names = _by_chain(of, of.lms, None)
    if len(names) and len(np.unique(names)) < len(names):
        short = np.unique(names, return_inverse=True)[1]
        names = suffix_ranks(short)
    rank = np.zeros(len(s) + 1, np.int64)
    rank[of.lms] = names + 1
    return rank


def suffix_ranks(s: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Rank, among the suffixes that start at ``wanted`` (all by default), of each of them."""
    of = Classes(s)
    return _by_chain(of, np.arange(len(s)) if wanted is None else wanted, _lms_rank(s, of))


def common_prefixes(s: np.ndarray, places: np.ndarray, before: np.ndarray, least: int) -> np.ndarray:
    """Whether the suffix at each of ``places`` (ascending) shares ``least`` bytes with the one at ``before``.

    Prefixes are taken in the order of the text: where a place and its forerunner both move on by one over an equal byte, the
    common prefix is one shorter, so only the head of such a stretch is compared, over ``least`` and the stretch's length.
    ``before`` is -1 where there is none.
    """
    n = len(s)
    step = (places[1:] == places[:-1] + 1) & (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    follows = np.append(False, step & (s[places[:-1]] == s[before[:-1]]))
    heads = np.flatnonzero(~follows)
    stretch = np.cumsum(~follows) - 1
    into = np.arange(len(places)) - heads[stretch]
    need = least + np.bincount(stretch, minlength=len(heads)) - 1
    padded = np.concatenate([s.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    shared = np.zeros(len(heads), np.int64)
    active = np.flatnonzero(before[heads] >= 0)
    a, b = places[heads[active]], before[heads[active]]
    while len(active):
        # the end of the text is no byte, so nothing is shared past it
        differ = words[a] ^ words[b]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)) // 8).astype(np.int64)
        same = np.minimum(same, n - np.maximum(a, b))
        shared[active] += same
        on = (same == 8) & (shared[active] < need[active])
        active, a, b = active[on], a[on] + 8, b[on] + 8
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
    return shared[stretch] - into >= least
