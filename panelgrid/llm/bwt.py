"""Repeated substrings of a set of strings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of the strings in ``text`` by their first ``depth`` symbols, ties in any order.

    ``text`` holds symbols 1 to 255 and a terminator 0 after each string; ``ends[i]`` is the place of the
    terminator of the string at ``i``, where its suffixes stop.
    """
    return ordered(text, ends, depth)[0]


def ordered(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The order of the suffixes; a number of first symbols below ``depth``; and the rank of each suffix by these
    symbols, where suffixes that end before count up to their terminator.

    Ranks by the first eight symbols become ranks by several times as many, and so on.
    """
    n = len(text)
    bits = (n + 1).bit_length()
    ranks = 63 // bits  # as many as fit one key: at least two for any array that numpy can hold
    place = np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = text
    left = np.minimum(ends - place + 1, 8).astype(np.uint64)  # symbols up to the terminator
    for i in range(8):
        key <<= np.uint64(8)
        key |= padded[i : i + n]
    key &= ~np.uint64(0) << ((np.uint64(8) - left) * np.uint64(8) & np.uint64(63))
    span, known, rank = 8, 0, np.zeros(n + 1, dtype=np.uint64)
    while True:
        order = np.argsort(key)
        held = key[order]
        new = np.ones(n, dtype=bool)
        new[1:] = held[1:] != held[:-1]
        if span >= depth or new.all():
            return order, known, rank[:n]
        known = span
        rank = np.zeros(n + 1, dtype=np.uint64)
        rank[order] = np.cumsum(new)
        key = rank[:n].copy()
        for i in range(1, ranks):
            at = place + i * span
            at[at > ends] = n
            key <<= np.uint64(bits)
            key |= rank[at]
        span *= ranks


def repeats(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that begin a substring of ``length`` symbols found at least twice, and the number of its class.

    Breadth-first backward extension: at step l the suffixes are grouped into the intervals of their
    first l symbols. Prepending a symbol maps each suffix of an interval through the last-to-first
    mapping; those of one interval and one symbol form the next interval, so the intervals of common
    prefix l + 1 follow from those of l. The first intervals are those of as many symbols as the sort has ranks for. An
    interval of one suffix or of a terminator is dropped,
    and the expansion stops at ``length``, whatever longer repeats there are. Suffixes need not be ordered beyond
    ``length``: an interval is used as a set.
    """
    order, known, rank = ordered(text, ends, length)
    n = len(text)
    before = text[order - 1].astype(np.uint8)  # the transform; text[-1] is a terminator
    step = np.empty(n, dtype=np.int32)
    step[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    first = text[order].astype(np.uint8)
    inside = np.flatnonzero(ends[order] - order >= known).astype(np.int32)
    group = rank[order[inside]].astype(np.int32)
    several = np.zeros(len(inside) + 1, dtype=bool)
    several[1:-1] = group[1:] == group[:-1]
    several = several[1:] | several[:-1]
    inside, group = inside[several], group[several]
    at = np.empty(n, dtype=np.int32)
    reached = np.zeros(n, dtype=bool)
    for _ in range(known, length):
        moved = before[inside] != 0
        inside, group = inside[moved], group[moved]
        if not len(inside):
            break
        to = step[inside]
        at[to] = group
        reached[to] = True
        inside = np.flatnonzero(reached).astype(np.int32)
        reached[inside] = False
        group = at[inside]
        symbol = first[inside]
        new = np.ones(len(inside) + 1, dtype=bool)
        new[1:-1] = (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])
        several = ~(new[:-1] & new[1:])
        inside = inside[several]
        group = np.cumsum(new[:-1][several], dtype=np.int32)
    return order[inside], group.astype(np.int64)
