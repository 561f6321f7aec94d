"""Suffix arrays by linear grouping: Lyndon-prefix groups in descending order, many texts in step."""

from __future__ import annotations

import numpy as np


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin. Steps are many and mostly short, so they go without numpy's slower conveniences."""
    out = np.empty(len(keys[0]), bool)
    out[:1] = True
    np.not_equal(keys[0][1:], keys[0][:-1], out=out[1:])
    for key in keys[1:]:
        out[1:] |= key[1:] != key[:-1]
    return out.nonzero()[0]


def _gaps(starts: np.ndarray, end: int) -> np.ndarray:
    """From each start to the next, the last one's to the end."""
    out = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = end - starts[-1:]
    return out


def lyndon_groups(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, previous smaller) of each suffix of texts laid end to end in ``text``; each ends with its own least symbol.

    A group holds the suffixes of one text with one Lyndon prefix, is named by the place of its first member in the
    order, and is refined while the groups above it are processed: from the top group down, each member looks for the
    nearest suffix on its left in a lower group, along pointers that skip what is known to be no smaller. Suffixes that
    are so found by k members of the group have their prefixes lengthened by k copies of the group's, and move to
    new groups just above their old ones, the larger k the higher. All texts take such a step at once.
    """
    n = len(text)
    stop = np.cumsum(sizes)
    first = stop - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((text, owner))
    heads = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (text[order][1:] != text[order][:-1])]
    starts = np.flatnonzero(heads)
    group = np.empty(n, np.int64)
    group[order] = starts[np.cumsum(heads) - 1]
    last = np.zeros(n, np.int64)  # of each group, at its start
    last[starts] = np.r_[starts[1:], n] - 1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.arange(n) - 1
    before[first] = -1
    moved = np.zeros(n, bool)
    tops = stop - 1
    floors = first
    while len(tops):
        bottoms = group[order[tops]]
        count = tops - bottoms + 1
        upto = count.cumsum()
        shift = (bottoms - upto + count).repeat(count)
        members = order[shift + np.arange(len(shift))]
        level = bottoms.repeat(count)
        p = before[members]
        on = ((p >= 0) & (group[p] >= level)).nonzero()[0]
        while len(on):
            to = before[p[on]]
            p[on] = before[members[on]] = to  # so that the next round goes twice as far
            on = on[(to >= 0) & (group[to] >= level[on])]
        found = p[p >= 0]
        if len(found):
            found.sort()
            edge = _edges(found)
            up, times = found[edge], _gaps(edge, len(found))
            old = group[up]
            by = np.lexsort((times, old))
            up, times, old = up[by], times[by], old[by]
            run = _edges(old)
            amount = _gaps(run, len(old))
            begin = last[old[run]] - amount + 1  # where those that move from this group will lie
            goal = (begin - run).repeat(amount) + np.arange(len(old))
            there, here = order[goal], place[up]
            moved[up] = True
            stay, free = there[~moved[there]], here[here < begin.repeat(amount)]
            moved[up] = False
            order[free], place[stay] = stay, free
            order[goal], place[up] = up, goal
            last[old[run]] = begin - 1
            cut = _edges(old, times)
            fresh, size = goal[cut], _gaps(cut, len(old))
            group[up] = fresh.repeat(size)
            last[fresh] = fresh + size - 1
        tops = bottoms - 1
        live = tops >= floors
        if not live.all():
            tops, floors = tops[live], floors[live]
    return group, before


def suffix_arrays(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffixes of each text in lexicographic order, text after text; each text ends with its own least symbol.

    The order is emitted from the groups in one sweep: each suffix in turn lets the one on its left, and the chain of
    previous smaller suffixes from there, take the next free places of their groups. Nothing is renamed or sorted again.
    """
    group, before = lyndon_groups(text, sizes)
    n = len(text)
    out, free, open_yet = np.full(n, -1), np.arange(n), np.ones(n, bool)
    first = np.cumsum(sizes) - sizes
    out[first] = first + sizes - 1
    open_yet[first + sizes - 1] = False
    by = np.argsort(-sizes, kind="stable")
    first, sizes = first[by], sizes[by]
    lives = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), "left")  # texts longer than each rank
    for rank, live in enumerate(lives.tolist()):
        least = first[:live]
        p = out[least + rank] - 1
        p = p[p >= least]
        p = p[open_yet[p]]
        while len(p):
            to = group[p]  # one suffix of each text, so no group twice
            spot = free[to]
            out[spot] = p
            spot += 1
            free[to] = spot
            open_yet[p] = False
            p = before[p]
            p = p[p >= 0]
            p = p[open_yet[p]]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int, most: int) -> np.ndarray:
    """Of each suffix in ``order`` and the one after it: how many symbols agree, separators (below ``least``) excluded, up to ``most``."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(order), np.int64)
    live = np.arange(len(a))
    padded = np.r_[text, np.zeros(most + 1, text.dtype)]
    for k in range(most):
        x, y = padded[a[live] + k], padded[b[live] + k]
        live = live[(x == y) & (x >= least)]
        if not len(live):
            break
        out[live] = k + 1
    return out
