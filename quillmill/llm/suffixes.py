"""Suffix arrays of one task's bytes, in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a byte array in order, which must be whole for Kasai's rule to hold.

    Suffixes start in the order of eight bytes.  Then groups of equal suffixes, and
    only those, are put in the order of the suffix as far on as they are equal,
    which doubles the sorted length each time.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | padded[k: n + k]
    order = np.argsort(head)
    value = head[order]
    first = np.concatenate([np.ones(min(n, 1), bool), value[1:] != value[:-1]])
    rank = np.zeros(n + 1, np.int64)  # a group's rank is its first place plus one, the end's rank zero
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(1, n + 1), 0))
    h = 8
    while True:
        tied = ~first
        tied[:-1] |= ~first[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        which = order[places]
        key = rank[which] * (n + 1) + rank[np.minimum(which + h, n)]
        within = np.argsort(key)
        which, key = which[within], key[within]
        order[places] = which
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first[places] = fresh
        rank[which] = 1 + places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, cap: int) -> np.ndarray:
    """For each suffix that starts in a segment, its common prefix with the one before it in order, up to ``cap``.

    Kasai's rule: going on by one byte, a common prefix shrinks by one at most.
    Each segment (from ``starts`` to ``ends``) is a chain of its own, and all chains move in step.
    """
    n = len(text)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.append(text, np.uint8(0))
    lcp = np.zeros(n, np.int64)
    some = ends > starts
    at, stop = starts[some], ends[some]
    h = np.zeros(len(at), np.int64)
    while len(at):
        a, b = at + h, before[at] + h
        going = (h < cap) & (a < n) & (b < n)
        going &= padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
        done = ~going
        lcp[at[done]] = h[done]
        at = at + done
        h = np.where(going, h + 1, np.maximum(h - 1, 0))
        alive = at < stop
        if not alive.all():
            at, stop, h = at[alive], stop[alive], h[alive]
    return lcp


def repeated(segments: list[bytes], heads: list[int], width: int) -> list[np.ndarray]:
    """For each segment, which of its first ``heads`` places start a string of ``width`` bytes that starts elsewhere too.

    Segments are UTF-8, so the byte 0xFF between them is in none of their strings.
    """
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    order = suffix_array(text)
    lcp = common_prefixes(text, order, starts, starts + sizes, width)
    twice = lcp >= width
    found = twice.copy()
    found[order[:-1]] |= twice[order[1:]]
    return [found[s: s + k] for s, k in zip(starts.tolist(), heads)]
