"""Suffixes of byte slices in order by two-stage sorting, and windows that occur twice (numpy).

A suffix is *small* if it is smaller than its successor. Only small suffixes are sorted
directly; every other one is induced: scanning the order from the smallest first byte up,
the predecessor of a suffix, if not small, goes to the next free place of its own byte's
bucket. Comparing neighbours in the order then shows which windows occur twice."""

from __future__ import annotations

import numpy as np


def small_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``text`` is smaller than its successor (equal bytes: as the next)."""
    n = len(text)
    small = np.ones(n, bool)
    if n > 1:
        differs = np.append(text[:-1] != text[1:], True)
        at = np.flatnonzero(differs)
        first = at[np.searchsorted(at, np.arange(n))]
        small = text[first] < np.append(text, 255)[first + 1]
        small[first == n - 1] = True
    return small


def sort_direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` sorted by the next ``depth`` bytes; ``words`` gives 8 bytes from any position."""
    group = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for k in range(0, depth, 8):
        word = words[at[open_] + k]
        order = np.lexsort((word, group[open_]))
        at[open_] = at[open_][order]
        word, g = word[order], group[open_]
        new = np.empty(len(open_), bool)
        new[:1] = True
        new[1:] = (word[1:] != word[:-1]) | (g[1:] != g[:-1])
        # a group is named by the place of its first member
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        if not len(open_):
            break
    return at


def suffix_order(text: np.ndarray, words: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions marked in ``wanted`` in the order of their first ``depth`` bytes.

    ``wanted`` must hold, with each suffix that is not small, its successor."""
    small = small_types(text)
    direct = np.flatnonzero(wanted & small)
    direct = sort_direct(words, direct, depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    large = wanted & ~small
    out = []

    def before(p: np.ndarray) -> np.ndarray:
        q = p[p > 0] - 1
        return q[large[q]]

    for c in np.unique(text[wanted]).tolist() if wanted.any() else []:
        held = induced[c]
        turn = np.concatenate(held) if held else np.zeros(0, np.int64)
        held = [turn]
        while len(turn):            # runs of the byte itself
            q = before(turn)
            turn = q[text[q] == c]
            held.append(turn)
        full = np.concatenate([*held, direct[edges[c]:edges[c + 1]]])
        out.append(full)
        q = before(full)
        q = q[text[q] > c]
        byte = text[q]
        order = np.argsort(byte, kind="stable")
        q, byte = q[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(q, cuts):
            if len(part):
                induced[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_windows(slices: list[bytes], starts: list[int], width: int) -> list[np.ndarray]:
    """For each slice, whether the window of ``width`` bytes at each of its first ``starts``
    positions also is at another of all those positions. A slice has starts + width - 1 bytes."""
    pad = bytes(width + 8)
    buf = np.frombuffer(b"".join(x + pad for x in slices), np.uint8)
    first = np.cumsum([0] + [len(x) + len(pad) for x in slices])[:-1]
    n = np.array(starts, np.int64)
    words = np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))
    is_start = np.zeros(len(buf), bool)
    is_start[np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())] = True
    # a last start that is not small needs its successors up to a small one
    small = small_types(buf)
    next_small = np.flatnonzero(small)
    last = first + n - 1
    stop = next_small[np.searchsorted(next_small, last)]
    wanted = is_start.copy()
    for a, b in zip(last[stop > last].tolist(), stop[stop > last].tolist()):
        wanted[a:b + 1] = True
    order = suffix_order(buf, words, wanted, width)
    order = order[is_start[order]]
    same = np.arange(len(order) - 1)        # neighbours whose common prefix reaches the width
    for k in range(0, width, 8):
        at = min(k, width - 8)
        same = same[words[order[same] + at] == words[order[same + 1] + at]]
    hit = np.zeros(len(buf), bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return [hit[a:a + k] for a, k in zip(first.tolist(), starts)]
