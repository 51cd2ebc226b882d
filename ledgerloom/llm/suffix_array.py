"""Two-stage suffix sorting in numpy, to a fixed depth.

Only suffixes smaller than their successors are sorted directly. Every other suffix is larger than its
successor, so its place follows from the successor's: a scan of the buckets of first symbols, from the
smallest, puts each predecessor that is larger behind those put before it. Within a bucket, runs of its own symbol
are induced in rounds, one for each length of run.
"""

from __future__ import annotations

import numpy as np


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last counts as larger than the empty one."""
    n = len(text)
    changes = np.flatnonzero(text[1:] != text[:-1])  # the next symbol differs
    up = np.append(text[changes + 1] > text[changes], False)
    return np.repeat(up, np.diff(np.concatenate([[-1], changes, [n - 1]])))


def words(text: np.ndarray, depth: int) -> np.ndarray:
    """The 8 symbols from each place on as one number, which orders as they do, up to ``depth`` places after the last."""
    wide = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    out = np.empty(len(wide), np.uint64)
    for k in range(8):
        some = wide[k:]
        whole = some[: len(some) // 8 * 8].view(">u8")
        out[k::8][: len(whole)] = whole
    return out[: len(text) + depth + 1]


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` symbols, ties by place: sorted 8 symbols at a time,
    from the left, and after the first pass only among those that are still equal."""
    key = words(text, depth)
    first = key[at]
    order = np.argsort(first, kind="stable")
    out, k = at[order], first[order]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    for d in range(8, depth, 8):
        # Rows that are equal to a neighbour so far, in groups.
        member = same | np.append(same[1:], False)
        todo = np.flatnonzero(member)
        if not len(todo):
            break
        k = key[np.minimum(out[todo] + d, len(text))]
        begin = np.flatnonzero(~same[todo])
        size = np.diff(np.append(begin, len(todo)))
        # Repeated text makes most groups go on being equal; only those that part are sorted.
        parted = np.repeat(np.minimum.reduceat(k, begin) != np.maximum.reduceat(k, begin), size)
        if not parted.any():
            continue
        group = np.repeat(np.arange(len(begin)), size)[parted]
        moved, k = todo[parted], k[parted]
        by = np.lexsort((k, group))
        out[moved] = out[moved][by]
        k, group = k[by], group[by]
        same[moved[1:]] = (group[1:] == group[:-1]) & (k[1:] == k[:-1])
    return out


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffix starts of ``text`` (uint8), in the order of their first ``depth`` symbols at least; or those that are
    ``wanted``, and the few others that these are induced from: the successors of one that is larger than its successor."""
    n = len(text)
    up = ascending(text)
    if wanted is None:
        need = np.ones(n, bool)
    else:
        # A wanted run that ends on a suffix larger than its successor needs those up to the next smaller one.
        change = np.diff(np.concatenate([[0], wanted.astype(np.int8), [0]]))
        ends = np.flatnonzero(change == -1)
        ends = ends[~up[ends - 1] & (ends < n)]
        smaller = np.append(np.flatnonzero(up), n - 1)
        reach = np.zeros(n + 1, np.int32)
        np.add.at(reach, ends, 1)
        np.add.at(reach, np.minimum(smaller[np.searchsorted(smaller[:-1], ends)], n - 1) + 1, -1)
        need = wanted | (np.cumsum(reach[:-1]) > 0)
    direct = _sorted_directly(text, np.flatnonzero(up & need), depth)
    direct_cuts = np.searchsorted(text[direct], np.arange(257))
    put: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and need[-1]:
        put[text[-1]].append(np.array([n - 1]))  # larger than the empty suffix after it
    out: list[np.ndarray] = [np.zeros(0, np.int64)]
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        induced, wave = [], np.concatenate(put[c]) if put[c] else np.zeros(0, np.int64)
        while len(wave):
            induced.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~up[before] & need[before]]
        bucket = np.concatenate([*induced, direct[direct_cuts[c] : direct_cuts[c + 1]]])
        out.append(bucket)
        put[c] = []
        before = bucket[bucket > 0] - 1
        symbol = text[before]
        larger = (symbol > c) & need[before]
        before, symbol = before[larger], symbol[larger]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for piece in np.split(before, cuts) if len(before) else ():
            put[text[piece[0]]].append(piece)
    return np.concatenate(out)


LONG = 48  # places in a row that are compared as one stretch


def reaches(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of ``order`` has its first ``depth`` symbols in common with the one before it.

    Where a place and the one before it in the order are followed by another such two, at the same distance, the symbols of
    both are compared once: text that repeats is long rows of such places.
    """
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    key = words(text, depth)
    todo = np.flatnonzero(np.maximum(order[1:], order[:-1]) + depth <= len(text)) + 1
    for d in (0, depth - 8):
        todo = todo[key[order[todo] + d] == key[order[todo - 1] + d]]
    todo = todo[np.argsort(order[todo])]
    at, other = order[todo], order[todo - 1]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(other) != 1)])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(at)))
    good = np.zeros(len(at), bool)
    for x, n in zip(edge[size >= LONG].tolist(), size[size >= LONG].tolist(), strict=True):
        a, b = at[x], other[x]
        unlike = np.flatnonzero(text[a : a + n + depth - 1] != text[b : b + n + depth - 1])
        good[x : x + n] = True if not len(unlike) else np.searchsorted(unlike, np.arange(n)) == np.searchsorted(unlike, np.arange(n) + depth)
    few = np.flatnonzero(np.repeat(size < LONG, size))
    for d in range(8, depth - 8, 8):
        if not len(few):
            break
        few = few[key[at[few] + d] == key[other[few] + d]]
    good[few] = True
    out[todo[good]] = True
    return out
