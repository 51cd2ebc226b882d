"""Substring deduplication of word windows behind a count-min prefilter.

The sketch has two rows of counters, by two independent hashes of a window. Pass 1: each block makes its sketch, in
which each of its distinct windows adds one to a counter of either row, sent as the sorted counters that are not zero;
shards add the sketches of all blocks up, by ranges of counters, and blocks learn which of theirs are two or
more. The smaller of a window's two counters never is less than the number of blocks that have it, so a window of two blocks
is never lost. Pass 2: blocks send only the windows so estimated, each once with its smallest doc_id; grouping
them by both hashes, 128 bits in all, is exact, and blocks learn which have a smaller doc_id elsewhere. What repeats within a
block, the block knows by itself.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .blocks import Blocks, among, ask, by_shard, counted, distinct, documents, grown, parts

WINDOW = 13
ROWS = 2  # of counters
LOAD = 4  # counters of a row for each window: about one window in 20 is estimated repeated by chance
SHARD_WINDOWS = 3_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Windows:
    """The windows of a block's documents: two 64-bit hashes, and the document of each."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.ids, self.order, texts = documents(table)
        self.words = [t.split() for t in texts]
        del texts
        self.n = np.array([len(w) for w in self.words])
        self.count = np.maximum(self.n - window + 1, 0)
        # Two independent hashes of each word, so that what one confuses the other does not.
        word = np.frombuffer(b"".join(h for ws in self.words for h in map(xxhash.xxh3_128_digest, ws)), "<u8").reshape(-1, 2)
        first, second = np.ascontiguousarray(word[:, 0]), np.ascontiguousarray(word[:, 1])
        starts = np.repeat(np.cumsum(self.n) - self.n - (np.cumsum(self.count) - self.count), self.count)
        self.at = np.arange(int(self.count.sum())) + starts
        self.a, self.b = (_mixed(_rolling(w, window, factor)[self.at]) for w, factor in ((first, _A), (second, _B)))
        self.doc = np.repeat(np.arange(len(self.ids)), self.count)

    def groups(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some windows, the groups that are equal: the first window of each, ascending by hash, each window's group,
        and the order of the smallest doc_id of each; documents are in the order of their ids."""
        a, b = self.a[which], self.b[which]
        by = np.argsort(a)
        same = a[by][1:] == a[by][:-1]
        if (same & (b[by][1:] != b[by][:-1])).any():  # one hash confuses what the other does not
            by = np.lexsort((b, a))
            same = (a[by][1:] == a[by][:-1]) & (b[by][1:] == b[by][:-1])
        new = np.flatnonzero(np.append(True, ~same)) if len(by) else by
        group = np.empty(len(by), np.int64)
        group[by] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(by))))
        first = which[np.minimum.reduceat(by, new)] if len(by) else which
        return first, group, self.order[self.doc[first]]


def _rolling(values: np.ndarray, window: int, factor: np.uint64) -> np.ndarray:
    """A number for each ``window`` consecutive values, a polynomial built by doubling; the last ones lack values."""
    total, have, step = None, 0, values
    span, times = 1, int(factor)  # ``step`` covers ``span`` values; ``times`` is factor ** span
    while True:
        if window & span:
            if total is None:
                total, have = step.copy(), span
            else:
                ahead = np.zeros_like(step)
                ahead[: len(step) - have] = step[have:]
                total = total * np.uint64(times) + ahead
                have += span
        if span * 2 > window:
            return total
        ahead = np.zeros_like(step)
        ahead[: len(step) - span] = step[span:]
        step = step * np.uint64(times) + ahead
        span, times = span * 2, times * times % 2**64


def _packed(ascending: np.ndarray) -> bytes:
    """Ascending numbers by their differences: the low bits of each, then the rest as runs of 0 that a 1 ends, so
    that numbers spread at random take about two bits more than the logarithm of their mean distance."""
    steps = np.diff(ascending)
    mean = int(ascending[-1] - ascending[0]) // max(1, len(steps))
    low = max(0, (mean * 7 // 10).bit_length() - 1)
    bits = np.unpackbits(steps.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - -(-low // 8) :], axis=1)
    ends = np.cumsum((steps >> np.uint64(low)).astype(np.int64) + 1)
    runs = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    runs[ends - 1] = 1
    head = struct.pack("<QIB", int(ascending[0]), len(steps), low)
    return head + np.packbits(bits[:, bits.shape[1] - low :]).tobytes() + np.packbits(runs).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    first, n, low = struct.unpack_from("<QIB", data)
    flat = np.frombuffer(data, np.uint8, offset=13)
    cut, wide = -(-n * low // 8), -(-low // 8)
    bits = np.zeros((n, 8 * wide), np.uint8)
    bits[:, 8 * wide - low :] = np.unpackbits(flat[:cut], count=n * low).reshape(n, low)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, 8 - wide :] = np.packbits(bits, axis=1)
    ends = np.flatnonzero(np.unpackbits(flat[cut:]))
    rest = np.diff(ends, prepend=-1) - 1
    steps = steps.view(">u8").ravel().astype(np.uint64) | rest.astype(np.uint64) << np.uint64(low)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), steps]), dtype=np.uint64)


def _merged(answers: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([_unpacked(x) for x in answers])) if answers else np.zeros(0, np.uint64)


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words that are covered by a window of
    ``window`` words whose sequence also starts in a document with a smaller doc_id.

    Words are runs of bytes other than ASCII white space, unchanged; windows are judged on the input. A null text has
    no words; a null doc_id is larger than all others. Rows of one doc_id do not remove from each other. Two
    sequences are taken as equal if two independent hashes of 64 bits are. Documents are shuffled once; what blocks send
    is about 2 bytes for each distinct window and row of the sketch, and 17 for those estimated repeated.
    """
    blocks = Blocks(docs)
    windows = max(1, blocks.size // 5)  # a bound for sizing: words of under four letters are no majority
    bits = min(63, (LOAD * windows - 1).bit_length())
    shift = np.uint64(64 - bits)
    shards = max(1, -(-windows // grown(SHARD_WINDOWS, blocks.size)))

    def tell_cells(table: pa.Table) -> Iterator[dict]:
        w = _Windows(table, window)
        block = table.column("block")[0].as_py()
        for row, hashes in enumerate((w.a, w.b)):
            cells = distinct(hashes >> shift)
            for k, (x, y) in enumerate(parts(len(cells), by_shard(cells << shift, shards))):
                if y > x:
                    yield {"shard": row * shards + k, "block": block, "cells": _packed(cells[x:y])}

    def merge(table: pa.Table) -> Iterator[dict]:
        shard = table.column("shard")[0].as_py()
        sent = [_unpacked(x) for x in table.column("cells").to_pylist()]
        cells, counts = counted(np.concatenate(sent))  # the sum of the blocks' sketches
        repeated = cells[counts >= 2]
        for block, own in zip(table.column("block").to_pylist(), sent, strict=True):
            hit = among(own, repeated)
            if hit.any():
                yield {"block": block, "shard": shard, "hits": _packed(own[hit])}

    def tell_windows(table: pa.Table, answers: pa.Table) -> Iterator[dict]:
        if not answers.num_rows:
            return
        w = _Windows(table, window)
        sent = list(zip(answers.column("shard").to_pylist(), answers.column("hits").to_pylist(), strict=True))
        found = np.arange(len(w.a))
        for row, hashes in enumerate((w.a, w.b)):
            found = found[among(hashes[found] >> shift, _merged([x for k, x in sent if k // shards == row]))]
        first, _, low = w.groups(found)
        a, b = w.a[first], w.b[first]
        block = table.column("block")[0].as_py()
        for k, (x, y) in enumerate(parts(len(a), by_shard(a, shards))):
            if y > x:
                ids = distinct(low[x:y])
                which = np.searchsorted(ids, low[x:y]).astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)
                yield {"shard": k, "block": block, "a": _packed(a[x:y]), "b": b[x:y].tobytes(), "ids": ids.tobytes(), "which": which.tobytes()}

    def group(table: pa.Table) -> Iterator[dict]:
        shard = table.column("shard")[0].as_py()
        sent = [table.column(c).to_pylist() for c in ("a", "b", "ids", "which")]
        a = np.concatenate([_unpacked(x) for x in sent[0]])
        b = np.concatenate([np.frombuffer(x, np.uint64) for x in sent[1]])
        sizes = [len(x) // 8 for x in sent[1]]
        low = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(w, np.uint16 if len(i) // 8 < 1 << 16 else np.uint32)] for i, w in zip(sent[2], sent[3], strict=True)])
        by = np.argsort(a)
        same = a[by][1:] == a[by][:-1]
        if (same & (b[by][1:] != b[by][:-1])).any():
            by = np.lexsort((b, a))
            same = (a[by][1:] == a[by][:-1]) & (b[by][1:] == b[by][:-1])
        new = np.flatnonzero(np.append(True, ~same))
        least = np.empty(len(by), np.int64)
        least[by] = np.repeat(np.minimum.reduceat(low[by], new), np.diff(np.append(new, len(by))))
        smaller, at = least < low, 0
        for block, n in zip(table.column("block").to_pylist(), sizes, strict=True):
            hit = smaller[at : at + n]
            if hit.any():
                yield {"block": block, "shard": shard, "hits": _packed(a[at : at + n][hit]), "more": b[at : at + n][hit].tobytes()}
            at += n

    def remove(table: pa.Table, answers: pa.Table) -> Iterator[dict]:
        w = _Windows(table, window)
        first, group, low = w.groups(np.arange(len(w.a)))
        out = w.order[w.doc] > low[group]  # a smaller doc_id in the same block
        if answers.num_rows:
            a = np.concatenate([_unpacked(x) for x in answers.column("hits").to_pylist()])
            b = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("more").to_pylist()])
            known = np.zeros(len(first), bool)
            pair = np.dtype([("a", "<u8"), ("b", "<u8")])
            theirs, ours = np.empty(len(a), pair), np.empty(len(first), pair)
            theirs["a"], theirs["b"], ours["a"], ours["b"] = a, b, w.a[first], w.b[first]
            at = np.searchsorted(ours["a"], theirs["a"], side="left")
            while True:  # groups are ascending by both hashes; step over equal first halves
                short = (at < len(ours)) & (ours["a"][np.minimum(at, len(ours) - 1)] == theirs["a"]) & (ours["b"][np.minimum(at, len(ours) - 1)] < theirs["b"])
                if not short.any():
                    break
                at = at + short
            ok = at < len(ours)
            ok[ok] &= ours[at[ok]] == theirs[ok]
            known[at[ok]] = True
            out |= known[group]
        covered = np.zeros(int(w.n.sum()) + 1, np.int32)
        np.add.at(covered, w.at[out], 1)
        np.add.at(covered, w.at[out] + window, -1)
        gone = np.cumsum(covered[:-1]) > 0
        at = 0
        for i, words in enumerate(w.words):
            mask = gone[at : at + len(words)]
            at += len(words)
            kept = [x for x, m in zip(words, mask.tolist(), strict=True) if not m] if mask.any() else words
            yield {"doc_id": w.ids[i], "n_words": len(words), "n_removed": int(mask.sum()), "kept": b" ".join(kept).decode()}

    cells = ask(blocks.tell(tell_cells, "shard long, block long, cells binary"), ROWS * shards, merge, "block long, shard long, hits binary")
    told = blocks.tell(tell_windows, "shard long, block long, a binary, b binary, ids binary, which binary", cells)
    smaller = ask(told, shards, group, "block long, shard long, hits binary, more binary")
    return blocks.tell(remove, "doc_id long, n_words long, n_removed long, kept string", smaller)
