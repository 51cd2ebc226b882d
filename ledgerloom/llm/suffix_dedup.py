"""Suffix-array deduplication of byte strings.

Two equal strings of 200 bytes have the same smallest hash of their 32-byte pieces. So each stretch of string
starts that share a smallest hash (an interval) belongs to the shard of that hash, and only hashes that some other
place has too can hold a repeat. Blocks find which these are, and send the text of those intervals, each
distinct text once with its count. A shard then sorts all suffixes of what it got by the two-stage method, and
adjacent common prefixes of 200 bytes or more are the repeats.

A hash that many blocks have (a phrase of many documents, each time in other company) would gather all its
company in one shard. Strings of such a hash are owned instead by the smallest hash in them of a short stretch that
is not itself common: what many documents have, a second round finds, and what no other block has is not sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import LAST_ID, raw_strings
from .blocks import Blocks, among, ask, by_shard, counted, distinct, grown, parts
from .suffix_array import reaches, suffix_array, words

LENGTH = 200
BLOCK_BYTES = 2 << 20  # UTF-8 bytes of text in a block: each takes some 60 bytes of arrays
SHARD_BYTES = 4 << 20  # bytes of text for each shard
PIECE = 32  # bytes of a hashed piece; a power of two, 8 at least and less than LENGTH
FINE = 16  # pieces of a stretch whose smallest may own a string where the string's own smallest is hot
HOT = 32  # blocks that make a hash hot
SLAB = 1 << 20  # bytes of text whose suffixes are sorted at a time
RUN = 1 << 14  # hashes worked on at a time: what they take stays in a core's cache
_NONE = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _even(hashes: np.ndarray) -> np.ndarray:
    """Another number for each, spread over the whole range: smallest hashes are small, and shards are ranges."""
    h = hashes * _SPREAD
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(f, values: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over each ``width`` consecutive values, by doubling; the last over what is left. Values
    are taken in runs that stay in a core's cache."""
    out = np.empty_like(values)
    for at in range(0, len(values), RUN):
        part = values[at : at + RUN + width - 1]
        if len(part) < min(RUN, len(values) - at) + width - 1:
            part = np.append(part, np.full(width - 1, _NONE if f is np.minimum else 0, values.dtype))
        have = 1
        while have < width:
            step = min(have, width - have)
            part = f(part[:-step], part[step:])
            have += step
        out[at : at + RUN] = part[: len(values) - at][:RUN]
    return out


def _pieces(text: np.ndarray) -> np.ndarray:
    """A hash of the ``PIECE`` bytes from each place on, less than ``_NONE``; zeros follow the last byte."""
    out = np.empty(len(text), np.uint64)
    for at in range(0, len(text), RUN):
        n = min(RUN, len(text) - at)
        part = words(text[at : at + n + PIECE - 1], PIECE)[: n + PIECE - 8]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        have, factor = 8, 0xD6E8FEB86659FD93
        while have < PIECE:
            ahead, part = part[have:], part[:-have] * np.uint64(factor)
            part += ahead
            have, factor = have * 2, factor * factor % 2**64
        part ^= part >> np.uint64(31)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(30)
        np.minimum(part, _NONE - np.uint64(1), out=out[at : at + n])
    return out


class _Intervals:
    """The intervals of a block: their document, first string start, number of starts, and hash."""

    def __init__(self, table: pa.Table, length: int, repeats: bool = False) -> None:
        order = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.length, self.ids = length, order.column("doc_id").to_pylist()
        self.ends, self.text = raw_strings(order.column("text"))
        n, size = len(self.text), np.diff(self.ends)
        if not n:
            self.start = self.starts = self.doc = np.zeros(0, np.int64)
            self.hash = self.twice = self.piece = np.zeros(0, np.uint64)
            return
        piece = _pieces(self.text)
        left = np.repeat(self.ends[1:].astype(np.int32), size) - np.arange(n, dtype=np.int32)  # bytes to the end
        piece[left < PIECE] = _NONE
        least = _sliding(np.minimum, piece, length - PIECE + 1)
        whole = left >= length
        # An interval is a run of starts with one smallest hash, within one document.
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (left[1:] > left[:-1])
        self.start = np.flatnonzero(new)
        stop = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        self.starts = stop - self.start + 1
        self.hash = _even(least[self.start])
        self.doc = np.searchsorted(self.ends, self.start, side="right") - 1
        del left, new, stop
        self.piece = piece
        if repeats:
            # Places of pieces that are smallest somewhere: a hash with two such places may repeat in this block.
            least[~whole] = 0
            back = _sliding(np.maximum, np.concatenate([np.zeros(length - PIECE, np.uint64), least]), length - PIECE + 1)[:n]
            chosen = np.sort(piece[(back == piece) & (piece != _NONE)])
            self.twice = distinct(_even(chosen[1:][chosen[1:] == chosen[:-1]]))

    def stretches(self, which: np.ndarray) -> tuple[list[np.ndarray], int]:
        """For each of some intervals, the smallest hash of each short stretch of its strings; how many a string has."""
        span = self.length - PIECE - FINE + 2
        fine = _sliding(np.minimum, self.piece, FINE)
        return [fine[a : a + n + span - 1] for a, n in zip(self.start[which].tolist(), self.starts[which].tolist(), strict=True)], span

    def split(self, which: np.ndarray, common: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, starts, document, owner) of the parts that hot intervals fall into, less those whose owner no other
        place has. A string all of whose stretches are common is owned by its interval's hash and the largest of them."""
        values, span = self.stretches(which)
        inside = np.zeros(len(self.piece) + 1, np.int32)
        np.add.at(inside, self.start[which], 1)
        np.add.at(inside, self.start[which] + self.starts[which] + self.length - PIECE, -1)
        near = np.sort(self.piece[np.cumsum(inside[:-1]) > 0])
        again = distinct(near[1:][near[1:] == near[:-1]])
        parts_ = []
        for i, fine in zip(which.tolist(), values, strict=True):
            rare = np.where(among(_even(fine), common), _NONE, fine)
            owner = np.lib.stride_tricks.sliding_window_view(rare, span).min(axis=1)
            whole = owner == _NONE
            kept = whole | among(_even(owner), shared) | among(owner, again)
            owner = _even(owner)
            if whole.any():  # common phrases in some company of each other: by the interval's hash and the largest
                most = np.lib.stride_tricks.sliding_window_view(fine, span).max(axis=1)
                owner = np.where(whole, _even(most ^ self.hash[i]), owner)
            new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for a, n in zip(new.tolist(), np.diff(np.append(new, len(owner))).tolist(), strict=True):
                if kept[a]:
                    parts_.append((self.start[i] + a, n, self.doc[i], owner[a]))
        if not parts_:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        at, n, doc, owner = zip(*parts_, strict=True)
        return np.array(at, np.int64), np.array(n, np.int64), np.array(doc, np.int64), np.array(owner, np.uint64)


def _repeated_starts(texts: list[bytes], counts: np.ndarray, length: int, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The ranges (text, first byte, end) that are covered by the suffixes of ``length`` bytes or more which have that
    many in common with another, or with themselves in another copy of the text (``counts``); and those of such that are
    not the very first by ``first`` (an order of the texts' first occurrences, shifted to hold the place in the document)."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    starts = size - length + 1
    # Suffixes that are too short, or in another interval, are of no text.
    owner = np.repeat(np.stack([np.arange(len(texts)), np.full(len(texts), -1)], 1).ravel(), np.stack([starts, size - starts], 1).ravel())
    order = suffix_array(flat, length, owner >= 0)
    order = order[owner[order] >= 0]
    same = reaches(flat, order, length)
    group = np.cumsum(~same) - 1
    weight = np.bincount(group, weights=counts[owner[order]])
    hit = np.zeros(len(flat), bool)
    hit[order] = weight[group] >= 2
    later = hit
    if first is not None:
        key = first[owner[order]] + (order - begin[owner[order]])
        least = np.minimum.reduceat(key, np.flatnonzero(~same))
        later = np.zeros(len(flat), bool)
        later[order] = hit[order] & (key > least[group])
    spans = _spans(hit, begin, length)
    return spans, spans if first is None else _spans(later, begin, length)


def _slabs(least: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts, ordered by smallest hash, of about ``SLAB`` bytes; a hash is in one range."""
    edges = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
    total = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a > start and total[b] - total[start] > SLAB:
            yield start, a
            start = a
    if start < len(least):
        yield start, len(least)


def _spans(starts: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """The bytes covered by strings at the marked starts, as ranges (text, first byte, end); texts begin at ``begin``, and
    none has a start among its last ``length`` - 1 bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], starts, [False]])))
    text = np.searchsorted(begin, edge[::2], side="right") - 1
    return np.stack([text, edge[::2] - begin[text], edge[1::2] + length - 1 - begin[text]], 1)


def _placed(spans: np.ndarray, texts: int, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places, each of a text: (place, row of ``spans``) of all ranges of their texts."""
    spans_of = np.bincount(spans[:, 0], minlength=texts)
    order, begin = np.argsort(spans[:, 0], kind="stable"), np.cumsum(spans_of) - spans_of
    n = spans_of[each]
    place = np.repeat(np.arange(len(each)), n)
    return place, order[begin[each][place] + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, or a string without cut characters, and the columns ``carry``): each text, as UTF-8, without the bytes that are covered
    by a ``length``-byte string that also starts anywhere else, in the same document too.

    Strings are judged on the input, overlaps count, and none crosses documents. With ``keep_first`` the first
    occurrence, by doc_id and place, stays. A null text is empty; rows of equal or null doc_id are documents of
    their own, so two equal rows of ``length`` bytes remove each other. Texts are shuffled once; beside them go 8
    bytes for each interval (one in about 85 bytes) and the text of intervals whose hash repeats.
    """
    blocks = Blocks(docs, BLOCK_BYTES, carry)
    shards = max(1, -(-blocks.size // grown(SHARD_BYTES, blocks.size)))

    def tell_hashes(table: pa.Table) -> Iterator[dict]:
        found = _Intervals(table, length)
        hashes = distinct(found.hash)
        block = table.column("block")[0].as_py()
        for k, (x, y) in enumerate(parts(len(hashes), by_shard(hashes, shards))):
            if y > x:
                yield {"shard": k, "block": block, "hashes": hashes[x:y].tobytes()}

    def count_blocks(few: str, many: str):
        """What blocks sent of hashes, answered: ``few`` are in two blocks or more, ``many`` in ``HOT`` or more."""

        def meet(table: pa.Table) -> Iterator[dict]:
            shard = table.column("shard")[0].as_py()
            sent = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
            values, n = counted(np.concatenate(sent))
            for kind, known in ((few, values[n >= 2]), (many, values[n >= HOT])):
                for block, hashes in zip(table.column("block").to_pylist(), sent, strict=True):
                    hit = hashes[among(hashes, known)]
                    if len(hit):
                        yield {"block": block, "shard": shard, "kind": kind, "hashes": hit.tobytes()}

        return meet

    def answered(answers: pa.Table, kind: str) -> np.ndarray:
        kinds = answers.column("kind").to_pylist()
        sent = [np.frombuffer(x, np.uint64) for k, x in zip(kinds, answers.column("hashes").to_pylist(), strict=True) if k == kind]
        return distinct(np.concatenate(sent)) if sent else np.zeros(0, np.uint64)

    def tell_stretches(table: pa.Table, answers: pa.Table) -> Iterator[dict]:
        hot = answered(answers, "hot")
        if not len(hot):
            return
        found = _Intervals(table, length)
        values, _ = found.stretches(np.flatnonzero(among(found.hash, hot)))
        hashes = distinct(_even(np.concatenate(values))) if values else np.zeros(0, np.uint64)
        block = table.column("block")[0].as_py()
        for k, (x, y) in enumerate(parts(len(hashes), by_shard(hashes, shards))):
            if y > x:
                yield {"shard": k, "block": block, "hashes": hashes[x:y].tobytes()}

    def tell_texts(table: pa.Table, answers: pa.Table) -> Iterator[dict]:
        found = _Intervals(table, length, repeats=True)
        hot = answered(answers, "hot")
        is_hot = among(found.hash, hot)
        take = np.flatnonzero((among(found.hash, answered(answers, "repeated")) | among(found.hash, found.twice)) & ~is_hot)
        split = found.split(np.flatnonzero(is_hot), answered(answers, "common"), answered(answers, "shared"))
        at, count, doc, owner = (np.concatenate(x) for x in zip((found.start[take], found.starts[take], found.doc[take], found.hash[take]), split, strict=True))
        by = np.argsort(owner, kind="stable")
        at, count, doc, owner = at[by], count[by], doc[by], owner[by]
        flat = found.text.tobytes()
        block = table.column("block")[0].as_py()
        doc0 = found.ends[doc]
        for k, (x, y) in enumerate(parts(len(at), by_shard(owner, shards))):
            if y == x:
                continue
            # Each distinct text once; which places have it stays with it and comes back as it is.
            seen: dict[bytes, list[int]] = {}
            for i in range(x, y):
                seen.setdefault(flat[at[i] : at[i] + count[i] + length - 1], []).append(i)
            places = np.array([i for v in seen.values() for i in v])
            yield {
                "shard": k, "block": block, "texts": b"".join(seen), "hashes": owner[[v[0] for v in seen.values()]].tobytes(),
                "sizes": np.array([len(t) for t in seen], np.int64).tobytes(), "copies": np.array([len(v) for v in seen.values()], np.int64).tobytes(),
                "docs": doc[places].astype(np.int64).tobytes(), "starts": (at[places] - doc0[places]).astype(np.int64).tobytes(),
                "ids": np.array([LAST_ID if found.ids[d] is None else found.ids[d] for d in doc[places].tolist()], np.int64).tobytes() if keep_first else b"",
            }

    def sort_suffixes(table: pa.Table) -> Iterator[dict]:
        shard = table.column("shard")[0].as_py()
        column = {c: table.column(c).to_pylist() for c in ("block", "texts", "hashes", "sizes", "copies", "docs", "starts", "ids")}
        number: dict[bytes, int] = {}
        least: list[int] = []
        which: list[np.ndarray] = []  # of each block, the number of each text it sent
        for flat, hashes, sizes in zip(column["texts"], column["hashes"], column["sizes"], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
            own = []
            for a, b, h in zip([0, *ends[:-1]], ends, np.frombuffer(hashes, np.uint64).tolist(), strict=True):
                if (i := number.setdefault(flat[a:b], len(number))) == len(least):
                    least.append(h)
                own.append(i)
            which.append(np.array(own, np.int64))
        texts = list(number)
        number.clear()
        copies = [np.frombuffer(x, np.int64) for x in column["copies"]]
        each = np.concatenate([np.repeat(w, n) for w, n in zip(which, copies, strict=True)])  # the text at each place
        sent = np.array([len(x) // 8 for x in column["docs"]])
        block = np.repeat(np.array(column["block"]), sent)
        doc, start = (np.concatenate([np.frombuffer(x, np.int64) for x in column[c]]) for c in ("docs", "starts"))
        total = np.bincount(each, minlength=len(texts))
        is_first, first = np.zeros(len(each), bool), None
        if keep_first:
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in column["ids"]])
            by = np.lexsort((start, doc, block, ids, each))
            is_first[by[np.concatenate([[True], each[by][1:] != each[by][:-1]])]] = True
            at = np.flatnonzero(is_first)
            place = np.stack([ids[at], block[at], doc[at]], 1)
            by = np.lexsort(place.T[::-1])
            document = np.empty(len(by), np.int64)
            document[by] = np.cumsum(np.append(False, (place[by][1:] != place[by][:-1]).any(axis=1)))
            first = np.empty(len(texts), np.int64)
            first[each[at]] = (document << 34) + start[at]
        hash_of = np.array(least, np.uint64)
        by = np.argsort(hash_of, kind="stable")
        found = []
        for x, y in _slabs(hash_of[by], np.array([len(texts[i]) for i in by.tolist()])):
            group = by[x:y]
            hits = _repeated_starts([texts[i] for i in group.tolist()], total[group], length, None if first is None else first[group])
            found.append([np.column_stack([group[h[:, 0]], h[:, 1:]]) for h in (hits if first is not None else hits[:1])])
        # The first place of a text keeps what is the very first of its string.
        out = []
        for kind, chosen in zip(zip(*found, strict=True), (~is_first, is_first), strict=False):
            spans, at = np.concatenate(kind), np.flatnonzero(chosen)
            place, row = _placed(spans, len(texts), each[at])
            at = at[place]
            out.append(np.column_stack([block[at], doc[at], start[at] + spans[row, 1], start[at] + spans[row, 2]]))
        covered = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        covered = covered[np.argsort(covered[:, 0], kind="stable")]
        cuts = np.flatnonzero(np.diff(covered[:, 0])) + 1
        for of in np.split(covered, cuts) if len(covered) else ():
            yield {"block": int(of[0, 0]), "shard": shard, "spans": np.ascontiguousarray(of[:, 1:]).tobytes()}

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        order = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ends, text = raw_strings(order.column("text"))
        change = np.zeros(len(text) + 1, np.int64)
        if answers.num_rows:
            spans = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in answers.column("spans").to_pylist()])
            np.add.at(change, ends[spans[:, 0]] + spans[:, 1], 1)
            np.add.at(change, ends[spans[:, 0]] + spans[:, 2], -1)
        gone = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        begins[ends[:-1][ends[:-1] < len(text)]] |= gone[ends[:-1][ends[:-1] < len(text)]]
        runs = np.concatenate([[0], np.cumsum(begins)])
        removed = np.diff(total[ends])
        kept: list = [text[a:b][~gone[a:b]].tobytes() if n else text[a:b].tobytes() for a, b, n in zip(ends[:-1].tolist(), ends[1:].tolist(), removed.tolist(), strict=True)]
        if as_text:  # without the characters that a cut went through
            kept = [x.decode("utf-8", "ignore") for x in kept]
        return pa.table({"doc_id": order.column("doc_id"), "n_bytes": np.diff(ends), "n_removed": removed, "n_spans": np.diff(runs[ends]), "kept": pa.array(kept, pa.string() if as_text else pa.binary())} | {f"_c{i}": order.column(f"_c{i}") for i in range(len(carry))})

    reply = "block long, shard long, kind string, hashes binary"
    met = ask(blocks.tell(tell_hashes, "shard long, block long, hashes binary"), shards, count_blocks("repeated", "hot"), reply)
    common = ask(blocks.tell(tell_stretches, "shard long, block long, hashes binary", met.where("kind = 'hot'")), shards, count_blocks("shared", "common"), reply)
    told = blocks.tell(tell_texts, "shard long, block long, texts binary, hashes binary, sizes binary, copies binary, docs binary, starts binary, ids binary", met.unionByName(common))
    spans = ask(told, shards, sort_suffixes, "block long, shard long, spans binary")
    kinds = dict(docs.dtypes)
    out = blocks.tell(remove, ", ".join([f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}", *[f"_c{i} {kinds[c]}" for i, c in enumerate(carry)]]), spans)
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})

