"""Media columns: baseline JPEG, from markers to DC-only luminance thumbnails and their hashes.

``encode_payloads`` stores bytes as a grey JPEG in which every 8x8 block is flat, so that one block
is one 8-bit sample and any baseline decoder gets it back exactly. ``thumbnails`` is a decoder for
baseline (SOF0) JPEGs at large: it parses the markers, Huffman-decodes the scans and keeps the DC
coefficient of each luminance block. Entropy-coded segments are independent between restart
markers, so all segments of a batch are decoded side by side: one numpy step reads one symbol of
every segment.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, raw_strings, slices, text_or_empty

UNIT = 64  # samples in a row of blocks; payloads are padded to a multiple of it
ROWS = 8191  # rows of blocks in a frame: 65,528 lines, the most a 16-bit height holds
STEP_BYTES = 2 << 20  # payload bytes encoded or decoded at a time


def _header(rows: int) -> bytes:
    """Markers of one frame. A DC difference of size s has a code of 12 - s bits and the end of a block one of
    4, so each block takes two whole bytes: equal text gives equal bytes, which a table's compression finds, and
    no byte is 255."""

    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    dc = bytes([0] * 3 + [1] * 9 + [0] * 4) + bytes(range(8, -1, -1))
    ac = bytes([0] * 3 + [1] + [0] * 12) + b"\0"
    return (
        b"\xff\xd8"
        + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + segment(0xDB, b"\0" + bytes([8] * 64))
        + segment(0xC0, struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + b"\1\x11\0")
        + segment(0xC4, b"\0" + dc)
        + segment(0xC4, b"\x10" + ac)
        + segment(0xDD, struct.pack(">H", UNIT))
        + segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def _difference_codes() -> np.ndarray:
    """The 16 bits of each DC difference from -255 to 255, with the end of the block."""
    prefix, code = {}, 0
    for size in range(8, -1, -1):  # canonical codes: each is the one before it plus one, with one more bit
        prefix[size], code = code, (code + 1) << 1
    out = np.zeros(511, ">u2")
    for d in range(-255, 256):
        size = abs(d).bit_length()
        bits = d if d >= 0 else d + (1 << size) - 1
        out[d + 255] = ((prefix[size] << size) | bits) << 4
    return out


_CODES = _difference_codes()
ROW = 2 * UNIT  # bytes of a coded row


def padded(n: int) -> int:
    return max(UNIT, -(-n // UNIT) * UNIT)


def encode_payloads(payloads: np.ndarray, lengths: list[int]) -> list[bytes]:
    """JPEG streams of consecutive payloads (each a positive multiple of 64 bytes); a payload of more than
    8191 rows becomes several frames, one after another. Equal payloads give equal streams; no payload, no stream."""
    frames = [(i, r) for i, n in enumerate(lengths) for r in [ROWS] * (n // UNIT // ROWS) + [n // UNIT % ROWS] if r]
    rows = np.array([r for _, r in frames])
    total = int(rows.sum())
    image = np.repeat(np.arange(len(frames)), rows)
    nth = np.arange(total) - np.repeat(np.cumsum(rows) - rows, rows)
    samples = payloads.reshape(total, UNIT).astype(np.int16)
    diff = np.empty_like(samples)
    diff[:, 0] = samples[:, 0] - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=diff[:, 1:])
    scan = _CODES[diff + 255].view(np.uint8)  # 128 bytes a row
    out = np.empty((total, ROW + 2), np.uint8)
    out[:, :ROW], out[:, ROW] = scan, 255
    out[:, ROW + 1] = np.where(nth == rows[image] - 1, 0xD9, 0xD0 + nth % 8)  # end of image, or restart
    stop = np.cumsum(rows) * (ROW + 2)
    start = stop - rows * (ROW + 2)
    media: list[list[bytes]] = [[] for _ in lengths]
    flat = out.tobytes()
    for (i, r), a, b in zip(frames, start.tolist(), stop.tolist(), strict=True):
        media[i].append(_header(r) + flat[a:b])
    return [b"".join(x) for x in media]


@dataclass
class Frame:
    """What the markers of one image say, and where its scan lies."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, int] = field(default_factory=dict)  # the DC step of each table
    codes: dict[int, bytes] = field(default_factory=dict)  # class * 16 + id: BITS and HUFFVAL
    restart: int = 0
    order: list[tuple[int, int, int]] = field(default_factory=list)  # part, DC table, AC table
    start: int = 0  # of the scan that holds the luminance
    stop: int = 0


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse_markers(data: bytes) -> list[Frame]:
    """The frames of a stream of baseline JPEGs; ValueError for other data."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, frame, codes = at + 2, Frame(), {}
        while True:
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("broken marker")
            marker = data[at + 1]
            if marker == 0xD9:
                at += 2
                break
            if marker == 0xFF:
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide, table = body[0] >> 4, body[0] & 15
                    frame.quant[table] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("not 8-bit")
                frame.height, frame.width = struct.unpack(">HH", body[1:5])
                frame.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                ids = {p[0]: i for i, p in enumerate(frame.parts)}
                order = [(ids[body[i]], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
                if not frame.width or not frame.height:
                    raise ValueError("no size")
                end = _MARKER.search(data, at)
                if not end:
                    raise ValueError("no end of scan")
                if not frame.order and order[0][0] == 0:  # the first component is the luminance
                    frame.order, frame.codes, frame.start, frame.stop = order, dict(codes), at, end.start()
                at = end.start()
        if not frame.order:
            raise ValueError("no scan of the luminance")
        frames.append(frame)
    if not frames:
        raise ValueError("empty")
    return frames


_TABLES: dict[bytes, np.ndarray] = {}


def _lookup(code: bytes) -> np.ndarray:
    """For all 16-bit windows: code length * 256 + symbol."""
    if (table := _TABLES.get(code)) is None:
        table, at, k = np.zeros(1 << 16, np.int32), 0, 16
        for length, n in enumerate(code[:16], 1):
            for _ in range(n):
                table[at : at + (1 << (16 - length))] = length << 8 | code[k]
                at, k = at + (1 << (16 - length)), k + 1
        if len(_TABLES) < 64:
            _TABLES[code] = table
    return table


def _scan_thumbnails(buffers: list[np.ndarray], frames: list[Frame]) -> list[np.ndarray]:
    """DC-only luminance of frames that share components and tables."""
    first = frames[0]
    single = len(first.order) == 1  # a scan of one component has its blocks row by row, whatever its sampling
    h_most, v_most = max(p[1] for p in first.parts), max(p[2] for p in first.parts)
    _, own_h, own_v, _ = first.parts[0]
    blocks = [(part, dc, ac, v, h) for part, dc, ac in first.order for v in range(1 if single else first.parts[part][2]) for h in range(1 if single else first.parts[part][1])]
    # Blocks of luminance in a row and column of the image, and units of the scan.
    wide, high = ([-(-n * own // (8 * most)) for n in ns] for ns, own, most in (([f.width for f in frames], own_h, h_most), ([f.height for f in frames], own_v, v_most)))
    across = wide if single else [-(-f.width // (8 * h_most)) for f in frames]
    units = [a * (b if single else -(-f.height // (8 * v_most))) for a, b, f in zip(across, high, frames, strict=True)]
    raw = np.concatenate([*buffers, np.zeros(8, np.uint8)])
    size = np.array([len(b) for b in buffers])
    is_ff = raw[:-1] == 255
    drop = np.zeros(len(raw), bool)
    drop[1:] = is_ff & (raw[1:] == 0)
    mark = np.flatnonzero(is_ff & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    mark = mark[mark < size.sum()]
    drop[mark] = drop[mark + 1] = True
    kept = np.cumsum(~drop)
    bits = raw[~drop]
    begins = np.cumsum(size) - size
    lane_at = np.sort(np.concatenate([begins, mark + 2]))
    lane_frame = np.searchsorted(begins, lane_at, side="right") - 1
    nth = np.arange(len(lane_at)) - np.searchsorted(lane_frame, lane_frame)
    units_of, every = np.array(units)[lane_frame], np.array([f.restart or u for f, u in zip(frames, units, strict=True)])[lane_frame]
    unit0 = nth * every
    left = np.minimum(every, units_of - unit0)
    if (left <= 0).any() or (np.bincount(lane_frame, weights=left, minlength=len(frames)) != units).any():
        raise ValueError("restart markers do not fit the size")
    position = np.where(lane_at > 0, kept[lane_at - 1], 0).astype(np.int64) * 8
    b = np.concatenate([bits, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    end = (len(window) - 1) * 8

    def peek(p: np.ndarray) -> np.ndarray:
        return ((window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int64)

    tables = {(k, t): _lookup(first.codes[16 * k + t]) for _, dc, ac in first.order for k, t in ((0, dc), (1, ac))}
    luma = [x for x in blocks if x[0] == first.order[0][0]]
    dc_out = np.zeros((sum(units), len(luma)), np.int32)
    out0 = (np.cumsum(units) - units)[lane_frame] + unit0
    predicted = np.zeros((len(first.parts), len(lane_at)), np.int64)
    order = np.argsort(-left, kind="stable")
    left, position, out0, predicted = left[order], position[order], out0[order], predicted[:, order]
    for step in range(int(left[0])):
        n = int(np.searchsorted(-left, -step, side="left"))  # lanes with more than ``step`` units
        p, seen = position[:n], 0
        for part, dc, ac, _, _ in blocks:
            entry = tables[0, dc][peek(p)]
            if not entry.all():
                raise ValueError("no such code")
            p = p + (entry >> 8)
            length = (entry & 255).astype(np.int64)
            value = peek(p) >> (16 - length)
            value = np.where((value << 1) >> length, value, value - (1 << length) + 1) * (length > 0)
            p = p + length
            predicted[part, :n] += value
            if part == first.order[0][0]:
                dc_out[out0[:n] + step, seen] = predicted[part, :n]
                seen += 1
            run, todo = np.ones(n, np.int64), None
            while True:
                here = p if todo is None else p[todo]
                entry = tables[1, ac][peek(here)]
                if not entry.all():
                    raise ValueError("no such code")
                symbol = entry & 255
                moved = np.minimum(here + (entry >> 8) + (symbol & 15), end)
                k = np.where(symbol == 0, 64, (run if todo is None else run[todo]) + (symbol >> 4) + 1)
                if todo is None:
                    p, run = moved, k
                    todo = np.flatnonzero(k < 64)
                else:
                    p[todo], run[todo] = moved, k
                    todo = todo[k < 64]
                if not len(todo):
                    break
        position[:n] = p
    out, at = [], 0
    h, v = (1, 1) if single else (own_h, own_v)
    for f, a, u, w, n in zip(frames, across, units, wide, high, strict=True):
        grid = dc_out[at : at + u].reshape(u // a, a, v, h).transpose(0, 2, 1, 3).reshape(u // a * v, a * h)
        at += u
        grey = np.clip((grid * f.quant[f.parts[0][3]] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        out.append(grey[:n, :w])
    return out


def thumbnails(media: list[bytes]) -> list[list[np.ndarray] | None]:
    """DC-only luminance of every frame of every stream; None where a stream is not baseline JPEG."""
    out: list = [None] * len(media)
    alike = defaultdict(list)
    for i, data in enumerate(media):
        try:
            parsed = parse_markers(data)
        except (ValueError, IndexError, KeyError, struct.error):
            continue
        out[i] = [None] * len(parsed)
        for k, f in enumerate(parsed):
            alike[tuple(f.parts), tuple(f.order), tuple(sorted(f.codes.items()))].append((i, k, f))
    for group in alike.values():
        try:
            found = _scan_thumbnails([np.frombuffer(media[i], np.uint8)[f.start : f.stop] for i, _, f in group], [f for _, _, f in group])
        except (ValueError, IndexError, KeyError):
            found = []
            for i, _, f in group:  # one broken stream does not spoil its neighbours
                try:
                    found += _scan_thumbnails([np.frombuffer(media[i], np.uint8)[f.start : f.stop]], [f])
                except (ValueError, IndexError, KeyError):
                    found.append(None)
        for (i, k, _), grey in zip(group, found, strict=True):
            out[i][k] = grey
    return [None if x is None or any(g is None for g in x) else x for x in out]


def thumbnail_hash(grey: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 mean grid is brighter than its right neighbour. Fewer rows or columns
    than cells are repeated."""
    rows = np.arange(8) * grey.shape[0] // 8
    columns = np.arange(9) * grey.shape[1] // 9
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), columns, axis=1), rows, axis=0)
    width = np.maximum(np.diff([*columns, grey.shape[1]]), 1)
    mean = sums / width
    return int.from_bytes(np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes(), "big")


def stacked(frames: list[np.ndarray]) -> np.ndarray:
    """All frames of a stream as one image, one below another; narrower ones are filled up with 0."""
    width = max(f.shape[1] for f in frames)
    return np.concatenate([np.pad(f, ((0, 0), (0, width - f.shape[1]))) for f in frames])


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, padded with bytes 0, in a media column of JPEGs.

    A null text is empty, and an empty one is stored as 64 bytes 0. Each row is encoded by itself, so
    rows with equal or null doc_id all stay; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = raw_strings(batch.column("text"))
            for a, b in slices(batch, np.diff(at), STEP_BYTES):
                sizes = np.diff(at[a : b + 1]).tolist()
                lengths = [padded(n) for n in sizes]
                buffer = np.zeros(sum(lengths), np.uint8)
                to, start = 0, int(at[a])
                for n, long in zip(sizes, lengths, strict=True):
                    buffer[to : to + n] = data[start : start + n]
                    to, start = to + long, start + n
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(encode_payloads(buffer, lengths), pa.binary())], ["doc_id", "n_bytes", "media"])

    return mapped(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, n_bytes long, media binary")


def store_media(media: DataFrame, path: str) -> DataFrame:
    """Write a table with a media column (zstd) and read it again."""
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, frames int, thumbnail_hash string"


def decode_media(media: DataFrame) -> DataFrame:
    """Adds, to a table with a column ``media`` of JPEG streams, the payload's digests read back from the
    DC-only thumbnails, the dimensions and the thumbnail hash, both of all frames one below another. Null or
    broken media: all of these null."""
    keep = [c for c in media.columns if c != "media"]
    kinds = dict(media.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        kind = [types[x.split()[1]] for x in FEATURES.split(", ")]
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("media")], np.int64)
            for a, b in slices(batch, sizes, STEP_BYTES):
                streams = [x if x is not None else b"" for x in batch.column("media").slice(a, b - a).to_pylist()]
                rows = []
                for data, frames in zip(streams, thumbnails(streams), strict=True):
                    if frames is None:
                        rows.append([None] * len(names))
                        continue
                    payload = b"".join(g.tobytes() for g in frames)
                    whole = frames[0] if len(frames) == 1 else stacked(frames)
                    height, width = whole.shape
                    mark = f"{thumbnail_hash(whole):016x}"
                    rows.append([len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), f"{width}x{height}x{len(frames)}:{mark}", width, height, len(frames), mark])
                yield pa.record_batch([*[batch.column(c).slice(a, b - a) for c in keep], *[pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kind, strict=True)]], [*keep, *names])

    return mapped(media, run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], FEATURES]))
