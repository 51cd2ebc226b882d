"""Best-fit packing of token sequences under several capacities at once.

A bin (a training sequence) has a capacity of tokens, of documents and of attention cost (the sum of
squared lengths). Pieces are taken by descending length; each goes to the open bin that fits under
every capacity and scores best, by the weighted dot product of need and residual or by the weighted
norm of what would be left, or opens a new bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, raw_strings, stored, text_or_empty
from .tokens import PartEncoder

CAPACITY = 4096
GROUP_TOKENS = 12_000_000  # tokens packed by one task; a group leaves about one bin unfilled
GROUP_ROWS = 200_000  # pieces packed by one task, where they are short


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each length. ``rule``: "norm" or "dot". Of equal lengths the first comes first; no length, no bin."""
    whole = np.array([tokens, documents, attention], float)
    if len(lengths) and (lengths.max() > tokens or float(lengths.max()) ** 2 > attention or documents < 1):
        raise ValueError("a piece exceeds a capacity")
    scale, weight = 1 / whole, np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    least = lengths[order[-1]] if len(order) else 0
    left = np.zeros((3, max(16, len(lengths))))  # residuals of the open bins
    name = np.zeros(left.shape[1], np.int64)
    n_open = bins = 0
    for i in order.tolist():
        n = float(lengths[i])
        need = np.array([n, 1.0, n * n])
        here = left[:, :n_open]
        fits = np.flatnonzero((here[0] >= n) & (here[1] >= 1) & (here[2] >= need[2]))
        if len(fits):
            residual = here[:, fits]
            if rule == "dot":
                best = np.argmax((weight * scale * scale * need) @ residual)
            else:
                rest = (residual - need[:, None]) * scale[:, None]
                best = np.argmin(weight @ (rest * rest))
            k = int(fits[best])
        else:
            k, n_open = n_open, n_open + 1
            left[:, k], name[k], bins = whole, bins, bins + 1
        place[i], offset[i] = name[k], int(whole[0] - left[0, k])
        left[:, k] -= need
        if left[0, k] < least or left[1, k] < 1 or left[2, k] < float(least) ** 2:
            n_open -= 1  # full: the last open bin takes its place
            left[:, k], name[k] = left[:, n_open], name[n_open]
    return place, offset


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole text's ids and ``end_id``, cut only where they
    exceed ``capacity``. A null text is empty (one token); repeated rows give their pieces each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or PartEncoder(vocabulary)
            end = np.array([end_id], "<u4").tobytes()
            at, data = raw_strings(batch.column("text"))
            flat, ends = data.tobytes(), at.tolist()
            out: list[tuple] = []
            texts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.ids(texts), strict=True):
                ids = found + end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[s : s + 4 * capacity]
                    out.append((doc, k, s // 4, len(cut) // 4, zlib.crc32(cut)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = CAPACITY, documents: int = CAPACITY, attention: float = float(CAPACITY) ** 2, rule: str = "norm", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to rows with a column ``length`` (1 to ``capacity``).

    Rows are dealt at random to groups of about ``group_tokens`` tokens (or ``GROUP_ROWS`` rows), and each group is packed by
    itself: a bin of each may stay unfilled, no other task is waited for, and no value of any column
    can gather many rows in one group. Equal lengths go by doc_id and piece; an empty table gives no rows. With the
    defaults, documents and attention cost never bind, as fewest sequences are asked for: they only enter the choice.
    """
    base = stored(items, "items")
    total, rows = base.agg(F.sum("length"), F.count(F.lit(1))).first()
    groups = max(1, -(-int(total or 0) // group_tokens), -(-rows // GROUP_ROWS))
    out = base.schema.add("sequence_id", "long").add("offset", "long")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([c for c in ("length", "doc_id", "piece") if c in group], kind="stable", na_position="last")
        place, offset = best_fit(group["length"].to_numpy(), capacity, documents, attention, rule)
        return group.assign(sequence_id=(int(group["_group"].iloc[0]) << 32) + place, offset=offset).drop(columns="_group")

    dealt = base.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, out)
