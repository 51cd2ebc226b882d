"""Token ids in Parquet: list columns, encoded for selective reads of tokens or of metadata alone.

A file holds a run of documents in ascending doc_id order. ``ids`` is a dictionary-encoded list
column (a vocabulary fits a dictionary page); doc_id, n_tokens and part_start are delta-encoded, so
that positions are read without touching ids. Row groups are small enough to skip, and the writer's
column and offset indexes let a reader fetch single pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import corpus_size, mapped, raw_strings, slices, text_or_empty
from .tokens import forget_encoders, part_encoder

FILE_BYTES = 32 << 20  # UTF-8 bytes of text for each file
STEP_BYTES = 4 << 20
MOST_PARTS = 200_000  # parts whose starts may be broadcast (16 bytes each)

# The writer's settings.
LAYOUT = {
    "compression": "snappy",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.columnindex.truncate.length": "64",
}


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Encode each whole text, append ``end_id``, and write files in ascending doc_id order.

    A null text is empty (one token, the end). A null doc_id comes last; rows with equal doc_ids are
    in the order of the input, and all are written; an empty table gives no ids. Texts are dealt by ranges of doc_id and place
    in the input before they are encoded, so that each is encoded once, where it is written, and a doc_id of many rows
    is split. ``docs`` should be a stored table, which is read again in the same order.
    """
    _, size = corpus_size(docs)
    order = [F.col("doc_id").asc_nulls_last(), F.col("place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = None, 0
        for batch in batches:
            encoder = encoder or part_encoder(vocabulary)
            end = np.array([end_id], "<u4").tobytes()
            at, data = raw_strings(batch.column("text"))
            flat = data.tobytes()
            for a, b in slices(batch, np.diff(at), STEP_BYTES):
                ids = [x + end for x in encoder.ids([flat[x:y] for x, y in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True)])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                stops = np.cumsum(n)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), values)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(start + stops - n), lists], ["doc_id", "n_tokens", "part_start", "ids"])
                start += int(stops[-1])

    placed = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = placed.repartitionByRange(max(1, -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order)
    mapped(dealt, run, "doc_id long, n_tokens long, part_start long, ids array<int>").write.options(**LAYOUT).parquet(path)


def read_positions(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """(doc_id, start, n_tokens, ...) of token files; ids are read only if they are among ``more``.

    A document's start is its place in its part plus the tokens of the parts before it: one row a part.
    """
    files = spark.read.schema("doc_id long, n_tokens long, part_start long, ids array<int>").parquet(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("part")
    totals = files.select(part, (F.col("part_start") + F.col("n_tokens")).alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = files.select("doc_id", "n_tokens", "part_start", *more, part)
    if before.count() <= MOST_PARTS:
        before = F.broadcast(before)  # a row a part; its size is checked, and beyond it the join shuffles
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", *more)


def token_digests(rows: DataFrame) -> DataFrame:
    """Replaces the list column ``ids`` by the CRC-32 of its little-endian unsigned 32-bit integers."""
    keep = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    kinds = dict(rows.dtypes)
    return mapped(rows, run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "ids_crc32 long"]))
