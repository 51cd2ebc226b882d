"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where documents are ordered: after every real one.
LAST_ID = 2**63 - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a local session (one machine, as in tests) takes a temporary folder; a cluster has
    no folder that is known to be shared, so there it is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        set_before = context._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            base = set_before.get()
        elif context.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="ledgerloom-")
            context.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that goes to Python, whichever is reached first.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def release(collect: bool = True) -> None:
    """Give back memory at a task's end: workers are kept for later tasks, beside which it would count."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small batches, whose workers hold no memory between tasks.

    Spark reads the bounds of batches when a plan runs, so they are the session's; smaller ones that it has stay.
    """
    conf = df.sparkSession.conf
    for name, most in BATCH.items():
        if not 0 < int(conf.get(name).removesuffix("b")) <= most:
            conf.set(name, str(most))

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # what it frees can be given back
        yield from run(batches)
        release()

    return df.mapInArrow(then_release, schema)


def fresh(stem: str, columns: list[str]) -> str:
    """``stem``, with as many underscores before it as it takes to begin no column's name."""
    while any(c.lower().startswith(stem.lower()) for c in columns):
        stem = f"_{stem}"
    return stem


SPREAD_ROWS = 100_000  # rows of one key that are a task's work


def join_spread(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key), where any key may hold most of ``rows``.

    A key of more than ``SPREAD_ROWS`` rows, and more than a thousandth of all, is joined in parts: at most a thousand
    keys are so, and their list alone is broadcast. ``rows`` should be stored, as it is read twice.
    """
    most = max(SPREAD_ROWS, rows.count() // 1000)
    part, hot, n = (fresh(x, [*rows.columns, *table.columns]) for x in ("_part", "_hot", "_n"))
    wide = rows.groupBy(F.col(key).alias(hot)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) >= most).select(hot, F.expr(f"{n} div {most}").alias(n))
    parts = F.broadcast(wide)
    left = rows.join(parts, F.col(key) == F.col(hot), "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col(n), F.lit(0)) + 1)).drop(hot, n)
    right = table.join(parts, F.col(key) == F.col(hot), "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(0))))).drop(hot, n)
    return left.join(right, [key, part]).drop(part)


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, UTF-8 bytes of text): one column-pruned pass, two numbers to the driver."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_or_empty()))).first()
    return int(row[0]), int(row[1] or 0)


def raw_strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and UTF-8 bytes of a string or binary column without Python strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return at, np.zeros(0, np.uint8)
    whole = np.frombuffer(data, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row where a single row is longer."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield start, batch.num_rows
