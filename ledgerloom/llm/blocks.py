"""Exchange between blocks of documents and shards of hashes.

Documents are dealt once to blocks of a few megabytes. A block says what hashes its texts have, by
shard: each hash once, however often the block has it, in one compact row for each shard. A shard
sees the hashes of all blocks and answers each. So hot values cost at most one entry a block, every step
is a numpy operation over arrays, and no row holds more than a block or a shard.

Each block sends each shard a row, so rows grow with the product of the two. Blocks and shards therefore grow with the
root of the input (``grown``), up to sixteen times: a row still holds tens of hashes at 100 TB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LAST_ID, corpus_size, raw_strings, release, text_or_empty

BLOCK_BYTES = 4 << 20  # UTF-8 bytes of text in a block
GROW_FROM = 64 << 30  # bytes of input from which blocks and shards grow
MOST_GROWTH = 16  # times that they grow at most: a block of 64 MB takes a worker one or two gigabytes


def grown(base: int, size: int) -> int:
    """``base``, grown with the root of the size of the input."""
    return int(base * min(MOST_GROWTH, max(1.0, (size / GROW_FROM) ** 0.5)))


class Blocks:
    """The documents of ``docs`` (doc_id, text), dealt to blocks; ``carry`` names columns that go with them,
    as _c0, _c1 and so on."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> None:
        rows, size = corpus_size(docs)
        self.count = max(1, min(rows, -(-size // grown(block_bytes, size))))
        kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
        # Every row by itself, so that neither an id nor a text that many rows have gathers them in a block. The number is the
        # row's place in the input, so ``docs`` should be a stored table: a lost part of it is then read again the same.
        salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(self.count))
        self.rows = kept.withColumn("block", salt).repartition(self.count, "block")
        self.size = size

    def tell(self, f: Callable[[pa.Table], Iterable[dict]], schema: str, answers: DataFrame | None = None) -> DataFrame:
        """Rows that ``f`` makes of each block, and of the answers to it if there are any."""
        out = _schema(schema)
        if answers is None:
            return self.rows.groupBy("block").applyInArrow(lambda t: _table(f(t), out), schema)
        return self.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: _table(f(t, a), out), schema)


def ask(told: DataFrame, shards: int, f: Callable[[pa.Table], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``f`` makes of all that blocks told a shard; shards are heavy, so none wait for another's task."""
    out = _schema(schema)
    return told.repartition(shards, "shard").groupBy("shard").applyInArrow(lambda t: _table(f(t), out), schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(text: str) -> pa.Schema | None:
    """None of a schema with carried columns: there ``f`` gives a table itself."""
    pairs = [x.split(" ", 1) for x in text.split(", ")]
    return None if any(a.startswith("_c") for a, _ in pairs) else pa.schema([(a, _KINDS[b]) for a, b in pairs])


def _table(rows: Iterable[dict] | pa.Table, schema: pa.Schema | None) -> pa.Table:
    pa.set_memory_pool(pa.system_memory_pool())
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(list(rows), schema)
    del rows
    release(collect=False)  # once for each block: a full collection would cost more than the block
    return table


def documents(table: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """(doc_ids, their order with null last, texts) of a block, ordered by doc_id and text."""
    at, data = raw_strings(table.column("text"))
    flat, ends = data.tobytes(), at.tolist()
    ids = table.column("doc_id").to_pylist()
    texts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    order = sorted(range(len(ids)), key=lambda i: (LAST_ID if ids[i] is None else ids[i], texts[i]))
    ids = [ids[i] for i in order]
    return ids, np.array([LAST_ID if i is None else i for i in ids], np.int64), [texts[i] for i in order]


def by_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins and ends among ascending hashes: a shard has an equal part of their range."""
    width = -(-(2**64) // shards)
    return np.searchsorted(hashes, np.array([min(k * width, 2**64 - 1) for k in range(1, shards)], np.uint64), side="left") if shards > 1 else np.zeros(0, np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending: a sort of numbers is many times as fast as numpy's own ``unique``."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each is there."""
    values = np.sort(values)
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[new], np.diff(np.append(new, len(values)))


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are there among ascending ones."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def parts(n: int, cuts: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))
