"""Document fingerprints: threshold-scaled sketches of word shingles.

Every shingle hash below a fixed fraction of the hash space is retained, whatever the document's length, so sketches
of very unequal documents compare and merge without loss: the sketch of a union is the union of the sketches.
A fingerprint has the retained hashes after two numbers on all of them, their count and their sum, which tell equal
sets from others where too few hashes are retained to do so. With k retained hashes in either of two documents, an
estimate of resemblance J has a standard error of about sqrt(J (1 - J) / k); a text of 100 words has some 25.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import corpus_size, mapped, raw_strings, text_or_empty

FRACTION = 4  # one hash in so many is retained
WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the distinct shingles of lower-cased (A-Z) words, ascending; a text of fewer words
    is one shingle, and one of none has no hash."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    h = np.full(n, min(len(w), words), np.uint64)
    for j in range(min(words, len(w))):
        h = (h ^ w[j : j + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def further(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """A column each of independent 64-bit hashes: those given, then others made of them."""
    h = hashes[:, None] + np.arange(n_words, dtype=np.uint64) * _MULTIPLIER
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h[:, 0] = hashes
    return h


def majority(hashes: np.ndarray, n_words: int = 1) -> bytes:
    """The SimHash of 64-bit hashes (unsigned), in ``n_words`` big-endian words, each of further hashes than the one
    before: a bit is set if over half of them have it. Of no hash it is 0."""
    count = np.zeros(64 * n_words, np.int64)
    for at in range(0, len(hashes), 255):  # as many as fit the sum of a byte: eight bytes are added at once
        part = hashes[at : at + 255]
        rows = (further(part, n_words) if n_words > 1 else part).astype(">u8")
        bits = np.unpackbits(rows.view(np.uint8).reshape(-1)).view(np.uint64).reshape(len(part), -1)
        count += bits.sum(axis=0).view(np.uint8)
    return np.packbits(2 * count > len(hashes)).tobytes()


def sketch(hashes: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The retained part of ascending hashes."""
    return hashes if fraction == 1 else hashes[: np.searchsorted(hashes, np.uint64(2**64 // fraction))]


def fingerprint(hashes: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The count and the sum of ascending hashes (mod 2**64), then the retained ones."""
    return np.concatenate([np.array([len(hashes), hashes.sum(dtype=np.uint64)], np.uint64), sketch(hashes, fraction)])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two documents' shingles, from their sketches."""
    return np.union1d(a, b)


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Estimates, from two fingerprints, of resemblance and of the containment of each in the other. Equal sets, also
    empty ones, are 1; a document of which nothing is retained is 0 like any of another set."""
    if (a[:2] == b[:2]).all():
        return 1.0, 1.0, 1.0
    a, b = a[2:], b[2:]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both), both / max(1, len(a)), both / max(1, len(b))


def as_text(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype(">u8").tobytes()).decode()


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(value), ">u8").astype(np.uint64)


def document_sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint): a null or empty text has the fingerprint of no shingles; every row its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = raw_strings(batch.column("text"))
            flat, ends = data.tobytes(), at.tolist()
            found = [as_text(fingerprint(shingle_hashes(flat[a:b], words))) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return mapped(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, fingerprint string")


RANGE_BYTES = 16 << 20  # UTF-8 bytes of text for each range of documents, more where ranges would be too many
MOST_RANGES = 200_000  # whose edges (two numbers each) go to the driver and back
FIRST_ID = -(2**63)  # stands for a null doc_id, the last in descending order
NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_next double, contains_next double"


def in_descending_ranges(docs: DataFrame) -> DataFrame:
    """(part, extra, key, tie, doc_id, text): documents dealt by ranges of doc_id and sorted within each, from the
    largest; each range ends with the document that follows it (extra = 1), the last with the very first.

    The ranges are found on the doc_ids alone, with the input's order for ties, so that a doc_id of many rows is
    split too. Two numbers a range go to the driver and back: the largest (doc_id, tie) of each, which are both
    its edge and the document that the range above it needs.
    """
    spark = docs.sparkSession
    _, size = corpus_size(docs)
    n = max(1, -(-size // max(RANGE_BYTES, size // MOST_RANGES)))
    tie = F.monotonically_increasing_id().alias("tie")  # ascending in the input's order
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("key"), tie, F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tops = rows.select("key", "tie").repartitionByRange(n, "key", F.col("tie").desc()).groupBy(F.spark_partition_id()).agg(F.max(F.struct("key", (-F.col("tie")).alias("tie"))).alias("top")).select("top.*").collect()
    top = spark.sparkContext.broadcast(np.array(sorted((r[0], r[1]) for r in tops), np.int64).reshape(-1, 2))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ties = top.value[:, 0], top.value[:, 1]
        for batch in batches:
            key, back = batch.column("key").to_numpy(), -batch.column("tie").to_numpy()
            part = np.searchsorted(keys, key, side="left")
            last = np.searchsorted(keys, key, side="right")
            for i in np.flatnonzero(last - part > 1).tolist():  # a doc_id that several ranges end with
                part[i] += np.searchsorted(ties[part[i] : last[i]], back[i], side="left")
            full = np.flatnonzero((last - part == 1) & (ties[np.minimum(part, len(ties) - 1)] < back))
            part[full] += 1  # ties after the last range that ends with this doc_id
            again = np.flatnonzero((keys[part] == key) & (ties[part] == back))
            names = ["part", "extra", *batch.schema.names]
            yield pa.record_batch([pa.array(part), pa.array(np.zeros(len(key), np.int32)), *batch.columns], names)
            if len(again):
                taken = batch.take(pa.array(again))
                yield pa.record_batch([pa.array((part[again] + 1) % len(keys)), pa.array(np.ones(len(again), np.int32)), *taken.columns], names)

    tagged = mapped(rows, tag, "part long, extra int, key long, tie long, doc_id long, text string")
    return tagged.repartition(n, "part").sortWithinPartitions("part", "extra", F.col("key").desc(), "tie")


def neighbour_likeness(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is that with the next smaller doc_id, after the last the first; the edited text has
    its last third (of code points, rounded down) replaced by as much of the next one's start. A null text
    is empty; a null doc_id is after all others; rows with equal doc_ids follow one another in the order of
    the input. A
    document alone is its own next. One shuffle of the texts; a task holds two documents at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in NEIGHBOURS.split(", ")]
        held = None  # part, doc_id, text, sketch
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")]
            for part, extra, doc_id, text in zip(*columns, strict=True):
                kept = fingerprint(shingle_hashes(text.encode(), words))
                if held and held[0] == part:
                    n = len(held[2])
                    edited = (held[2][: n - n // 3] + text[: n // 3]).encode()
                    changed = fingerprint(shingle_hashes(edited, words))
                    near, inside, around = likeness(held[3], kept)
                    out.append((held[1], n, hashlib.sha256(edited).hexdigest(), as_text(held[3]), as_text(changed), likeness(held[3], changed)[0], near, inside, around))
                held = None if extra else (part, doc_id, text, kept)
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            types = [kinds[x.split()[1]] for x in NEIGHBOURS.split(", ")]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names)

    return mapped(in_descending_ranges(docs), run, NEIGHBOURS)
