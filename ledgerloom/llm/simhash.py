"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a common variant at most r bits from each. So each distinct
fingerprint emits all its variants within half the radius, and fingerprints that meet at a variant
are candidates. A variant's ball has a fixed number of members (65 of 64 bits), and every two of them
are within the radius; a link from each to the least of them therefore loses none.

The pipeline's near copies differ in more bits than a ball can hold. There a fingerprint has 512 bits, cut into bands;
texts that have a band in common are linked to the least that has it, and links are checked shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import LAST_ID, fresh, join_spread, mapped, raw_strings, stored, text_or_empty
from .graph import components
from .resemblance import N_WORDS, resembling, resembling_smaller, set_digests

SEED = 42
STEP = 1 << 16  # shingles counted at a time
NARROWEST, WIDER = 16, 4  # bits of a band: that many at least, and so many more than number the texts
APART = 16  # of the first 64 bits of two texts with a band in common: in more they are no near copies
ROWS, MOST_TASKS = 20_000, 50_000  # fingerprints whose variants a task emits, more where tasks would be too many


def fingerprint_words(text: bytes, words: int, n_words: int = 1) -> list[int]:
    """``n_words`` independent 64-bit fingerprints (unsigned) of the word shingles of a text, A-Z lower-cased,
    repeats included. The first is of XXH64 with seed 42, further ones of numbers mixed from it."""
    parts = text.lower().split()
    if not parts:
        return [0] * n_words
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(size + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts, stops = (stop - size)[:n].tolist(), stop[-n:].tolist()
    of = xxhash.xxh64_intdigest
    first = np.array([of(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    out = []
    for k in range(n_words):
        hashes = first if k == 0 else _mixed(first + np.uint64(0x9E3779B97F4A7C15 * k % 2**64))
        count = np.zeros(64, np.int64)
        for at in range(0, n, STEP):
            bits = np.unpackbits(hashes[at : at + STEP].astype(">u8").view(np.uint8)).reshape(-1, 64)
            count += bits.sum(axis=0, dtype=np.uint32)
        out.append(int.from_bytes(np.packbits(2 * count > n).tobytes(), "big"))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """Further hashes of a shingle, from its first."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 3, n_words: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...): signed 64-bit fingerprints of each whole text. A null or empty text has zeros."""
    names = [f"f{k}" for k in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = raw_strings(batch.column("text"))
            flat, ends = data.tobytes(), at.tolist()
            found = np.array([fingerprint_words(flat[a:b], words, n_words) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64).reshape(-1, n_words)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(found[:, k].astype(np.int64)) for k in range(n_words)]], ["doc_id", *names])

    return mapped(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def ball(value: Column, bits: int, radius: int) -> Column:
    """An array of all variants of a number within ``radius`` flipped bits of its lowest ``bits``."""
    masks = [sum(1 << i for i in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: value.bitwiseXOR(m))


def fingerprint_links(distinct: DataFrame, bits: int = 64, radius: int = 2) -> DataFrame:
    """(a, b): links among distinct fingerprints (``f``, long) within ``radius`` differing bits, enough to
    connect all that are; each pair is verified."""
    if radius % 2:
        raise ValueError("an even radius has a middle")
    n = distinct.count()
    dealt = distinct.repartition(max(1, n // max(ROWS, n // MOST_TASKS)), "f")
    variants = dealt.select("f", F.explode(ball(F.col("f"), bits, radius // 2)).alias("variant"))
    met = variants.groupBy("variant").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.collect_list("f").alias("members"))
    pairs = met.where("low <> high").select(F.col("low").alias("b"), F.explode("members").alias("a")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the smallest doc_id reachable over links.

    Equal fingerprints are one node, whatever the number of their documents: only distinct ones are
    shuffled and linked. Repeated rows each keep their row. A null doc_id is larger than all others: its
    component_id is null only where its component has no other. A null or empty text has fingerprint 0.
    """
    rows = stored(fingerprints(docs, words).withColumnRenamed("f0", "f").withColumn("key", F.coalesce("doc_id", F.lit(LAST_ID))), "fingerprints")
    distinct = stored(rows.groupBy("f").agg(F.min("key").alias("key")), "distinct")
    parts = components(fingerprint_links(distinct.select("f"), 64, radius)).withColumnRenamed("id", "f")
    # Components are of fingerprints; each takes the smallest doc_id of its members.
    linked = distinct.join(parts, "f", "left").select("f", "key", F.coalesce("component", "f").alias("component"))
    linked = stored(linked, "linked")
    least = linked.groupBy("component").agg(F.min("key").alias("least"))
    out = join_spread(rows, join_spread(linked.select("f", "component"), least, "component").select("f", "least"), "f")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.when(F.col("least") != LAST_ID, F.col("least")).alias("component_id"))


def bands(nodes: DataFrame, width: int) -> DataFrame:
    """(band, node, f): for each of ``nodes`` (node, bits) the bands of ``width`` bits that its fingerprint has, and its first word."""
    n = 64 * N_WORDS // width
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = raw_strings(batch.column("bits"))[1].reshape(-1, 8 * N_WORDS)
            cut = np.unpackbits(whole, axis=1)[:, : n * width].reshape(-1, n, width)
            band = (cut * weights).sum(axis=2, dtype=np.uint64) * np.uint64(n) + np.arange(n, dtype=np.uint64)
            first = np.ascontiguousarray(whole[:, :8]).view(">u8").astype(np.uint64).view(np.int64)
            node = batch.column("node").to_numpy()
            yield pa.record_batch([pa.array(band.reshape(-1).view(np.int64)), pa.array(np.repeat(node, n)), pa.array(np.repeat(first, n))], ["band", "node", "f"])

    return mapped(nodes.select("node", "bits"), run, "band long, node long, f long")


def linked_to_least(nodes: DataFrame) -> DataFrame:
    """(a, b): each of ``nodes`` (node, bits) with the least node that has one of its bands, where that is another and few
    of the first 64 bits differ. A band is wide enough that few texts have it by chance, and however many have
    it, each gets one pair from it."""
    width = max(NARROWEST, nodes.count().bit_length() + WIDER)
    least = F.min(F.struct("node", "f")).over(Window.partitionBy("band"))
    met = bands(nodes, width).withColumn("least", least).where("node > least.node")
    return met.where(F.bit_count(F.col("f").bitwiseXOR(F.col("least.f"))) <= APART).select(F.col("node").alias("a"), F.col("least.node").alias("b")).distinct()


def keep_one_of_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without each row whose text resembles that of a row which stays and has a smaller doc_id (null last).

    SimHash comes first: texts whose fingerprints have a band in common are compared, shingle by shingle, with the least
    that has it. Fingerprints lose some pairs and join some texts that do not resemble each other, so what they
    do not settle is searched exactly: no row goes that does not resemble one that stays, and no two that stay
    resemble each other, whatever the fingerprints. Resemblance and fingerprints are those of the sets of shingles,
    repeats not counted. Texts of equal sets are one node. All columns stay. Empty and null texts are one group, as
    are repeated rows.
    """
    row = f"{fresh('_near', docs.columns)}_row"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "marked")
    slim = rows.select(F.col(row).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), text_or_empty().alias("text"))
    digests = set_digests(slim, words)
    first = digests.join(slim.select("key", "doc"), "key").groupBy("high", "low").agg(F.min(F.struct("doc", "key", "bits")).alias("first"))
    # Numbers that grow with doc_id: a sorted table's partitions are numbered in its order.
    nodes = stored(first.orderBy("first").select(F.monotonically_increasing_id().alias("node"), F.col("first.key").alias("key"), F.col("first.bits").alias("bits")), "nodes")
    texts = nodes.select("node", "key")
    alike = stored(resembling(linked_to_least(nodes), slim, texts, words, similarity), "alike")
    removed = resembling_smaller(slim, texts, words, similarity, alike).withColumnRenamed("key", "node")
    kept = texts.join(removed, "node", "left_anti")
    gone = stored(rows.select(row).join(kept.select(F.col("key").alias(row)), row, "left_anti"), "removed")
    return rows.join(gone, row, "left_anti").select(*docs.columns)
