"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal size in words. Slot k has the golden-ratio point frac(k * phi), which the
cumulative weights of the sources map to a source, so every stretch of slots is near the weights. The
r-th slot of a source takes the r-th block of its documents, laid end to end in an order shuffled by a
hash and repeated up to three times. So the schedule alone decides how many blocks of a source are taken, which
documents these are, and where in the mix they stand.

A slot is a small part of the smallest target. Sources whose targets differ by more than ``SPREAD`` times
therefore have schedules of their own (tiers) with slots of their own size; a slot's place in the mix is
its fraction of its schedule, so that the tiers run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, mapped, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times that a document may be taken
FINE = 1024  # slots that the smallest target of a tier has at least, where a word is not more than a slot
SPREAD = 64  # times that targets of one tier may differ
MOST_SLOTS = 1 << 22  # slots of a tier, or FINE for each of its sources if these are more
BLOCK = 1 << 16  # words in a slot at most, where MOST_SLOTS allows
CHUNK = 1 << 14  # slots ranked by one task
SEED = 42

# Fixed value: the golden ratio's fraction in 64-bit fixed point, whose products wrap without error.
GOLDEN = 0x9E3779B97F4A7C15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """The target of each source: sources by code point, null last, take ``weights`` in turn and share the sum
    of all sizes; a target above ``most`` times its source's size stops there and the excess is shared anew."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size, target = dict(ordered), {}
    rest, todo = float(sum(size.values())), set(size)
    while todo:
        share = rest / sum(weight[s] for s in todo)
        over = {s for s in todo if weight[s] * share > most * size[s]}
        if not over:
            target |= {s: weight[s] * share for s in todo}
            break
        target |= {s: float(most * size[s]) for s in over}
        rest -= sum(most * size[s] for s in over)
        todo -= over
    return target


@dataclass(frozen=True)
class Tier:
    """Sources that share a schedule: their names and shares, in order; the number of slots; words in a slot."""

    names: list[str | None]
    shares: list[float]
    slots: int
    block: int


def tiers(target: dict[str | None, float]) -> list[Tier]:
    """The schedules of some targets in words. A source whose target is less than half a word is in none."""
    out, todo = [], sorted(((t, s) for s, t in target.items() if t >= 0.5), key=lambda x: (-x[0], x[1] is None, x[1] or ""))
    while todo:
        own = [(t, s) for t, s in todo if t * SPREAD >= todo[0][0]]
        todo = todo[len(own) :]
        total = sum(t for t, _ in own)
        block = max(1, min(BLOCK, int(own[-1][0]) // FINE), math.ceil(total / max(MOST_SLOTS, FINE * len(own))))
        own.sort(key=lambda x: (x[1] is None, x[1] or ""))
        out.append(Tier([s for _, s in own], [t / total for t, _ in own], max(1, round(total / block)), block))
    return out


def schedule(docs: DataFrame, plan: list[Tier]) -> DataFrame:
    """(source, rank, slot, place, block): the golden-ratio schedules, each slot ranked among those of its source.

    Slots are ranked in chunks, so that a source of heavy weight is ranked by many tasks. ``docs`` gives the session.
    """
    first = np.cumsum([0, *[t.slots for t in plan]])
    edges = [np.cumsum(t.shares)[:-1] for t in plan]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("id").to_numpy()
            tier = np.searchsorted(first, number, side="right") - 1
            for k in np.unique(tier).tolist():
                slot = number[tier == k] - first[k]
                point = (slot.astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(11)).astype(float) * 2.0**-53
                source = pa.array(plan[k].names, pa.string()).take(pa.array(np.searchsorted(edges[k], point, side="right")))
                columns = [source, slot, slot // CHUNK, (slot + 0.5) / plan[k].slots, np.full(len(slot), plan[k].block)]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["source", "slot", "chunk", "place", "block"])

    drawn = mapped(docs.sparkSession.range(int(first[-1])), draw, "source string, slot long, chunk long, place double, block long")
    sums = drawn.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("within", within).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return ranked.select("source", (F.col("before") + F.col("within")).alias("rank"), "slot", "place", "block")


def numbered(rows: DataFrame, group: list[str], row: str, name: str) -> DataFrame:
    """``rows`` with the number of each, from 0, among those equal in the columns ``group`` (not null), by ``row``.

    Rows are numbered within their partition, and partitions added up, so that no group is one task's work. ``row``
    is what monotonically_increasing_id gave stored rows.
    """
    part = fresh("_part", rows.columns)
    marked = rows.withColumn(part, F.shiftright(row, 33))
    local = marked.withColumn(name, F.row_number().over(Window.partitionBy(part, *group).orderBy(row)) - 1)
    counts = marked.groupBy(part, *group).agg(F.count(F.lit(1)).alias(f"{part}n"))
    offset = counts.withColumn(f"{part}b", F.sum(f"{part}n").over(Window.partitionBy(*group).orderBy(part)) - F.col(f"{part}n")).drop(f"{part}n")
    return local.join(offset, [part, *group]).withColumn(name, F.col(name) + F.col(f"{part}b")).drop(part, f"{part}b")


def takes(rows: DataFrame, target: dict[str | None, float], size: dict[str | None, int], most: int, seed: int) -> DataFrame:
    """(row, round, words, slot, place): what the slots of the schedule take of each of ``rows``, in each round, with
    the first slot that takes of it and that slot's place in the mix. ``rows`` has row, key, source and size.

    A source's documents lie in the order of a hash of ``key`` (a string that names a document); rows of
    one key and source are interchangeable, so the partitioning of the input changes nothing but which of them is which.
    """
    spark = rows.sparkSession
    plan = tiers(target)
    block = {s: t.block for t in plan for s in t.names}
    table = [(s, size[s], block[s]) for s in block]
    sources = spark.createDataFrame(table, "s string, source_size long, block long")
    marked = rows.where("size > 0").withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), "key", "size"))).select("row", "source", "size", "h")
    marked = marked.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("own", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))

    # Equal rows lie together, as one group; groups are summed in hashed chunks, so that no source is one task's.
    many = F.least(F.count(F.lit(1)), F.lit(SPREAD)).alias("copies")
    groups = marked.groupBy("own", "h").agg(F.sum("size").alias("n"), many).withColumn("chunk", F.substring("h", 1, 3))
    sums = groups.groupBy("own", "chunk").agg(F.sum("n").alias("n"))
    before = sums.select("own", "chunk", (F.sum("n").over(Window.partitionBy("own").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("own", "chunk").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    laid = groups.withColumn("inside", inside).join(before, ["own", "chunk"]).select("own", "h", "copies", (F.col("before") + F.col("inside")).alias("begin"))
    # A group of many equal rows is joined in SPREAD parts.
    laid = laid.select("own", "h", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("spread"))
    again = numbered(marked, ["own", "h"], "row", "nth").withColumn("spread", F.pmod(F.col("nth"), F.lit(SPREAD)).cast("long"))
    starts = again.join(laid, ["own", "h", "spread"]).withColumn("start", F.col("begin") + F.col("nth") * F.col("size"))

    slots = schedule(rows, plan)
    drawn = slots.groupBy("source").agg(F.count(F.lit(1)).alias("slots")).withColumnRenamed("source", "s")
    rounds = starts.select("row", "source", "size", "block", "start", "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round"))
    places = rounds.withColumn("a", F.col("start") + F.col("round") * F.col("source_size")).join(drawn, F.col("source").eqNullSafe(F.col("s")))
    places = places.where("a < slots * block").withColumn("z", F.least(F.col("a") + F.col("size"), F.col("slots") * F.col("block")))
    pieces = places.select("row", "round", "source", "a", "z", F.explode(F.expr("sequence(a div block, (z - 1) div block)")).alias("rank")).alias("p")
    joined = pieces.join(slots.alias("q"), F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.rank") == F.col("q.rank")))
    words = F.least("z", (F.col("q.rank") + 1) * F.col("q.block")) - F.greatest("a", F.col("q.rank") * F.col("q.block"))
    return joined.select("row", "round", words.alias("words"), "slot", "place").groupBy("row", "round").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"), F.min("place").alias("place"))


def source_targets(rows: DataFrame, weights: tuple[float, ...], most: int) -> tuple[dict[str | None, int], dict[str | None, float]]:
    """The size and the target of each source. The list of sources, a row each, goes to the driver: weights are
    dealt over it in order, and shares depend on all of it."""
    found = [(r[0], int(r[1])) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    return dict(found), shares(found, weights, most)


def taken_words(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """(key, size, source_size, target, taken, slot, place) of each row of (key, source, size).

    ``taken`` counts the words that the slots of the schedule take of the document, repeats counted: at most ``most``
    times its size, and together, for each source, as many as its slots hold, which is its target to within a few
    slots. ``slot`` and ``place`` (0 to 1) are those of the first that takes of it, null where none does. Null and
    empty texts have size 0 and are never taken; repeated rows each count. The order depends on a hash of
    key, size and seed, so reruns agree, with any partitioning.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(key, "source", "size", F.monotonically_increasing_id().alias("row")), "sizes")  # texts are read once
    size, target = source_targets(rows, weights, most)
    named = rows.select("row", F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), "source", "size")
    found = takes(named, target, size, most, seed).groupBy("row").agg(F.sum("words").alias("taken"), F.min_by("slot", "round").alias("slot"), F.min_by("place", "round").alias("place"))
    sources = spark.createDataFrame([(s, size[s], target[s]) for s in size], "s string, source_size long, target double")
    out = rows.join(found, "row", "left").join(sources, F.col("source").eqNullSafe(F.col("s")))
    return out.select(key, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot", "place")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` as the schedule takes them, in whole documents, each partition in the order of the mix.

    A row is there once for each round (0 to ``most``) in which the slots of its source take at least half
    of it, at the place of the first slot that does; so only the document at which a source's slots end is
    rounded. Documents without words stay once, at the start. Documents are told apart by doc_id and text, and equal rows of a
    source are interchangeable: another partitioning of the input gives the same documents. All columns stay.
    """
    own = fresh("_mix", docs.columns)
    row, place, n = f"{own}_row", f"{own}_place", f"{own}_size"
    sized = stored(docs.withColumn(n, word_count(F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "sized")
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text"))
    rows = stored(sized.select(F.col(row).alias("row"), name.alias("key"), "source", F.col(n).alias("size")), "sizes")
    size, target = source_targets(rows, weights, most)
    found = takes(rows, target, size, most, seed).join(rows.select("row", "size"), "row").where("2 * words >= size")
    once = rows.where("size = 0").select("row", F.lit(0.0).alias("place"))
    counts = found.select("row", "place").union(once).select(F.col("row").alias(row), F.col("place").alias(place))
    return sized.join(counts, row).sortWithinPartitions(place, row).select(*docs.columns)
