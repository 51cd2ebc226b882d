"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that occurs in ``links`` (a, b: long).

    Alternates large-star and small-star rounds: each replaces the links of a node by links to the
    smallest of its neighbours, so that a long chain halves at each round. A node's neighbours meet only
    in an aggregate of one number, and links are joined to it by node, so that no list of neighbours is
    gathered. Each round is written to the shared folder; the driver sees one count and one sum a round.
    Null ends and links of a node to itself are left out, repeated links count once.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now, before = stored(now, "links"), None
    while True:  # every round that changes anything moves ends to smaller ones, so it settles
        # Large star: each larger neighbour of u is linked to the least of u and its neighbours.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours are linked to the least of these.
        smaller = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(smaller, F.col("a") == F.col("u")).select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smaller.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = stored(small, "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if tuple(state)[:2] == before and state[0] == state[2]:
            break
        before = tuple(state)[:2]
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
