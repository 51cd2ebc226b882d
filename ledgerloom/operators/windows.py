"""Window operators: overlap clusters, runs, ranks, folds, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_clusters(spans: DataFrame, *tie: str) -> DataFrame:
    """``spans`` with the number (from 1) of the cluster of overlapping spans of their document: a span opens a
    cluster if it starts at or after the furthest end before it."""
    order = Window.partitionBy("DocID").orderBy("Start", "Stop", *tie)
    reach = F.max("Stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(reach.isNull() | (F.col("Start") >= reach), 1).otherwise(0))
    return opened.withColumn("Cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def runs(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """``df`` with the number of the run of equal values that a row is in, within its keys; nulls are last in the order."""
    w = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    before = F.lag(value).over(w)
    change = F.when(F.row_number().over(w) == 1, 0).when(before.eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("Run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_c")


def nulls_last(*columns: Column | str) -> Column:
    """A struct that orders as the columns do, each with its nulls last; in a plain one they are first."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.struct(*[x.alias(f"_{i}") for i, x in enumerate(x for c in parts for x in (c.isNull(), c))])


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, with their rank."""
    return df.withColumn("Rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("Rank") <= n)


def folds(df: DataFrame, stratum: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds from 1 to ``k``: rows of a stratum in the order of the MD5 of seed and key, dealt in turn.

    Rows are numbered in 4096 parts of a stratum by the first digits of the hash, and parts are added up: a stratum is no
    single task's. A null stratum is one of its own.
    """
    marked = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_p", F.substring("_h", 1, 3))
    counts = marked.groupBy(F.col(stratum).alias("_s"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    before = counts.select("_s", "_q", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_q")) - F.col("_n")).alias("_b"))
    within = marked.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", key)))
    met = within.join(before, F.col(stratum).eqNullSafe(F.col("_s")) & F.col("_p").eqNullSafe(F.col("_q")))
    return met.select(*df.columns, ((F.col("_b") + F.col("_r") - 1) % k + 1).cast("int").alias("Fold"))


def seeded(key: str, seed: int = 42) -> Column:
    """The order of a seeded draw, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def copy_flags(register: DataFrame) -> DataFrame:
    """Whether a document's copies agree in their measures, and which copy is read: kept ones first, by DocID."""
    over = Window.partitionBy("HashDocument")
    same = [(F.size(F.collect_set(c).over(over)) <= 1).alias(f"{c}Agree") for c in ("nChars", "nWords", "nNums")]
    first = F.row_number().over(over.orderBy("Removed", "DocID")) == 1
    return register.select("DocID", "HashDocument", *same, first.alias("PrimaryFiler"))


def best_class(hits: DataFrame, none: str = "(none)") -> DataFrame:
    """(DocID, Class, Power, Second): the class of the strongest term, none where two classes tie for it."""
    per = hits.groupBy("DocID", "Class").agg(F.max("Power").alias("Power"))
    doc = Window.partitionBy("DocID")
    ranked = per.withColumn("r", F.row_number().over(doc.orderBy(F.desc("Power"), "Class"))).withColumn("tied", F.rank().over(doc.orderBy(F.desc("Power"))))
    out = ranked.groupBy("DocID").agg(F.count_if(F.col("tied") == 1).alias("nTied"), F.max(F.when(F.col("r") == 1, F.col("Class"))).alias("First"), F.max("Power").alias("Power"), F.max(F.when(F.col("r") == 2, F.col("Class"))).alias("Second"))
    return out.select("DocID", F.when(F.col("nTied") == 1, F.col("First")).otherwise(none).alias("Class"), "Power", "Second")
