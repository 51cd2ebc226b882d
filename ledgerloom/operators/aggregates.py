"""Aggregates: conditional counts, shares of a total, two-level groups, subtotals, pivots of fixed shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_of_total(df: DataFrame, by: Sequence[str], within: Sequence[str] = (), name: str = "Share", digits: int = 6) -> DataFrame:
    """Counts by ``by``, with the share of all rows or of those of each ``within``."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counted.withColumn(name, F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))), digits))


def with_all_row(df: DataFrame, key: str, aggregates: Sequence[Column], label: str = "All documents") -> DataFrame:
    """Aggregates by ``key`` and over all rows, in one pass by grouping sets; the total's key is ``label``."""
    sets = df.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping(key).alias("_all"), *aggregates)
    return sets.withColumn(key, F.when(F.col("_all") == 1, label).otherwise(F.col(key))).drop("_all")


def pivot_fixed(df: DataFrame, keys: Sequence[str], column: str, levels: Sequence[str], aggregates: Mapping[str, Column], fill: int | None = None) -> DataFrame:
    """One row a key with a column for every level and aggregate, present or not: no pass to find the levels."""
    out = df.groupBy(*keys).pivot(column, list(levels)).agg(*[a.alias(n) for n, a in aggregates.items()])
    if len(aggregates) == 1:
        (name,) = aggregates
        out = out.withColumnsRenamed({level: f"{level}_{name}" for level in levels})
    return out if fill is None else out.fillna(fill, [c for c in out.columns if c not in keys])


def complete(df: DataFrame, *keys: str) -> DataFrame:
    """Every combination of the keys' values, with the rows of ``df`` or nulls; the values are few by design."""
    grid = None
    for key in keys:
        values = df.select(key).distinct()
        grid = values if grid is None else grid.crossJoin(F.broadcast(values))
    return grid.join(df, list(keys), "left")


def count_where(**conditions: Column | str) -> list[Column]:
    return [F.count_if(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in conditions.items()]


def top_levels(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, missing ones as '(missing)'; the limit is the operator's."""
    level = F.coalesce(F.col(column).cast("string"), F.lit("(missing)")).alias("Level")
    return df.groupBy(level).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "Level").limit(n)


def profile(df: DataFrame, columns: Sequence[str], ceiling: float | None = None) -> DataFrame:
    """One row a numeric column: values present, their share, median, mean, extremes, and how many exceed ``ceiling``."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "Column", "x")
    above = F.count_if(F.col("x") > ceiling) if ceiling is not None else F.lit(None).cast("bigint")
    return long.groupBy("Column").agg(F.count("x").alias("nValues"), F.round(F.count("x") / F.count("*"), 6).alias("pValues"), F.median("x").alias("Median"), F.round(F.avg("x"), 4).alias("Mean"), F.min("x").alias("Min"), F.max("x").alias("Max"), above.alias("nAbove"))


def ordered_list(order: Sequence[str], value: str, separator: str = "|") -> Column:
    """Values joined in the order of other columns, nulls of these last."""
    row = F.struct(*[x for c in order for x in (F.isnull(c).alias(f"_{c}"), F.col(c))], value)
    return F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x[value].cast("string")), separator)


def boilerplate_share(docs: DataFrame, words: Column, min_share: float = 0.01) -> DataFrame:
    """(DocID, nGrams, nBoilerplate, Share): word 4-grams that at least max(2, 1 % of filers) distinct filers use."""
    grams = F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 3), lambda i: F.concat_ws(" ", F.slice(words, i, 4))))
    exploded = docs.select("DocID", "CIK", F.explode(grams).alias("gram"))
    filers = docs.agg(F.countDistinct("CIK").alias("filers"))
    used = exploded.groupBy("gram").agg(F.countDistinct("CIK").alias("by")).crossJoin(F.broadcast(filers)).where(F.col("by") >= F.greatest(F.lit(2), F.ceil(F.col("filers") * min_share))).select("gram", F.lit(1).alias("hit"))
    per = exploded.join(used, "gram", "left").groupBy("DocID").agg(F.count("*").alias("nGrams"), F.count("hit").alias("nBoilerplate"))
    return docs.select("DocID").join(per, "DocID", "left").select("DocID", F.coalesce("nGrams", F.lit(0)).alias("nGrams"), F.coalesce("nBoilerplate", F.lit(0)).alias("nBoilerplate"), F.round(F.try_divide("nBoilerplate", "nGrams"), 6).alias("Share"))
