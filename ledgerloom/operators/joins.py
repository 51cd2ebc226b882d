"""Joins: ranges, containment, tolerance bands, as-of, semi and anti, one-to-one spines.

Every join keeps an equality (document, filer), so that ranges are residual conditions of a
sort-merge or broadcast-hash join and never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; the order must be total for the result to be fixed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def no_collision(left: DataFrame, right: DataFrame, by: list[str]) -> None:
    """An error where two tables share columns other than the join's keys."""
    if both := sorted((set(left.columns) & set(right.columns)) - set(by)):
        raise ValueError(f"columns of both sides: {', '.join(both)}")


def quarter_ranges(fundamentals: DataFrame) -> DataFrame:
    """(CIK, gvkey, fyear, fqtr, DateStart, DateStop): quarter ends as half-open ranges of three months.

    Repeats are resolved in four steps, each keeping the row of the largest assets (unknown ones last).
    """
    kept = fundamentals
    for keys in (["CIK", "gvkey", "datadate"], ["CIK", "datadate"], ["gvkey", "datadate"], ["gvkey", "fyear", "fqtr"]):
        kept = first_per(kept, keys, F.col("atq").desc_nulls_last(), F.col("CIK"), F.col("gvkey"), F.col("datadate"), F.col("RowKey"))
    return kept.select("CIK", "gvkey", "fyear", "fqtr", F.col("datadate").alias("DateStart"), F.add_months("datadate", 3).alias("DateStop"))


def attach_range(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each document with the range of its filer that holds its date; where several do, none is chosen."""
    hit = (docs["CIK"] == ranges["CIK"]) & (docs["DateFiled"] >= ranges["DateStart"]) & (docs["DateFiled"] < ranges["DateStop"])
    joined = docs.join(ranges, hit, "left").select(docs["*"], *[ranges[c].alias(f"r_{c}") for c in ("gvkey", "fyear", "fqtr")])
    counted = joined.withColumn("nQuarters", F.count("*").over(Window.partitionBy("DocID")))
    clear = [F.when(F.col("nQuarters") == 1, F.col(f"r_{c}")).alias(f"r_{c}") for c in ("gvkey", "fyear", "fqtr")]
    return counted.select(*docs.columns, *clear, "nQuarters").distinct()


def link_by_date(refs: DataFrame, filings: DataFrame, tolerance: int = 3) -> DataFrame:
    """Links (RefID, CIK, FormType, RefDate) to filings (CIK, FormType, DateFiled, HashIndex, HasDocument) in tiers.

    A sole filing of that filer, form and date is exact; of several, the only one with a document breaks the
    tie; else the only distinct filing within ``tolerance`` days is near; otherwise no link.
    """
    same = refs.join(filings.withColumnRenamed("DateFiled", "RefDate"), ["CIK", "FormType", "RefDate"])
    exact = same.groupBy("RefID").agg(F.countDistinct("HashIndex").alias("n"), F.min("HashIndex").alias("only"), F.countDistinct(F.when(F.col("HasDocument"), F.col("HashIndex"))).alias("n_doc"), F.min(F.when(F.col("HasDocument"), F.col("HashIndex"))).alias("only_doc"))
    near = refs.join(filings, ["CIK", "FormType"]).where(F.abs(F.datediff("DateFiled", "RefDate")) <= tolerance)
    near = near.groupBy("RefID").agg(F.countDistinct("HashIndex").alias("n_near"), F.min("HashIndex").alias("only_near"))
    tier = F.when(F.col("n") == 1, "exact").when((F.col("n") > 1) & (F.col("n_doc") == 1), "tie broken").when(F.col("n").isNull() & (F.col("n_near") == 1), "near").otherwise("none")
    found = refs.join(exact, "RefID", "left").join(near, "RefID", "left").withColumn("Tier", tier)
    link = F.when(F.col("Tier") == "exact", F.col("only")).when(F.col("Tier") == "tie broken", F.col("only_doc")).when(F.col("Tier") == "near", F.col("only_near"))
    return found.select("RefID", "Tier", link.alias("HashIndex"))


def link_status(linked: DataFrame, documents: DataFrame) -> DataFrame:
    """Filing links and their documents by exhibit number: an ordered status."""
    counted = documents.groupBy("HashIndex", "ExhibitNo").agg(F.count("*").alias("n_match"), F.min("DocID").alias("DocID"))
    per_filing = documents.groupBy("HashIndex").agg(F.count("*").alias("n_docs"))
    joined = linked.join(counted, ["HashIndex", "ExhibitNo"], "left").join(per_filing, "HashIndex", "left")
    status = F.when(F.col("HashIndex").isNull(), F.concat(F.lit("no filing: "), "Tier")).when(F.col("ExhibitNo").isNull(), "no exhibit number").when(F.col("n_match") == 1, "linked").when(F.col("n_match") > 1, "several exhibits").when(F.col("n_docs").isNull(), "filing without documents").otherwise("exhibit not in filing")
    return joined.select("RefID", "Tier", "HashIndex", F.when(F.col("n_match") == 1, F.col("DocID")).alias("DocID"), status.alias("LinkStatus"))


BIN = 2000  # characters of a stretch of a document


def near_pairs(spans: DataFrame, others: DataFrame, start: str, stop: str, reach: int = 0) -> DataFrame:
    """Pairs of spans (DocID, Start, Stop) and others (DocID, ``start``, ``stop``) of one document that share a stretch of it, once each;
    pairs within ``reach`` characters of each other are among them.

    Both are dealt to the stretches that they touch, so a document of very many spans is met stretch by stretch and not all with all.
    A pair counts in the first stretch that both touch.
    """
    low, high = F.floor((F.col("Start") - reach) / BIN), F.floor((F.greatest("Start", "Stop") + reach) / BIN)
    left = spans.withColumn("_low", low).withColumn("_bin", F.explode(F.sequence("_low", high)))
    first, last = F.floor(F.col(start) / BIN), F.floor(F.greatest(start, stop) / BIN)
    right = others.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence("_first", last)))
    return left.join(right, ["DocID", "_bin"]).where("_bin = greatest(_low, _first)").drop("_bin", "_low", "_first")


def inside(spans: DataFrame, hosts: DataFrame) -> DataFrame:
    """(DocID, Start, Stop, HostStart, HostStop): spans within a host span of their document, the first host each."""
    h = hosts.select("DocID", F.col("Start").alias("HostStart"), F.col("Stop").alias("HostStop"))
    met = near_pairs(spans, h, "HostStart", "HostStop").where("Start >= HostStart and Stop <= HostStop")
    return first_per(met, ["DocID", "Start", "Stop"], F.col("HostStart"), F.col("HostStop")).select("DocID", "Start", "Stop", "HostStart", "HostStop")


def attach_last_mention(places: DataFrame, mentions: DataFrame, reach: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each place with the last party mentioned before it, if that ended at most ``reach`` characters before.

    As-of without a join: both are ordered by position (a mention before a place at the same one) and the
    last mention is filled down, so each document is sorted once. ``carry`` names columns of places that stay.
    """
    kinds = dict(places.dtypes)
    m = mentions.select("DocID", F.col("Start").alias("Pos"), F.lit(0).alias("IsPlace"), F.struct("PartyKey", F.col("Start").alias("MentionStart"), F.col("Stop").alias("MentionStop")).alias("last"), F.lit(None).cast("bigint").alias("Stop"))
    p = places.select("DocID", F.col("Start").alias("Pos"), F.lit(1).alias("IsPlace"), F.lit(None).cast(m.schema["last"].dataType).alias("last"), "Stop", *carry)
    m = m.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in carry])
    order = Window.partitionBy("DocID").orderBy("Pos", "IsPlace", F.col("last.PartyKey"), F.col("last.MentionStop"))
    filled = m.unionByName(p).withColumn("last", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("IsPlace = 1")
    gap = F.col("Pos") - F.col("last.MentionStop")
    near = gap.between(0, reach)
    return filled.select("DocID", F.col("Pos").alias("PlaceStart"), F.col("Stop").alias("PlaceStop"), F.when(near, F.col("last.PartyKey")).alias("PartyKey"), F.when(near, F.col("last.MentionStart")).alias("MentionStart"), F.when(near, gap).alias("DistToParty"), F.coalesce(near, F.lit(False)).alias("Attached"), *carry)


def distance_profile(attached: DataFrame, level: str) -> DataFrame:
    """(level, n, P25, P50, P90, Most): how far attached places stand from their party. Distances are whole numbers up to the
    reach, so percentiles are taken over counts of them and no group's rows are gathered."""
    shares = {"P25": 0.25, "P50": 0.5, "P90": 0.9}
    return attached.where("Attached").groupBy(level).agg(F.count("*").alias("n"), *[F.percentile("DistToParty", p).alias(c) for c, p in shares.items()], F.max("DistToParty").alias("Most"))


def nearest_named(ambiguous: DataFrame, candidates: DataFrame, named: DataFrame) -> DataFrame:
    """Ambiguous places (DocID, Start, Name) given the candidate state (Name, State) that the document names
    nearest; ties go to the state named more often, then by name."""
    times = Window.partitionBy("DocID", "State")
    states = named.withColumn("Times", F.count("*").over(times))
    met = ambiguous.join(candidates, "Name").join(states.select("DocID", "State", F.col("Start").alias("StateStart"), "Times"), ["DocID", "State"])
    best = first_per(met.withColumn("Gap", F.abs(F.col("Start") - F.col("StateStart"))), ["DocID", "Start", "Name"], F.col("Gap"), F.col("Times").desc(), F.col("State"))
    out = ambiguous.join(best.select("DocID", "Start", "Name", "State", "Gap"), ["DocID", "Start", "Name"], "left")
    return out.withColumn("StateFrom", F.when(F.col("State").isNull(), "unresolved").otherwise("named nearby"))


def overlap_or_near(marks: DataFrame, money: DataFrame, tolerance: int = 10) -> DataFrame:
    """Each mark with the amount that it overlaps, or else the nearest within ``tolerance`` characters."""
    m = money.select("DocID", F.col("Start").alias("MStart"), F.col("Stop").alias("MStop"), "Amount")
    gap = F.greatest(F.col("MStart") - F.col("Stop"), F.col("Start") - F.col("MStop"), F.lit(0))
    met = near_pairs(marks, m, "MStart", "MStop", tolerance).withColumn("Gap", gap).withColumn("Overlaps", (F.col("Start") < F.col("MStop")) & (F.col("MStart") < F.col("Stop"))).where(F.col("Overlaps") | (F.col("Gap") <= tolerance))
    best = first_per(met, ["DocID", "Start", "Stop", "SpanNo"], F.col("Overlaps").desc(), F.col("Gap"), F.col("MStart"), F.col("MStop"), F.col("Amount"))
    return marks.join(best.select("DocID", "Start", "Stop", "SpanNo", "MStart", "Gap", "Overlaps"), ["DocID", "Start", "Stop", "SpanNo"], "left").select("DocID", "Start", "Stop", "SpanNo", "MStart", "Gap", F.coalesce("Overlaps", F.lit(False)).alias("Overlaps"), F.when(F.col("MStart").isNull(), "unmatched").otherwise("MONEY").alias("Entity"))


def neighbours(marks: DataFrame, others: DataFrame, labels: list[str], reach: int = 40) -> DataFrame:
    """(DocID, Start, SpanNo, Neighbour, Gap): the nearest span of ``labels`` within ``reach``, ties by their order."""
    rank = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("Label"))
    o = others.where(F.col("Label").isin(labels)).select("DocID", F.col("Start").alias("OStart"), F.col("Stop").alias("OStop"), "Label", rank.alias("rank"))
    gap = F.greatest(F.col("OStart") - F.col("Stop"), F.col("Start") - F.col("OStop"), F.lit(0))
    met = near_pairs(marks.select("DocID", "Start", "Stop", "SpanNo"), o, "OStart", "OStop", reach).withColumn("Gap", gap).where(F.col("Gap") <= reach)
    best = first_per(met, ["DocID", "Start", "SpanNo"], F.col("Gap"), F.col("rank"), F.col("OStart"), F.col("OStop"))
    return marks.select("DocID", "Start", "SpanNo").join(best.select("DocID", "Start", "SpanNo", "Label", "Gap"), ["DocID", "Start", "SpanNo"], "left").select("DocID", "Start", "SpanNo", F.coalesce("Label", F.lit("nothing")).alias("Neighbour"), "Gap")


def pairs_of_producers(mentions: DataFrame) -> DataFrame:
    """For each two producers: mentions of both, of equal extent, of either, and their Jaccard share."""
    per = mentions.groupBy("Producer").agg(F.countDistinct("MentionID").alias("n"))
    a = mentions.select("MentionID", F.col("Producer").alias("A"), F.col("Start").alias("s1"), F.col("Stop").alias("e1"))
    b = mentions.select("MentionID", F.col("Producer").alias("B"), F.col("Start").alias("s2"), F.col("Stop").alias("e2"))
    both = a.join(b, "MentionID").where("A <> B").groupBy("A", "B").agg(F.countDistinct("MentionID").alias("Both"), F.countDistinct(F.when((F.col("s1") == F.col("s2")) & (F.col("e1") == F.col("e2")), F.col("MentionID"))).alias("Exact"))
    left, right = per.select(F.col("Producer").alias("A"), F.col("n").alias("nA")), per.select(F.col("Producer").alias("B"), F.col("n").alias("nB"))
    return both.join(left, "A").join(right, "B").withColumn("Jaccard", F.col("Both") / (F.col("nA") + F.col("nB") - F.col("Both")))


def fan_out(primary: DataFrame, copies: DataFrame, key: str) -> DataFrame:
    """What was read of the primary copy, for every copy that shares its key."""
    no_collision(primary, copies, [key])
    return copies.join(primary, key, "left")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, or an error if a key occurs twice; one aggregate, of which one row comes to the driver."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(keys)} repeats")
    return df


def spine(base: DataFrame, *parts: tuple[DataFrame, list[str]]) -> DataFrame:
    """``base`` with tables joined to it one after the other; columns may not collide and keys are unique."""
    for part, by in parts:
        no_collision(base, part, by)
        base = base.join(part, by, "left")
    return base
