"""Queries of the aggregate, window, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as W
from ..operators.joins import first_per
from ..operators import parties as P
from ..sources.tables import Tables
from .registry import query

CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("edg_landing_coverage", "SELECT Year, count(*) AS nRows, count(DISTINCT HashIndex) AS nFilings, count(DISTINCT CIK) AS nFilers, round(avg(CASE WHEN gvkey IS NULL THEN 1.0 ELSE 0.0 END), 6) AS pNoKey, round(CAST(count(DISTINCT CIK) AS DOUBLE) / count(DISTINCT HashIndex), 6) AS FilersPerFiling FROM register GROUP BY 1")
def landing_coverage(t: Tables) -> DataFrame:
    return t.register.groupBy("Year").agg(F.count("*").alias("nRows"), F.countDistinct("HashIndex").alias("nFilings"), F.countDistinct("CIK").alias("nFilers"), F.round(F.avg(F.col("gvkey").isNull().cast("double")), 6).alias("pNoKey"), F.round(F.countDistinct("CIK") / F.countDistinct("HashIndex"), 6).alias("FilersPerFiling"))


@query("edg_landing_grain", "SELECT count(*) AS nRows, count(DISTINCT HashIndex) AS nFilings, count(*) FILTER (DocID IN (SELECT DocID FROM ledger)) AS nInFrame FROM register")
def landing_grain(t: Tables) -> DataFrame:
    frame = t.ledger.select("DocID").distinct().withColumn("here", F.lit(1))
    return t.register.join(frame, "DocID", "left").agg(F.count("*").alias("nRows"), F.countDistinct("HashIndex").alias("nFilings"), F.count("here").alias("nInFrame"))


@query("edg_landing_forms", "SELECT FormType, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS Share FROM register GROUP BY 1")
def landing_forms(t: Tables) -> DataFrame:
    return A.share_of_total(t.register, ["FormType"])


@query("edg_landing_duplicates", "WITH k AS (SELECT HashIndex, Class, count(*) AS n, count(DISTINCT (FormType, CIK)) AS d FROM register GROUP BY 1, 2) SELECT CAST(sum(n) FILTER (n > 1) AS BIGINT) AS nRepeatRows, count(*) FILTER (n > 1) AS nRepeatKeys, bool_and(d = 1) FILTER (n > 1) AS AllRepeatsIdentical FROM k")
def duplicates(t: Tables) -> DataFrame:
    per = t.register.groupBy("HashIndex", "Class").agg(F.count("*").alias("n"), F.countDistinct("FormType", "CIK").alias("d"))
    return per.where("n > 1").agg(F.sum("n").alias("nRepeatRows"), F.count("*").alias("nRepeatKeys"), F.bool_and(F.col("d") == 1).alias("AllRepeatsIdentical"))


@query("edg_outstanding", "SELECT Class, count(*) AS nWanted, count(*) FILTER (l.DocID IS NOT NULL) AS nOnDisk, count(*) FILTER (l.DocID IS NULL) AS nOutstanding FROM register r LEFT JOIN (SELECT DISTINCT DocID FROM ledger WHERE Status = 'hit') l USING (DocID) GROUP BY 1")
def outstanding(t: Tables) -> DataFrame:
    disk = t.ledger.where("Status = 'hit'").select("DocID").distinct().withColumn("here", F.lit(True))
    return t.register.join(disk, "DocID", "left").groupBy("Class").agg(F.count("*").alias("nWanted"), *A.count_where(nOnDisk="here is not null", nOutstanding="here is null"))


@query("edg_corpus_composition", "SELECT DocType, count(*) AS n, count(DISTINCT Year) AS nYears, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS Share FROM register GROUP BY 1")
def composition(t: Tables) -> DataFrame:
    out = t.register.groupBy("DocType").agg(F.count("*").alias("n"), F.countDistinct("Year").alias("nYears"))
    return out.withColumn("Share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("edg_corpus_by_quarter", "SELECT concat(Year, '-', EXTRACT(QUARTER FROM DateFiled)) AS YQ, DocType, count(*) AS n FROM register GROUP BY 1, 2")
def by_quarter(t: Tables) -> DataFrame:
    return t.register.groupBy(F.concat_ws("-", "Year", F.quarter("DateFiled")).alias("YQ"), "DocType").agg(F.count("*").alias("n"))


@query("edg_filer_disagreements", "SELECT HashDocument, count(*) AS n, count(DISTINCT nWords) AS nDistinct, min(nWords) AS Least, max(nWords) AS Most, max(nWords) - min(nWords) AS Spread FROM register GROUP BY 1 HAVING count(DISTINCT nWords) > 1")
def disagreements(t: Tables) -> DataFrame:
    return t.register.groupBy("HashDocument").agg(F.count("*").alias("n"), F.countDistinct("nWords").alias("nDistinct"), F.min("nWords").alias("Least"), F.max("nWords").alias("Most"), (F.max("nWords") - F.min("nWords")).alias("Spread")).where("nDistinct > 1")


@query("edg_filer_distribution", "SELECT nCopies, count(*) AS nAttachments FROM (SELECT HashDocument, count(*) AS nCopies FROM register GROUP BY 1) q GROUP BY 1")
def distribution(t: Tables) -> DataFrame:
    return t.register.groupBy("HashDocument").agg(F.count("*").alias("nCopies")).groupBy("nCopies").agg(F.count("*").alias("nAttachments"))


_REMOVALS = """
    WITH f AS (SELECT *, CASE WHEN DocType LIKE 'Exhibit10%' THEN 'Exhibit10' WHEN DocType LIKE 'CTO%' THEN 'CTO' ELSE '8-K' END AS Grp, CAST(greatest(nWords - 40, 0) AS BIGINT) AS nWordsAdj, round(least(CASE WHEN nWords > 0 THEN CAST(nNums AS DOUBLE) / nWords END, 1.0) * 100, 6) AS pNums FROM register),
    g AS (SELECT *, CASE WHEN nWordsAdj <= 10 THEN 'words' WHEN pStopShort <= 20 AND nWordsAdj <= 100 THEN 'stop' WHEN pNums >= 75 THEN 'nums' ELSE 'kept' END AS RemClass FROM f)"""


def removals(t: Tables) -> DataFrame:
    group = F.when(F.col("DocType").startswith("Exhibit10"), "Exhibit10").when(F.col("DocType").startswith("CTO"), "CTO").otherwise("8-K")
    marked = t.register.withColumn("Grp", group).withColumn("nWordsAdj", F.greatest(F.col("nWords") - 40, F.lit(0)).cast("bigint")).withColumn("pNums", F.round(F.least(F.try_divide("nNums", "nWords"), F.lit(1.0)) * 100, 6))
    why = F.when(F.col("nWordsAdj") <= 10, "words").when((F.col("pStopShort") <= 20) & (F.col("nWordsAdj") <= 100), "stop").when(F.col("pNums") >= 75, "nums").otherwise("kept")
    return marked.withColumn("RemClass", why)


@query("edg_flag_removals", _REMOVALS + " SELECT DocID, regexp_replace(DocType, 'A$', '') AS DocType, Grp, nWordsAdj, pNums, RemClass, RemClass <> 'kept' AS RemDoc FROM g")
def flag_removals(t: Tables) -> DataFrame:
    return removals(t).select("DocID", F.regexp_replace("DocType", "A$", "").alias("DocType"), "Grp", "nWordsAdj", "pNums", "RemClass", (F.col("RemClass") != "kept").alias("RemDoc"))


@query("edg_removal_summary", _REMOVALS + " SELECT Grp, RemClass, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY Grp), 6) AS Share FROM g GROUP BY 1, 2")
def removal_summary(t: Tables) -> DataFrame:
    return A.share_of_total(removals(t), ["Grp", "RemClass"], ["Grp"])


@query("edg_survival_summary", _REMOVALS + " SELECT Grp, count(*) AS nDocs, count(*) FILTER (RemClass <> 'kept') AS nFlagged, count(*) FILTER (RemClass = 'kept') AS nKept, round(avg(CASE WHEN RemClass = 'kept' THEN 1.0 ELSE 0.0 END), 6) AS pKept FROM g GROUP BY 1")
def survival(t: Tables) -> DataFrame:
    return removals(t).groupBy("Grp").agg(F.count("*").alias("nDocs"), *A.count_where(nFlagged="RemClass <> 'kept'", nKept="RemClass = 'kept'"), F.round(F.avg((F.col("RemClass") == "kept").cast("double")), 6).alias("pKept"))


@query("edg_filer_summary", "SELECT FormType, CAST(sum(n) AS BIGINT) AS nDocs, count(*) AS nAttachments, count(*) FILTER (n > 1) AS nMulti, count(*) FILTER (d > 1) AS nDiffering, round(CAST(sum(n) - count(*) AS DOUBLE) / sum(n), 6) AS pRedundant FROM (SELECT FormType, HashDocument, count(*) AS n, count(DISTINCT nWords) AS d FROM register GROUP BY 1, 2) q GROUP BY 1")
def filer_summary(t: Tables) -> DataFrame:
    per = t.register.groupBy("FormType", "HashDocument").agg(F.count("*").alias("n"), F.countDistinct("nWords").alias("d"))
    return per.groupBy("FormType").agg(F.sum("n").alias("nDocs"), F.count("*").alias("nAttachments"), *A.count_where(nMulti="n > 1", nDiffering="d > 1"), F.round((F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("pRedundant"))


@query("cmp_coverage_summary", "SELECT count(*) AS nRows, count(DISTINCT gvkey) AS nFirms, count(DISTINCT CIK) AS nFilers, min(fyear) AS FirstYear, max(fyear) AS LastYear FROM fundamentals")
def coverage(t: Tables) -> DataFrame:
    return t.fundamentals.agg(F.count("*").alias("nRows"), F.countDistinct("gvkey").alias("nFirms"), F.countDistinct("CIK").alias("nFilers"), F.min("fyear").alias("FirstYear"), F.max("fyear").alias("LastYear"))


@query("cmp_quarters_by_year", "SELECT fyear, count(*) AS n, count(DISTINCT gvkey) AS nFirms FROM fundamentals WHERE fyear >= 1990 GROUP BY 1")
def quarters(t: Tables) -> DataFrame:
    return t.fundamentals.where("fyear >= 1990").groupBy("fyear").agg(F.count("*").alias("n"), F.countDistinct("gvkey").alias("nFirms"))


@query("reg_sample_table", """
    WITH s AS (SELECT *, CASE WHEN nWords < 50 THEN 'Less: short' WHEN gvkey IS NULL THEN 'Less: no firm' ELSE 'Final sample' END AS Step FROM register)
    SELECT Step, CASE WHEN Step LIKE 'Less%' THEN -n ELSE n END AS n, nAttach, nFilings, nFilers FROM (SELECT CASE WHEN grouping(Step) = 1 THEN 'Universe' ELSE Step END AS Step, count(*) AS n, count(DISTINCT HashDocument) AS nAttach, count(DISTINCT HashIndex) AS nFilings, count(DISTINCT CIK) AS nFilers FROM s GROUP BY GROUPING SETS ((Step), ())) q""")
def sample_table(t: Tables) -> DataFrame:
    step = F.when(F.col("nWords") < 50, "Less: short").when(F.col("gvkey").isNull(), "Less: no firm").otherwise("Final sample")
    counts = [F.count("*").alias("n"), *[F.countDistinct(c).alias(n) for c, n in (("HashDocument", "nAttach"), ("HashIndex", "nFilings"), ("CIK", "nFilers"))]]
    return A.with_all_row(t.register.withColumn("Step", step), "Step", counts, "Universe").withColumn("n", F.when(F.col("Step").startswith("Less"), -F.col("n")).otherwise(F.col("n")))


@query("reg_group_summary", "SELECT FormType, count(*) AS nDocs, count(DISTINCT HashDocument) AS nAttach, count(DISTINCT HashIndex) AS nFilings, CAST(sum(CASE WHEN gvkey IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS nWithFirm FROM register GROUP BY 1")
def group_summary(t: Tables) -> DataFrame:
    return t.register.groupBy("FormType").agg(F.count("*").alias("nDocs"), F.countDistinct("HashDocument").alias("nAttach"), F.countDistinct("HashIndex").alias("nFilings"), F.sum(F.col("gvkey").isNotNull().cast("int")).alias("nWithFirm"))


@query("itm_item_flags", """
    SELECT HashIndex, count(*) AS nItems, count(*) FILTER (ItemCode LIKE '%.%') AS nDotted, count(*) FILTER (ItemCode IN ('7.01', '8.01')) AS nVoluntary, count(*) FILTER (ItemCode NOT IN ('7.01', '8.01')) AS nMandatory, string_agg(ItemCode, '|' ORDER BY ItemOrder, ItemCode) AS Codes, bool_or(ItemCode = '1.01') AS HasAgreement,
        CASE WHEN bool_and(FilingDate < DATE '1995-06-17') THEN 'Pre' WHEN bool_and(FilingDate >= DATE '1995-06-17') THEN 'Post' ELSE 'Mixed' END AS ItemEra FROM items GROUP BY 1""")
def item_flags(t: Tables) -> DataFrame:
    late = F.col("FilingDate") >= F.lit("1995-06-17").cast("date")
    return t.items.groupBy("HashIndex").agg(F.count("*").alias("nItems"), *A.count_where(nDotted="ItemCode like '%.%'", nVoluntary="ItemCode in ('7.01', '8.01')", nMandatory="ItemCode not in ('7.01', '8.01')"), A.ordered_list(["ItemOrder"], "ItemCode").alias("Codes"), F.bool_or(F.col("ItemCode") == "1.01").alias("HasAgreement"), F.when(F.bool_and(~late), "Pre").when(F.bool_and(late), "Post").otherwise("Mixed").alias("ItemEra"))


_RUNS = "WITH c AS (SELECT *, CASE WHEN lag(ItemFurnished) OVER w IS NOT DISTINCT FROM ItemFurnished OR row_number() OVER w = 1 THEN 0 ELSE 1 END AS chg FROM items WINDOW w AS (PARTITION BY HashIndex ORDER BY ItemOrder, ItemCode)), runs AS (SELECT *, CAST(sum(chg) OVER (PARTITION BY HashIndex ORDER BY ItemOrder, ItemCode ROWS UNBOUNDED PRECEDING) AS BIGINT) AS Run FROM c)"


@query("itm_runs", _RUNS + " SELECT HashIndex, ItemOrder, ItemFurnished, Run FROM runs")
def item_runs(t: Tables) -> DataFrame:
    return W.runs(t.items, ["HashIndex"], "ItemFurnished", "ItemOrder", "ItemCode").select("HashIndex", "ItemOrder", "ItemFurnished", "Run")


@query("itm_run_paste", _RUNS + " SELECT HashIndex, Run, string_agg(ItemCode, '|' ORDER BY ItemOrder, ItemCode) AS Codes FROM runs GROUP BY 1, 2")
def run_paste(t: Tables) -> DataFrame:
    return W.runs(t.items, ["HashIndex"], "ItemFurnished", "ItemOrder", "ItemCode").groupBy("HashIndex", "Run").agg(A.ordered_list(["ItemOrder"], "ItemCode").alias("Codes"))


@query("itm_run_sum", _RUNS + " SELECT HashIndex, Run, CAST(sum(ItemOrder) AS BIGINT) AS Total FROM runs GROUP BY 1, 2")
def run_sum(t: Tables) -> DataFrame:
    return W.runs(t.items, ["HashIndex"], "ItemFurnished", "ItemOrder", "ItemCode").groupBy("HashIndex", "Run").agg(F.sum("ItemOrder").alias("Total"))


@query("itm_items_per_filing", "SELECT nItems, count(*) AS nFilings FROM (SELECT HashIndex, count(*) AS nItems FROM items GROUP BY 1) q GROUP BY 1")
def items_per_filing(t: Tables) -> DataFrame:
    return t.items.groupBy("HashIndex").agg(F.count("*").alias("nItems")).groupBy("nItems").agg(F.count("*").alias("nFilings"))


@query("itm_era_cross", "SELECT FilingDate >= DATE '1995-06-17' AS Late, ItemFurnished, count(*) AS nRows, count(DISTINCT HashIndex) AS nFilings, string_agg(DISTINCT ItemCode, ', ' ORDER BY ItemCode) AS Codes FROM items GROUP BY 1, 2")
def era_cross(t: Tables) -> DataFrame:
    return t.items.groupBy((F.col("FilingDate") >= F.lit("1995-06-17").cast("date")).alias("Late"), "ItemFurnished").agg(F.count("*").alias("nRows"), F.countDistinct("HashIndex").alias("nFilings"), F.array_join(F.sort_array(F.collect_set("ItemCode")), ", ").alias("Codes"))


@query("itm_length_summary", "SELECT FormType, min(nChars) AS Least, quantile_cont(nChars, 0.25) AS Q25, median(nChars) AS Mid, quantile_cont(nChars, 0.75) AS Q75, max(nChars) AS Most FROM register GROUP BY 1")
def length_summary(t: Tables) -> DataFrame:
    return t.register.groupBy("FormType").agg(F.min("nChars").alias("Least"), F.percentile("nChars", 0.25).alias("Q25"), F.median("nChars").alias("Mid"), F.percentile("nChars", 0.75).alias("Q75"), F.max("nChars").alias("Most"))


@query("itm_outcome_summary", "SELECT FormType, count(*) AS n, count(*) FILTER (nWords < 200) AS nShort, count(*) FILTER (nWords BETWEEN 200 AND 800) AS nMiddle, count(*) FILTER (nWords > 800) AS nLong, round(CAST(count(*) FILTER (nWords >= 200) AS DOUBLE) / count(*), 6) AS ShareExtracted FROM register GROUP BY 1")
def outcome_summary(t: Tables) -> DataFrame:
    return t.register.groupBy("FormType").agg(F.count("*").alias("n"), *A.count_where(nShort="nWords < 200", nMiddle="nWords between 200 and 800", nLong="nWords > 800"), F.round(F.count_if(F.col("nWords") >= 200) / F.count("*"), 6).alias("ShareExtracted"))


_BOILER = """
    WITH w AS (SELECT p_partkey AS DocID, CAST(p_size AS BIGINT) AS CIK, string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ') AS ws FROM part), g AS (SELECT DocID, CIK, unnest([array_to_string(ws[i:i + 3], ' ') FOR i IN generate_series(1, len(ws) - 3)]) AS gram FROM w),
    u AS (SELECT gram FROM g GROUP BY 1 HAVING count(DISTINCT CIK) >= greatest(2, ceil((SELECT count(DISTINCT CIK) FROM w) * 0.01))), p AS (SELECT DocID, count(*) AS nGrams, count(u.gram) AS nBoilerplate FROM g LEFT JOIN u USING (gram) GROUP BY 1)
    SELECT w.DocID, coalesce(nGrams, 0) AS nGrams, coalesce(nBoilerplate, 0) AS nBoilerplate, round(CAST(nBoilerplate AS DOUBLE) / nGrams, 6) AS Share FROM w LEFT JOIN p USING (DocID)"""


@query("itm_summary_boilerplate", _BOILER)
def boilerplate(t: Tables) -> DataFrame:
    docs = t.part.select(F.col("p_partkey").alias("DocID"), F.col("p_size").cast("bigint").alias("CIK"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("ws"))
    return A.boilerplate_share(docs, F.col("ws"))


@query("itx_firm_status", "SELECT CIK, count(*) FILTER (Year < 1995) AS nPre, CASE WHEN count(*) FILTER (DocType = '8-K' AND Year < 1995) = 0 AND count(*) FILTER (DocType LIKE 'Exhibit%') > 0 THEN 'Treated' WHEN count(*) FILTER (DocType = '8-K' AND Year < 1995) > 0 THEN 'Control' ELSE 'Unclassified' END AS Status FROM register GROUP BY 1")
def firm_status(t: Tables) -> DataFrame:
    pre, contracts = F.count_if(F.expr("DocType = '8-K' and Year < 1995")), F.count_if(F.expr("DocType like 'Exhibit%'"))
    return t.register.groupBy("CIK").agg(*A.count_where(nPre="Year < 1995"), F.when((pre == 0) & (contracts > 0), "Treated").when(pre > 0, "Control").otherwise("Unclassified").alias("Status"))


@query("itx_table_firms", "SELECT c_mktsegment AS Segment, count(*) AS nFirms, median(coalesce(n, 0)) AS Mid, round(avg(coalesce(n, 0)), 6) AS Mean FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey GROUP BY 1")
def table_firms(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    filled = t.customer.join(n, "c_custkey", "left").fillna(0, ["n"])
    return filled.groupBy(F.col("c_mktsegment").alias("Segment")).agg(F.count("*").alias("nFirms"), F.median("n").alias("Mid"), F.round(F.avg("n"), 6).alias("Mean"))


@query("itx_table_item_share", "SELECT Year, round(avg(a), 6) AS p101, round(avg(b), 6) AS p202 FROM (SELECT HashIndex, min(EXTRACT(YEAR FROM FilingDate)) AS Year, max(CASE WHEN ItemCode = '1.01' THEN 1.0 ELSE 0.0 END) AS a, max(CASE WHEN ItemCode = '2.02' THEN 1.0 ELSE 0.0 END) AS b FROM items GROUP BY 1) q GROUP BY 1")
def item_share(t: Tables) -> DataFrame:
    flag = lambda code: F.max((F.col("ItemCode") == code).cast("double"))
    per = t.items.groupBy("HashIndex").agg(F.min(F.year("FilingDate")).cast("bigint").alias("Year"), flag("1.01").alias("a"), flag("2.02").alias("b"))
    return per.groupBy("Year").agg(F.round(F.avg("a"), 6).alias("p101"), F.round(F.avg("b"), 6).alias("p202"))


@query("itx_contract_filings", "SELECT HashIndex, count(*) AS nExhibits FROM register WHERE DocType LIKE 'Exhibit10%' GROUP BY 1")
def contract_filings(t: Tables) -> DataFrame:
    return t.register.where("DocType like 'Exhibit10%'").groupBy("HashIndex").agg(F.count("*").alias("nExhibits"))


@query("ent_entities", "SELECT DocID, PartyKey, count(*) AS NOcc, max(Start) AS MaxStart, bool_or(Status = 'F') AS HasForm, min(Start) AS FirstStart, arg_min(Stop, (Start, Stop, SpanNo)) AS FirstStop FROM spans GROUP BY 1, 2")
def entities(t: Tables) -> DataFrame:
    return t.spans.groupBy("DocID", "PartyKey").agg(F.count("*").alias("NOcc"), F.max("Start").alias("MaxStart"), F.bool_or(F.col("Status") == "F").alias("HasForm"), F.min("Start").alias("FirstStart"), F.min_by("Stop", F.struct("Start", "Stop", "SpanNo")).alias("FirstStop"))


@query("ent_party_facts", "SELECT DocID, PartyKey, arg_min(PartyRole, (Start, SpanNo)) AS Role, count(DISTINCT Kind) AS nSpellings, min(Start) AS FirstAt, max(Stop) AS LastAt FROM spans WHERE Label = 'ORG' GROUP BY 1, 2")
def party_facts(t: Tables) -> DataFrame:
    return t.placed("spans").where("Label = 'ORG'").groupBy("DocID", "PartyKey").agg(F.min_by("PartyRole", W.nulls_last("Start", "SpanNo", "_place")).alias("Role"), F.countDistinct("Kind").alias("nSpellings"), F.min("Start").alias("FirstAt"), F.max("Stop").alias("LastAt"))


@query("ent_doc_facts", "SELECT l.DocID, l.DocLen, count(DISTINCT PartyKey) AS nParties, count(DISTINCT CASE WHEN PartyRole = 'registrant' THEN PartyKey END) AS nRegistrants, count(DISTINCT CASE WHEN PartyRole = 'counterparty' THEN PartyKey END) AS nCounter, greatest(0, min(Start) - 2000) AS WinStart, least(l.DocLen, max(Stop) + 2000) AS WinStop, CAST(FLOOR(l.DocLen * 0.9) AS BIGINT) AS TailStart FROM lens l JOIN spans s USING (DocID) WHERE Label = 'ORG' GROUP BY 1, 2")
def doc_facts(t: Tables) -> DataFrame:
    roles = [F.countDistinct(F.when(F.col("PartyRole") == r, F.col("PartyKey"))).alias(n) for r, n in (("registrant", "nRegistrants"), ("counterparty", "nCounter"))]
    met = t.lens.join(t.spans.where("Label = 'ORG'"), "DocID")
    return met.groupBy("DocID", "DocLen").agg(F.countDistinct("PartyKey").alias("nParties"), *roles, F.greatest(F.lit(0), F.min("Start") - 2000).cast("bigint").alias("WinStart"), F.least(F.col("DocLen"), F.max("Stop") + 2000).alias("WinStop"), F.floor(F.col("DocLen") * 0.9).alias("TailStart"))


@query("ent_density", "WITH b AS (SELECT DocID, least(CAST(FLOOR(CAST(Start AS DOUBLE) / DocLen * 50) AS BIGINT), 49) AS Bin, 1.0 / count(*) OVER (PARTITION BY DocID) AS w FROM spans JOIN lens USING (DocID)) SELECT Bin, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS ShareSpans, round(CAST(sum(w) AS DOUBLE) / sum(sum(w)) OVER (), 6) AS ShareDocs FROM b GROUP BY 1")
def density(t: Tables) -> DataFrame:
    each = t.spans.join(t.lens, "DocID").select(F.least(F.floor(F.col("Start") / F.col("DocLen") * 50), F.lit(49)).alias("Bin"), (1 / F.count("*").over(Window.partitionBy("DocID"))).alias("w"))
    whole = Window.partitionBy(F.lit(0))
    return each.groupBy("Bin").agg(F.count("*").alias("n"), F.sum("w").alias("w")).select("Bin", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("ShareSpans"), F.round(F.col("w") / F.sum("w").over(whole), 6).alias("ShareDocs"))


@query("ent_boundary", "SELECT Producer, median(Stop - Start) AS Mid, quantile_cont(Stop - Start, 0.9) AS P90, round(avg(CASE WHEN Status = 'F' THEN 1.0 ELSE 0.0 END), 6) AS pForm FROM spans GROUP BY 1")
def boundary(t: Tables) -> DataFrame:
    size = F.col("Stop") - F.col("Start")
    return t.spans.groupBy("Producer").agg(F.median(size).alias("Mid"), F.percentile(size, 0.9).alias("P90"), F.round(F.avg((F.col("Status") == "F").cast("double")), 6).alias("pForm"))


@query("ent_gap_profile", "WITH g AS (SELECT PartyRole, Start - lag(Start) OVER (PARTITION BY DocID ORDER BY Start, SpanNo, Stop, PartyRole) AS Gap FROM spans WHERE abs(Start - 400) <= 400) SELECT PartyRole, quantile_cont(Gap, 0.5) AS P50, quantile_cont(Gap, 0.75) AS P75, quantile_cont(Gap, 0.9) AS P90, quantile_cont(Gap, 0.95) AS P95 FROM g GROUP BY 1")
def gap_profile(t: Tables) -> DataFrame:
    near = t.spans.where("abs(Start - 400) <= 400").withColumn("Gap", F.col("Start") - F.lag("Start").over(Window.partitionBy("DocID").orderBy("Start", "SpanNo", "Stop", "PartyRole")))
    return near.groupBy("PartyRole").agg(*[F.percentile("Gap", p).alias(f"P{int(p * 100)}") for p in (0.5, 0.75, 0.9, 0.95)])


@query("ent_table_length", "WITH n AS (SELECT *, ntile(10) OVER (ORDER BY nChars, DocID) AS Decile FROM register) SELECT CAST(Decile AS INT) AS Decile, count(*) AS n, min(nChars) AS Least, max(nChars) AS Most, round(avg(nWords), 6) AS MeanWords FROM n GROUP BY 1")
def table_length(t: Tables) -> DataFrame:
    # Deciles over all documents by range: sorted by many tasks, numbered with the counts of the ranges before.
    ranked = ntile_all(t.register.select("DocID", "nChars", "nWords"), 10, "nChars", "DocID", name="Decile")
    return ranked.groupBy("Decile").agg(F.count("*").alias("n"), F.min("nChars").alias("Least"), F.max("nChars").alias("Most"), F.round(F.avg("nWords"), 6).alias("MeanWords"))


def ntile_all(df: DataFrame, k: int, *order: str, name: str) -> DataFrame:
    """ntile over the whole table without one task for all rows: values are numbered through the counts of the
    distinct leading values before them, whose window holds a row a value."""
    first = order[0]
    per = df.groupBy(first).agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.orderBy(first)) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy(F.lit(0)))).drop("_n")
    within = F.row_number().over(Window.partitionBy(first).orderBy(*order[1:]))
    place = df.withColumn("_within", within).join(before, first).withColumn("_row", F.col("_before") + F.col("_within") - 1)
    size, extra = F.floor(F.col("_total") / k), F.col("_total") % k
    tile = F.when(F.col("_row") < extra * (size + 1), F.floor(F.col("_row") / (size + 1))).otherwise(extra + F.floor((F.col("_row") - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return place.withColumn(name, (tile + 1).cast("int")).drop("_within", "_before", "_total", "_row")


@query("ent_coverage", "SELECT Label, count(DISTINCT DocID) AS nHit, round(CAST(count(DISTINCT DocID) AS DOUBLE) / (SELECT count(*) FROM register), 3) AS Coverage FROM spans GROUP BY 1")
def entity_coverage(t: Tables) -> DataFrame:
    total = t.register.agg(F.count("*").alias("total"))
    return t.spans.groupBy("Label").agg(F.countDistinct("DocID").alias("nHit")).crossJoin(F.broadcast(total)).select("Label", "nHit", F.round(F.col("nHit") / F.col("total"), 3).alias("Coverage"))


@query("ent_consensus", "WITH m AS (SELECT Label, DocID, CAST(FLOOR(Start / 40) AS BIGINT) AS Slot, count(DISTINCT Producer) AS nProducers FROM spans GROUP BY 1, 2, 3) SELECT Label, nProducers, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY Label), 6) AS Share FROM m GROUP BY 1, 2")
def consensus(t: Tables) -> DataFrame:
    mentions = t.spans.groupBy("Label", "DocID", F.floor(F.col("Start") / 40).alias("Slot")).agg(F.countDistinct("Producer").alias("nProducers"))
    return A.share_of_total(mentions, ["Label", "nProducers"], ["Label"])


_POS = "WITH p AS (SELECT Label, Producer, least(CAST(FLOOR((Start + Stop) / 2.0 / DocLen * 30) AS BIGINT), 29) AS Bin FROM spans JOIN lens USING (DocID)), c AS (SELECT Label, Producer, Bin, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY Label, Producer), 6) AS Share FROM p GROUP BY 1, 2, 3)"


def positions(t: Tables) -> DataFrame:
    each = t.spans.join(t.lens, "DocID").withColumn("Bin", F.least(F.floor((F.col("Start") + F.col("Stop")) / 2 / F.col("DocLen") * 30), F.lit(29)))
    return A.share_of_total(each, ["Label", "Producer", "Bin"], ["Label", "Producer"])


@query("ent_positions", _POS + " SELECT * FROM c")
def entity_positions(t: Tables) -> DataFrame:
    return positions(t)


@query("ent_contrast", _POS + " SELECT Label, round(avg(Share) FILTER (Bin < 3 OR Bin >= 27), 6) AS EndShare, round(avg(Share) FILTER (Bin BETWEEN 6 AND 23), 6) AS MidShare, round(avg(Share) FILTER (Bin < 3 OR Bin >= 27) / avg(Share) FILTER (Bin BETWEEN 6 AND 23), 4) AS Ratio FROM c GROUP BY 1")
def contrast(t: Tables) -> DataFrame:
    end, mid = (F.avg(F.when(F.expr(c), F.col("Share"))) for c in ("Bin < 3 or Bin >= 27", "Bin between 6 and 23"))
    return positions(t).groupBy("Label").agg(F.round(end, 6).alias("EndShare"), F.round(mid, 6).alias("MidShare"), F.round(end / mid, 4).alias("Ratio"))


@query("edg_flag_filer_copies", "SELECT DocID, HashDocument, count(DISTINCT nChars) OVER w <= 1 AS nCharsAgree, count(DISTINCT nWords) OVER w <= 1 AS nWordsAgree, count(DISTINCT nNums) OVER w <= 1 AS nNumsAgree, row_number() OVER (PARTITION BY HashDocument ORDER BY nWords < 50, DocID) = 1 AS PrimaryFiler FROM register WINDOW w AS (PARTITION BY HashDocument)")
def filer_copies(t: Tables) -> DataFrame:
    return W.copy_flags(t.register.withColumn("Removed", F.col("nWords") < 50))


@query("ent_build_mentions", "WITH n AS (SELECT *, CASE WHEN Start >= max(Stop) OVER (PARTITION BY DocID ORDER BY Start, Stop, SpanNo, Producer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY DocID ORDER BY Start, Stop, SpanNo, Producer) = 1 THEN 1 ELSE 0 END AS new FROM spans) SELECT DocID, Start, Stop, SpanNo, concat(DocID, '-', sum(new) OVER (PARTITION BY DocID ORDER BY Start, Stop, SpanNo, Producer ROWS UNBOUNDED PRECEDING)) AS MentionID FROM n")
def build_mentions(t: Tables) -> DataFrame:
    return W.overlap_clusters(t.spans, "SpanNo", "Producer").select("DocID", "Start", "Stop", "SpanNo", F.concat_ws("-", "DocID", "Cluster").alias("MentionID"))


_LEXHITS = "WITH h AS (SELECT DISTINCT DocID, Term, Family AS Class, round(CAST(CAST(substr(Term, 5) AS INT) % 5 AS DOUBLE) / 5, 2) AS Power FROM hits), p AS (SELECT DocID, Class, max(Power) AS Power FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY DocID ORDER BY Power DESC, Class) AS r, rank() OVER (PARTITION BY DocID ORDER BY Power DESC) AS k FROM p)"


@query("kw_decide", _LEXHITS + " SELECT DocID, CASE WHEN count(*) FILTER (k = 1) = 1 THEN max(Class) FILTER (r = 1) ELSE '(none)' END AS Class, max(Power) AS Power, max(Class) FILTER (r = 2) AS Second FROM r GROUP BY 1")
def decide(t: Tables) -> DataFrame:
    power = F.round(F.substring("Term", 5, 9).cast("int") % 5 / 5, 2)
    return W.best_class(t.hits.select("DocID", "Term", F.col("Family").alias("Class"), power.alias("Power")).distinct())


@query("itx_table_codes", "SELECT Late, ItemCode, n, Share, Rank FROM (SELECT *, row_number() OVER (PARTITION BY Late ORDER BY n DESC, ItemCode) AS Rank FROM (SELECT FilingDate >= DATE '1995-06-17' AS Late, ItemCode, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY FilingDate >= DATE '1995-06-17'), 6) AS Share FROM items GROUP BY 1, 2) q) z WHERE Rank <= 12")
def table_codes(t: Tables) -> DataFrame:
    shares = A.share_of_total(t.items.withColumn("Late", F.col("FilingDate") >= F.lit("1995-06-17").cast("date")), ["Late", "ItemCode"], ["Late"])
    return W.top_per(shares, ["Late"], 12, F.desc("n"), F.col("ItemCode")).withColumn("Rank", F.col("Rank").cast("bigint"))


_TOP2 = "WITH u AS (UNPIVOT probabilities ON P_A, P_B, P_C INTO NAME c VALUE Prob), r AS (SELECT DocID, substr(c, 3) AS Class, Prob, row_number() OVER (PARTITION BY DocID ORDER BY Prob DESC, c) AS k FROM u)"


def top2(t: Tables) -> DataFrame:
    long = t.probabilities.unpivot(["DocID"], ["P_A", "P_B", "P_C"], "c", "Prob").withColumn("Class", F.substring("c", 3, 1))
    ranked = W.top_per(long, ["DocID"], 2, F.desc("Prob"), F.col("c"))
    pick = lambda k, c: F.max(F.when(F.col("Rank") == k, F.col(c)))
    return ranked.groupBy("DocID").agg(pick(1, "Class").alias("First"), F.round(pick(1, "Prob"), 9).alias("P1"), pick(2, "Class").alias("Second"), F.round(pick(2, "Prob"), 9).alias("P2"))


@query("app_top2", _TOP2 + " SELECT DocID, max(Class) FILTER (k = 1) AS First, round(max(Prob) FILTER (k = 1), 9) AS P1, max(Class) FILTER (k = 2) AS Second, round(max(Prob) FILTER (k = 2), 9) AS P2 FROM r GROUP BY 1")
def app_top2(t: Tables) -> DataFrame:
    return top2(t)


@query("bert_classification", _TOP2 + " SELECT DocID, max(Class) FILTER (k = 1) AS Pred, round(max(Prob) FILTER (k = 1) - max(Prob) FILTER (k = 2), 8) AS Margin FROM r GROUP BY 1")
def classification(t: Tables) -> DataFrame:
    return top2(t).select("DocID", F.col("First").alias("Pred"), F.round(F.col("P1") - F.col("P2"), 8).alias("Margin"))


@query("pbd_sample_pick", "SELECT DocID, Class, Rank FROM (SELECT *, row_number() OVER (PARTITION BY Class ORDER BY nWords DESC, nChars, DocID) AS Rank FROM register) q WHERE Rank <= 15")
def sample_pick(t: Tables) -> DataFrame:
    return W.top_per(t.register, ["Class"], 15, F.desc("nWords"), F.col("nChars"), F.col("DocID")).select("DocID", "Class", F.col("Rank").cast("bigint").alias("Rank"))


@query("itm_locate_items", "SELECT DocID, Start, SpanNo, coalesce(lead(Start) OVER (PARTITION BY DocID ORDER BY Start, SpanNo), DocLen) AS NextStart FROM spans JOIN lens USING (DocID) WHERE Label = 'ORG'")
def locate_items(t: Tables) -> DataFrame:
    met = t.spans.where("Label = 'ORG'").join(t.lens, "DocID")
    return met.select("DocID", "Start", "SpanNo", F.coalesce(F.lead("Start").over(Window.partitionBy("DocID").orderBy("Start", "SpanNo")), "DocLen").alias("NextStart"))


@query("clf_prepare_sample", "SELECT DocID, TrueLabel, CAST((row_number() OVER (PARTITION BY TrueLabel ORDER BY md5('42:' || DocID), DocID) - 1) % 5 + 1 AS INT) AS Fold FROM predictions")
def prepare_sample(t: Tables) -> DataFrame:
    return W.folds(t.predictions.select("DocID", "TrueLabel"), "TrueLabel", "DocID")


_WINDOW = "WITH m AS (SELECT * FROM spans WHERE Label = 'ORG'), f AS (SELECT DocID, min(Start) AS Centre FROM m WHERE PartyRole = 'registrant' GROUP BY 1), w AS (SELECT m.*, DocLen, Centre, Start - Centre AS Dist, floor(DocLen * 0.9) AS TailStart FROM m JOIN lens USING (DocID) LEFT JOIN f USING (DocID))"


@query("ent_window", _WINDOW + " SELECT DocID, Start, SpanNo, Dist, CASE WHEN PartyRole IN ('registrant', 'cofiler') THEN PartyRole WHEN Start BETWEEN greatest(0, Centre - 200) AND least(DocLen, Centre + 200) THEN 'counterparty' WHEN Start >= TailStart THEN 'signatory' ELSE 'other' END AS Role FROM w")
def role_window(t: Tables) -> DataFrame:
    """Half-width 200: these documents are a tenth as long as contracts, for which it is 2000."""
    return P.party_windows(t.spans.where("Label = 'ORG'"), t.lens).select("DocID", "Start", "SpanNo", "Dist", P.window_role(200).alias("Role"))


@query("ent_sweep_window", _WINDOW + " SELECT CAST(h AS BIGINT) AS Half, count(*) FILTER (Start BETWEEN greatest(0, Centre - h) AND least(DocLen, Centre + h)) AS nInWindow, count(DISTINCT DocID) FILTER (Start BETWEEN greatest(0, Centre - h) AND least(DocLen, Centre + h)) AS nDocs FROM w CROSS JOIN (VALUES (100), (200), (300)) q(h) GROUP BY 1")
def sweep_window(t: Tables) -> DataFrame:
    halves = t.spark.createDataFrame([(100,), (200,), (300,)], "Half long")
    near = P.in_window(F.col("Half"))
    met = P.party_windows(t.spans.where("Label = 'ORG'"), t.lens)
    return met.crossJoin(F.broadcast(halves)).groupBy("Half").agg(F.count_if(near).alias("nInWindow"), F.countDistinct(F.when(near, F.col("DocID"))).alias("nDocs"))


@query("ent_dist_profile", _WINDOW + " SELECT CAST(b AS BIGINT) AS Bound, count(*) FILTER (abs(Dist) <= b) AS nWithin, round(CAST(count(*) FILTER (abs(Dist) <= b) AS DOUBLE) / count(*), 6) AS Share FROM w CROSS JOIN (VALUES (50), (100), (250), (500)) q(b) WHERE Centre IS NOT NULL GROUP BY 1")
def bounds_profile(t: Tables) -> DataFrame:
    bounds = t.spark.createDataFrame([(50,), (100,), (250,), (500,)], "Bound long")
    met = P.party_windows(t.spans.where("Label = 'ORG'"), t.lens).where("Centre is not null")
    near = F.abs("Dist") <= F.col("Bound")
    return met.crossJoin(F.broadcast(bounds)).groupBy("Bound").agg(F.count_if(near).alias("nWithin"), F.round(F.count_if(near) / F.count("*"), 6).alias("Share"))


@query("ent_release_mentions", "SELECT r.DocID, s.PartyKey, s.Start, s.SpanNo, coalesce(s.Start = min(s.Start) OVER (PARTITION BY r.DocID, s.PartyKey), false) AS IsFirst, CASE WHEN s.PartyKey IS NULL THEN 'none' ELSE s.PartyRole END AS Role FROM register r LEFT JOIN (SELECT * FROM spans WHERE Label = 'ORG') s USING (DocID)")
def release_mentions(t: Tables) -> DataFrame:
    met = t.register.select("DocID").join(t.spans.where("Label = 'ORG'"), "DocID", "left")
    first = F.col("Start") == F.min("Start").over(Window.partitionBy("DocID", "PartyKey"))
    return met.select("DocID", "PartyKey", "Start", "SpanNo", F.coalesce(first, F.lit(False)).alias("IsFirst"), F.when(F.col("PartyKey").isNull(), "none").otherwise(F.col("PartyRole")).alias("Role"))


@query("ent_locate_party", "SELECT r.DocID, m.PartyKey, m.Start, CASE WHEN m.DocID IS NULL THEN 'no entity' WHEN m.IsMatch THEN 'matched' ELSE 'first' END AS Status FROM register r LEFT JOIN (SELECT *, PartyRole = 'registrant' AS IsMatch FROM spans WHERE Label = 'ORG' QUALIFY row_number() OVER (PARTITION BY DocID ORDER BY (PartyRole = 'registrant') DESC, Start, SpanNo) = 1) m USING (DocID)")
def locate_party(t: Tables) -> DataFrame:
    matched = t.placed("spans").where("Label = 'ORG'").withColumn("IsMatch", F.col("PartyRole") == "registrant")
    best = first_per(matched, ["DocID"], F.desc("IsMatch"), F.asc_nulls_last("Start"), F.asc_nulls_last("SpanNo"), F.col("_place")).select("DocID", "PartyKey", "Start", "IsMatch")
    return t.register.select("DocID").join(best, "DocID", "left").select("DocID", "PartyKey", "Start", F.when(F.col("IsMatch").isNull(), "no entity").when(F.col("IsMatch"), "matched").otherwise("first").alias("Status"))


@query("ent_party_names", "SELECT DocID, PartyKey, arg_min(Kind, (PartyRole <> 'registrant', Status <> 'F', Start, SpanNo)) AS Name, bool_or(PartyRole = 'registrant') AS IsMatch, CAST(count(*) AS BIGINT) AS NOcc, arg_min(Stop, (Start, SpanNo)) AS FirstStop FROM spans WHERE Label = 'ORG' GROUP BY 1, 2")
def party_names(t: Tables) -> DataFrame:
    order = W.nulls_last(F.col("PartyRole") != "registrant", F.col("Status") != "F", "Start", "SpanNo", "_place")
    stop = F.when(F.col("Stop").isNotNull(), W.nulls_last("Start", "SpanNo", "_place"))  # as in SQL, the first that is known
    return t.placed("spans").where("Label = 'ORG'").groupBy("DocID", "PartyKey").agg(F.min_by("Kind", order).alias("Name"), F.bool_or(F.col("PartyRole") == "registrant").alias("IsMatch"), F.count("*").alias("NOcc"), F.min_by("Stop", stop).alias("FirstStop"))
