"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import parties as P
from ..sources.tables import Tables
from .registry import query

KEY_SQL = f"""trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(upper(NAME), ' & ', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '{T.LEAD_PATTERN}', ''), '{T.SUFFIX_PATTERN}', ''))"""

_RANGES = """
    WITH a AS (SELECT * FROM fundamentals QUALIFY row_number() OVER (PARTITION BY CIK, gvkey, datadate ORDER BY atq DESC NULLS LAST, CIK, gvkey, datadate, RowKey) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY CIK, datadate ORDER BY atq DESC NULLS LAST, CIK, gvkey, datadate, RowKey) = 1),
    c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY gvkey, datadate ORDER BY atq DESC NULLS LAST, CIK, gvkey, datadate, RowKey) = 1),
    d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY gvkey, fyear, fqtr ORDER BY atq DESC NULLS LAST, CIK, gvkey, datadate, RowKey) = 1),
    ranges AS (SELECT CIK, gvkey, fyear, fqtr, datadate AS DateStart, CAST(datadate + INTERVAL 3 MONTH AS DATE) AS DateStop FROM d)"""


@query("cmp_quarter_range", _RANGES + " SELECT * FROM ranges")
def quarter_range(t: Tables) -> DataFrame:
    return J.quarter_ranges(t.fundamentals)


@query("reg_merge_compustat", _RANGES + """,
    j AS (SELECT r.DocID, r.CIK, r.DateFiled, q.gvkey AS g, q.fyear AS y, q.fqtr AS f, count(*) OVER (PARTITION BY r.DocID) AS nQuarters FROM register r LEFT JOIN ranges q ON r.CIK = q.CIK AND r.DateFiled >= q.DateStart AND r.DateFiled < q.DateStop)
    SELECT DISTINCT DocID, CIK, DateFiled, CASE WHEN nQuarters = 1 THEN g END AS r_gvkey, CASE WHEN nQuarters = 1 THEN y END AS r_fyear, CASE WHEN nQuarters = 1 THEN f END AS r_fqtr, nQuarters FROM j""")
def merge_ranges(t: Tables) -> DataFrame:
    return J.attach_range(t.register.select("DocID", "CIK", "DateFiled"), J.quarter_ranges(t.fundamentals))


@query("cmp_add_periods", "SELECT DocID, CAST(DateFiled + INTERVAL 3 MONTH AS DATE) AS PlusQuarter, CAST(DateFiled + INTERVAL 2 YEAR AS DATE) AS PlusYears, CAST(DateFiled - INTERVAL 1 MONTH AS DATE) AS Earlier FROM register")
def add_periods(t: Tables) -> DataFrame:
    return t.register.select("DocID", F.add_months("DateFiled", 3).alias("PlusQuarter"), F.add_months("DateFiled", 24).alias("PlusYears"), F.add_months("DateFiled", -1).alias("Earlier"))


def _refs(t: Tables) -> DataFrame:
    return t.register.select(F.col("DocID").alias("RefID"), "CIK", "FormType", F.expr("date_add(DateFiled, int(DocID % 5) - 2)").alias("RefDate"))


def _filings(t: Tables) -> DataFrame:
    return t.register.select("CIK", "FormType", "DateFiled", "HashIndex", (F.col("DocID") % 3 == 0).alias("HasDocument"))


_LINKS = """
    WITH refs AS (SELECT DocID AS RefID, CIK, FormType, CAST(DateFiled + CAST(DocID % 5 - 2 AS INT) AS DATE) AS RefDate FROM register),
    filings AS (SELECT CIK, FormType, DateFiled, HashIndex, DocID % 3 = 0 AS HasDocument FROM register),
    ex AS (SELECT r.RefID, count(DISTINCT HashIndex) AS n, min(HashIndex) AS sole, count(DISTINCT CASE WHEN HasDocument THEN HashIndex END) AS n_doc, min(CASE WHEN HasDocument THEN HashIndex END) AS sole_doc FROM refs r JOIN filings f ON r.CIK = f.CIK AND r.FormType = f.FormType AND r.RefDate = f.DateFiled GROUP BY 1),
    nr AS (SELECT r.RefID, count(DISTINCT HashIndex) AS n_near, min(HashIndex) AS sole_near FROM refs r JOIN filings f ON r.CIK = f.CIK AND r.FormType = f.FormType AND abs(f.DateFiled - r.RefDate) <= 3 GROUP BY 1),
    linked AS (SELECT r.RefID, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 AND n_doc = 1 THEN 'tie broken' WHEN n IS NULL AND n_near = 1 THEN 'near' ELSE 'none' END AS Tier,
        CASE WHEN n = 1 THEN sole WHEN n > 1 AND n_doc = 1 THEN sole_doc WHEN n IS NULL AND n_near = 1 THEN sole_near END AS HashIndex FROM refs r LEFT JOIN ex USING (RefID) LEFT JOIN nr USING (RefID))"""


@query("cto_link_filing", _LINKS + " SELECT * FROM linked")
def link_filing(t: Tables) -> DataFrame:
    return J.link_by_date(_refs(t), _filings(t))


@query("cto_link_document", _LINKS + """,
    docs AS (SELECT HashIndex, DocID, CAST(nWords % 4 AS BIGINT) AS ExhibitNo FROM register),
    l AS (SELECT *, CASE WHEN RefID % 5 = 0 THEN NULL ELSE RefID % 4 END AS ExhibitNo FROM linked),
    c AS (SELECT HashIndex, ExhibitNo, count(*) AS n_match, min(DocID) AS DocID FROM docs GROUP BY ALL), p AS (SELECT HashIndex, count(*) AS n_docs FROM docs GROUP BY ALL)
    SELECT l.RefID, l.Tier, l.HashIndex, CASE WHEN n_match = 1 THEN c.DocID END AS DocID, CASE WHEN l.HashIndex IS NULL THEN 'no filing: ' || Tier WHEN l.ExhibitNo IS NULL THEN 'no exhibit number' WHEN n_match = 1 THEN 'linked' WHEN n_match > 1 THEN 'several exhibits' WHEN n_docs IS NULL THEN 'filing without documents' ELSE 'exhibit not in filing' END AS LinkStatus
    FROM l LEFT JOIN c ON l.HashIndex = c.HashIndex AND l.ExhibitNo = c.ExhibitNo LEFT JOIN p ON l.HashIndex = p.HashIndex""")
def link_document(t: Tables) -> DataFrame:
    docs = t.register.select("HashIndex", "DocID", (F.col("nWords") % 4).alias("ExhibitNo"))
    linked = J.link_by_date(_refs(t), _filings(t)).withColumn("ExhibitNo", F.when(F.col("RefID") % 5 != 0, F.col("RefID") % 4))
    return J.link_status(linked, docs)


@query("geo_law_inside", """
    SELECT s.DocID, s.Start, s.Stop, h.Start AS HostStart, h.Stop AS HostStop FROM spans s JOIN spans h ON s.DocID = h.DocID AND h.Label = 'ORG' AND s.Start >= h.Start AND s.Stop <= h.Stop WHERE s.Label = 'GPE'
    QUALIFY row_number() OVER (PARTITION BY s.DocID, s.Start, s.Stop ORDER BY h.Start, h.Stop) = 1""")
def law_inside(t: Tables) -> DataFrame:
    return J.inside(t.spans.where("Label = 'GPE'").select("DocID", "Start", "Stop"), t.spans.where("Label = 'ORG'"))


_ATTACH = """
    WITH e AS (SELECT DocID, Start AS Pos, 0 AS IsPlace, PartyKey, Start AS MentionStart, Stop AS MentionStop, NULL::BIGINT AS Stop FROM spans WHERE Label = 'ORG' UNION ALL SELECT DocID, Start, 1, NULL, NULL, NULL, Stop FROM spans WHERE Label = 'GPE'),
    f AS (SELECT *, last_value(CASE WHEN IsPlace = 0 THEN {'p': PartyKey, 's': MentionStart, 'e': MentionStop} END IGNORE NULLS) OVER (PARTITION BY DocID ORDER BY Pos, IsPlace, PartyKey, MentionStop ROWS UNBOUNDED PRECEDING) AS m FROM e),
    attached AS (SELECT DocID, Pos AS PlaceStart, Stop AS PlaceStop, CASE WHEN Pos - m.e BETWEEN 0 AND 200 THEN m.p END AS PartyKey, CASE WHEN Pos - m.e BETWEEN 0 AND 200 THEN m.s END AS MentionStart, CASE WHEN Pos - m.e BETWEEN 0 AND 200 THEN Pos - m.e END AS DistToParty, coalesce(Pos - m.e BETWEEN 0 AND 200, false) AS Attached FROM f WHERE IsPlace = 1)"""


@query("geo_attach", _ATTACH + " SELECT * FROM attached")
def attach(t: Tables) -> DataFrame:
    return J.attach_last_mention(t.spans.where("Label = 'GPE'"), t.spans.where("Label = 'ORG'"))


_GAPS = _ATTACH.replace("Stop FROM spans WHERE Label = 'GPE'", "Stop, Kind FROM spans WHERE Label = 'GPE'").replace("NULL::BIGINT AS Stop FROM", "NULL::BIGINT AS Stop, NULL::VARCHAR AS Kind FROM").replace("AS Attached FROM f", "AS Attached, Kind FROM f").replace("AND 200", "AND 400")


@query("geo_dist_profile", _GAPS + " SELECT Kind, count(*) AS n, quantile_cont(DistToParty, 0.25) AS P25, quantile_cont(DistToParty, 0.5) AS P50, quantile_cont(DistToParty, 0.9) AS P90, max(DistToParty) AS Most FROM attached WHERE Attached GROUP BY 1")
def dist_profile(t: Tables) -> DataFrame:
    met = J.attach_last_mention(t.spans.where("Label = 'GPE'"), t.spans.where("Label = 'ORG'"), 400, ("Kind",))
    return J.distance_profile(met, "Kind")


@query("geo_sweep_reach", _GAPS + " SELECT CAST(reach AS BIGINT) AS Reach, count(*) FILTER (DistToParty <= reach) AS nAttached, count(DISTINCT DocID) FILTER (DistToParty <= reach) AS nDocs FROM attached CROSS JOIN (VALUES (100), (200), (400)) r(reach) GROUP BY 1")
def sweep_reach(t: Tables) -> DataFrame:
    """Places are attached once, at the widest reach; narrower ones are counted by distance."""
    reaches = t.spark.createDataFrame([(100,), (200,), (400,)], "Reach long")
    met = J.attach_last_mention(t.spans.where("Label = 'GPE'"), t.spans.where("Label = 'ORG'"), 400)
    near = F.col("DistToParty") <= F.col("Reach")
    return met.crossJoin(F.broadcast(reaches)).groupBy("Reach").agg(F.count_if(near).alias("nAttached"), F.countDistinct(F.when(near, F.col("DocID"))).alias("nDocs"))


@query("geo_city_state", """
    WITH amb AS (SELECT DocID, Start, 'N' || (Start % 4) AS Name FROM spans WHERE Label = 'GPE'), cand AS (SELECT 'N' || (n_nationkey % 4) AS Name, 'P' || (n_nationkey % 5) AS State FROM nation GROUP BY ALL),
    named AS (SELECT DocID, PartyKey AS State, Start, count(*) OVER (PARTITION BY DocID, PartyKey) AS Times FROM spans WHERE Label = 'ORG'),
    best AS (SELECT a.DocID, a.Start, a.Name, c.State, abs(a.Start - n.Start) AS Gap FROM (SELECT DISTINCT * FROM amb) a JOIN cand c USING (Name) JOIN named n ON n.DocID = a.DocID AND n.State = c.State QUALIFY row_number() OVER (PARTITION BY a.DocID, a.Start, a.Name ORDER BY abs(a.Start - n.Start), n.Times DESC, c.State) = 1)
    SELECT a.DocID, a.Start, a.Name, b.State, b.Gap, CASE WHEN b.State IS NULL THEN 'unresolved' ELSE 'named nearby' END AS StateFrom FROM (SELECT DISTINCT * FROM amb) a LEFT JOIN best b ON a.DocID = b.DocID AND a.Start = b.Start AND a.Name = b.Name""")
def city_state(t: Tables) -> DataFrame:
    ambiguous = t.spans.where("Label = 'GPE'").select("DocID", "Start", F.expr("concat('N', Start % 4)").alias("Name")).distinct()
    candidates = t.nation.select(F.expr("concat('N', n_nationkey % 4)").alias("Name"), F.expr("concat('P', n_nationkey % 5)").alias("State")).distinct()
    return J.nearest_named(ambiguous, candidates, t.spans.where("Label = 'ORG'").select("DocID", F.col("PartyKey").alias("State"), "Start"))


@query("red_match_entity", """
    WITH m AS (SELECT DocID, Start, Stop, SpanNo FROM spans WHERE Label IN ('GPE', 'ORG')), b AS (SELECT m.*, o.Start AS MStart, greatest(o.Start - m.Stop, m.Start - o.Stop, 0) AS Gap, (m.Start < o.Stop AND o.Start < m.Stop) AS Overlaps FROM m JOIN spans o ON o.DocID = m.DocID AND o.Label = 'MONEY'
        WHERE (m.Start < o.Stop AND o.Start < m.Stop) OR greatest(o.Start - m.Stop, m.Start - o.Stop, 0) <= 10 QUALIFY row_number() OVER (PARTITION BY m.DocID, m.Start, m.Stop, m.SpanNo ORDER BY (m.Start < o.Stop AND o.Start < m.Stop) DESC, greatest(o.Start - m.Stop, m.Start - o.Stop, 0), o.Start, o.Stop, o.Amount) = 1)
    SELECT m.DocID, m.Start, m.Stop, m.SpanNo, b.MStart, b.Gap, coalesce(b.Overlaps, false) AS Overlaps, CASE WHEN b.MStart IS NULL THEN 'unmatched' ELSE 'MONEY' END AS Entity FROM m LEFT JOIN b USING (DocID, Start, Stop, SpanNo)""")
def match_entity(t: Tables) -> DataFrame:
    return J.overlap_or_near(t.spans.where("Label in ('GPE', 'ORG')").select("DocID", "Start", "Stop", "SpanNo"), t.spans.where("Label = 'MONEY'"))


@query("red_neighbour", """
    WITH m AS (SELECT DocID, Start, Stop, SpanNo FROM spans WHERE Label = 'ORG'), b AS (SELECT m.*, o.Label, greatest(o.Start - m.Stop, m.Start - o.Stop, 0) AS Gap FROM m JOIN spans o ON o.DocID = m.DocID AND o.Label IN ('MONEY', 'GPE', 'DATE') AND greatest(o.Start - m.Stop, m.Start - o.Stop, 0) <= 40
        QUALIFY row_number() OVER (PARTITION BY m.DocID, m.Start, m.SpanNo ORDER BY greatest(o.Start - m.Stop, m.Start - o.Stop, 0), CASE o.Label WHEN 'MONEY' THEN 1 WHEN 'GPE' THEN 2 ELSE 3 END, o.Start, o.Stop) = 1)
    SELECT m.DocID, m.Start, m.SpanNo, coalesce(b.Label, 'nothing') AS Neighbour, b.Gap FROM m LEFT JOIN b USING (DocID, Start, SpanNo)""")
def neighbour(t: Tables) -> DataFrame:
    return J.neighbours(t.spans.where("Label = 'ORG'"), t.spans, ["MONEY", "GPE", "DATE"])


@query("ent_pairwise", """
    WITH m AS (SELECT concat(DocID, '-', CAST(FLOOR(Start / 40) AS BIGINT)) AS MentionID, Producer, Start, Stop FROM spans), per AS (SELECT Producer, count(DISTINCT MentionID) AS n FROM m GROUP BY 1),
    b AS (SELECT a.Producer AS A, b.Producer AS B, count(DISTINCT a.MentionID) AS "Both", count(DISTINCT CASE WHEN a.Start = b.Start AND a.Stop = b.Stop THEN a.MentionID END) AS Exact FROM m a JOIN m b ON a.MentionID = b.MentionID AND a.Producer <> b.Producer GROUP BY 1, 2)
    SELECT b.A, b.B, b."Both", b.Exact, x.n AS nA, y.n AS nB, CAST("Both" AS DOUBLE) / (x.n + y.n - "Both") AS Jaccard FROM b JOIN per x ON x.Producer = b.A JOIN per y ON y.Producer = b.B""")
def pairwise(t: Tables) -> DataFrame:
    return J.pairs_of_producers(t.spans.select(F.expr("concat(DocID, '-', cast(floor(Start / 40) as bigint))").alias("MentionID"), "Producer", "Start", "Stop"))


@query("app_fan_out", "SELECT c.HashDocument, c.DocID, p.Class AS ReadClass, p.nWords AS ReadWords FROM register c LEFT JOIN (SELECT * FROM register QUALIFY row_number() OVER (PARTITION BY HashDocument ORDER BY DocID) = 1) p USING (HashDocument)")
def copies(t: Tables) -> DataFrame:
    primary = J.first_per(t.register, ["HashDocument"], F.col("DocID")).select("HashDocument", F.col("Class").alias("ReadClass"), F.col("nWords").alias("ReadWords"))
    return J.fan_out(primary, t.register.select("HashDocument", "DocID"), "HashDocument")


@query("export_final", """
    SELECT r.DocID, r.HashIndex, r.Class, i.nItems, o.MaxAmount, p.nSpans FROM register r LEFT JOIN (SELECT HashIndex, count(*) AS nItems FROM items GROUP BY 1) i USING (HashIndex)
    LEFT JOIN (SELECT DocID, max(Amount) AS MaxAmount FROM spans WHERE Label = 'MONEY' GROUP BY 1) o USING (DocID) LEFT JOIN (SELECT DocID, count(*) AS nSpans FROM spans GROUP BY 1) p USING (DocID)""")
def final_table(t: Tables) -> DataFrame:
    per_filing = t.items.groupBy("HashIndex").agg(F.count("*").alias("nItems"))
    amounts = t.spans.where("Label = 'MONEY'").groupBy("DocID").agg(F.max("Amount").alias("MaxAmount"))
    counts = t.spans.groupBy("DocID").agg(F.count("*").alias("nSpans"))
    return J.spine(t.register.select("DocID", "HashIndex", "Class"), (per_filing, ["HashIndex"]), (amounts, ["DocID"]), (counts, ["DocID"]))


@query("ner_db_missing", "SELECT DocID FROM register r WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.DocID = r.DocID AND Model = 'model1' AND Entity = 'MONEY')")
def missing(t: Tables) -> DataFrame:
    return t.register.select("DocID").join(t.ledger.where("Model = 'model1' and Entity = 'MONEY'"), "DocID", "left_anti")


@query("cor_pending", "SELECT r.DocID, coalesce(n, 0) AS nDone FROM register r LEFT JOIN (SELECT DocID, count(DISTINCT Entity) AS n FROM ledger WHERE Model = 'model1' AND Entity IN ('DATE', 'MONEY') GROUP BY 1) l USING (DocID) WHERE coalesce(n, 0) < 2 ORDER BY md5(CAST(r.DocID AS STRING)) LIMIT 500")
def pending(t: Tables) -> DataFrame:
    done = t.ledger.where("Model = 'model1' and Entity in ('DATE', 'MONEY')").groupBy("DocID").agg(F.countDistinct("Entity").alias("n"))
    left = t.register.select("DocID").join(done, "DocID", "left").select("DocID", F.coalesce("n", F.lit(0)).alias("nDone")).where("nDone < 2")
    return left.orderBy(F.md5(F.col("DocID").cast("string"))).limit(500)  # a reproducible draw is the operator's limit


@query("app_pending", "SELECT DocID FROM register r WHERE DocID NOT IN (SELECT DocID FROM ledger WHERE Status = 'hit') AND DocID NOT IN (SELECT DocID FROM ledger WHERE Status = 'error')")
def not_run(t: Tables) -> DataFrame:
    done, failed = (t.ledger.where(f"Status = '{s}'").select("DocID") for s in ("hit", "error"))
    return t.register.select("DocID").join(done, "DocID", "left_anti").join(failed, "DocID", "left_anti")


@query("txt_pending", "SELECT DocID FROM register WHERE DocID NOT IN (SELECT DocID FROM hits) ORDER BY md5(CAST(DocID AS STRING)) LIMIT 200")
def text_pending(t: Tables) -> DataFrame:
    return t.register.select("DocID").join(t.hits, "DocID", "left_anti").orderBy(F.md5(F.col("DocID").cast("string"))).limit(200)


@query("apl_corpus_index", "SELECT DocID FROM ledger WHERE Status <> 'error' AND Entity IN ('DATE', 'MONEY', 'GPE') GROUP BY DocID HAVING count(DISTINCT Entity) = 3")
def division(t: Tables) -> DataFrame:
    held = t.ledger.where("Status <> 'error'").where(F.col("Entity").isin("DATE", "MONEY", "GPE"))
    return held.groupBy("DocID").agg(F.countDistinct("Entity").alias("k")).where("k = 3").select("DocID")


@query("edg_restrict_upstream", "SELECT r.HashIndex, count(*) AS n FROM register r WHERE EXISTS (SELECT 1 FROM spans s WHERE s.DocID = r.DocID AND s.Label = 'MONEY') GROUP BY 1")
def restrict(t: Tables) -> DataFrame:
    return t.register.join(t.spans.where("Label = 'MONEY'"), "DocID", "left_semi").groupBy("HashIndex").agg(F.count("*").alias("n"))


@query("itm_candidates", "SELECT r.DocID, r.HashIndex, i.Codes FROM register r JOIN (SELECT HashIndex, string_agg(ItemCode, '|' ORDER BY ItemOrder, ItemCode) AS Codes FROM items GROUP BY 1) i USING (HashIndex) WHERE DocType = '8-K' AND HashIndex IN (SELECT HashIndex FROM items WHERE ItemCode = '1.01')")
def candidates(t: Tables) -> DataFrame:
    with_item = t.items.where("ItemCode = '1.01'").select("HashIndex").distinct()
    codes = t.items.groupBy("HashIndex").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ItemOrder", "ItemCode"))), lambda x: x["ItemCode"]), "|").alias("Codes"))
    return t.register.where("DocType = '8-K'").select("DocID", "HashIndex").join(with_item, "HashIndex", "left_semi").join(codes, "HashIndex").select("DocID", "HashIndex", "Codes")


@query("reg_attach_item101", "SELECT r.DocID, i.Outcome, CASE WHEN i.Outcome IS NULL THEN 'no filing' WHEN i.Outcome = 'furnished' THEN 'no' ELSE 'yes' END AS HasSummary FROM register r LEFT JOIN (SELECT HashIndex, CASE WHEN bool_or(ItemFurnished) THEN 'furnished' ELSE 'extracted' END AS Outcome FROM items GROUP BY 1) i USING (HashIndex)")
def attach_item(t: Tables) -> DataFrame:
    outcome = t.items.groupBy("HashIndex").agg(F.when(F.bool_or("ItemFurnished"), "furnished").otherwise("extracted").alias("Outcome"))
    return t.register.select("DocID", "HashIndex").join(outcome, "HashIndex", "left").select("DocID", "Outcome", F.when(F.col("Outcome").isNull(), "no filing").when(F.col("Outcome") == "furnished", "no").otherwise("yes").alias("HasSummary"))


@query("itx_table_population", "SELECT coalesce(a.Year, b.Year) AS Year, nContracts, nFilings, CASE WHEN nFilings > 0 THEN CAST(nContracts AS DOUBLE) / nFilings END AS Share FROM (SELECT Year, count(*) AS nContracts FROM register WHERE DocType LIKE 'Exhibit%' AND Year <> 1995 GROUP BY 1) a FULL JOIN (SELECT Year, count(*) AS nFilings FROM register WHERE DocType = '8-K' AND Year <> 1996 GROUP BY 1) b ON a.Year = b.Year")
def population(t: Tables) -> DataFrame:
    a = t.register.where("DocType like 'Exhibit%' and Year <> 1995").groupBy("Year").agg(F.count("*").alias("nContracts"))
    b = t.register.where("DocType = '8-K' and Year <> 1996").groupBy("Year").agg(F.count("*").alias("nFilings"))
    return a.join(b, "Year", "full").withColumn("Share", F.try_divide("nContracts", "nFilings"))


@query("itm_code_table", """
    WITH v(ItemCode) AS (VALUES ('1.01'), ('2.02'), ('3.03'), ('9.99')), o AS (SELECT ItemCode, count(*) AS n, count(DISTINCT HashIndex) AS nFilings FROM items GROUP BY 1)
    SELECT coalesce(v.ItemCode, o.ItemCode) AS ItemCode, coalesce(n, 0) AS n, CASE WHEN v.ItemCode IS NULL THEN 'unregistered' WHEN n IS NULL THEN 'registered, unseen' ELSE 'ok' END AS Status, round(coalesce(CAST(nFilings AS DOUBLE), 0) / (SELECT count(DISTINCT HashIndex) FROM items), 6) AS pFilings FROM v FULL JOIN o ON v.ItemCode = o.ItemCode""")
def code_table(t: Tables) -> DataFrame:
    vocabulary = t.spark.createDataFrame([("1.01",), ("2.02",), ("3.03",), ("9.99",)], "ItemCode string").withColumn("known", F.lit(True))
    seen = t.items.groupBy("ItemCode").agg(F.count("*").alias("n"), F.countDistinct("HashIndex").alias("nFilings"))
    total = t.items.agg(F.countDistinct("HashIndex").alias("total"))
    status = F.when(F.col("known").isNull(), "unregistered").when(F.col("n").isNull(), "registered, unseen").otherwise("ok")
    return vocabulary.join(seen, "ItemCode", "full").crossJoin(F.broadcast(total)).select("ItemCode", F.coalesce("n", F.lit(0)).alias("n"), status.alias("Status"), F.round(F.coalesce("nFilings", F.lit(0)) / F.col("total"), 6).alias("pFilings"))


@query("clf_rollup_to_broad", "WITH m(Class, Broad) AS (VALUES ('1-URGENT', 'High'), ('2-HIGH', 'High'), ('3-MEDIUM', 'Low'), ('5-LOW', 'Low')) SELECT p.DocID, a.Broad AS TrueBroad, b.Broad AS PredBroad FROM predictions p LEFT JOIN m a ON p.TrueLabel = a.Class LEFT JOIN m b ON p.PredLabel = b.Class")
def rollup(t: Tables) -> DataFrame:
    broad = t.spark.createDataFrame([("1-URGENT", "High"), ("2-HIGH", "High"), ("3-MEDIUM", "Low"), ("5-LOW", "Low")], "Class string, Broad string")
    a, b = (F.broadcast(broad.select(F.col("Class").alias(c), F.col("Broad").alias(n))) for c, n in (("TrueLabel", "TrueBroad"), ("PredLabel", "PredBroad")))
    return t.predictions.join(a, "TrueLabel", "left").join(b, "PredLabel", "left").select("DocID", "TrueBroad", "PredBroad")


_FIRMS = "(SELECT c_custkey AS CIK, CASE c_custkey % 5 WHEN 0 THEN 'The ' || c_name || ' & Sons Holdings, Inc.' WHEN 1 THEN c_name || ' L.P.' WHEN 2 THEN lower(c_name) || ' Co. Ltd' WHEN 3 THEN 'Firm ' || (c_custkey % 7) || ' Corp' ELSE '---' END AS Name FROM customer)"


def _firms(t: Tables) -> DataFrame:
    name = "CASE c_custkey % 5 WHEN 0 THEN concat('The ', c_name, ' & Sons Holdings, Inc.') WHEN 1 THEN concat(c_name, ' L.P.') WHEN 2 THEN concat(lower(c_name), ' Co. Ltd') WHEN 3 THEN concat('Firm ', c_custkey % 7, ' Corp') ELSE '---' END"
    return t.customer.selectExpr("c_custkey AS CIK", f"{name} AS Name")


@query("ent_filer_keys", f"WITH k AS (SELECT r.DocID, r.HashDocument, nullif({KEY_SQL.replace('NAME', 'n.Name')}, '') AS FilerKey FROM register r JOIN {_FIRMS} n ON r.CIK = n.CIK) SELECT a.DocID, b.FilerKey, bool_or(b.DocID = a.DocID) AS IsPrimary FROM register a JOIN k b ON a.HashDocument = b.HashDocument WHERE b.FilerKey IS NOT NULL GROUP BY 1, 2")
def filer_keys(t: Tables) -> DataFrame:
    return P.filer_keys(t.register.select("DocID", "HashDocument", "CIK"), _firms(t))


@query("itm_summary_filing", "SELECT r.DocID, r.DateFiled, d.DateFirst, CAST(r.DateFiled - d.DateFirst AS INT) AS AnnounceLagDays FROM register r JOIN (SELECT DocID, min(DateValue) AS DateFirst FROM spans WHERE Label = 'DATE' GROUP BY 1) d USING (DocID)")
def announce_lag(t: Tables) -> DataFrame:
    first = t.spans.where("Label = 'DATE'").groupBy("DocID").agg(F.min("DateValue").alias("DateFirst"))
    return t.register.select("DocID", "DateFiled").join(first, "DocID").withColumn("AnnounceLagDays", F.datediff("DateFiled", "DateFirst"))


@query("txt_filer_sic", "SELECT r.DocID, c.c_mktsegment AS Industry, n.n_name AS Nation FROM register r LEFT JOIN customer c ON r.CIK = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def filer_industry(t: Tables) -> DataFrame:
    filers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("CIK"), F.col("c_mktsegment").alias("Industry"), F.col("n_name").alias("Nation"))
    return t.register.select("DocID", "CIK").join(filers, "CIK", "left").drop("CIK")


@query("kw_hits_mine", "SELECT h.DocID, l.Class, h.Term, l.Power FROM hits h JOIN (SELECT 'term' || (n_nationkey % 12) AS Term, r_name AS Class, round(CAST(n_nationkey AS DOUBLE) / 25, 2) AS Power FROM nation JOIN region ON n_regionkey = r_regionkey) l USING (Term)")
def mine_hits(t: Tables) -> DataFrame:
    lexicon = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.expr("concat('term', n_nationkey % 12)").alias("Term"), F.col("r_name").alias("Class"), F.round(F.col("n_nationkey") / 25, 2).alias("Power"))
    return t.hits.select("DocID", "Term").join(lexicon, "Term").select("DocID", "Class", "Term", "Power")


@query("kw_parity_check", "WITH a AS (SELECT DISTINCT DocID, Term FROM hits WHERE Family <> 'War'), b AS (SELECT DISTINCT DocID, Term FROM hits WHERE StartAt > 100) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS OnlyMined, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS OnlyApplied, false AS Agree")
def parity(t: Tables) -> DataFrame:
    a, b = (t.hits.where(c).select("DocID", "Term").distinct() for c in ("Family <> 'War'", "StartAt > 100"))
    one, two = (x.exceptAll(y).agg(F.count("*").alias(n)) for x, y, n in ((a, b, "OnlyMined"), (b, a, "OnlyApplied")))
    return one.crossJoin(two).withColumn("Agree", (F.col("OnlyMined") == 0) & (F.col("OnlyApplied") == 0))


@query("ent_anchor_keys", f"""WITH d AS (SELECT HashIndex, arg_min(Address, RecordNo) AS Address FROM (SELECT HashIndex, DocID AS RecordNo, 'Street ' || (DocID % 13) AS Address FROM register WHERE nWords > 300) q GROUP BY 1),
    l AS (SELECT DocID, min(TrueLabel) AS Class FROM predictions GROUP BY 1), n AS (SELECT CIK, Name, nullif({KEY_SQL.replace('NAME', 'Name')}, '') AS AnchorKey FROM {_FIRMS})
    SELECT l.DocID, l.Class, n.Name AS AnchorName, n.AnchorKey, length(n.AnchorKey) AS AnchorLen, d.Address FROM l LEFT JOIN register r ON l.DocID = r.DocID LEFT JOIN n ON r.CIK = n.CIK LEFT JOIN d ON r.HashIndex = d.HashIndex""")
def anchors(t: Tables) -> DataFrame:
    labelled = t.predictions.groupBy("DocID").agg(F.min("TrueLabel").alias("Class"))
    landing = t.register.where("nWords > 300").select("HashIndex", F.col("DocID").alias("RecordNo"), F.concat(F.lit("Street "), F.col("DocID") % 13).alias("Address"))
    return P.anchor_keys(labelled, t.register, _firms(t), landing)


@query("ent_corpus_keys", "SELECT r.DocID, r.CIK, p.PredLabel AS ReleaseClass FROM register r LEFT JOIN predictions p USING (DocID) WHERE r.DocID IN (SELECT DocID FROM spans WHERE Label = 'ORG')")
def corpus_keys(t: Tables) -> DataFrame:
    return t.register.join(t.spans.where("Label = 'ORG'"), "DocID", "left_semi").join(t.predictions, "DocID", "left").select("DocID", "CIK", F.col("PredLabel").alias("ReleaseClass"))


@query("pbd_text_coverage", "SELECT count(*) FILTER (DocID IN (SELECT DocID FROM spans)) AS WithText, count(*) FILTER (DocID NOT IN (SELECT DocID FROM spans)) AS WithoutText, count(*) - count(DISTINCT DocID) AS Repeated FROM register")
def text_coverage(t: Tables) -> DataFrame:
    texts = t.spans.select("DocID").distinct().withColumn("has", F.lit(True))
    marked = t.register.select("DocID").join(texts, "DocID", "left")
    return marked.agg(F.count_if(F.col("has").isNotNull()).alias("WithText"), F.count_if(F.col("has").isNull()).alias("WithoutText"), (F.count("*") - F.countDistinct("DocID")).alias("Repeated"))
