"""Queries of the span extractors, over contract prose, and of the rules that read spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import any_pattern, phrase_pattern
from ..operators import aggregates as A
from ..operators.joins import first_per
from ..sources.tables import Tables
from .registry import query

PLACES = [("New York", "US State", False), ("Delaware", "US State", False), ("Illinois", "US State", False), ("Springfield", "US Populated Place", False), ("Street", "US Populated Place", True), ("Notice", "US Populated Place", True)]
_AT = "CAST(strpos(Text, Span) - 1 AS BIGINT) AS Start, CAST(strpos(Text, Span) - 1 + length(Span) AS BIGINT) AS Stop"


def _found(t: Tables, label: str) -> DataFrame:
    return S.extract(t.contracts, [label], PLACES).where(F.col("Label") == label)


@query("extract_dates", f"WITH x AS (SELECT c.DocID, Text, strftime(o_orderdate, '%B %-d, %Y') AS Span, CAST(CAST(o_orderdate AS DATE) AS STRING) AS DateValue FROM contracts c JOIN orders ON o_orderkey = DocID) SELECT DocID, {_AT}, Span, 'Text' AS LabelRaw, DateValue FROM x")
def extract_dates(t: Tables) -> DataFrame:
    return _found(t, "DATE").select("DocID", "Start", "Stop", "Span", "LabelRaw", "DateValue")


@query("extract_terms", f"WITH x AS (SELECT DocID, Text, 'continue in effect for a period of ' || CASE DocID % 3 WHEN 0 THEN 'five (5) years' WHEN 1 THEN 'thirty (30) days' ELSE '18 months' END AS Span FROM contracts) SELECT DocID, {_AT}, Span, 'ContinueFor' AS LabelRaw, CASE DocID % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 30.0 ELSE 18.0 END AS TermN, CASE DocID % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'day' ELSE 'month' END AS TermUnit, CASE DocID % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 0.0821 ELSE 1.5 END AS TermYears FROM x")
def extract_terms(t: Tables) -> DataFrame:
    return _found(t, "TERM").select("DocID", "Start", "Stop", "Span", "LabelRaw", "TermN", "TermUnit", "TermYears")


@query("extract_money", f"WITH x AS (SELECT DocID, Text, '$' || format('{{:,.2f}}', o_totalprice) AS Span, 'symbol_amount' AS LabelRaw, round(o_totalprice, 2) AS Amount, 'USD' AS Currency FROM contracts JOIN orders ON o_orderkey = DocID UNION ALL SELECT DocID, Text, 'USD 45,000', 'iso_amount', 45000, 'USD' FROM contracts WHERE DocID % 4 = 2 UNION ALL SELECT DocID, Text, 'EUR 3 million', 'iso_scaled', 3000000, 'EUR' FROM contracts WHERE DocID % 4 = 3) SELECT DocID, {_AT}, Span, LabelRaw, Amount, Currency FROM x")
def extract_money(t: Tables) -> DataFrame:
    return _found(t, "MONEY").select("DocID", "Start", "Stop", "Span", "LabelRaw", F.round(F.col("Amount").cast("double"), 2).alias("Amount"), "Currency")


@query("extract_redactions", f"WITH x AS (SELECT DocID, Text, CASE DocID % 4 WHEN 0 THEN '[***]' ELSE '[CONFIDENTIAL TREATMENT REQUESTED]' END AS Span FROM contracts WHERE DocID % 4 < 2) SELECT DocID, {_AT}, Span, CASE DocID % 4 WHEN 0 THEN 'RedactSymbol' ELSE 'RedactExplicit' END AS LabelRaw FROM x")
def extract_redactions(t: Tables) -> DataFrame:
    return _found(t, "REDACT").select("DocID", "Start", "Stop", "Span", "LabelRaw")


@query("extract_laws", f"WITH x AS (SELECT DocID, Text, 'governed by the laws of the State of ' || CASE DocID % 2 WHEN 0 THEN 'New York' ELSE 'Delaware' END AS Span FROM contracts) SELECT DocID, {_AT}, Span, 'GovernedBy' AS LabelRaw FROM x")
def extract_laws(t: Tables) -> DataFrame:
    return _found(t, "LAW").select("DocID", "Start", "Stop", "Span", "LabelRaw")


@query("extract_places", f"WITH x AS (SELECT DocID, Text, unnest([CASE DocID % 2 WHEN 0 THEN 'New York' ELSE 'Delaware' END, 'Springfield', 'Illinois']) AS Span FROM contracts) SELECT DocID, {_AT}, Span, CASE Span WHEN 'Springfield' THEN 'US Populated Place' ELSE 'US State' END AS LabelRaw, CASE Span WHEN 'Springfield' THEN 'corroborated' ELSE 'anchor' END AS MatchKind FROM x")
def extract_places(t: Tables) -> DataFrame:
    return _found(t, "GPE").select("DocID", "Start", "Stop", "Span", "LabelRaw", "MatchKind")


@query("finalize", "SELECT doc_id AS DocID, true AS Answered FROM documents")
def sentinels(t: Tables) -> DataFrame:
    """Every document answers, with spans or without."""
    rows = S.extract(t.documents, ["DATE", "TERM", "MONEY", "LAW"], id_column="doc_id", text_column="text")
    return rows.groupBy("DocID").agg((F.count("*") > 0).alias("Answered"))


@query("verify_offsets", "SELECT 0::BIGINT AS nWrong")
def offsets(t: Tables) -> DataFrame:
    rows = S.extract(t.contracts, ["DATE", "TERM", "MONEY", "REDACT", "LAW", "GPE"], PLACES, columns=["DocID", "Start", "Stop", "Span"])
    return S.wrong_offsets(rows, t.contracts).agg(F.count("*").alias("nWrong"))


TERMS = {"shall be governed": "Law", "fixed price": "Price", "price is": "Price", "confidential treatment": "Redaction", "notice": "Notice"}


def text_hits(docs: DataFrame, terms: dict[str, str], cue: int = 80) -> DataFrame:
    """(DocID, Family, Term, StartAt, StopAt, RelPos, CueBefore, CueAfter): every hit of every phrase, 1-based and inclusive.

    One pass over the texts, in the JVM: those that no phrase is in are rejected by one expression; the rest are
    split at each phrase, whose places are running sums of lengths, and all hits of a text are put out together.
    """
    hit = S.spread(docs.select("DocID", "Text")).where(F.col("Text").rlike(any_pattern(list(terms)))).withColumn("DocLen", F.length("Text"))
    place = "struct<StartAt:int,Length:int>"

    def places(term: str) -> Column:
        """Of each occurrence, its place and length: the gaps and matches before it, added up."""
        gaps, found = F.split("Text", phrase_pattern(term), -1), F.regexp_extract_all("Text", F.lit(phrase_pattern(term)), F.lit(0))
        sizes = F.zip_with(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(found)), F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        start = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{place}>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["g"]).alias("StartAt"), x["m"].alias("Length"))).alias("out"))
        return F.aggregate(sizes, start, step, lambda a: a["out"])

    def named(term: str, family: str) -> Column:
        return F.transform(places(term), lambda h: F.struct(F.lit(family).alias("Family"), F.lit(term).alias("Term"), h["StartAt"].alias("StartAt"), h["Length"].alias("Length")))

    rows = hit.select("DocID", "Text", "DocLen", F.explode(F.concat(*[named(*x) for x in terms.items()])).alias("h"))
    a, n = F.col("h.StartAt"), F.col("h.Length")
    return rows.select(
        "DocID", "h.Family", "h.Term", "h.StartAt", (a + n - 1).alias("StopAt"), (a / F.col("DocLen")).alias("RelPos"),
        F.substr("Text", F.greatest(a - cue, F.lit(1)), F.least(F.lit(cue), a - 1)).alias("CueBefore"), F.substr("Text", a + n, F.lit(cue)).alias("CueAfter"),
    )


_TERM_HITS = "WITH t(Term, Family, Pat) AS (VALUES ('shall be governed', 'Law', 'shall be governed'), ('price is', 'Price', 'price is'), ('confidential treatment', 'Redaction', 'confidential treatment'), ('notice', 'Notice', 'notice')), h AS (SELECT DocID, Family, Term, CAST(strpos(lower(Text), Pat) AS INT) AS StartAt, CAST(strpos(lower(Text), Pat) + length(Pat) - 1 AS INT) AS StopAt, Text FROM contracts, t WHERE strpos(lower(Text), Pat) > 0)"


@query("txt_scan", _TERM_HITS + " SELECT DocID, Family, Term, StartAt, StopAt, round(CAST(StartAt AS DOUBLE) / length(Text), 6) AS RelPos, right(substr(Text, 1, StartAt - 1), 80) AS CueBefore FROM h")
def scan(t: Tables) -> DataFrame:
    return text_hits(t.contracts, TERMS).withColumn("RelPos", F.round("RelPos", 6)).drop("CueAfter")


@query("txt_check_offsets", "SELECT 0::BIGINT AS nWrong")
def check_offsets(t: Tables) -> DataFrame:
    met = text_hits(t.contracts, TERMS).join(t.contracts, "DocID")
    return met.agg(F.count_if(F.lower(F.substr("Text", F.col("StartAt"), F.col("StopAt") - F.col("StartAt") + 1)) != F.lower("Term")).alias("nWrong"))


@query("txt_doc_table", "WITH f AS (SELECT DISTINCT Family FROM hits), g AS (SELECT DocID, nWords, Family FROM register CROSS JOIN f), h AS (SELECT DocID, Family, count(*) AS nHits, count(DISTINCT Term) AS nTerms, min(StartAt) AS FirstPos FROM hits GROUP BY 1, 2) SELECT g.DocID, g.Family, coalesce(nHits, 0) AS nHits, coalesce(nTerms, 0) AS nTerms, FirstPos, nHits IS NOT NULL AS HasTerm, CASE WHEN nWords > 0 THEN round(1000.0 * coalesce(nHits, 0) / nWords, 6) END AS PerKWords FROM g LEFT JOIN h USING (DocID, Family)")
def doc_table(t: Tables) -> DataFrame:
    families = t.hits.select("Family").distinct()  # a vocabulary
    grid = t.register.select("DocID", "nWords").crossJoin(F.broadcast(families))
    counts = t.hits.groupBy("DocID", "Family").agg(F.count("*").alias("nHits"), F.countDistinct("Term").alias("nTerms"), F.min("StartAt").alias("FirstPos"))
    n = F.coalesce("nHits", F.lit(0))
    return grid.join(counts, ["DocID", "Family"], "left").select("DocID", "Family", n.alias("nHits"), F.coalesce("nTerms", F.lit(0)).alias("nTerms"), "FirstPos", F.col("nHits").isNotNull().alias("HasTerm"), F.round(F.try_divide(n * 1000, "nWords"), 6).alias("PerKWords"))


@query("txt_term_counts", "SELECT Term, count(*) AS nHits, count(DISTINCT DocID) AS nDocs, round(CAST(count(DISTINCT DocID) AS DOUBLE) / (SELECT count(*) FROM register), 6) AS Share FROM hits GROUP BY 1")
def term_counts(t: Tables) -> DataFrame:
    total = t.register.agg(F.count("*").alias("total"))
    return t.hits.groupBy("Term").agg(F.count("*").alias("nHits"), F.countDistinct("DocID").alias("nDocs")).crossJoin(F.broadcast(total)).select("Term", "nHits", "nDocs", F.round(F.col("nDocs") / F.col("total"), 6).alias("Share"))


def _prevalence(t: Tables, *by: str) -> DataFrame:
    has = t.hits.select("DocID", "Family").distinct().withColumn("has", F.lit(1))
    grid = t.register.select("DocID", *by).crossJoin(F.broadcast(t.hits.select("Family").distinct()))
    return grid.join(has, ["DocID", "Family"], "left").groupBy(*by, "Family").agg(F.count("*").alias("nDocs"), F.count("has").alias("nWith"), F.round(F.count("has") / F.count("*"), 6).alias("Share"))


_PREV = "WITH f AS (SELECT DISTINCT Family FROM hits), h AS (SELECT DISTINCT DocID, Family FROM hits) SELECT BY, f.Family, count(*) AS nDocs, count(h.DocID) AS nWith, round(CAST(count(h.DocID) AS DOUBLE) / count(*), 6) AS Share FROM register r CROSS JOIN f LEFT JOIN h ON h.DocID = r.DocID AND h.Family = f.Family GROUP BY 1, 2"


@query("txt_prevalence", _PREV.replace("BY,", "Year,", 1))
def prevalence(t: Tables) -> DataFrame:
    return _prevalence(t, "Year")


@query("txt_prevalence_class", _PREV.replace("BY,", "Class,", 1).replace("GROUP BY 1, 2", "WHERE f.Family = 'Pandemic' AND Year >= 1994 GROUP BY 1, 2"))
def prevalence_class(t: Tables) -> DataFrame:
    has = t.hits.where("Family = 'Pandemic'").select("DocID", "Family").distinct()
    return t.register.where("Year >= 1994").join(has, "DocID", "left").groupBy("Class").agg(F.count("*").alias("nDocs"), F.count("Family").alias("nWith"), F.round(F.count("Family") / F.count("*"), 6).alias("Share")).withColumn("Family", F.lit("Pandemic"))


@query("txt_term_break", """
    WITH d AS (SELECT CASE WHEN Year < 1995 THEN 'Pre' ELSE 'Post' END AS Era, count(*) AS n FROM register GROUP BY 1), t AS (SELECT DISTINCT Term FROM hits), h AS (SELECT Term, CASE WHEN Year < 1995 THEN 'Pre' ELSE 'Post' END AS Era, count(DISTINCT h.DocID) AS k FROM hits h JOIN register USING (DocID) GROUP BY 1, 2),
    w AS (SELECT t.Term, coalesce(max(k) FILTER (d.Era = 'Pre'), 0) AS kPre, coalesce(max(k) FILTER (d.Era = 'Post'), 0) AS kPost, max(n) FILTER (d.Era = 'Pre') AS nPre, max(n) FILTER (d.Era = 'Post') AS nPost FROM t CROSS JOIN d LEFT JOIN h ON h.Term = t.Term AND h.Era = d.Era GROUP BY 1), r AS (SELECT *, round(CASE WHEN kPre > 0 THEN (CAST(kPost AS DOUBLE) / nPost) / (CAST(kPre AS DOUBLE) / nPre) END, 6) AS Ratio FROM w)
    SELECT Term, kPre, kPost, Ratio, CASE WHEN kPre + kPost = 0 THEN 'silent' WHEN kPre = 0 THEN 'new after break' WHEN Ratio >= 3 THEN 'steps' WHEN Ratio <= 1.5 THEN 'flat' ELSE 'mixed' END AS Verdict FROM r""")
def term_break(t: Tables) -> DataFrame:
    era = F.when(F.col("Year") < 1995, "Pre").otherwise("Post")
    docs = t.register.select("DocID", era.alias("Era"))
    size = docs.groupBy().pivot("Era", ["Pre", "Post"]).agg(F.count(F.lit(1))).select(F.col("Pre").alias("nPre"), F.col("Post").alias("nPost"))
    counts = A.pivot_fixed(t.hits.join(docs, "DocID"), ["Term"], "Era", ["Pre", "Post"], {"k": F.countDistinct("DocID")}, 0).select("Term", F.col("Pre_k").alias("kPre"), F.col("Post_k").alias("kPost"))
    ratio = F.round(F.when(F.col("kPre") > 0, (F.col("kPost") / F.col("nPost")) / (F.col("kPre") / F.col("nPre"))), 6)
    out = counts.crossJoin(F.broadcast(size)).withColumn("Ratio", ratio)
    verdict = F.when(F.col("kPre") + F.col("kPost") == 0, "silent").when(F.col("kPre") == 0, "new after break").when(F.col("Ratio") >= 3, "steps").when(F.col("Ratio") <= 1.5, "flat").otherwise("mixed")
    return out.select("Term", "kPre", "kPost", "Ratio", verdict.alias("Verdict"))


@query("txt_position", "SELECT Family, least(CAST(FLOOR(RelPos * 20) AS BIGINT), 19) AS Bin, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY Family), 6) AS Share FROM hits GROUP BY 1, 2")
def position(t: Tables) -> DataFrame:
    return A.share_of_total(t.hits.withColumn("Bin", F.least(F.floor(F.col("RelPos") * 20), F.lit(19))), ["Family", "Bin"], ["Family"])


@query("txt_table_intensity", "WITH h AS (SELECT DocID, count(*) AS k FROM hits WHERE Family = 'War' GROUP BY 1) SELECT Year, count(*) AS nDocs, round(avg(k), 6) AS MeanHits, median(k) AS MidHits FROM register LEFT JOIN h USING (DocID) GROUP BY 1")
def intensity(t: Tables) -> DataFrame:
    per = t.hits.where("Family = 'War'").groupBy("DocID").agg(F.count("*").alias("k"))
    return t.register.join(per, "DocID", "left").groupBy("Year").agg(F.count("*").alias("nDocs"), F.round(F.avg("k"), 6).alias("MeanHits"), F.median("k").alias("MidHits"))


@query("txt_table_composition", "SELECT Year, FormType, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY Year), 6) AS Share FROM register GROUP BY 1, 2")
def table_composition(t: Tables) -> DataFrame:
    return A.share_of_total(t.register, ["Year", "FormType"], ["Year"])


@query("txt_table_class_sic", "SELECT Class, c_mktsegment AS Industry, count(DISTINCT r.DocID) AS n FROM register r JOIN customer ON CIK = c_custkey JOIN hits h ON h.DocID = r.DocID AND Family = 'Pandemic' GROUP BY 1, 2")
def class_industry(t: Tables) -> DataFrame:
    filers = t.customer.select(F.col("c_custkey").alias("CIK"), F.col("c_mktsegment").alias("Industry"))
    hit = t.hits.where("Family = 'Pandemic'").select("DocID").distinct()
    return t.register.join(hit, "DocID", "left_semi").join(filers, "CIK").groupBy("Class", "Industry").agg(F.count("*").alias("n"))


@query("txt_report_examples", "SELECT DocID, Term, StartAt FROM (SELECT DISTINCT DocID, Term, StartAt FROM hits WHERE Family = 'Pandemic') q ORDER BY md5(DocID || Term || StartAt) LIMIT 12")
def examples(t: Tables) -> DataFrame:
    rows = t.hits.where("Family = 'Pandemic'").select("DocID", "Term", "StartAt").distinct()
    return rows.orderBy(F.md5(F.concat("DocID", "Term", "StartAt"))).limit(12)


# --- Money ---------------------------------------------------------------------------------------------

_MONEY = "WITH m AS (SELECT DocID, SpanNo, Start, CASE WHEN Producer = 'model0' THEN 'USD' ELSE 'non-USD' END AS Block, CASE WHEN Start % 13 = 0 THEN NULL WHEN Start % 17 = 0 THEN 0 ELSE Amount END AS Amount, Kind IN ('RedactExplicit', 'RedactSymbol') AND Start % 5 = 0 AS Withheld, Start % 7 = 0 AS IsPar FROM spans WHERE Label = 'MONEY'), d AS (SELECT *, CASE WHEN Withheld THEN 'withheld' WHEN Amount IS NULL THEN 'unparsed' WHEN Amount = 0 THEN 'zero' WHEN IsPar THEN 'par' ELSE 'kept' END AS MoneyDrop FROM m)"


def money_spans(t: Tables) -> DataFrame:
    m = t.spans.where("Label = 'MONEY'")
    amount = F.when(F.col("Start") % 13 == 0, None).when(F.col("Start") % 17 == 0, 0).otherwise(F.col("Amount"))
    withheld = F.col("Kind").isin("RedactExplicit", "RedactSymbol") & (F.col("Start") % 5 == 0)
    m = m.select("DocID", "SpanNo", "Start", F.when(F.col("Producer") == "model0", "USD").otherwise("non-USD").alias("Block"), amount.alias("Amount"), withheld.alias("Withheld"), (F.col("Start") % 7 == 0).alias("IsPar"))
    drop = F.when(F.col("Withheld"), "withheld").when(F.col("Amount").isNull(), "unparsed").when(F.col("Amount") == 0, "zero").when(F.col("IsPar"), "par").otherwise("kept")
    return m.withColumn("MoneyDrop", drop)


@query("mny_release_spans", _MONEY + " SELECT DocID, SpanNo, Start, Block, Amount, MoneyDrop FROM d")
def release_money(t: Tables) -> DataFrame:
    return money_spans(t).select("DocID", "SpanNo", "Start", "Block", "Amount", "MoneyDrop")


@query("mny_load", "SELECT DocID, SpanNo, Start, TRY_CAST(CASE WHEN Start % 9 = 0 THEN 'n/a' ELSE CAST(CAST(Amount AS DECIMAL(18, 2)) AS STRING) END AS DOUBLE) AS Parsed, Kind IN ('RedactExplicit', 'RedactSymbol') AS Withheld FROM spans WHERE Label = 'MONEY'")
def load_money(t: Tables) -> DataFrame:
    raw = F.when(F.col("Start") % 9 == 0, "n/a").otherwise(F.col("Amount").cast("decimal(18,2)").cast("string"))
    return t.spans.where("Label = 'MONEY'").select("DocID", "SpanNo", "Start", raw.try_cast("double").alias("Parsed"), F.col("Kind").isin("RedactExplicit", "RedactSymbol").alias("Withheld"))


PAR = ["PAR VALUE", "STATED VALUE", "NO PAR", "LIQUIDATION PREFERENCE"]
_PARB = "upper(CASE SpanNo % 4 WHEN 0 THEN 'common stock, par value ' WHEN 1 THEN 'of no par, stated value ' ELSE 'the sum of ' END)"
_PARA = "upper(CASE Start % 3 WHEN 0 THEN ' liquidation preference each' ELSE ' per share' END)"


@query("mny_mark_par", f"WITH m AS (SELECT DocID, SpanNo, Start, {_PARB} AS b, {_PARA} AS a FROM spans WHERE Label = 'MONEY'), h AS (SELECT *, CASE " + " ".join(f"WHEN contains(b, '{c}') OR contains(a, '{c}') THEN '{c}'" for c in PAR) + " END AS ParCue, " + " OR ".join(f"contains(b, '{c}')" for c in PAR) + " AS hb, " + " OR ".join(f"contains(a, '{c}')" for c in PAR) + " AS ha FROM m) SELECT DocID, SpanNo, Start, ParCue, CASE WHEN hb AND ha THEN 'both' WHEN hb THEN 'before' WHEN ha THEN 'after' ELSE 'none' END AS ParSide FROM h")
def mark_par(t: Tables) -> DataFrame:
    before = F.upper(F.right(F.expr("CASE SpanNo % 4 WHEN 0 THEN 'common stock, par value ' WHEN 1 THEN 'of no par, stated value ' ELSE 'the sum of ' END"), F.lit(60)))
    after = F.upper(F.left(F.expr("CASE Start % 3 WHEN 0 THEN ' liquidation preference each' ELSE ' per share' END"), F.lit(60)))
    has = lambda c: F.array_max(F.array(*[F.contains(c, F.lit(x)) for x in PAR]))
    cue = F.get(F.filter(F.array(*[F.when(F.contains(before, F.lit(x)) | F.contains(after, F.lit(x)), x) for x in PAR]), lambda x: x.isNotNull()), F.lit(0))
    side = F.when(has(before) & has(after), "both").when(has(before), "before").when(has(after), "after").otherwise("none")
    return t.spans.where("Label = 'MONEY'").select("DocID", "SpanNo", "Start", cue.alias("ParCue"), side.alias("ParSide"))


_MAGG = ", ".join(f"count(*) FILTER (Block = '{b}' AND MoneyDrop = 'kept') AS \"{b}_N\", round(max(d.Amount) FILTER (Block = '{b}' AND MoneyDrop = 'kept'), 4) AS \"{b}_Max\", round(median(d.Amount) FILTER (Block = '{b}' AND MoneyDrop = 'kept'), 4) AS \"{b}_Median\"" for b in ("USD", "non-USD"))


@query("mny_collapse", _MONEY + f" SELECT r.DocID, {_MAGG}, count(*) FILTER (MoneyDrop <> 'kept') AS nDropped FROM register r LEFT JOIN d USING (DocID) GROUP BY 1")
def collapse_money(t: Tables) -> DataFrame:
    kept = F.col("MoneyDrop") == "kept"
    amounts = F.when(kept, F.col("Amount"))
    wide = A.pivot_fixed(money_spans(t), ["DocID"], "Block", ["USD", "non-USD"], {"N": F.count_if(kept), "Max": F.round(F.max(amounts), 4), "Median": F.round(F.median(amounts), 4)})
    dropped = money_spans(t).groupBy("DocID").agg(F.count_if(~kept).alias("nDropped"))
    return t.register.select("DocID").join(wide, "DocID", "left").join(dropped, "DocID", "left").fillna(0, ["USD_N", "non-USD_N", "nDropped"])


# --- Redactions ------------------------------------------------------------------------------------------

KINDS = ["RedactExplicit", "RedactSymbol", "RedactBlank", "OmitExplicit", "OmitSymbol", "RedactBare"]


@query("red_release_spans", "SELECT DocID, SpanNo, Start, Kind, Kind NOT IN ('RedactBare') AS Bracketed, starts_with(Kind, 'Redact') AS Withheld FROM spans WHERE Label = 'GPE'")
def release_marks(t: Tables) -> DataFrame:
    return t.spans.where("Label = 'GPE'").select("DocID", "SpanNo", "Start", "Kind", (F.col("Kind") != "RedactBare").alias("Bracketed"), F.col("Kind").startswith("Redact").alias("Withheld"))


@query("red_collapse", "SELECT r.DocID, " + ", ".join(f"count(*) FILTER (Kind = '{k}') AS {k}_n" for k in KINDS) + ", count(s.DocID) AS nMarks, round(1000.0 * count(*) FILTER (Kind <> 'RedactBare') / greatest(r.nWords, 1), 6) AS RedactRatio FROM register r LEFT JOIN (SELECT * FROM spans WHERE Label = 'GPE') s USING (DocID) GROUP BY r.DocID, r.nWords")
def collapse_marks(t: Tables) -> DataFrame:
    marks = t.spans.where("Label = 'GPE'")
    wide = A.pivot_fixed(marks, ["DocID"], "Kind", KINDS, {"n": F.count(F.lit(1))}, 0)
    total = marks.groupBy("DocID").agg(F.count("*").alias("nMarks"), F.count_if(F.col("Kind") != "RedactBare").alias("b"))
    out = t.register.select("DocID", "nWords").join(wide, "DocID", "left").join(total, "DocID", "left").fillna(0)
    return out.withColumn("RedactRatio", F.round(F.col("b") * 1000 / F.greatest("nWords", F.lit(1)), 6)).drop("nWords", "b")


@query("red_contrast", "SELECT w AS Cell, Kind, count(*) AS nSpans, count(DISTINCT DocID) AS nDocs, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY w), 6) AS Share FROM (SELECT 'with bare' AS w, * FROM spans WHERE Label = 'GPE' UNION ALL SELECT 'without bare', * FROM spans WHERE Label = 'GPE' AND Kind <> 'RedactBare') q GROUP BY 1, 2")
def contrast_marks(t: Tables) -> DataFrame:
    cells = F.when(F.col("Kind") == "RedactBare", F.array(F.lit("with bare"))).otherwise(F.array(F.lit("with bare"), F.lit("without bare")))
    out = t.spans.where("Label = 'GPE'").withColumn("Cell", F.explode(cells)).groupBy("Cell", "Kind").agg(F.count("*").alias("nSpans"), F.countDistinct("DocID").alias("nDocs"))
    return out.withColumn("Share", F.round(F.col("nSpans") / F.sum("nSpans").over(Window.partitionBy("Cell")), 6))


@query("red_read_heavy", "SELECT DocID, count(*) AS nMarks FROM spans WHERE Label = 'GPE' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def heavy(t: Tables) -> DataFrame:
    return t.spans.where("Label = 'GPE'").groupBy("DocID").agg(F.count("*").alias("nMarks")).orderBy(F.desc("nMarks"), "DocID").limit(10)


# --- Dates: a cascade from spans to a start, an end and a duration ------------------------------------------

_DATES = """
    WITH d AS (SELECT s.DocID, s.DateValue, r.DateFiled, CAST(s.DateValue - r.DateFiled AS INT) AS Gap, s.Status = 'F' AS Cued FROM spans s JOIN register r USING (DocID) WHERE Label = 'DATE'),
    t AS (SELECT DocID, CASE WHEN Start % 6 = 0 THEN NULL ELSE round(CAST(Start % 40 AS DOUBLE) / 2, 1) END AS Years FROM spans WHERE Label = 'MONEY'),
    s AS (SELECT DocID, max(DateValue) FILTER (Gap <= 0) AS Past, max(DateValue) FILTER (Gap > 0 AND Cued) AS CuedEnd, max(DateValue) FILTER (Gap > 0) AS Future FROM d GROUP BY 1), l AS (SELECT DocID, max(Years) AS Longest, count(*) FILTER (Years IS NULL) > 0 AS HasOpen FROM t GROUP BY 1),
    c AS (SELECT r.DocID, coalesce(Past, r.DateFiled) AS DateStart, CASE WHEN Past IS NULL THEN 'filed' ELSE 'span' END AS StartFrom, CASE WHEN Longest IS NOT NULL THEN 'term' WHEN HasOpen THEN 'open' WHEN CuedEnd IS NOT NULL THEN 'cued' WHEN Future IS NOT NULL THEN 'future' ELSE 'none' END AS EndFrom, Longest, CuedEnd, Future FROM register r LEFT JOIN s USING (DocID) LEFT JOIN l USING (DocID)),
    e AS (SELECT *, CASE EndFrom WHEN 'term' THEN CAST(DateStart + CAST(round(Longest * 365.25) AS INT) AS DATE) WHEN 'cued' THEN CuedEnd WHEN 'future' THEN Future END AS DateStop FROM c),
    f AS (SELECT *, round(CAST(DateStop - DateStart AS INT) / 365.25, 6) AS Duration FROM e), dur AS (SELECT DocID, DateStart, StartFrom, DateStop, EndFrom, CASE WHEN Duration BETWEEN 0 AND 15 THEN Duration END AS Duration, CASE WHEN Duration < 0 THEN 'negative' WHEN Duration > 15 THEN 'too long' END AS Dropped FROM f)"""


def durations(t: Tables, cap: float = 15.0) -> DataFrame:
    """Start: the latest date up to filing, else filing. End: the longest closed term, an open one, the latest cued
    future date, the latest future date. Durations below zero or above ``cap`` years are dropped, with the reason."""
    dates = t.spans.where("Label = 'DATE'").join(t.register.select("DocID", "DateFiled"), "DocID").withColumn("Gap", F.datediff("DateValue", "DateFiled"))
    latest = lambda c: F.max(F.when(F.expr(c), F.col("DateValue")))
    picked = dates.groupBy("DocID").agg(latest("Gap <= 0").alias("Past"), latest("Gap > 0 and Status = 'F'").alias("CuedEnd"), latest("Gap > 0").alias("Future"))
    years = F.when(F.col("Start") % 6 != 0, F.round(F.col("Start") % 40 / 2, 1))
    terms = t.spans.where("Label = 'MONEY'").groupBy("DocID").agg(F.max(years).alias("Longest"), (F.count_if(years.isNull()) > 0).alias("HasOpen"))
    out = t.register.select("DocID", "DateFiled").join(picked, "DocID", "left").join(terms, "DocID", "left")
    out = out.withColumn("DateStart", F.coalesce("Past", "DateFiled")).withColumn("StartFrom", F.when(F.col("Past").isNull(), "filed").otherwise("span"))
    out = out.withColumn("EndFrom", F.when(F.col("Longest").isNotNull(), "term").when(F.col("HasOpen"), "open").when(F.col("CuedEnd").isNotNull(), "cued").when(F.col("Future").isNotNull(), "future").otherwise("none"))
    out = out.withColumn("DateStop", F.when(F.col("EndFrom") == "term", F.date_add("DateStart", F.round(F.col("Longest") * 365.25).cast("int"))).when(F.col("EndFrom") == "cued", F.col("CuedEnd")).when(F.col("EndFrom") == "future", F.col("Future")))
    d = F.round(F.datediff("DateStop", "DateStart") / 365.25, 6)
    return out.select("DocID", "DateStart", "StartFrom", "DateStop", "EndFrom", F.when(d.between(0, cap), d).alias("Duration"), F.when(d < 0, "negative").when(d > cap, "too long").alias("Dropped"))


@query("dte_collapse", _DATES + " SELECT * FROM dur")
def collapse_dates(t: Tables) -> DataFrame:
    return durations(t)


@query("dte_row", _DATES + " SELECT round(CAST(count(Duration) AS DOUBLE) / count(*), 6) AS Kept, round(avg(Duration), 6) AS Mean, round(median(Duration), 6) AS Mid, round(stddev_samp(Duration), 6) AS Sd FROM dur")
def duration_row(t: Tables) -> DataFrame:
    return durations(t).agg(F.round(F.count("Duration") / F.count("*"), 6).alias("Kept"), F.round(F.avg("Duration"), 6).alias("Mean"), F.round(F.median("Duration"), 6).alias("Mid"), F.round(F.stddev_samp("Duration"), 6).alias("Sd"))


@query("dte_sweep", _DATES + " SELECT CAST(cap AS DOUBLE) AS Cap, count(*) FILTER (d BETWEEN 0 AND cap) AS nKept, round(avg(d) FILTER (d BETWEEN 0 AND cap), 6) AS Mean FROM (SELECT Duration AS d FROM f) q CROSS JOIN (VALUES (5), (10), (20)) c(cap) GROUP BY 1")
def duration_sweep(t: Tables) -> DataFrame:
    caps = t.spark.createDataFrame([(5.0,), (10.0,), (20.0,)], "Cap double")
    inside = F.col("Duration").between(0, F.col("Cap"))
    return durations(t, 1e9).crossJoin(F.broadcast(caps)).groupBy("Cap").agg(F.count_if(inside).alias("nKept"), F.round(F.avg(F.when(inside, F.col("Duration"))), 6).alias("Mean"))


@query("dte_table_source", _DATES + " SELECT CASE WHEN grouping(Class) = 1 THEN 'All documents' ELSE Class END AS Class, count(*) AS n, round(avg(CASE WHEN EndFrom = 'term' THEN 1.0 ELSE 0.0 END), 6) AS pTerm, round(avg(CASE WHEN EndFrom = 'cued' THEN 1.0 ELSE 0.0 END), 6) AS pCued, round(avg(CASE WHEN EndFrom = 'none' THEN 1.0 ELSE 0.0 END), 6) AS pNone FROM dur JOIN register USING (DocID) GROUP BY GROUPING SETS ((Class), ())")
def source_table(t: Tables) -> DataFrame:
    met = durations(t).join(t.register.select("DocID", "Class"), "DocID")
    share = lambda v: F.round(F.avg((F.col("EndFrom") == v).cast("double")), 6)
    return A.with_all_row(met, "Class", [F.count("*").alias("n"), share("term").alias("pTerm"), share("cued").alias("pCued"), share("none").alias("pNone")])


@query("dte_release_terms", "WITH c AS (SELECT DocID, SpanNo, Start, upper(CASE Start % 5 WHEN 0 THEN 'shall survive for' WHEN 1 THEN 'may cure within' WHEN 2 THEN 'upon notice of' WHEN 3 THEN 'the initial term of' ELSE 'after' END) AS Cue FROM spans WHERE Label = 'DATE') SELECT DocID, SpanNo, Start, CASE WHEN regexp_matches(Cue, 'SURVIV') THEN 'survival' WHEN regexp_matches(Cue, 'CURE') THEN 'cure' WHEN regexp_matches(Cue, 'NOTICE') THEN 'notice' WHEN regexp_matches(Cue, 'TERM') THEN 'term' ELSE 'other' END AS PeriodKind, nullif(regexp_extract(Cue, 'SURVIV|CURE|NOTICE|TERM'), '') AS PeriodCue FROM c")
def release_terms(t: Tables) -> DataFrame:
    cue = F.upper(F.expr("CASE Start % 5 WHEN 0 THEN 'shall survive for' WHEN 1 THEN 'may cure within' WHEN 2 THEN 'upon notice of' WHEN 3 THEN 'the initial term of' ELSE 'after' END"))
    kind = F.when(cue.rlike("SURVIV"), "survival").when(cue.rlike("CURE"), "cure").when(cue.rlike("NOTICE"), "notice").when(cue.rlike("TERM"), "term").otherwise("other")
    return t.spans.where("Label = 'DATE'").select("DocID", "SpanNo", "Start", kind.alias("PeriodKind"), F.nullif(F.regexp_extract(cue, "SURVIV|CURE|NOTICE|TERM", 0), F.lit("")).alias("PeriodCue"))


@query("dte_terms_collapse", "WITH t AS (SELECT DocID, Start, SpanNo, CASE WHEN Start % 6 = 0 THEN NULL ELSE CAST(Start % 40 AS DOUBLE) / 2 END AS Years FROM spans WHERE Label = 'MONEY'), c AS (SELECT DocID, max(Years) AS Longest, arg_min(Years, (Start, SpanNo)) AS First, count(*) AS nClosed FROM t WHERE Years IS NOT NULL GROUP BY 1), o AS (SELECT DocID, count(*) AS nOpen FROM t WHERE Years IS NULL GROUP BY 1) SELECT coalesce(c.DocID, o.DocID) AS DocID, Longest, First, coalesce(nClosed, 0) AS nClosed, coalesce(nOpen, 0) AS nOpen, coalesce(Longest <> First, false) AS Disagree FROM c FULL JOIN o ON c.DocID = o.DocID")
def collapse_terms(t: Tables) -> DataFrame:
    terms = t.spans.where("Label = 'MONEY'").withColumn("Years", F.when(F.col("Start") % 6 != 0, F.col("Start") % 40 / 2))
    closed = terms.where("Years is not null").groupBy("DocID").agg(F.max("Years").alias("Longest"), F.min_by("Years", F.struct("Start", "SpanNo")).alias("First"), F.count("*").alias("nClosed"))
    unbounded = terms.where("Years is null").groupBy("DocID").agg(F.count("*").alias("nOpen"))
    return closed.join(unbounded, "DocID", "full").fillna(0, ["nClosed", "nOpen"]).withColumn("Disagree", F.coalesce(F.col("Longest") != F.col("First"), F.lit(False)))


# --- Places ------------------------------------------------------------------------------------------------


@query("geo_collapse", "WITH a AS (SELECT s.DocID, s.PartyKey, s.Start, abs(s.Start - 450) AS Dist, s.Kind AS Place FROM spans s WHERE Label = 'GPE') SELECT DocID, PartyKey, Place, Dist FROM a QUALIFY row_number() OVER (PARTITION BY DocID, PartyKey ORDER BY Dist, Start, Place) = 1")
def collapse_places(t: Tables) -> DataFrame:
    near = t.spans.where("Label = 'GPE'").withColumn("Dist", F.abs(F.col("Start") - 450))
    return first_per(near, ["DocID", "PartyKey"], F.col("Dist"), F.col("Start"), F.col("Kind")).select("DocID", "PartyKey", F.col("Kind").alias("Place"), "Dist")


@query("geo_doc_facts", "SELECT r.DocID, count(DISTINCT Kind) AS nPlaces, count(DISTINCT CASE WHEN Status = 'O' THEN Kind END) AS nOutsideLaw, count(DISTINCT CASE WHEN PartyRole = 'counterparty' THEN Kind END) AS nCounter FROM register r LEFT JOIN (SELECT * FROM spans WHERE Label = 'GPE') s USING (DocID) GROUP BY 1")
def place_facts(t: Tables) -> DataFrame:
    met = t.register.select("DocID").join(t.spans.where("Label = 'GPE'"), "DocID", "left")
    distinct = lambda c=None: F.countDistinct(F.when(F.expr(c), F.col("Kind")) if c else F.col("Kind"))
    return met.groupBy("DocID").agg(distinct().alias("nPlaces"), distinct("Status = 'O'").alias("nOutsideLaw"), distinct("PartyRole = 'counterparty'").alias("nCounter"))


@query("geo_edgar_check", "SELECT c_custkey AS CIK, bool_or(contains(upper('12 Main Street, ' || n_name), upper(s.Place))) AS AnyHit FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT r.CIK, n2.n_name AS Place FROM register r JOIN nation n2 ON n2.n_nationkey = r.DocID % 25) s ON s.CIK = c_custkey GROUP BY 1")
def edgar_check(t: Tables) -> DataFrame:
    places = t.register.join(t.nation, F.col("n_nationkey") == F.col("DocID") % 25).select("CIK", F.col("n_name").alias("Place"))
    address = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("CIK"), F.upper(F.concat(F.lit("12 Main Street, "), "n_name")).alias("Address"))
    return address.join(places, "CIK").groupBy("CIK").agg(F.bool_or(F.contains("Address", F.upper("Place"))).alias("AnyHit"))


_GEO_ALL = "SELECT CASE WHEN grouping(PartyRole) = 1 THEN 'All documents' ELSE PartyRole END AS PartyRole, count(*) AS n, count(DISTINCT DocID) AS nDocs, round(avg(CASE WHEN Status = 'O' THEN 1.0 ELSE 0.0 END), 6) AS pResolved FROM spans WHERE Label = 'GPE' GROUP BY GROUPING SETS ((PartyRole), ())"


@query("geo_table_resolve", _GEO_ALL)
def resolve_table(t: Tables) -> DataFrame:
    return A.with_all_row(t.spans.where("Label = 'GPE'"), "PartyRole", [F.count("*").alias("n"), F.countDistinct("DocID").alias("nDocs"), F.round(F.avg((F.col("Status") == "O").cast("double")), 6).alias("pResolved")])


@query("geo_table_law_top", "SELECT Place AS Jurisdiction, count(*) AS n FROM (SELECT regexp_extract(Text, 'State of (New York|Delaware)', 1) AS Place FROM contracts) q GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def law_top(t: Tables) -> DataFrame:
    rows = S.extract(t.contracts, ["LAW"]).where("Start is not null")
    return rows.groupBy(F.regexp_extract("Span", "State of (.*)$", 1).alias("Jurisdiction")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "Jurisdiction").limit(15)


@query("export_ORG", "SELECT DocID, count(*) FILTER (PartyRole = 'registrant') AS registrant_n, count(*) FILTER (PartyRole = 'cofiler') AS cofiler_n, count(*) FILTER (PartyRole = 'counterparty') AS counterparty_n FROM (SELECT DISTINCT DocID, PartyKey, PartyRole FROM spans WHERE Label = 'ORG') q GROUP BY 1")
def export_parties(t: Tables) -> DataFrame:
    parties = t.spans.where("Label = 'ORG'").select("DocID", "PartyKey", "PartyRole").distinct()
    return A.pivot_fixed(parties, ["DocID"], "PartyRole", ["registrant", "cofiler", "counterparty"], {"n": F.count(F.lit(1))}, 0)


@query("export_GPE", "SELECT DocID, count(DISTINCT Kind) FILTER (PartyRole = 'registrant') AS registrant_n, count(DISTINCT Kind) FILTER (PartyRole = 'counterparty') AS counterparty_n FROM spans WHERE Label = 'GPE' GROUP BY 1")
def export_places_wide(t: Tables) -> DataFrame:
    return A.pivot_fixed(t.spans.where("Label = 'GPE'"), ["DocID"], "PartyRole", ["registrant", "counterparty"], {"n": F.countDistinct("Kind")}, 0)


@query("export_LAW", "WITH d AS (SELECT DocID, Kind, min(Start) AS s FROM spans WHERE Label = 'GPE' GROUP BY 1, 2) SELECT DocID, count(*) AS nLaws, string_agg(Kind, '|' ORDER BY s, Kind) AS Laws, string_agg(CAST(s AS STRING), '|' ORDER BY s, Kind) AS Starts FROM d GROUP BY 1")
def export_laws(t: Tables) -> DataFrame:
    first = t.spans.where("Label = 'GPE'").groupBy("DocID", "Kind").agg(F.min("Start").alias("s"))
    both = F.sort_array(F.collect_list(F.struct("s", "Kind")))
    out = first.groupBy("DocID").agg(F.count("*").alias("nLaws"), both.alias("x"))
    return out.select("DocID", "nLaws", F.array_join(F.transform("x", lambda e: e["Kind"]), "|").alias("Laws"), F.array_join(F.transform("x", lambda e: e["s"].cast("string")), "|").alias("Starts"))


@query("export_places", "SELECT DocID, PartyKey, CASE min(CASE PartyRole WHEN 'registrant' THEN 1 WHEN 'cofiler' THEN 2 ELSE 3 END) WHEN 1 THEN 'registrant' WHEN 2 THEN 'cofiler' ELSE 'counterparty' END AS Role, count(*) AS n FROM spans WHERE Label = 'GPE' GROUP BY 1, 2")
def export_place_roles(t: Tables) -> DataFrame:
    roles = F.array(F.lit("registrant"), F.lit("cofiler"), F.lit("counterparty"))
    return t.spans.where("Label = 'GPE'").groupBy("DocID", "PartyKey").agg(F.element_at(roles, F.min(F.array_position(roles, F.col("PartyRole"))).cast("int")).alias("Role"), F.count("*").alias("n"))


@query("export_summary", "SELECT HashIndex, DocID, nChars FROM register QUALIFY row_number() OVER (PARTITION BY HashIndex ORDER BY (nWords >= 200) DESC, nChars DESC, DocID) = 1")
def export_summary(t: Tables) -> DataFrame:
    return first_per(t.register, ["HashIndex"], (F.col("nWords") >= 200).desc(), F.desc("nChars"), F.col("DocID")).select("HashIndex", "DocID", "nChars")
