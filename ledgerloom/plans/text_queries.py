"""Queries of the scalar functions and of predicates and flags of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import spread
from ..operators import places as G
from ..operators.aggregates import count_where
from ..sources.tables import Tables
from .join_queries import KEY_SQL as _KEY
from .registry import query

_NAMES = "SELECT DocID, CASE DocID % 5 WHEN 0 THEN 'The Acme & Sons Holdings, Inc.' WHEN 1 THEN 'WILLIAMS PARTNERS L.P.' WHEN 2 THEN 'By and between ' || Class || ' TRADING CO LTD' WHEN 3 THEN 'UGI CORP /PA/' ELSE 'Firm ' || CIK || ' (formerly: Old Firm) \\DE\\' END AS Name FROM register"


def _names(t: Tables) -> DataFrame:
    name = F.expr("CASE DocID % 5 WHEN 0 THEN 'The Acme & Sons Holdings, Inc.' WHEN 1 THEN 'WILLIAMS PARTNERS L.P.' WHEN 2 THEN concat('By and between ', Class, ' TRADING CO LTD') WHEN 3 THEN 'UGI CORP /PA/' ELSE concat('Firm ', CIK, ' (formerly: Old Firm) \\\\DE\\\\') END")
    return t.register.select("DocID", name.alias("Name"))


@query("ent_norm_key", f"WITH n AS ({_NAMES}) SELECT DocID, Name, nullif({_KEY.replace('NAME', 'Name')}, '') AS Key FROM n")
def norm_key(t: Tables) -> DataFrame:
    return _names(t).withColumn("Key", T.norm_key(F.col("Name")))


@query("ent_strip_conformed", f"WITH n AS ({_NAMES}) SELECT DocID, trim(regexp_replace(regexp_replace(Name, '(?i)\\((FORMERLY|FKA)[^)]*\\)', '', 'g'), '\\s*[/\\\\][A-Za-z ]{{2,3}}[/\\\\]\\s*$', '')) AS Plain FROM n")
def strip_conformed(t: Tables) -> DataFrame:
    return _names(t).select("DocID", T.strip_conformed(F.col("Name")).alias("Plain"))


@query("ent_shared_tokens", "WITH p AS (SELECT a.p_partkey AS A, b.p_partkey AS B, string_split(a.p_name, ' ') AS x, string_split(b.p_name, ' ') AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey = a.p_partkey + 1) , pos AS (SELECT A, B, x, y, unnest(range(1, least(len(x), len(y)) + 1)) AS i FROM p), bad AS (SELECT A, B, min(i) AS i FROM pos WHERE x[i] <> y[i] GROUP BY 1, 2) SELECT p.A, p.B, CAST(coalesce(bad.i - 1, least(len(x), len(y))) AS INT) AS Shared FROM p LEFT JOIN bad ON p.A = bad.A AND p.B = bad.B")
def shared_tokens(t: Tables) -> DataFrame:
    a = t.part.select(F.col("p_partkey").alias("A"), "p_brand", F.col("p_name").alias("x"))
    b = t.part.select((F.col("p_partkey") - 1).alias("A"), F.col("p_partkey").alias("B"), "p_brand", F.col("p_name").alias("y"))
    return a.join(b, ["A", "p_brand"]).select("A", "B", T.shared_tokens(F.col("x"), F.col("y")).alias("Shared"))


@query("ent_anchor_cols", "SELECT c_custkey AS CIK, upper(c_name) AS AnchorKey, replace(upper(c_name), ' ', '') AS AnchorTight, CAST(length(c_name) AS INT) AS AnchorLen, CAST(length(c_name) - length(replace(c_name, ' ', '')) + 1 AS INT) AS AnchorTok FROM customer")
def anchor_cols(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("CIK"), F.upper("c_name").alias("AnchorKey"), F.replace(F.upper("c_name"), F.lit(" "), F.lit("")).alias("AnchorTight"), F.length("c_name").alias("AnchorLen"), (F.regexp_count("c_name", F.lit(" ")) + 1).alias("AnchorTok"))


@query("ent_doc_lens", "SELECT doc_id, length(text) AS DocLen FROM documents WHERE length(text) > 0")
def doc_lens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.char_length("text").cast("bigint").alias("DocLen")).where("DocLen > 0")


@query("edg_doc_stats", "SELECT page_id, length(html) AS nChars, len(regexp_extract_all(html, '\\b[0-9]+\\b')) AS nNums, len(regexp_extract_all(upper(html), '<IMG')) AS nImg, strpos(upper(html), '<HEAD') > 0 AS HasHead, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS Title FROM pages")
def doc_stats(t: Tables) -> DataFrame:
    up = F.upper("html")
    return t.pages.select("page_id", F.length("html").cast("bigint").alias("nChars"), F.regexp_count("html", F.lit("\\b[0-9]+\\b")).cast("bigint").alias("nNums"), F.regexp_count(up, F.lit("<IMG")).cast("bigint").alias("nImg"), F.contains(up, F.lit("<HEAD")).alias("HasHead"), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("Title"))


STOP = ["the", "of", "and", "to", "in", "a", "is", "der", "die", "und", "le", "la", "de", "que", "y"]
_LIST = ", ".join(f"'{w}'" for w in STOP)


@query("edg_doc_stopwords", f"SELECT doc_id, len(string_split(text, ' ')) AS nToken, round(CAST(len(list_filter(string_split(lower(text), ' '), lambda w: w IN ({_LIST}))) AS DOUBLE) / len(string_split(text, ' ')) * 100, 6) AS pStop FROM documents")
def doc_stopwords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.split("text", " ")).cast("bigint").alias("nToken"), F.round(T.stopword_share(F.col("text"), STOP), 6).alias("pStop"))


@query("edg_stopword_dict", f"SELECT DISTINCT w FROM (SELECT unnest([{_LIST}]) AS w UNION ALL SELECT unnest([{', '.join(repr(w) for w in T.DOMAIN_STOPWORDS)}])) q")
def stopword_dict(t: Tables) -> DataFrame:
    both = [t.spark.createDataFrame([(w,) for w in x], "w string") for x in (STOP, T.DOMAIN_STOPWORDS)]
    return both[0].union(both[1]).distinct()


@query("edg_doc_statistics", "SELECT DocID, CAST(greatest(nWords - 40, 0) AS BIGINT) AS nWordsAdj, round(least(CASE WHEN nWords > 0 THEN CAST(nNums AS DOUBLE) / nWords END, 1) * 100, 6) AS pNums FROM register")
def doc_statistics(t: Tables) -> DataFrame:
    return t.register.select("DocID", F.greatest(F.col("nWords") - 40, F.lit(0)).cast("bigint").alias("nWordsAdj"), F.round(F.least(F.try_divide("nNums", "nWords"), F.lit(1.0)) * 100, 6).alias("pNums"))


@query("itm_syllables", "WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_type, ' ')) AS Word FROM part) SELECT Word, CAST(greatest(len(regexp_extract_all(lower(Word), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(Word), '[^aeiouy]e$') AND len(regexp_extract_all(lower(Word), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1) AS INT) AS nSyllables FROM w")
def syllables(t: Tables) -> DataFrame:
    found = t.part.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("Word")).distinct()
    return found.withColumn("nSyllables", T.syllables(F.col("Word")))


_SYL = "greatest(len(regexp_extract_all(lower(#), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(#), '[^aeiouy]e$') AND len(regexp_extract_all(lower(#), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)".replace("#", "regexp_replace(w, '[^A-Za-z]', '', 'g')")


@query("itm_summary_measures", f"WITH s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9.,$%]+$')) AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, greatest(len(regexp_extract_all(text, '[.!?](\\s|$)')), 1) AS s, len(list_filter(ws, lambda w: {_SYL} >= 3)) AS x FROM s) SELECT doc_id, CASE WHEN n > 0 THEN round(0.4 * (CAST(n AS DOUBLE) / s + 100 * CAST(x AS DOUBLE) / n), 5) END AS Fog FROM c")
def summary_measures(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.round(T.fog(F.col("text")), 5).alias("Fog"))


@query("itm_tetragrams", "WITH w AS (SELECT p_partkey, string_split(p_name || ' of ' || p_brand || ' ' || p_type, ' ') AS ws FROM part) SELECT p_partkey, unnest([array_to_string(ws[i:i + 3], ' ') FOR i IN generate_series(1, len(ws) - 3)]) AS Gram FROM w")
def tetragrams(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(T.ngrams(F.split(F.concat_ws(" ", "p_name", F.lit("of"), "p_brand", "p_type"), " "), 4)).alias("Gram"))


@query("itm_summary_dates", "WITH d AS (SELECT DocID, list_distinct(regexp_extract_all(Text, '(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}')) AS x FROM contracts) SELECT DocID, len(x) AS nDates, CAST(try_strptime(x[1], '%B %-d, %Y') AS DATE) AS FirstDate, len(x) = 1 AS Single FROM d")
def summary_dates(t: Tables) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("Text", F.lit("(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}"), F.lit(0)))
    return t.contracts.select("DocID", found.alias("x")).select("DocID", F.size("x").cast("bigint").alias("nDates"), F.try_to_date(F.get("x", F.lit(0)), "MMMM d, yyyy").alias("FirstDate"), (F.size("x") == 1).alias("Single"))


@query("itm_unspace", "SELECT page_id, md5(regexp_replace(html, '(&nbsp;|&#160;|&#xA0;|[\\p{Zs}\\x{200B}\\x{FEFF}])+', ' ', 'g')) AS Digest FROM pages")
def unspace(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(T.unspace(F.col("html"))).alias("Digest"))


@query("itm_strip_heading", "WITH i AS (SELECT HashIndex, ItemOrder, 'Item ' || ItemCode || ': Entry into an agreement. On ' || FilingDate AS Line FROM items) SELECT HashIndex, ItemOrder, regexp_replace(Line, '^Item\\s+[0-9.]+\\s*:\\s*[A-Za-z ]+\\.\\s*', '') AS Body FROM i")
def strip_heading(t: Tables) -> DataFrame:
    line = F.concat(F.lit("Item "), "ItemCode", F.lit(": Entry into an agreement. On "), "FilingDate")
    return t.items.select("HashIndex", "ItemOrder", F.regexp_replace(line, "^Item\\s+[0-9.]+\\s*:\\s*[A-Za-z ]+\\.\\s*", "").alias("Body"))


@query("itx_parse_items", "WITH i AS (SELECT HashIndex, ItemOrder, CASE WHEN ItemOrder % 4 = 0 THEN 'Other matter' ELSE 'Item ' || ItemCode || ': Entry' END AS Line FROM items) SELECT HashIndex, ItemOrder, nullif(regexp_extract(Line, '^Item\\s+(\\d+(\\.\\d+)?)\\s*:', 1), '') AS Code, coalesce(strpos(nullif(regexp_extract(Line, '^Item\\s+(\\d+(\\.\\d+)?)\\s*:', 1), ''), '.') > 0, false) AS Dotted FROM i")
def parse_items(t: Tables) -> DataFrame:
    line = F.when(F.col("ItemOrder") % 4 == 0, "Other matter").otherwise(F.concat(F.lit("Item "), "ItemCode", F.lit(": Entry")))
    return t.items.select("HashIndex", "ItemOrder", T.item_code(line).alias("Code")).withColumn("Dotted", F.coalesce(F.contains("Code", F.lit(".")), F.lit(False)))


@query("itm_items_long", "WITH l AS (SELECT HashIndex, string_agg('Item ' || ItemCode, chr(10) ORDER BY ItemOrder, ItemCode) AS Items FROM items GROUP BY 1), u AS (SELECT HashIndex, unnest(string_split(Items, chr(10))) AS Line, generate_subscripts(string_split(Items, chr(10)), 1) AS ItemOrder FROM l) SELECT HashIndex, CAST(ItemOrder AS INT) AS ItemOrder, substr(Line, 6) AS ItemCode FROM u")
def items_long(t: Tables) -> DataFrame:
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ItemOrder", "ItemCode"))), lambda x: F.concat(F.lit("Item "), x["ItemCode"])), "\n")
    return t.items.groupBy("HashIndex").agg(lines.alias("Items")).select("HashIndex", F.posexplode(F.split("Items", "\n")).alias("i", "Line")).select("HashIndex", (F.col("i") + 1).alias("ItemOrder"), F.substr("Line", F.lit(6)).alias("ItemCode"))


@query("itm_dedup_landing", "WITH d AS (SELECT DISTINCT DocID, Status FROM spans) SELECT DocID, min(Status) AS Status FROM d GROUP BY 1 HAVING count(*) = 1")
def dedup_landing(t: Tables) -> DataFrame:
    return t.spans.select("DocID", "Status").distinct().groupBy("DocID").agg(F.min("Status").alias("Status"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("cto_exhibit_number", "WITH e AS (SELECT DocID, CASE DocID % 4 WHEN 0 THEN 'EX-010.0' || (DocID % 9) WHEN 1 THEN ' ex 99.' || (DocID % 7) WHEN 2 THEN 'Exhibit 4.0' || (DocID % 5) ELSE '0' || (1 + DocID % 9) END AS Raw FROM register) SELECT DocID, regexp_replace(regexp_replace(upper(trim(Raw)), '^EX(HIBIT)?[-. ]*', ''), '(^|\\.)0+([0-9])', '\\1\\2', 'g') AS ExhibitNo FROM e")
def exhibit_number(t: Tables) -> DataFrame:
    raw = F.expr("CASE DocID % 4 WHEN 0 THEN concat('EX-010.0', DocID % 9) WHEN 1 THEN concat(' ex 99.', DocID % 7) WHEN 2 THEN concat('Exhibit 4.0', DocID % 5) ELSE concat('0', 1 + DocID % 9) END")
    return t.register.select("DocID", T.exhibit_number(raw).alias("ExhibitNo"))


@query("cto_parse_date", "SELECT DocID, CAST(try_strptime(CASE WHEN DocID % 6 = 0 THEN 'February 30, 2011' ELSE strftime(DateFiled, '%B %-d, %Y') END, '%B %-d, %Y') AS DATE) AS Parsed FROM register")
def parse_date(t: Tables) -> DataFrame:
    raw = F.when(F.col("DocID") % 6 == 0, "February 30, 2011").otherwise(F.date_format("DateFiled", "MMMM d, yyyy"))
    return t.register.select("DocID", F.try_to_date(raw, "MMMM d, yyyy").alias("Parsed"))


@query("cto_guard_release", "SELECT DocID, CASE WHEN ReleaseDate <= DateFiled + 30 * 365 THEN ReleaseDate END AS ReleaseDate, ReleaseDate > DateFiled + 30 * 365 AS Guarded FROM (SELECT DocID, DateFiled, CAST(DateFiled + CAST(DocID % 20000 AS INT) AS DATE) AS ReleaseDate FROM register) q")
def guard_release(t: Tables) -> DataFrame:
    released = t.register.select("DocID", "DateFiled", F.expr("date_add(DateFiled, int(DocID % 20000))").alias("ReleaseDate"))
    late = F.col("ReleaseDate") > F.date_add("DateFiled", 30 * 365)
    return released.select("DocID", F.when(~late, F.col("ReleaseDate")).alias("ReleaseDate"), late.alias("Guarded"))


@query("cto_filing_hop", "SELECT count(*) AS nRefs, count(*) FILTER (nWords > 500) AS nLinked, count(*) FILTER (nWords <= 500 AND gvkey IS NULL) AS nNoFiling FROM register")
def filing_hop(t: Tables) -> DataFrame:
    return t.register.agg(F.count("*").alias("nRefs"), *count_where(nLinked="nWords > 500", nNoFiling="nWords <= 500 and gvkey is null"))


@query("cto_link_by_year", "SELECT Year, count(*) AS nRefs, count(*) FILTER (nWords > 500) AS nLinked, round(CAST(count(*) FILTER (nWords > 500) AS DOUBLE) / count(*), 6) AS Share FROM register GROUP BY 1")
def link_by_year(t: Tables) -> DataFrame:
    return t.register.groupBy("Year").agg(F.count("*").alias("nRefs"), F.count_if(F.col("nWords") > 500).alias("nLinked"), F.round(F.count_if(F.col("nWords") > 500) / F.count("*"), 6).alias("Share"))


@query("truncate_words", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:20], ' ') AS Head FROM documents")
def truncate_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncate_words(F.col("text"), 20).alias("Head"))


@query("llm_ctx_for", "SELECT DocID, CAST(least(greatest(pow(2.0, ceil(log2((nChars + 1) * 7 * 1.25))), 8192), 32768) AS BIGINT) AS Context FROM register")
def context_for(t: Tables) -> DataFrame:
    return t.register.select("DocID", T.context_tokens((F.col("nChars") + 1) * 7).alias("Context"))


@query("oa_format_number", "SELECT DocID, format('{:,}', nChars) AS AsCount, format('{:,.3f}', pStopShort / 64) AS AsShare FROM register")
def format_number(t: Tables) -> DataFrame:
    return t.register.select("DocID", T.number_text(F.col("nChars"), "count").alias("AsCount"), T.number_text(F.col("pStopShort") / 64, "prop3").alias("AsShare"))


@query("edg_select_index", "SELECT DISTINCT HashIndex FROM register WHERE FormType IN ('F', 'O') AND Year <= 1997")
def select_index(t: Tables) -> DataFrame:
    return t.register.where(F.col("FormType").isin("F", "O") & (F.col("Year") <= 1997)).select("HashIndex").distinct()


@query("edg_links_with_ext", "SELECT page_id, regexp_extract(url, '[.]([A-Za-z0-9]+)$', 1) AS Ext FROM pages WHERE regexp_matches(url, '[.][A-Za-z0-9]+$') AND page_id IN (SELECT doc_id FROM documents)")
def links_with_ext(t: Tables) -> DataFrame:
    found = t.pages.where(F.col("url").rlike("[.][A-Za-z0-9]+$")).join(t.documents, F.col("page_id") == F.col("doc_id"), "left_semi")
    return found.select("page_id", F.regexp_extract("url", "[.]([A-Za-z0-9]+)$", 1).alias("Ext"))


@query("edg_hash_with_item", "SELECT DISTINCT HashIndex FROM items WHERE ItemCode LIKE '%.01'")
def hash_with_item(t: Tables) -> DataFrame:
    return t.items.where(F.col("ItemCode").endswith(".01")).select("HashIndex").distinct()


@query("edg_doc_group", "SELECT DocID, CASE WHEN starts_with(DocType, 'Exhibit10') THEN 'Exhibit10' WHEN starts_with(DocType, 'CTO') THEN 'CTO' ELSE '8-K' END AS Grp FROM register")
def doc_group(t: Tables) -> DataFrame:
    return t.register.select("DocID", F.when(F.col("DocType").startswith("Exhibit10"), "Exhibit10").when(F.col("DocType").startswith("CTO"), "CTO").otherwise("8-K").alias("Grp"))


@query("reg_sample_flags", "WITH s AS (SELECT DocID, (DocID % 7) || ' Step' AS D FROM register) SELECT DocID, CAST(regexp_extract(D, '^[0-9]+') AS INT) AS Code, CAST(regexp_extract(D, '^[0-9]+') AS INT) >= 3 AS DescSample, CAST(regexp_extract(D, '^[0-9]+') AS INT) = 6 AS EstiSample FROM s")
def sample_flags(t: Tables) -> DataFrame:
    code = F.regexp_extract(F.concat(F.col("DocID") % 7, F.lit(" Step")), "^([0-9]+)", 1).cast("int")
    return t.register.select("DocID", code.alias("Code"), (code >= 3).alias("DescSample"), (code == 6).alias("EstiSample"))


@query("reg_derive", "SELECT page_id, coalesce(regexp_extract(url, '[.]([A-Za-z0-9]+)$', 1), '') AS DocExt, length(url) AS UrlLen FROM pages")
def derive(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.coalesce(F.regexp_extract("url", "[.]([A-Za-z0-9]+)$", 1), F.lit("")).alias("DocExt"), F.length("url").cast("bigint").alias("UrlLen"))


@query("reg_shape", "SELECT DocID, CIK, DocType, DateFiled, nWords FROM register")
def shape(t: Tables) -> DataFrame:
    return t.register.select("DocID", "CIK", "DocType", "DateFiled", "nWords")


@query("exp_fold_unclassified", "SELECT DocID, CASE WHEN gvkey IS NULL AND nWords >= 2 THEN 2 ELSE 6 END AS Step, CASE WHEN gvkey IS NULL AND nWords >= 2 THEN 'unclassified' END AS RemClass FROM register")
def fold_unclassified(t: Tables) -> DataFrame:
    gone = F.col("gvkey").isNull() & (F.col("nWords") >= 2)
    return t.register.select("DocID", F.when(gone, 2).otherwise(6).alias("Step"), F.when(gone, "unclassified").alias("RemClass"))


@query("txt_window", "SELECT DocID, Year FROM register WHERE Year BETWEEN 1994 AND 1996")
def year_window(t: Tables) -> DataFrame:
    return t.register.where(F.col("Year").between(1994, 1996)).select("DocID", "Year")


@query("txt_period", "SELECT r.DocID, p.Period FROM register r JOIN (VALUES (1993, 'early'), (1994, 'early'), (1996, 'late'), (1997, 'late')) p(Year, Period) USING (Year)")
def period(t: Tables) -> DataFrame:
    periods = t.spark.createDataFrame([(1993, "early"), (1994, "early"), (1996, "late"), (1997, "late")], "Year int, Period string")
    return t.register.join(F.broadcast(periods), "Year").select("DocID", "Period")


@query("txt_form_group", "WITH f AS (SELECT DocID, CASE DocID % 6 WHEN 0 THEN '8-K/A' WHEN 1 THEN 'S-1' WHEN 2 THEN 'S-11' WHEN 3 THEN '10-K405' WHEN 4 THEN '10-Q' ELSE 'F-4/A' END AS Form FROM register) SELECT DocID, CASE WHEN regexp_matches(replace(Form, '/A', ''), '^8-K') THEN 'Current report' WHEN regexp_matches(replace(Form, '/A', ''), '^[SF]-[14]([^0-9]|$)') THEN 'Registration' WHEN regexp_matches(replace(Form, '/A', ''), '^10-K') THEN 'Annual' WHEN regexp_matches(replace(Form, '/A', ''), '^10-Q') THEN 'Quarterly' ELSE 'Other' END AS FormGroup FROM f")
def form_group(t: Tables) -> DataFrame:
    form = F.replace(F.expr("CASE DocID % 6 WHEN 0 THEN '8-K/A' WHEN 1 THEN 'S-1' WHEN 2 THEN 'S-11' WHEN 3 THEN '10-K405' WHEN 4 THEN '10-Q' ELSE 'F-4/A' END"), F.lit("/A"), F.lit(""))
    group = F.when(form.rlike("^8-K"), "Current report").when(form.rlike("^[SF]-[14]([^0-9]|$)"), "Registration").when(form.rlike("^10-K"), "Annual").when(form.rlike("^10-Q"), "Quarterly").otherwise("Other")
    return t.register.select("DocID", group.alias("FormGroup"))


@query("txt_sic_group", "SELECT DocID, CASE WHEN s = 6770 THEN 'Blank check' WHEN s BETWEEN 2833 AND 2836 OR s = 8731 THEN 'Pharma' WHEN s BETWEEN 6000 AND 6799 THEN 'Other finance' ELSE 'Other' END AS SicGroup FROM (SELECT DocID, CASE DocID % 5 WHEN 0 THEN 6770 WHEN 1 THEN 2834 WHEN 2 THEN 6021 WHEN 3 THEN 8731 ELSE 3711 END AS s FROM register) q")
def sic_group(t: Tables) -> DataFrame:
    sic = F.expr("CASE DocID % 5 WHEN 0 THEN 6770 WHEN 1 THEN 2834 WHEN 2 THEN 6021 WHEN 3 THEN 8731 ELSE 3711 END")
    return t.register.select("DocID", F.when(sic == 6770, "Blank check").when(sic.between(2833, 2836) | (sic == 8731), "Pharma").when(sic.between(6000, 6799), "Other finance").otherwise("Other").alias("SicGroup"))


@query("itx_era", "SELECT HashIndex, ItemOrder, CASE WHEN FilingDate < DATE '1994-01-01' THEN 'Pre' WHEN FilingDate < DATE '1995-08-23' THEN 'Transition' ELSE 'Post' END AS Era FROM items")
def era(t: Tables) -> DataFrame:
    d = F.col("FilingDate")
    return t.items.select("HashIndex", "ItemOrder", F.when(d < F.lit("1994-01-01").cast("date"), "Pre").when(d < F.lit("1995-08-23").cast("date"), "Transition").otherwise("Post").alias("Era"))


@query("red_words", "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS nWords FROM documents")
def red_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("\\S+")).cast("bigint").alias("nWords"))


_GEO = """WITH g AS (SELECT m.*, CASE WHEN l.Unit <> 'nan' THEN array_to_string(list_transform(string_split(l.Unit, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS GeoUnit,
    CASE l.Class WHEN 'US State' THEN 'State' WHEN 'US County' THEN 'County' WHEN 'US Populated Place' THEN 'City' WHEN 'Country' THEN 'Country' END AS GeoLevel,
    CASE WHEN l.NParent = 1 THEN nullif(l.State, 'nan') END AS GeoState, CASE WHEN l.NParent = 1 THEN nullif(l.County, 'nan') END AS GeoCounty, CASE WHEN l.NParent = 1 THEN nullif(l.Iso2, 'nan') END AS GeoIso2, nullif(l.Iso3, 'nan') AS GeoIso3, l.NParent AS GeoParents
    FROM mentions m LEFT JOIN gazetteer l ON upper(m.Name) = l.PlaceKey AND m.Class = l.Class)"""


@query("geo_resolve", _GEO + " SELECT * FROM g")
def resolve(t: Tables) -> DataFrame:
    return G.resolve(t.mentions, t.gazetteer)


@query("geo_country", _GEO + " SELECT DocID, SpanNo, CASE WHEN GeoLevel IN ('State', 'County', 'City') THEN 'USA' WHEN GeoIso3 IS NOT NULL THEN GeoIso3 WHEN substr(GeoIso2, 3, 1) = '-' THEN substr(GeoIso2, 1, 2) END AS Country FROM g")
def country(t: Tables) -> DataFrame:
    return G.resolve(t.mentions, t.gazetteer).select("DocID", "SpanNo", G.country().alias("Country"))


@query("geo_addr_hits", _GEO + " SELECT g.DocID, SpanNo, GeoUnit, strpos('12 main street, port ville' || (c_custkey % 29), lower(GeoUnit)) > 0 AS Hit FROM g JOIN register r ON g.DocID = r.DocID JOIN customer ON r.CIK = c_custkey WHERE PartyRole = 'registrant' AND GeoUnit IS NOT NULL AND c_custkey % 5 <> 0")
def address_hits(t: Tables) -> DataFrame:
    address = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("12 MAIN Street, Port Ville"), (F.col("c_custkey") % 29).cast("string")))
    return G.address_hits(G.resolve(t.mentions, t.gazetteer), t.register, t.customer.select(F.col("c_custkey").alias("CIK"), address.alias("Address")))


CUES = ["EXPIR", "TERMINAT", "MATURIT", "UNTIL", "THROUGH"]
_CUE = "CASE " + " ".join(f"WHEN contains(c, '{x}') THEN '{x}'" for x in CUES) + " END"
_DCUE = "upper(right(regexp_replace(CASE s.SpanNo % 3 WHEN 0 THEN 'shall remain until' || chr(10) || 'the  ' WHEN 1 THEN 'this lease expires on ' ELSE 'dated ' END, '\\s+', ' ', 'g'), 120))"


@query("dte_describe", f"WITH s AS (SELECT s.DocID, s.SpanNo, s.DateValue, r.DateFiled, {_DCUE} AS c FROM spans s JOIN register r USING (DocID) WHERE Label = 'DATE') SELECT DocID, SpanNo, DateValue, CAST(DateValue - DateFiled AS INT) AS GapDays, CASE WHEN DateValue < DateFiled THEN 'before filing' WHEN DateValue > DateFiled THEN 'after filing' ELSE 'same day' END AS Side, {_CUE} AS CueHit FROM s")
def describe_dates(t: Tables) -> DataFrame:
    raw = F.when(F.col("SpanNo") % 3 == 0, "shall remain until\nthe  ").when(F.col("SpanNo") % 3 == 1, "this lease expires on ").otherwise("dated ")
    cue = F.upper(F.right(F.regexp_replace(raw, "\\s+", " "), F.lit(120)))
    gap = F.datediff("DateValue", "DateFiled")
    hit = F.lit(None).cast("string")
    for x in reversed(CUES):
        hit = F.when(F.contains(cue, F.lit(x)), x).otherwise(hit)
    met = t.spans.where("Label = 'DATE'").join(t.register.select("DocID", "DateFiled"), "DocID")
    return met.select("DocID", "SpanNo", "DateValue", gap.alias("GapDays"), F.when(gap < 0, "before filing").when(gap > 0, "after filing").otherwise("same day").alias("Side"), hit.alias("CueHit"))
