"""Queries of the single readings that extractors are made of, of store steps and of reading by path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import spans as S
from ..functions.text import any_pattern
from ..operators import parties as P
from ..operators.joins import attach_last_mention, inside
from ..sources import files as X
from ..sources.tables import Tables
from ..streaming import store as St
from .registry import query

_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def each(docs: DataFrame, f: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``f`` makes of each Raw text, with its DocID; one crossing into Python, in batches."""
    fields = pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *r) for d, raw in zip(batch.column("DocID").to_pylist(), batch.column("Raw").to_pylist(), strict=True) for r in f(raw)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(columns, fields, strict=True)], schema=fields)

    return docs.select("DocID", "Raw").mapInArrow(run, schema)


def _raw(t: Tables, sql: str) -> DataFrame:
    return t.register.selectExpr("DocID", f"{sql} AS Raw")


_SPAN = "CASE DocID % 5 WHEN 0 THEN '2011-02-30' WHEN 1 THEN concat('20', lpad(CAST(DocID % 60 AS STRING), 2, '0'), '-03-0', CAST(1 + DocID % 9 AS STRING)) WHEN 2 THEN '1999-12-31' WHEN 3 THEN '2000-2-29' ELSE 'no date' END"


@query("parse_span", f"SELECT DocID, CAST(TRY_CAST({_SPAN} AS DATE) AS STRING) AS DateValue FROM register")
def parse_span(t: Tables) -> DataFrame:
    return each(_raw(t, _SPAN), lambda x: [(S.read_date(x, "ymd"),)], "DocID long, DateValue string")


_TERM = "CASE DocID % 3 WHEN 0 THEN concat('term of five (', CAST(1 + DocID % 40 AS STRING), ') years') WHEN 1 THEN concat('period of ', CAST(1 + DocID % 30 AS STRING), ' months') ELSE 'seven weeks' END"


@query("parse_term", "SELECT DocID, CASE DocID % 3 WHEN 0 THEN CAST(1 + DocID % 40 AS DOUBLE) WHEN 1 THEN 1 + DocID % 30 ELSE 7 END AS N, CASE DocID % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'week' END AS Unit, round(CASE DocID % 3 WHEN 0 THEN CAST(1 + DocID % 40 AS DOUBLE) WHEN 1 THEN CAST(1 + DocID % 30 AS DOUBLE) / 12 ELSE 49 / 365.25 END, 4) AS Years FROM register")
def parse_term(t: Tables) -> DataFrame:
    return each(_raw(t, _TERM), lambda x: [S.read_term(x, "count")], "DocID long, N double, Unit string, Years double")


_FIG = "CASE DocID % 6 WHEN 0 THEN concat(CAST(1 + DocID % 900 AS STRING), ',500') WHEN 1 THEN concat(CAST(1 + DocID % 900 AS STRING), '.250') WHEN 2 THEN '1.234.567,89' WHEN 3 THEN '1,234,567.89' WHEN 4 THEN '12,5' ELSE '1.500.000' END"


@query("num_from_text", "SELECT DocID, CASE DocID % 6 WHEN 0 THEN (1 + DocID % 900) * 1000.0 + 500 WHEN 1 THEN (1 + DocID % 900) + 0.25 WHEN 2 THEN 1234567.89 WHEN 3 THEN 1234567.89 WHEN 4 THEN 12.5 ELSE 1500000 END::DOUBLE AS Value FROM register")
def figures(t: Tables) -> DataFrame:
    return each(_raw(t, _FIG), lambda x: [(float(S.read_figure(x)),)], "DocID long, Value double")


_WRD = "CASE DocID % 4 WHEN 0 THEN 'SIXTY-ONE THOUSAND NINETY AND 90/100' WHEN 1 THEN 'two hundred five' WHEN 2 THEN 'three million' ELSE 'dollars' END"


@query("num_from_words", "SELECT DocID, CASE DocID % 4 WHEN 0 THEN 61090.9 WHEN 1 THEN 205 WHEN 2 THEN 3000000 END::DOUBLE AS Value FROM register")
def number_words(t: Tables) -> DataFrame:
    read = lambda x: None if (v := S.read_number_words(x)) is None else float(v)
    return each(_raw(t, _WRD), lambda x: [(read(x),)], "DocID long, Value double")


_CUR = "CASE DocID % 7 WHEN 0 THEN 'HK$5' WHEN 1 THEN 'US$5' WHEN 2 THEN 'RMB10' WHEN 3 THEN '€7' WHEN 4 THEN '5 pounds' WHEN 5 THEN '$9' ELSE 'nine' END"


@query("currency_of", "SELECT DocID, CASE DocID % 7 WHEN 0 THEN 'HKD' WHEN 1 THEN 'USD' WHEN 2 THEN 'CNY' WHEN 3 THEN 'EUR' WHEN 4 THEN 'GBP' WHEN 5 THEN 'USD' END AS Currency FROM register")
def currency(t: Tables) -> DataFrame:
    return each(_raw(t, _CUR), lambda x: [(S.read_currency(x, "symbol_amount"),)], "DocID long, Currency string")


@query("parse_money", "SELECT DocID, CAST(DocID % 90 + 1 AS STRING) || '000000' AS Amount, 'USD' AS Currency FROM register")
def money(t: Tables) -> DataFrame:
    return each(_raw(t, "concat('$', CAST(DocID % 90 + 1 AS STRING), ' million')"), lambda x: [S.read_money(x, "symbol_scaled", "figure")], "DocID long, Amount string, Currency string")


_FORM = (
    "CASE DocID % 8 WHEN 0 THEN concat('par value $0.000', CAST(1 + DocID % 9 AS STRING), ' per share') WHEN 1 THEN concat('the sum of CHF ', CAST(1 + DocID % 900 AS STRING), '.500,25 net') "
    "WHEN 2 THEN concat('R$', CAST(1 + DocID % 900 AS STRING), '.500.000') WHEN 3 THEN concat('a fee of $[***] and $', CAST(1 + DocID % 900 AS STRING), ',000.50') WHEN 4 THEN concat('NOK ', CAST(1 + DocID % 900 AS STRING), ' million') "
    "WHEN 5 THEN concat('Section 10.', CAST(DocID % 90 AS STRING), ' of the Agreement, in U.S. Dollars') WHEN 6 THEN concat(CAST(1 + DocID % 9 AS STRING), ',000,000 Dollars') ELSE concat('E', CAST(1 + DocID % 900 AS STRING), ',000,000') END"
)


@query("money_forms", """SELECT DocID, unnest(CASE DocID % 8 WHEN 0 THEN [{'s': '$0.000' || (1 + DocID % 9), 'a': '0.000' || (1 + DocID % 9), 'c': 'USD'}] WHEN 1 THEN [{'s': 'CHF ' || (1 + DocID % 900) || '.500,25', 'a': (1 + DocID % 900) || '500.25', 'c': 'CHF'}]
    WHEN 2 THEN [{'s': 'R$' || (1 + DocID % 900) || '.500.000', 'a': (1 + DocID % 900) || '500000', 'c': 'BRL'}] WHEN 3 THEN [{'s': '$[***]', 'a': NULL, 'c': 'USD'}, {'s': '$' || (1 + DocID % 900) || ',000.50', 'a': (1 + DocID % 900) || '000.5', 'c': 'USD'}]
    WHEN 4 THEN [{'s': 'NOK ' || (1 + DocID % 900) || ' million', 'a': (1 + DocID % 900) || '000000', 'c': 'NOK'}] WHEN 6 THEN [{'s': (1 + DocID % 9) || ',000,000 Dollars', 'a': (1 + DocID % 9) || '000000', 'c': 'USD'}]
    WHEN 7 THEN [{'s': 'E' || (1 + DocID % 900) || ',000,000', 'a': (1 + DocID % 900) || '000000', 'c': 'EUR'}] ELSE [] END, recursive := true) FROM register""".replace("SELECT DocID, unnest(", "SELECT DocID, s AS Span, a AS Amount, c AS Currency FROM (SELECT DocID, unnest(").replace(" FROM register", " FROM register) q"))
def money_forms(t: Tables) -> DataFrame:
    """Sub-cent, European, grouped, withheld, scaled, worded and damaged amounts, and text that is none."""
    return each(_raw(t, _FORM), lambda x: [(x[a:b], e["Amount"], e["Currency"]) for a, b, _, _, e in S.money(x)], "DocID long, Span string, Amount string, Currency string")


_BR = "CASE DocID % 6 WHEN 0 THEN '[* * *]' WHEN 1 THEN '[ CTR ]' WHEN 2 THEN '[____]' WHEN 3 THEN '[omitted]' WHEN 4 THEN '[...]' ELSE '[signature page follows]' END"


@query("red_classify", "SELECT DocID, CASE DocID % 6 WHEN 0 THEN 'RedactSymbol' WHEN 1 THEN 'RedactExplicit' WHEN 2 THEN 'RedactBlank' WHEN 3 THEN 'OmitExplicit' WHEN 4 THEN 'OmitSymbol' END AS Kind, CASE DocID % 6 WHEN 5 THEN 'filler' END AS Dropped FROM register")
def classify_mark(t: Tables) -> DataFrame:
    return each(_raw(t, _BR), lambda x: [S.redaction_class(x)], "DocID long, Kind string, Dropped string")


@query("is_legend", "SELECT DocID, DocID % 2 = 0 AS Legend FROM register")
def legend(t: Tables) -> DataFrame:
    return each(_raw(t, "CASE DocID % 2 WHEN 0 THEN 'it is denoted by [***]' ELSE 'the sum of [***]' END"), lambda x: [(S.is_legend(x, x.index("[")),)], "DocID long, Legend boolean")


@query("is_line_rule", "SELECT DocID, DocID % 2 = 0 AS Rule FROM register")
def line_rule(t: Tables) -> DataFrame:
    return each(_raw(t, "CASE DocID % 2 WHEN 0 THEN concat('a', chr(10), '*****', chr(10), 'b') ELSE 'pay ***** now' END"), lambda x: [(S.is_line_rule(x, x.index("*"), x.rindex("*") + 1),)], "DocID long, Rule boolean")


@query("law_classify", "SELECT DocID, CASE DocID % 2 WHEN 0 THEN 'SelfReferential' ELSE 'GovernedBy' END AS Kind FROM register")
def classify_law(t: Tables) -> DataFrame:
    return each(_raw(t, "CASE DocID % 2 WHEN 0 THEN 'governed by the laws of the State in which it lies' ELSE 'governed by Ohio law' END"), lambda x: [(r[3],) for r in S.laws(x)], "DocID long, Kind string")


_TWO = S.compiled([("short", "abcde"), ("long", "defghijkl")])


_OVER = "CASE DocID % 4 WHEN 0 THEN 'abcdefghijkl' WHEN 1 THEN 'abcde fgh' WHEN 2 THEN 'defghijkl and abcde' ELSE 'neither' END"


@query("keep_longest", "SELECT DocID, unnest(CASE DocID % 4 WHEN 0 THEN ['long'] WHEN 1 THEN ['short'] WHEN 2 THEN ['long', 'short'] ELSE [] END) AS Kept FROM register")
def keep_longest(t: Tables) -> DataFrame:
    return each(_raw(t, _OVER), lambda x: [(_TWO[k][0],) for *_, k in S.longest(x, _TWO)], "DocID long, Kept string")


@query("keep_leftmost", "SELECT DocID, unnest(CASE DocID % 4 WHEN 0 THEN ['short'] WHEN 1 THEN ['short'] WHEN 2 THEN ['long', 'short'] ELSE [] END) AS Kept FROM register")
def keep_leftmost(t: Tables) -> DataFrame:
    return each(_raw(t, _OVER), lambda x: [(_TWO[k][0],) for *_, k in S.leftmost(x, _TWO)], "DocID long, Kept string")


PLACES = [("Palo Alto", "US County", False), ("Palo Alto", "US Populated Place", False), ("California", "US State", False), ("Turkey", "Country", False), ("Street", "US Populated Place", True)]


@query("scan", "SELECT DocID, unnest(['Palo Alto', 'California', 'Turkey']) AS Name FROM register")
def scan(t: Tables) -> DataFrame:
    g = S.Gazetteer(PLACES)
    return each(_raw(t, "concat('In Palo Alto, California on Main Street roast Turkey ', CAST(DocID AS STRING))"), lambda x: [(x[a:b],) for a, b, *_ in g.scan(x)], "DocID long, Name string")


_PLACED = "CASE DocID % 4 WHEN 0 THEN 'In Palo Alto, California on Main Street roast Turkey' WHEN 1 THEN 'In Palo Alto alone' WHEN 2 THEN concat('Palo Alto ', repeat('x', 250), ' California') ELSE 'Turkey, California' END"


@query("gate", "SELECT DocID, unnest(CASE DocID % 4 WHEN 0 THEN ['Palo Alto', 'California'] WHEN 1 THEN [] WHEN 2 THEN ['California'] ELSE ['Turkey', 'California'] END) AS Name FROM register")
def gate(t: Tables) -> DataFrame:
    g = S.Gazetteer(PLACES)
    return each(_raw(t, _PLACED), lambda x: [(x[a:b],) for a, b, *_ in g.places(x)], "DocID long, Name string")


@query("build_index", "SELECT n_name AS Name, CASE min(k) WHEN 1 THEN 'US State' WHEN 2 THEN 'Country' ELSE 'US County' END AS Kind, CASE WHEN count(DISTINCT n_regionkey) = 1 THEN min(n_regionkey) END AS Parent FROM (SELECT upper(n_name) AS n_name, n_regionkey, 2 AS k FROM nation UNION ALL SELECT upper(n_name), n_regionkey + n_nationkey % 2, 3 FROM nation WHERE n_nationkey < 9 UNION ALL SELECT upper(n_name), n_regionkey, 1 FROM nation WHERE n_nationkey = 3) q GROUP BY 1")
def build_index(t: Tables) -> DataFrame:
    name = F.upper("n_name").alias("Name")
    rows = t.nation.select(name, "n_regionkey", F.lit(2).alias("k")).union(t.nation.where("n_nationkey < 9").select(name, F.col("n_regionkey") + F.col("n_nationkey") % 2, F.lit(3))).union(t.nation.where("n_nationkey = 3").select(name, "n_regionkey", F.lit(1)))
    kinds = F.array(F.lit("US State"), F.lit("Country"), F.lit("US County"))
    return rows.groupBy("Name").agg(F.element_at(kinds, F.min("k")).alias("Kind"), F.when(F.countDistinct("n_regionkey") == 1, F.min("n_regionkey")).alias("Parent"))


@query("demote_ambiguous", "SELECT upper(n_name) AS Name, CASE WHEN upper(n_name) IN ('CHINA', 'JORDAN', 'PERU') THEN 'US Populated Place' ELSE 'Country' END AS Kind, upper(n_name) IN ('CHINA', 'JORDAN', 'PERU') AS IsWord FROM nation WHERE upper(n_name) NOT IN ('STREET', 'ROAD')")
def demote(t: Tables) -> DataFrame:
    doubtful = F.upper("n_name").isin("CHINA", "JORDAN", "PERU")
    return t.nation.where(~F.upper("n_name").isin(S.ADDRESS_WORDS)).select(F.upper("n_name").alias("Name"), F.when(doubtful, "US Populated Place").otherwise("Country").alias("Kind"), doubtful.alias("IsWord"))


@query("find_indicators", "SELECT DocID, CASE DocID % 4 WHEN 0 THEN 'RedactSymbol' ELSE 'RedactExplicit' END AS Kind FROM contracts WHERE DocID % 4 < 2")
def indicators(t: Tables) -> DataFrame:
    return each(t.contracts.withColumnRenamed("Text", "Raw"), lambda x: [(r[3],) for r in S.redactions(x)], "DocID long, Kind string")


@query("find_clauses", "SELECT DocID, 'governed by the laws of the State of ' || CASE DocID % 2 WHEN 0 THEN 'New York' ELSE 'Delaware' END AS Clause FROM contracts")
def clauses(t: Tables) -> DataFrame:
    return each(t.contracts.withColumnRenamed("Text", "Raw"), lambda x: [(x[r[0] : r[1]],) for r in S.laws(x)], "DocID long, Clause string")


@query("windows", "SELECT doc_id AS DocID, length(text) AS nChars, true AS Covered FROM documents")
def windows(t: Tables) -> DataFrame:
    def check(x: str) -> list[tuple]:
        pieces = list(S.text_windows(x, 3000, 200))
        whole = all(x[a : a + len(p)] == p and len(p) <= 3000 for a, p in pieces) and all(b <= a + len(p) for (a, p), (b, _) in zip(pieces, pieces[1:], strict=False))
        return [(len(x), whole and pieces[-1][0] + len(pieces[-1][1]) == len(x))]

    return each(t.documents.select(F.col("doc_id").alias("DocID"), F.coalesce("text", F.lit("")).alias("Raw")), check, "DocID long, nChars long, Covered boolean")


# --- Letters ------------------------------------------------------------------------------------------------


def _layout(name: str, text: str, want: str, columns: str = "ExhibitNo, RefFormat", status: str | None = None) -> None:
    fields = columns.split(", ")

    @query(name, f"SELECT DocID, {want} FROM register")
    def refs(t: Tables) -> DataFrame:
        rows = lambda x: [tuple(str(r[c]) if r[c] is not None else None for c in fields) for r in L.order_references(x, status)]
        return each(_raw(t, text), rows, "DocID long, " + ", ".join(f"{c} string" for c in fields))


_layout("cto_refs_inline", "concat('Exhibit 10.', CAST(DocID % 50 AS STRING), ' to a Form 10-Q filed on May 1, 2009 through June 2, 2019')", "'10.' || (DocID % 50) AS ExhibitNo, '10-Q' AS RefForm, '2019-06-02' AS ReleaseDate, 'inline' AS RefFormat", "ExhibitNo, RefForm, ReleaseDate, RefFormat")
_layout("cto_refs_table", "concat('Exhibit to Form Filed on 4.', CAST(DocID % 50 AS STRING), ' 8-K May 1, 2009 through June 2, 2019')", "'4.' || (DocID % 50) AS ExhibitNo, '8-K' AS RefForm, 'table' AS RefFormat", "ExhibitNo, RefForm, RefFormat")
_layout("cto_refs_denial", "concat('excluded from Exhibit 3.', CAST(DocID % 50 AS STRING), ' to the Form S-1 filed May 1, 2009')", "'3.' || (DocID % 50) AS ExhibitNo, '2009-05-01' AS RefFiledOn, 'denial' AS RefFormat", "ExhibitNo, RefFiledOn, RefFormat", "DENYING")
_layout("cto_refs_plain", "concat('Exhibit 1.1 is old. It will not be released: Exhibit 2.', CAST(DocID % 50 AS STRING), ' until July 4, 2015')", "'2.' || (DocID % 50) AS ExhibitNo, '2015-07-04' AS ReleaseDate, 'plain' AS RefFormat", "ExhibitNo, ReleaseDate, RefFormat")


@query("cto_order_fields", "SELECT DocID, CASE DocID % 2 WHEN 0 THEN 'GRANTING' ELSE 'DENYING' END AS Status, '24B-2|406' AS Rule, 'S-1/A' AS SourceForm, '2009-04-30' AS SourceFiledOn FROM register")
def order_fields(t: Tables) -> DataFrame:
    def read(x: str) -> list[tuple]:
        f = L.order_fields(x)
        return [(f["Status"], f["Rule"], f["SourceForm"], str(f["SourceFiledOn"]))]

    text = "concat('ORDER ', CASE DocID % 2 WHEN 0 THEN 'GRANTING' ELSE 'DENYING' END, ' CONFIDENTIAL TREATMENT under Rule 406 and Rule 24b-2, to the Form S-1/A filed on April, 30, 2009.')"
    return each(_raw(t, text), read, "DocID long, Status string, Rule string, SourceForm string, SourceFiledOn string")


@query("cto_listing_block", "SELECT DocID, 'will not be released: ' || DocID AS Block FROM register")
def listing(t: Tables) -> DataFrame:
    return each(_raw(t, "concat('It will not be released. These will not be released: ', CAST(DocID AS STRING))"), lambda x: [(L.listing_block(x),)], "DocID long, Block string")


@query("itm_render_span", "SELECT DocID, 'Filing ' || DocID || chr(10) || 'a & b' AS Body FROM register")
def render(t: Tables) -> DataFrame:
    return each(_raw(t, "concat('<p>Filing&nbsp; <b>', CAST(DocID AS STRING), '</b></p><script>x()</script><div>a &amp; b</div>')"), lambda x: [(L.render(x),)], "DocID long, Body string")


# --- Terms ---------------------------------------------------------------------------------------------------


@query("txt_pattern_any", "SELECT DocID, regexp_matches(Text, '(?i)\\b(new[-\\s]+york|eur)(?:s|es)?\\b') AS Hit FROM contracts")
def any_term(t: Tables) -> DataFrame:
    return t.contracts.select("DocID", F.col("Text").rlike(any_pattern(["new york", "eur"])).alias("Hit"))


@query("canonical_terms", "WITH r AS (SELECT DISTINCT Class, lower(regexp_replace(Class, '[^A-Za-z]+', ' ', 'g')) AS x FROM register) SELECT Class, nullif(array_to_string(list_filter(string_split(trim(x), ' '), lambda w: length(w) >= 3 AND w NOT IN ('not', 'the')), ' '), '') AS Term FROM r")
def canonical(t: Tables) -> DataFrame:
    tokens = F.filter(F.split(F.trim(F.lower(F.regexp_replace("Class", "[^A-Za-z]+", " "))), " "), lambda w: (F.length(w) >= 3) & ~w.isin("not", "the"))
    return t.register.select("Class").distinct().select("Class", F.nullif(F.array_join(tokens, " "), F.lit("")).alias("Term"))


@query("build_vectorizer", "WITH w AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{2,}'))) AS Term FROM part), d AS (SELECT Term, count(*) AS n FROM w GROUP BY 1) SELECT Term, n FROM d WHERE n >= 2 AND n <= 0.9 * (SELECT count(*) FROM part)")
def vocabulary(t: Tables) -> DataFrame:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]{2,}"), F.lit(0)))
    total = t.part.agg(F.count("*").alias("total"))
    return t.part.select(F.explode(tokens).alias("Term")).groupBy("Term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where("n >= 2 and n <= 0.9 * total").select("Term", "n")


@query("kw_tau_floor_probe", "WITH g AS (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8, 0.9]) AS DOUBLE) AS Tau), c AS (SELECT Tau, round(avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) FILTER (Score >= Tau), 6) AS Selective FROM predictions CROSS JOIN g GROUP BY 1) SELECT (SELECT min(Tau) FROM c WHERE Selective >= 0.5 AND Tau >= 0.4) AS Published, (SELECT min(Tau) FROM c WHERE Selective >= 0.5) AS Extended, (SELECT min(Tau) FROM c WHERE Selective >= 0.5 AND Tau >= 0.4) <> (SELECT min(Tau) FROM c WHERE Selective >= 0.5) AS Moves")
def floor_probe(t: Tables) -> DataFrame:
    from ..operators.classify import at_thresholds

    curve = at_thresholds(t.predictions, [0.2, 0.4, 0.6, 0.8, 0.9], none="\0")
    ok = F.col("Accuracy") >= 0.5
    points = curve.agg(F.min(F.when(ok & (F.col("Threshold") >= 0.4), F.col("Threshold"))).alias("Published"), F.min(F.when(ok, F.col("Threshold"))).alias("Extended"))
    return points.withColumn("Moves", F.col("Published") != F.col("Extended"))


# --- Reading and the store -------------------------------------------------------------------------------------


@query("edg_parse_landing", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS Title FROM pages WHERE page_id % 2 = 1")
def parse_landing(t: Tables) -> DataFrame:
    """Only pages that are not among the parsed ones are parsed."""
    done = t.pages.where("page_id % 2 = 0").select("page_id")
    return t.pages.join(done, "page_id", "left_anti").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("Title"))


@query("edg_index_documents", "SELECT DocType, count(*) AS nDocs FROM register WHERE DocType IN ('8-K', 'CTO') GROUP BY 1")
def index_documents(t: Tables) -> DataFrame:
    """The type of each document as its path says."""
    path = X.scratch(t.spark)
    t.register.where("DocType in ('8-K', 'CTO')").select("DocID", "DocType").write.partitionBy("DocType").parquet(path)
    kind = F.regexp_extract("_metadata.file_path", "DocType=([^/]+)/", 1)
    return t.spark.read.parquet(path).groupBy(kind.alias("DocType")).agg(F.count("*").alias("nDocs"))


@query("resolve_inputs", "SELECT count(*) AS n FROM region")
def resolve_inputs(t: Tables) -> DataFrame:
    path = X.scratch(t.spark)
    t.region.select(F.col("r_regionkey").alias("DocID"), F.col("r_name").alias("Text")).write.parquet(f"{path}/a/b")
    return X.read_documents(t.spark, [path]).agg(F.count("*").alias("n"))


@query("write_output", "SELECT DocID, 'patterns' AS Model, CAST(round(o_totalprice, 2) AS DECIMAL(20, 2))::DOUBLE AS Amount FROM contracts JOIN orders ON o_orderkey = DocID")
def write_output(t: Tables) -> DataFrame:
    """Spans by engine and model; amounts cross as text and are read as decimals."""
    path = X.scratch(t.spark)
    S.extract(t.contracts, ["MONEY"], model="patterns").write.partitionBy("Engine", "Model").parquet(path)
    rows = t.spark.read.parquet(path).where("LabelRaw = 'symbol_amount'")
    return rows.select("DocID", "Model", F.col("Amount").cast("decimal(20,2)").cast("double").alias("Amount"))


@query("itm_read_landing", "SELECT HashIndex, ItemCode, FilingDate FROM items")
def read_landing(t: Tables) -> DataFrame:
    return t.items.select("HashIndex", "ItemCode", "FilingDate")


@query("ent_load_entity", "SELECT s.DocID, s.Start, s.Stop, l.DocLen FROM spans s JOIN lens l USING (DocID) WHERE Label = 'ORG' AND Producer = 'model1'")
def load_entity(t: Tables) -> DataFrame:
    return t.spans.where("Label = 'ORG' and Producer = 'model1'").join(t.lens, "DocID").select("DocID", "Start", "Stop", "DocLen")


@query("ner_attach", "SELECT s.DocID, count(*) AS nSpans, any_value(r.Class) AS Class FROM spans s JOIN register r USING (DocID) GROUP BY 1")
def attach_families(t: Tables) -> DataFrame:
    """Tables of several stores in one statement."""
    return t.spark.sql("SELECT s.DocID, count(*) AS nSpans, any_value(r.Class) AS Class FROM {spans} s JOIN {register} r USING (DocID) GROUP BY 1", spans=t.spans, register=t.register)


@query("apl_dataset", "SELECT Label, count(*) AS n FROM spans WHERE Label IN ('ORG', 'GPE') GROUP BY 1")
def chunks(t: Tables) -> DataFrame:
    path = X.scratch(t.spark)
    for k, label in enumerate(("ORG", "GPE")):
        t.spans.where(F.col("Label") == label).select("DocID", "Label").write.parquet(f"{path}/chunk-{k}/spans")
    return t.spark.read.parquet(f"{path}/chunk-*/spans").groupBy("Label").agg(F.count("*").alias("n"))


@query("apl_dep_index", "SELECT min(DocID) AS FirstDoc, max(DocID) AS LastDoc, count(*) AS n FROM spans")
def zone_map(t: Tables) -> DataFrame:
    path = X.scratch(t.spark)
    t.spans.select("DocID").repartitionByRange(4, "DocID").write.parquet(path)
    zones = t.spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).agg(F.min("DocID").alias("a"), F.max("DocID").alias("b"), F.count("*").alias("k"))
    return zones.agg(F.min("a").alias("FirstDoc"), F.max("b").alias("LastDoc"), F.sum("k").alias("n"))


# The forms of which filings are kept, each with its amendment.
SEC_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A", "8-K", "8-K/A", "20-F", "20-F/A", "S-1", "S-1/A", "S-4", "S-4/A", "F-1", "F-1/A", "F-4", "F-4/A", "CT ORDER"]


@query("edg_sec_forms", "SELECT unnest([f, f || '/A']) AS FormType FROM (VALUES ('8-K'), ('10-K'), ('10-Q'), ('20-F'), ('S-1'), ('S-4'), ('F-1'), ('F-4')) v(f) UNION ALL SELECT 'CT ORDER'")
def sec_forms(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(f,) for f in SEC_FORMS], "FormType string")


_FREE = """WITH h AS (SELECT DISTINCT p.DocID, p.Start, p.Stop FROM spans p JOIN spans o ON o.DocID = p.DocID AND o.Label = 'MONEY' AND p.Start >= o.Start AND p.Stop <= o.Stop WHERE p.Label = 'GPE'), fr AS (SELECT p.* FROM (SELECT * FROM spans WHERE Label = 'GPE') p ANTI JOIN h USING (DocID, Start, Stop)),
    e AS (SELECT DocID, Start AS Pos, 0 AS IsPlace, PartyKey, Stop AS MStop FROM spans WHERE Label = 'ORG' UNION ALL SELECT DocID, Start, 1, NULL, NULL FROM fr), f AS (SELECT *, last_value(CASE WHEN IsPlace = 0 THEN {'p': PartyKey, 'e': MStop} END IGNORE NULLS) OVER (PARTITION BY DocID ORDER BY Pos, IsPlace, PartyKey, MStop ROWS UNBOUNDED PRECEDING) AS m FROM e)"""


@query("geo_apply", _FREE + " SELECT DocID, count(*) AS nFree, count(*) FILTER (Pos - m.e BETWEEN 0 AND 200) AS nAttached FROM f WHERE IsPlace = 1 GROUP BY 1")
def geo_apply(t: Tables) -> DataFrame:
    """Places in clauses are left out before the others are attached."""
    places = t.spans.where("Label = 'GPE'")
    held = inside(places.select("DocID", "Start", "Stop").distinct(), t.spans.where("Label = 'MONEY'"))
    free = places.join(held, ["DocID", "Start", "Stop"], "left_anti")
    return attach_last_mention(free, t.spans.where("Label = 'ORG'")).groupBy("DocID").agg(F.count("*").alias("nFree"), F.count_if("Attached").alias("nAttached"))


@query("ent_apply")
def ent_apply(t: Tables) -> DataFrame:
    """Names to parties to matches; its steps are compared one by one."""
    entities = t.spans.where("Label = 'ORG'").select("DocID", F.concat_ws(" ", F.lit("ACME"), "PartyKey").alias("Key")).distinct()
    grouped = P.group_parties(entities)
    matched = P.match_anchor(entities, t.register.select("DocID", F.lit("ACME P1").alias("AnchorKey")))
    return grouped.join(matched, ["DocID", "Key"])


@query("apl_apply_safe", "SELECT DocID, CASE WHEN DocID % 5 = 0 THEN 'error:ValueError' ELSE 'ok' END AS Outcome FROM register")
def apply_safe(t: Tables) -> DataFrame:
    """A document that fails is a row that says so; the others are not touched."""

    def f(x: str) -> list[tuple]:
        try:
            if int(x) % 5 == 0:
                raise ValueError(x)
            return [("ok",)]
        except ValueError as error:
            return [(f"error:{type(error).__name__}",)]

    return each(_raw(t, "CAST(DocID AS STRING)"), f, "DocID long, Outcome string")


@query("ner_ingest", "SELECT Label, count(*) AS n FROM spans WHERE Label IN ('DATE', 'GPE') GROUP BY 1")
def ingest(t: Tables) -> DataFrame:
    """Staged spans of two entities, one of them twice: a document's spans are replaced, not added to."""
    store = St.Store(t.spark, X.scratch(t.spark))
    for label in ("DATE", "GPE", "DATE"):
        rows = t.spans.where(F.col("Label") == label).select("DocID", "Start", "Stop", "Label")
        store.write_spans(label, rows, rows)
    schema = "DocID long, Start long, Stop long, Label string"
    return store.spans("DATE", schema).union(store.spans("GPE", schema)).groupBy("Label").agg(F.count("*").alias("n"))


@query("ner_db_clear", "SELECT Model, count(*) AS n FROM ledger WHERE NOT (Model = 'model0' AND Entity = 'GPE') GROUP BY 1")
def clear(t: Tables) -> DataFrame:
    store = St.Store(t.spark, X.scratch(t.spark))
    store.replace("ledger", t.ledger.withColumn("RunAt", F.lit("2020-01-01").cast("timestamp")))
    store.clear("model0", "GPE")
    return store.ledger.groupBy("Model").agg(F.count("*").alias("n"))


@query("cor_ledger_mark", "SELECT DocID, CASE WHEN DocID % 3 = 0 THEN 'error' ELSE 'nohit' END AS Status FROM register")
def mark(t: Tables) -> DataFrame:
    store = St.Store(t.spark, X.scratch(t.spark))
    failed = t.register.where("DocID % 3 = 0").select("DocID", F.lit(None).cast("string").alias("Label"), F.lit("error:Unreadable").alias("LabelRaw"), F.lit(None).cast("long").alias("Start"))
    store.write_outcomes(t.register, failed, "m", ["DATE"])
    return store.ledger.select("DocID", "Status")


@query("ner_manifest_write", "SELECT Model, Entity, 'abc' AS SpecHash FROM (VALUES ('m', 'DATE'), ('m', 'MONEY'), ('n', 'DATE')) v(Model, Entity)")
def manifest(t: Tables) -> DataFrame:
    store = St.Store(t.spark, X.scratch(t.spark))
    store.register_model("m", ["DATE", "MONEY"], "abc")
    store.register_model("n", ["DATE"], "abc")
    store.register_model("m", ["DATE"], "abc")
    return store.manifest


@query("spec_hash", "SELECT true AS Stable, true AS Moves")
def spec(t: Tables) -> DataFrame:
    stable = S.spec_hash(["DATE", "TERM"]) == S.spec_hash(["TERM", "DATE"])
    return t.spark.createDataFrame([(stable, S.spec_hash(["DATE"]) != S.spec_hash(["TERM"]))], "Stable boolean, Moves boolean")


@query("apl_policy_hash", "SELECT true AS Stable, true AS Moves")
def policy(t: Tables) -> DataFrame:
    a, b, c = St.policy_hash({"x": 1, "y": 2}, ["s"]), St.policy_hash({"y": 2, "x": 1}, ["s"]), St.policy_hash({"x": 2, "y": 2}, ["s"])
    return t.spark.createDataFrame([(a == b, a != c)], "Stable boolean, Moves boolean")


@query("utils_dir_stamp", "SELECT true AS Same, true AS Moves")
def stamps(t: Tables) -> DataFrame:
    path = X.scratch(t.spark)
    t.region.write.parquet(path)
    one, two, three = (X.folder_stamp(X.list_files(t.spark, path), x).select(F.col("Stamp").alias(n)) for x, n in (("", "a"), ("", "b"), ("x", "c")))
    return one.crossJoin(two).crossJoin(three).select((F.col("a") == F.col("b")).alias("Same"), (F.col("a") != F.col("c")).alias("Moves"))
