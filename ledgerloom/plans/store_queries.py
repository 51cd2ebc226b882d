"""Queries of files, publishing, the incremental store, letters, parties and the remaining summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import spans as S
from ..functions.text import phrase_pattern
from ..operators import aggregates as A
from ..operators import parties as P
from ..operators import windows as W
from ..operators.joins import first_per, inside, no_collision, require_columns
from ..sources import files as X
from ..sources.tables import Tables
from ..streaming import store as St
from .registry import query
from .span_queries import _TERM_HITS, TERMS, text_hits

# --- Files and publishing ------------------------------------------------------------------------------


@query("utils_list_files", "SELECT count(*) > 0 AS Found, true AS AllNamed FROM region")
def list_files(t: Tables) -> DataFrame:
    path = X.scratch(t.spark)
    t.region.write.parquet(path)
    found = X.list_files(t.spark, path)
    return found.where("Path like '%.parquet'").agg((F.count("*") > 0).alias("Found"), F.bool_and(F.length("DocID") > 0).alias("AllNamed"))


@query("utils_doc_path", "SELECT DocID, 'mirror/' || DocType || '/' || Year || '-' || EXTRACT(QUARTER FROM DateFiled) || '/' || DocID || '.parquet' AS Path FROM register")
def doc_path(t: Tables) -> DataFrame:
    quarter = F.concat_ws(".", "Year", F.quarter("DateFiled"))
    return t.register.select("DocID", X.document_path(F.lit("mirror"), F.col("DocType"), quarter, F.col("DocID")).alias("Path"))


@query("read_documents", "SELECT DocID, Text FROM contracts")
def read_documents(t: Tables) -> DataFrame:
    path = X.scratch(t.spark)
    t.contracts.write.parquet(path)
    return X.read_documents(t.spark, [path])


@query("edg_clean_landing", "WITH r AS (SELECT DocID, CASE WHEN DocID % 9 = 0 THEN ' NONE ' WHEN DocID % 7 = 0 THEN '  ' ELSE ' ' || Class || ' ' END AS SRO, CASE WHEN DocID % 5 = 0 THEN '2011-02-30' ELSE CAST(DateFiled AS STRING) END AS D, CASE WHEN DocID % 4 = 0 THEN 'x1' ELSE ' ' || nWords END AS N FROM register) SELECT DocID, CASE WHEN trim(SRO) NOT IN ('', 'NONE') THEN trim(SRO) END AS SRO, TRY_CAST(trim(D) AS DATE) AS D, TRY_CAST(trim(N) AS BIGINT) AS N FROM r")
def clean_landing(t: Tables) -> DataFrame:
    sro = F.when(F.col("DocID") % 9 == 0, " NONE ").when(F.col("DocID") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "Class", F.lit(" ")))
    raw = t.register.select("DocID", sro.alias("SRO"), F.when(F.col("DocID") % 5 == 0, "2011-02-30").otherwise(F.col("DateFiled").cast("string")).alias("D"), F.when(F.col("DocID") % 4 == 0, "x1").otherwise(F.concat(F.lit(" "), "nWords")).alias("N"))
    return X.clean_landing(raw, ["D"], ["DocID", "N"])


SCHEMA = [X.Field("DocID", "bigint"), X.Field("FilingYear", "int", "Year"), X.Field("Words", "bigint", "coalesce(nWords, 0)"), X.Field("Kind", "string", "DocType")]


@query("pbd_table", "SELECT DocID, Year AS FilingYear, nWords AS Words, DocType AS Kind FROM register")
def published(t: Tables) -> DataFrame:
    path = X.scratch(t.spark)
    X.write_declared(t.register, SCHEMA, path, rows_per_group=1000)
    return t.spark.read.parquet(path)


@query("pbd_sql_copy", "SELECT DocID, Year AS FilingYear, nWords AS Words, DocType AS Kind FROM register")
def published_csv(t: Tables) -> DataFrame:
    path = X.scratch(t.spark)
    X.write_declared(t.register, SCHEMA, path, "csv")
    return t.spark.read.option("header", "true").schema("DocID bigint, FilingYear int, Words bigint, Kind string").csv(path)


@query("pbd_text", "SELECT DocID, Year, Text FROM contracts JOIN register USING (DocID) WHERE DocID IN (SELECT DocID FROM ledger WHERE Status = 'hit') AND Year = 1995")
def published_text(t: Tables) -> DataFrame:
    """Texts by year: written in partitions, and one year read without the others."""
    path = X.scratch(t.spark)
    keys = t.ledger.where("Status = 'hit'").select("DocID")
    t.contracts.join(t.register.select("DocID", "Year"), "DocID").join(keys, "DocID", "left_semi").repartition("Year").write.partitionBy("Year").parquet(path)
    return t.spark.read.parquet(path).where("Year = 1995").select("DocID", "Year", "Text")


@query("pbd_spans", "SELECT DocID, Start, Stop, Label FROM spans WHERE Label IN ('DATE', 'MONEY')")
def published_spans(t: Tables) -> DataFrame:
    """Chunks with different columns, read as one table by name."""
    path = X.scratch(t.spark)
    t.spans.where("Label = 'DATE'").select("DocID", "Start", "Stop", "Label", "DateValue").write.parquet(f"{path}/chunk-1")
    t.spans.where("Label = 'MONEY'").select("DocID", "Start", "Stop", "Label", "Amount").write.parquet(f"{path}/chunk-2")
    return t.spark.read.option("mergeSchema", "true").parquet(f"{path}/chunk-1", f"{path}/chunk-2").select("DocID", "Start", "Stop", "Label")


@query("exp_write_long", "SELECT * FROM (VALUES ('r_name', 'string', 'its name'), ('r_regionkey', 'int', 'a key')) v(\"Column\", \"Type\", About)")
def write_codebook(t: Tables) -> DataFrame:
    return X.codebook(t.region, {"r_regionkey": "a key", "r_name": "its name"})


@query("exp_stata_ready", "SELECT DocID, CAST(nWords > 500 AS INT) AS is_long_document_with_many_words, substr(Class, 1, 3) AS Class FROM register")
def stata_ready(t: Tables) -> DataFrame:
    return X.stata_ready(t.register.select("DocID", (F.col("nWords") > 500).alias("is long document with many words and more"), "Class"), 3)


@query("exp_table_columns", "SELECT * FROM (VALUES ('DocID', 'exported'), ('Start', 'left behind'), ('Ghost', 'absent')) v(\"Column\", Status)")
def table_columns(t: Tables) -> DataFrame:
    return X.column_report(t.spans.select("DocID", "Start"), ["DocID", "Ghost"])


@query("exp_table_numeric", "WITH l AS (SELECT 'nWords' AS c, CAST(nWords AS DOUBLE) AS x FROM register UNION ALL SELECT 'Amount', Amount FROM register UNION ALL SELECT 'gvkey', gvkey FROM register) SELECT c AS \"Column\", count(x) AS nValues, round(CAST(count(x) AS DOUBLE) / count(*), 6) AS pValues, median(x) AS Median, round(avg(x), 4) AS Mean, min(x) AS Min, max(x) AS Max, count(*) FILTER (x > 500) AS nAbove FROM l GROUP BY 1")
def table_numeric(t: Tables) -> DataFrame:
    return A.profile(t.register, ["nWords", "Amount", "gvkey"], 500)


@query("exp_table_levels", "SELECT coalesce(CAST(gvkey AS STRING), '(missing)') AS Level, count(*) AS n FROM register GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def table_levels(t: Tables) -> DataFrame:
    return A.top_levels(t.register, "gvkey", 15)


@query("exp_check_collide", "SELECT DocID, nWords, count(*) AS nSpans FROM register JOIN spans USING (DocID) GROUP BY 1, 2")
def checked_join(t: Tables) -> DataFrame:
    a, b = t.register.select("DocID", "nWords"), t.spans.groupBy("DocID").agg(F.count("*").alias("nSpans"))
    no_collision(a, b, ["DocID"])
    return a.join(b, "DocID")


@query("itx_require_cols", "SELECT DocID, Year FROM register")
def required(t: Tables) -> DataFrame:
    return require_columns(t.register, "DocID", "Year").select("DocID", "Year")


@query("oa_number_one", "SELECT max(nWords) AS Value FROM register WHERE FormType = 'F'")
def one_number(t: Tables) -> DataFrame:
    return t.register.where("FormType = 'F'").agg(F.expr("max(nWords)").alias("Value"))


@query("pbd_site_numbers", "SELECT 'documents' AS Key, count(*) AS Value FROM register UNION ALL SELECT 'spans', count(*) FROM spans UNION ALL SELECT 'filers', count(DISTINCT CIK) FROM register")
def site_numbers(t: Tables) -> DataFrame:
    parts = [(t.register, "documents", F.count("*")), (t.spans, "spans", F.count("*")), (t.register, "filers", F.countDistinct("CIK"))]
    rows = [df.agg(F.lit(k).alias("Key"), v.alias("Value")) for df, k, v in parts]
    return rows[0].union(rows[1]).union(rows[2])


@query("pbd_keywords_from", "SELECT Term, Family AS Class, 'family' AS Task, NULL::DOUBLE AS Power FROM hits GROUP BY 1, 2 UNION ALL SELECT DISTINCT PredLabel, TrueLabel, 'label', 1.0 FROM predictions")
def keywords(t: Tables) -> DataFrame:
    a = t.hits.select("Term", F.col("Family").alias("Class")).distinct().withColumn("Task", F.lit("family"))
    b = t.predictions.select(F.col("PredLabel").alias("Term"), F.col("TrueLabel").alias("Class")).distinct().withColumn("Task", F.lit("label")).withColumn("Power", F.lit(1.0))
    return a.unionByName(b, allowMissingColumns=True)


@query("pbd_text_keys", "SELECT DISTINCT gvkey FROM register WHERE gvkey IS NOT NULL")
def text_keys(t: Tables) -> DataFrame:
    return t.register.where("gvkey is not null").select("gvkey").distinct()


@query("ent_bind_all", "SELECT CASE WHEN grouping(Class) = 1 THEN 'All documents' ELSE Class END AS Class, count(*) AS n, round(avg(nWords), 6) AS Mean FROM register GROUP BY GROUPING SETS ((Class), ())")
def bind_all(t: Tables) -> DataFrame:
    return A.with_all_row(t.register, "Class", [F.count("*").alias("n"), F.round(F.avg("nWords"), 6).alias("Mean")])


@query("export_term_docs", "SELECT h.DocID, Family, count(*) AS nHits FROM hits h JOIN register r USING (DocID) WHERE r.DocType LIKE 'Exhibit%' GROUP BY 1, 2")
def term_docs(t: Tables) -> DataFrame:
    spine = t.register.where("DocType like 'Exhibit%'").select("DocID")
    return t.hits.join(spine, "DocID", "left_semi").groupBy("DocID", "Family").agg(F.count("*").alias("nHits"))


@query("export_summaries", "SELECT HashDocument, arg_max(DocID, (nChars, -DocID)) AS DocID, max(nChars) AS nChars FROM register GROUP BY 1")
def summaries(t: Tables) -> DataFrame:
    return t.register.groupBy("HashDocument").agg(F.max_by("DocID", F.struct("nChars", -F.col("DocID"))).alias("DocID"), F.max("nChars").alias("nChars"))


@query("export_MONEY", "SELECT DocID, count(DISTINCT Amount) AS nDistinct, max(Amount) AS MaxAmount, median(Amount) AS MidAmount FROM spans WHERE Label = 'MONEY' GROUP BY 1")
def export_money(t: Tables) -> DataFrame:
    return t.spans.where("Label = 'MONEY'").groupBy("DocID").agg(F.countDistinct("Amount").alias("nDistinct"), F.max("Amount").alias("MaxAmount"), F.median("Amount").alias("MidAmount"))


@query("export_REDACT", "WITH m AS (SELECT DocID, CASE SpanNo % 3 WHEN 0 THEN '[ ]' WHEN 1 THEN '[***]' ELSE Kind END AS Span FROM spans WHERE Label = 'GPE') SELECT DocID, count(*) AS nMarks FROM m WHERE NOT regexp_matches(Span, '^\\[\\s*\\]$') GROUP BY 1")
def export_redact(t: Tables) -> DataFrame:
    span = F.when(F.col("SpanNo") % 3 == 0, "[ ]").when(F.col("SpanNo") % 3 == 1, "[***]").otherwise(F.col("Kind"))
    return t.spans.where("Label = 'GPE'").where(~span.rlike("^\\[[\\s\\x85\\xA0]*\\]$")).groupBy("DocID").agg(F.count("*").alias("nMarks"))


@query("export_DATE", "SELECT DocID, DateFiled, HasDate, HasTerm FROM (SELECT DocID, bool_or(k = 'd') AS HasDate, bool_or(k = 't') AS HasTerm FROM (SELECT DISTINCT DocID, 'd' AS k FROM spans WHERE Label = 'DATE' UNION SELECT DISTINCT DocID, 't' FROM spans WHERE Label = 'TERM') u GROUP BY 1) q JOIN register USING (DocID)")
def export_date(t: Tables) -> DataFrame:
    keys = t.spans.where("Label in ('DATE', 'TERM')").groupBy("DocID").agg(F.bool_or(F.col("Label") == "DATE").alias("HasDate"), F.bool_or(F.col("Label") == "TERM").alias("HasTerm"))
    return keys.join(t.register.select("DocID", "DateFiled"), "DocID")


@query("export_cto", "SELECT HashDocument, count(*) AS nRefs, min(DateFiled) AS FirstRelease, max(DateFiled) AS LastRelease, bool_or(nWords % 3 = 0) AS AnyExtension FROM register WHERE DocType = 'CTO' GROUP BY 1")
def export_cto(t: Tables) -> DataFrame:
    return t.register.where("DocType = 'CTO'").groupBy("HashDocument").agg(F.count("*").alias("nRefs"), F.min("DateFiled").alias("FirstRelease"), F.max("DateFiled").alias("LastRelease"), F.bool_or(F.col("nWords") % 3 == 0).alias("AnyExtension"))


# --- The incremental store --------------------------------------------------------------------------------


ENTITIES = ["DATE", "MONEY", "REDACT"]


def _filled(t: Tables, *passes: DataFrame) -> St.Store:
    """A store after passes, each over what of its documents was left."""
    store = St.Store(t.spark, X.scratch(t.spark))
    extract = lambda docs: S.extract(docs, ENTITIES, model="patterns")
    for docs in passes:
        store.run_pass(docs, extract, "patterns", ENTITIES, S.spec_hash(ENTITIES))
    return store


@query("cor_pass", "SELECT DocID, 'DATE' AS Entity, 'hit' AS Status FROM contracts UNION ALL SELECT DocID, 'MONEY', 'hit' FROM contracts UNION ALL SELECT DocID, 'REDACT', CASE WHEN DocID % 4 < 2 THEN 'hit' ELSE 'nohit' END FROM contracts")
def corpus_pass(t: Tables) -> DataFrame:
    """Two passes: even documents, then all that were left."""
    return _filled(t, t.contracts.where("DocID % 2 = 0"), t.contracts).ledger.select("DocID", "Entity", "Status")


@query("ner_db_summary", "SELECT Model, Entity, count(*) AS n, count(*) FILTER (Status = 'error') AS n_error, count(*) FILTER (Status = 'timeout') AS n_timeout, count(*) FILTER (Status = 'hit') AS n_hit, count(*) FILTER (Status = 'nohit') AS n_nohit FROM ledger GROUP BY 1, 2")
def ledger_summary(t: Tables) -> DataFrame:
    return St.summary(t.ledger)


@query("ent_check_ledger", "SELECT r.DocID, m.Model, e.Entity FROM register r CROSS JOIN (VALUES ('model0'), ('model1')) m(Model) CROSS JOIN (VALUES ('DATE'), ('GPE')) e(Entity) WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.DocID = r.DocID AND l.Model = m.Model AND l.Entity = e.Entity)")
def check_ledger(t: Tables) -> DataFrame:
    return St.without_outcome(t.register, t.ledger, [(m, e) for m in ("model0", "model1") for e in ("DATE", "GPE")])


@query("ent_check_offsets", "SELECT 0::BIGINT AS nWrong")
def store_offsets(t: Tables) -> DataFrame:
    """Every span of every entity in a store of the whole corpus, beside its document's text."""
    store = _filled(t, t.contracts)
    spans = reduce(DataFrame.union, [store.spans(entity, S.SCHEMA) for entity in ENTITIES])
    return S.wrong_offsets(spans, t.contracts).agg(F.count("*").alias("nWrong"))


@query("edg_measure_corpus", "SELECT DocID, length(Text) AS nChars FROM contracts WHERE DocID % 3 <> 1")
def measure_corpus(t: Tables) -> DataFrame:
    measure = lambda d: d.select("DocID", F.length("Text").cast("bigint").alias("nChars"))
    cached = measure(t.contracts.where("DocID % 2 = 0"))
    return St.reconcile(t.contracts.where("DocID % 3 <> 1"), cached, measure)


@query("app_run_register", "SELECT CIK, CASE WHEN CIK % 2 = 0 THEN 'new' ELSE 'old' END AS State, CAST(CASE WHEN CIK % 3 = 0 AND CIK % 2 = 0 THEN 2 ELSE 1 END AS INT) AS StartedAt FROM (SELECT c_custkey AS CIK FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0) q")
def run_register(t: Tables) -> DataFrame:
    old = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("CIK"), F.lit("old").alias("State"), F.lit(1).alias("StartedAt"))
    new = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("CIK"), F.lit("new").alias("State"), F.lit(2).alias("StartedAt"))
    return St.upsert(old, new, "CIK", ["StartedAt"])


@query("apl_check_split", "SELECT true AS Same, 0::BIGINT AS nDiffer")
def check_split(t: Tables) -> DataFrame:
    """The whole corpus and its halves give the same spans."""
    run = lambda d: S.extract(d, ["DATE", "MONEY"], columns=["DocID", "Start", "Stop", "LabelRaw"])
    whole = run(t.contracts)
    halves = run(t.contracts.where("DocID % 2 = 0")).union(run(t.contracts.where("DocID % 2 = 1")))
    # Each side is read once: a row counts one for the whole and minus one for the halves, and what is left over differs.
    both = whole.withColumn("n", F.lit(1)).union(halves.withColumn("n", F.lit(-1)))
    left = both.groupBy("DocID", "Start", "Stop", "LabelRaw").agg(F.abs(F.sum("n")).alias("n"))
    differ = left.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nDiffer"))
    return differ.select((F.col("nDiffer") == 0).alias("Same"), "nDiffer")


@query("apl_check_done", "SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM spans s WHERE s.DocID = r.DocID)) AS nWithoutSpans FROM register r")
def check_done(t: Tables) -> DataFrame:
    return t.register.join(t.spans, "DocID", "left_anti").agg(F.count("*").alias("nWithoutSpans"))


def _facts(docs: DataFrame) -> DataFrame:
    """Rules over a document's dates and amounts: one row for each of the two, at its first place."""
    found = S.extract(docs, ["DATE", "MONEY"], columns=["DocID", "Start", "Label", "LabelRaw", "DateValue", "Amount"])
    first = found.groupBy("DocID", "Label").agg(F.min_by(F.struct("LabelRaw", "Start", F.coalesce("DateValue", "Amount").alias("Value")), "Start").alias("f"))
    return first.select("DocID", "Label", "f.*")


_FACTS = "SELECT DocID, 'DATE' AS Label, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS Value FROM contracts JOIN orders ON DocID = o_orderkey"


@query("apl_pass_run", _FACTS)
def rule_pass(t: Tables) -> DataFrame:
    """Rules over what is pending, twice, in chunks: first over a part of the corpus, then over all of it."""
    store = St.Store(t.spark, X.scratch(t.spark))
    for corpus, chunks in ((t.contracts.where("DocID % 3 = 0"), 2), (t.contracts, 3)):
        store.run_chunks(corpus, _facts, "facts", ["DATE", "MONEY"], S.spec_hash(["DATE", "MONEY"]), chunks)
    return store.spans("DATE", "DocID long, Label string, LabelRaw string, Start long, Value string").select("DocID", "Label", "Value")


@query("apl_chunk_run", "SELECT CAST(count(*) AS BIGINT) AS nDone, CAST(count(*) AS BIGINT) AS nLedger FROM contracts")
def rule_chunks(t: Tables) -> DataFrame:
    """What the chunks of a pass say they did, and what the ledger has."""
    store = St.Store(t.spark, X.scratch(t.spark))
    done = sum(store.run_chunks(t.contracts, _facts, "facts", ["DATE"], S.spec_hash(["DATE"]), 3))
    return store.ledger.agg(F.lit(done).cast("long").alias("nDone"), F.count("*").alias("nLedger"))


@query("txt_pass", _TERM_HITS + " SELECT DocID, Family, Term, StartAt FROM h")
def text_pass(t: Tables) -> DataFrame:
    """Phrases over what is pending, in chunks, under the hash of the phrases: a document is scanned once for one set."""
    store = St.Store(t.spark, X.scratch(t.spark))
    scan = lambda docs: text_hits(docs, TERMS).select("DocID", F.lit("TEXT").alias("Label"), F.col("Term").alias("LabelRaw"), F.col("StartAt").alias("Start"), "Family")
    spec = St.policy_hash(TERMS, [])
    for corpus in (t.contracts.where("DocID % 2 = 0"), t.contracts):
        store.run_chunks(corpus, scan, spec, ["TEXT"], spec, 2)
    return store.spans("TEXT", "DocID long, Label string, LabelRaw string, Start int, Family string").select("DocID", "Family", F.col("LabelRaw").alias("Term"), F.col("Start").alias("StartAt"))


@query("exp_cache_hit", "SELECT * FROM (VALUES ('absent', false), ('good', true), ('asked for again', false), ('input gone', false)) v(State, Hit)")
def cache_hit(t: Tables) -> DataFrame:
    """A made table beside its inputs; the case of an input that moves later is in the tests."""
    made, source = X.scratch(t.spark), X.scratch(t.spark)
    t.nation.write.parquet(source)
    states = [("absent", X.cache_hit(t.spark, made, [source]))]
    t.spark.read.parquet(source).write.parquet(made)
    states += [("good", X.cache_hit(t.spark, made, [source])), ("asked for again", X.cache_hit(t.spark, made, [source], rerun=True)), ("input gone", X.cache_hit(t.spark, made, [f"{source}/none"]))]
    return t.spark.createDataFrame(states, "State string, Hit boolean")


@query("run_plan", "WITH w(Model, Entity) AS (VALUES ('model0', 'DATE'), ('model0', 'GPE'), ('model1', 'MONEY'), ('model2', 'DATE')) SELECT w.Model, w.Entity, CAST(count(DISTINCT l.DocID) AS BIGINT) AS nDone, (SELECT count(*) FROM register) - count(DISTINCT l.DocID) AS nPending FROM w LEFT JOIN ledger l ON l.Model = w.Model AND l.Entity = w.Entity GROUP BY 1, 2")
def run_plan(t: Tables) -> DataFrame:
    return St.run_plan(t.register, t.ledger, [("model0", ["DATE", "GPE"]), ("model1", ["MONEY"]), ("model2", ["DATE"])])


@query("txt_write_chunk", "SELECT DISTINCT DocID, Family, Term, StartAt FROM hits")
def rewritten_hits(t: Tables) -> DataFrame:
    """A chunk that was scanned twice after a crash: hits are one for each document, term and place."""
    again = t.hits.where("DocID % 2 = 0")
    return t.hits.union(again).select("DocID", "Family", "Term", "StartAt").dropDuplicates(["DocID", "Family", "Term", "StartAt"])


@query("itm_check_items", "SELECT * FROM (SELECT 'codes are present' AS \"Check\", count(*) FILTER (ItemCode IS NULL) AS nBad FROM items UNION ALL SELECT 'orders start at one', count(*) FILTER (m <> 1) FROM (SELECT HashIndex, min(ItemOrder) AS m FROM items GROUP BY 1) q UNION ALL SELECT 'codes have a dot', count(*) FILTER (strpos(ItemCode, '.') = 0) FROM items) z")
def check_items(t: Tables) -> DataFrame:
    starts = t.items.groupBy("HashIndex").agg(F.min("ItemOrder").alias("m"))
    rows = [t.items.agg(F.lit("codes are present").alias("Check"), F.count_if(F.col("ItemCode").isNull()).alias("nBad")), starts.agg(F.lit("orders start at one"), F.count_if(F.col("m") != 1)), t.items.agg(F.lit("codes have a dot"), F.count_if(~F.contains("ItemCode", F.lit("."))))]
    return rows[0].union(rows[1]).union(rows[2])


@query("events_windows", "SELECT date_trunc('hour', ts) AS WindowStart, event_type, count(*) AS n, round(sum(value), 4) AS Total FROM events GROUP BY 1, 2")
def event_windows(t: Tables) -> DataFrame:
    return St.event_counts(t.events)


@query("events_sessions", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS Session FROM g) SELECT user_id, Session, count(*) AS n, min(ts) AS StartAt, max(ts) AS StopAt FROM s GROUP BY 1, 2")
def event_sessions(t: Tables) -> DataFrame:
    return St.sessions(t.events)


# --- Letters and items ------------------------------------------------------------------------------------

_ORDER = "concat('ORDER GRANTING CONFIDENTIAL TREATMENT UNDER Rule 24b-2. File No. 1-', CAST(DocID AS STRING), '. X submitted an application to the Form 10-K filed on March 3, 2010. The excluded information will not be released: ', CASE DocID % 3 WHEN 0 THEN concat('Exhibit 10.', CAST(DocID % 40 AS STRING), ' to Form 8-K filed on May 1, 2009 through June 2, 2019') WHEN 1 THEN concat('Exhibit 4.', CAST(DocID % 9 AS STRING), ' through July 4, 2015') ELSE 'nothing is listed' END)"
_WANT = f"SELECT DocID, 'GRANTING' AS Status, '24B-2' AS Rule, CASE DocID % 3 WHEN 0 THEN '10.' || (DocID % 40) WHEN 1 THEN '4.' || (DocID % 9) END AS ExhibitNo, CASE DocID % 3 WHEN 0 THEN 'inline' WHEN 1 THEN 'plain' ELSE 'none' END AS RefFormat, CASE DocID % 3 WHEN 0 THEN '8-K' ELSE '10-K' END AS UseForm, CASE DocID % 3 WHEN 0 THEN DATE '2009-05-01' ELSE DATE '2010-03-03' END AS UseFiledOn, CASE DocID % 3 WHEN 0 THEN DATE '2019-06-02' WHEN 1 THEN DATE '2015-07-04' END AS ReleaseDate FROM register"


@query("cto_parse_order", _WANT)
def parse_orders(t: Tables) -> DataFrame:
    letters = t.register.select("DocID", F.expr(_ORDER).alias("Text"))
    return L.parse_orders(letters).select("DocID", "Status", "Rule", "ExhibitNo", "RefFormat", "UseForm", "UseFiledOn", "ReleaseDate")


@query("itm_process_doc", "SELECT DocID, CASE DocID % 5 WHEN 0 THEN 'no-body' WHEN 1 THEN 'no-markers' WHEN 2 THEN 'not-found' WHEN 3 THEN 'heading-only' ELSE 'extracted' END AS Outcome, CASE WHEN DocID % 5 = 4 THEN 'Item 1.01 Entry into a Material Definitive Agreement. On May 1 the company ' || DocID || ' entered into a long agreement.' END AS ItemText FROM register")
def process_items(t: Tables) -> DataFrame:
    body = F.expr("CASE DocID % 5 WHEN 0 THEN '' WHEN 1 THEN '<p>Nothing here</p>' WHEN 2 THEN '<p>Item 2.02 Results</p>' WHEN 3 THEN 'Item 1.01\\nItem 9.01 Exhibits' ELSE concat('<html><p>Item 1.01 Entry into a Material&nbsp;Definitive Agreement. On May 1 the company ', DocID, ' entered into a long agreement.</p><p>Item 9.01 Exhibits</p></html>') END")
    return L.find_items(t.register.select("DocID", body.alias("Text"))).select("DocID", "Outcome", "ItemText")


@query("itm_body_chars", "SELECT DocID, length('On May 1 it was signed by ' || CIK) AS nBody FROM register")
def body_chars(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Item 1.01. Entry into a Material Definitive Agreement. On May 1 it was signed by "), "CIK")
    bare = F.regexp_replace(F.regexp_replace(text, "(?i)" + L.HEADING, ""), "(?i)" + L.ITEM_TITLE, "")
    return t.register.select("DocID", F.length(F.trim(bare)).cast("bigint").alias("nBody"))


@query("txt_pattern", "SELECT DocID, regexp_matches(Text, '(?i)\\bfull[-\\s]+force(?:s|es)?\\b') AS A, regexp_matches(Text, '(?i)\\bperiod[-\\s]+of(?:s|es)?\\b') AS B FROM contracts")
def phrase_patterns(t: Tables) -> DataFrame:
    return t.contracts.select("DocID", F.col("Text").rlike(phrase_pattern("full force")).alias("A"), F.col("Text").rlike(phrase_pattern("period of")).alias("B"))


# --- Parties ------------------------------------------------------------------------------------------------

_NAMES = "SELECT DISTINCT DocID, CASE SpanNo % 5 WHEN 0 THEN 'ACME' WHEN 1 THEN 'ACME TRADING' WHEN 2 THEN 'ACME TRADING NORTH' WHEN 3 THEN 'BETA ' || PartyKey ELSE PartyKey END AS Key FROM spans"


def _entities(t: Tables) -> DataFrame:
    key = F.expr("CASE SpanNo % 5 WHEN 0 THEN 'ACME' WHEN 1 THEN 'ACME TRADING' WHEN 2 THEN 'ACME TRADING NORTH' WHEN 3 THEN concat('BETA ', PartyKey) ELSE PartyKey END")
    return t.spans.select("DocID", key.alias("Key")).distinct()


_PAIRS = f"""WITH RECURSIVE n AS ({_NAMES}), w AS (SELECT DocID, Key, unnest(list_distinct(string_split(Key, ' '))) AS Tok FROM n WHERE strpos(Key, ' ') > 0), f AS (SELECT s.DocID, s.Key, w.Key AS Host, count(*) OVER (PARTITION BY s.DocID, s.Key) AS k FROM n s JOIN w ON w.DocID = s.DocID AND w.Tok = s.Key WHERE strpos(s.Key, ' ') = 0),
    p AS (SELECT a.DocID, a.Key AS A, b.Key AS B FROM n a JOIN n b ON a.DocID = b.DocID AND a.Key < b.Key AND (starts_with(b.Key, a.Key || ' ') OR starts_with(a.Key, b.Key || ' ')) UNION SELECT DocID, least(Key, Host), greatest(Key, Host) FROM f WHERE k = 1)"""


@query("ent_group_parties", _PAIRS + ", e AS (SELECT DocID, A, B FROM p UNION SELECT DocID, B, A FROM p), r AS (SELECT DocID, Key, Key AS Root FROM n UNION SELECT e.DocID, e.B, r.Root FROM r JOIN e ON e.DocID = r.DocID AND e.A = r.Key) SELECT DocID, Key, min(Root) AS PartyKey FROM r GROUP BY 1, 2")
def grouped_parties(t: Tables) -> DataFrame:
    return P.group_parties(_entities(t)).select("DocID", "Key", "PartyKey")


@query("ent_match_party", f"WITH n AS ({_NAMES}) SELECT DocID, Key, (Key = 'ACME TRADING' OR starts_with(Key, 'ACME TRADING ') OR Key = 'ACME') AS IsMatch, Key = 'ACME TRADING' AS IsExact FROM n")
def matched_parties(t: Tables) -> DataFrame:
    return P.match_anchor(_entities(t), t.register.select("DocID", F.lit("ACME TRADING").alias("AnchorKey")))


# --- Remaining summaries ------------------------------------------------------------------------------------

_GPE = "(SELECT * FROM spans WHERE Label = 'GPE')"


@query("geo_release_places", f"WITH h AS (SELECT DISTINCT p.DocID, p.Start, p.Stop FROM {_GPE} p JOIN spans o ON o.DocID = p.DocID AND o.Label = 'ORG' AND p.Start >= o.Start AND p.Stop <= o.Stop) SELECT p.DocID, p.Start, p.Stop, p.SpanNo, h.DocID IS NOT NULL AS InLawClause FROM {_GPE} p LEFT JOIN h USING (DocID, Start, Stop)")
def release_places(t: Tables) -> DataFrame:
    places = t.spans.where("Label = 'GPE'").select("DocID", "Start", "Stop", "SpanNo")
    held = inside(places.select("DocID", "Start", "Stop").distinct(), t.spans.where("Label = 'ORG'")).select("DocID", "Start", "Stop", F.lit(True).alias("InLawClause"))
    return places.join(held, ["DocID", "Start", "Stop"], "left").fillna(False, ["InLawClause"])


@query("geo_release_law", "SELECT l.DocID, l.Start, l.Stop, l.SpanNo, arg_min(p.Kind, (p.Start, p.SpanNo)) AS Place FROM spans l LEFT JOIN spans p ON p.DocID = l.DocID AND p.Label = 'GPE' AND p.Start >= l.Start AND p.Stop <= l.Stop WHERE l.Label = 'ORG' GROUP BY 1, 2, 3, 4")
def release_law(t: Tables) -> DataFrame:
    law = t.spans.where("Label = 'ORG'").select("DocID", "Start", "Stop", "SpanNo").distinct()
    p = t.spans.where("Label = 'GPE'").select("DocID", F.col("Start").alias("ps"), F.col("Stop").alias("pe"), F.col("SpanNo").alias("pn"), "Kind")
    first = law.join(p, "DocID").where("ps >= Start and pe <= Stop").groupBy("DocID", "Start", "Stop", "SpanNo").agg(F.min_by("Kind", F.struct("ps", "pn")).alias("Place"))
    return law.join(first, ["DocID", "Start", "Stop", "SpanNo"], "left")


@query("geo_table_cover", "SELECT CASE WHEN grouping(PartyRole) = 1 THEN 'All documents' ELSE PartyRole END AS PartyRole, count(*) AS n, count(DISTINCT PartyKey) AS nParties FROM spans WHERE Label = 'GPE' GROUP BY GROUPING SETS ((PartyRole), ())")
def cover_table(t: Tables) -> DataFrame:
    return A.with_all_row(t.spans.where("Label = 'GPE'"), "PartyRole", [F.count("*").alias("n"), F.countDistinct("PartyKey").alias("nParties")])


@query("geo_table_city", "SELECT Kind AS Source, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS Share FROM spans WHERE Label = 'GPE' GROUP BY 1")
def city_table(t: Tables) -> DataFrame:
    return A.share_of_total(t.spans.where("Label = 'GPE'").withColumnRenamed("Kind", "Source"), ["Source"])


_RANKED = "CASE min(CASE Kind WHEN 'RedactExplicit' THEN 1 WHEN 'RedactSymbol' THEN 2 ELSE 3 END) WHEN 1 THEN 'named' WHEN 2 THEN 'self-referential' ELSE 'without a place' END"


@query("geo_table_law", f"SELECT coalesce(o, 'none found') AS Outcome, count(*) AS n FROM register LEFT JOIN (SELECT DocID, {_RANKED} AS o FROM spans WHERE Label = 'ORG' GROUP BY 1) q USING (DocID) GROUP BY 1")
def law_table(t: Tables) -> DataFrame:
    rank = F.min(F.when(F.col("Kind") == "RedactExplicit", 1).when(F.col("Kind") == "RedactSymbol", 2).otherwise(3))
    best = t.spans.where("Label = 'ORG'").groupBy("DocID").agg(F.element_at(F.array(F.lit("named"), F.lit("self-referential"), F.lit("without a place")), rank).alias("Outcome"))
    return t.register.select("DocID").join(best, "DocID", "left").groupBy(F.coalesce("Outcome", F.lit("none found")).alias("Outcome")).agg(F.count("*").alias("n"))


_DOCF = "WITH d AS (SELECT r.Class, s.DocID, count(*) AS nMentions, count(DISTINCT PartyKey) AS nParties, median(Start) AS Mid FROM spans s JOIN register r USING (DocID) WHERE Label = 'ORG' GROUP BY 1, 2)"


def _doc_parties(t: Tables) -> DataFrame:
    met = t.spans.where("Label = 'ORG'").join(t.register.select("DocID", "Class"), "DocID")
    return met.groupBy("Class", "DocID").agg(F.count("*").alias("nMentions"), F.countDistinct("PartyKey").alias("nParties"), F.median("Start").alias("Mid"))


@query("ent_table_naive", _DOCF + " SELECT CASE WHEN grouping(Class) = 1 THEN 'All documents' ELSE Class END AS Class, count(*) AS n, round(avg(nMentions), 6) AS Mentions, round(CAST(sum(nParties) AS DOUBLE) / sum(nMentions), 6) AS Ratio FROM d GROUP BY GROUPING SETS ((Class), ())")
def table_naive(t: Tables) -> DataFrame:
    return A.with_all_row(_doc_parties(t), "Class", [F.count("*").alias("n"), F.round(F.avg("nMentions"), 6).alias("Mentions"), F.round(F.sum("nParties") / F.sum("nMentions"), 6).alias("Ratio")])


@query("ent_table_where", _DOCF + " SELECT CASE WHEN grouping(Class) = 1 THEN 'All documents' ELSE Class END AS Class, median(Mid) AS Mid, round(avg(CASE WHEN nParties > 1 THEN 1.0 ELSE 0.0 END), 6) AS pSeveral FROM d GROUP BY GROUPING SETS ((Class), ())")
def table_where(t: Tables) -> DataFrame:
    return A.with_all_row(_doc_parties(t), "Class", [F.median("Mid").alias("Mid"), F.round(F.avg((F.col("nParties") > 1).cast("double")), 6).alias("pSeveral")])


@query("ent_table_tail", "WITH d AS (SELECT Class, DocLen - Stop AS Tail FROM spans JOIN lens USING (DocID) JOIN register USING (DocID) WHERE Label = 'ORG') SELECT CASE WHEN grouping(Class) = 1 THEN 'All documents' ELSE Class END AS Class, median(Tail) AS MidTail, round(avg(Tail), 6) AS MeanTail FROM d GROUP BY GROUPING SETS ((Class), ())")
def table_tail(t: Tables) -> DataFrame:
    met = t.spans.where("Label = 'ORG'").join(t.lens, "DocID").join(t.register.select("DocID", "Class"), "DocID").withColumn("Tail", F.col("DocLen") - F.col("Stop"))
    return A.with_all_row(met, "Class", [F.median("Tail").alias("MidTail"), F.round(F.avg("Tail"), 6).alias("MeanTail")])


@query("ent_window_terms", "SELECT PartyKey, count(DISTINCT DocID) AS nDocs, round(CAST(count(DISTINCT DocID) AS DOUBLE) / (SELECT count(*) FROM register), 6) AS Share FROM spans WHERE Label = 'ORG' AND PartyRole = 'counterparty' GROUP BY 1")
def window_terms(t: Tables) -> DataFrame:
    total = t.register.agg(F.count("*").alias("total"))
    return t.spans.where("Label = 'ORG' and PartyRole = 'counterparty'").groupBy("PartyKey").agg(F.countDistinct("DocID").alias("nDocs")).crossJoin(F.broadcast(total)).select("PartyKey", "nDocs", F.round(F.col("nDocs") / F.col("total"), 6).alias("Share"))


@query("ent_producers", "SELECT Label, count(DISTINCT Producer) AS n, string_agg(DISTINCT Producer, ', ' ORDER BY Producer) AS Producers FROM spans GROUP BY 1")
def producers(t: Tables) -> DataFrame:
    return t.spans.groupBy("Label").agg(F.countDistinct("Producer").alias("n"), F.array_join(F.sort_array(F.collect_set("Producer")), ", ").alias("Producers"))


@query("ent_producer_grid", "SELECT Label, count(DISTINCT DocID) FILTER (Producer = 'model0') AS model0_n, count(DISTINCT DocID) FILTER (Producer = 'model1') AS model1_n, count(DISTINCT DocID) FILTER (Producer = 'model2') AS model2_n FROM spans GROUP BY 1")
def producer_grid(t: Tables) -> DataFrame:
    return A.pivot_fixed(t.spans, ["Label"], "Producer", ["model0", "model1", "model2"], {"n": F.countDistinct("DocID")}, 0)


@query("ent_release_sample", "SELECT DocID, CAST(dense_rank() OVER (ORDER BY DocID) AS INT) AS No FROM (SELECT DocID FROM register ORDER BY md5('42:' || DocID), DocID LIMIT 4) q")
def release_sample(t: Tables) -> DataFrame:
    """A seeded draw of four documents with their numbers."""
    drawn = t.register.select("DocID").orderBy(W.seeded("DocID"), "DocID").limit(4)
    return drawn.withColumn("No", F.dense_rank().over(Window.orderBy("DocID")))


@query("dte_table_period", "WITH k AS (SELECT DocID, Start, CASE Start % 5 WHEN 0 THEN 'survival' WHEN 1 THEN 'cure' WHEN 2 THEN 'notice' WHEN 3 THEN 'term' ELSE 'other' END AS PeriodKind FROM spans WHERE Label = 'DATE') SELECT PeriodKind, count(*) AS n, median(Start) AS Mid, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS Share FROM k GROUP BY 1")
def period_table(t: Tables) -> DataFrame:
    kind = F.expr("CASE Start % 5 WHEN 0 THEN 'survival' WHEN 1 THEN 'cure' WHEN 2 THEN 'notice' WHEN 3 THEN 'term' ELSE 'other' END")
    k = t.spans.where("Label = 'DATE'").withColumn("PeriodKind", kind)
    return A.share_of_total(k, ["PeriodKind"]).join(k.groupBy("PeriodKind").agg(F.median("Start").alias("Mid")), "PeriodKind")


@query("dte_cue_hits", "WITH c AS (SELECT unnest(['R', 'A', 'E']) AS Cue), s AS (SELECT DocID, Kind FROM spans WHERE Label = 'DATE') SELECT Cue, count(*) FILTER (contains(Kind, Cue)) AS nSpans, count(DISTINCT DocID) FILTER (contains(Kind, Cue)) AS nDocs FROM s CROSS JOIN c GROUP BY 1")
def cue_hits(t: Tables) -> DataFrame:
    cues = t.spark.createDataFrame([("R",), ("A",), ("E",)], "Cue string")
    hit = F.contains("Kind", "Cue")
    return t.spans.where("Label = 'DATE'").crossJoin(F.broadcast(cues)).groupBy("Cue").agg(F.count_if(hit).alias("nSpans"), F.countDistinct(F.when(hit, F.col("DocID"))).alias("nDocs"))


@query("dte_release_dates", "SELECT DocID, CAST(Start AS INT) AS DateStart, CAST(Stop AS INT) AS DateStop, DateValue FROM spans WHERE Label = 'DATE'")
def release_dates(t: Tables) -> DataFrame:
    return t.spans.where("Label = 'DATE'").select("DocID", F.col("Start").cast("int").alias("DateStart"), F.col("Stop").cast("int").alias("DateStop"), "DateValue")


@query("dte_term_compare", "WITH t AS (SELECT DocID, max(Start) AS Longest, arg_min(Start, (SpanNo, Start)) AS First FROM spans WHERE Label = 'MONEY' GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (Longest = First) AS nSame, count(*) FILTER (Longest > First) AS nLonger FROM t")
def term_compare(t: Tables) -> DataFrame:
    per = t.spans.where("Label = 'MONEY'").groupBy("DocID").agg(F.max("Start").alias("Longest"), F.min_by("Start", F.struct("SpanNo", "Start")).alias("First"))
    return per.agg(F.count("*").alias("n"), *A.count_where(nSame="Longest = First", nLonger="Longest > First"))


@query("red_table_money", "SELECT Kind, count(*) AS n FROM spans WHERE Label = 'MONEY' AND Start % 5 = 0 GROUP BY 1 UNION ALL SELECT 'no marker found', count(*) FROM spans WHERE Label = 'MONEY' AND Start % 5 <> 0")
def money_marks(t: Tables) -> DataFrame:
    m = t.spans.where("Label = 'MONEY'")
    return m.where("Start % 5 = 0").groupBy("Kind").agg(F.count("*").alias("n")).union(m.where("Start % 5 <> 0").agg(F.lit("no marker found"), F.count("*")))


@query("kw_survival", "WITH p AS (SELECT TrueLabel AS Class, count(DISTINCT Term) AS nProposed FROM hits JOIN predictions USING (DocID) GROUP BY 1), s AS (SELECT TrueLabel AS Class, count(DISTINCT Term) AS nSurvived FROM hits JOIN predictions USING (DocID) WHERE RelPos < 0.02 GROUP BY 1) SELECT Class, nProposed, coalesce(nSurvived, 0) AS nSurvived FROM p LEFT JOIN s USING (Class)")
def keyword_survival(t: Tables) -> DataFrame:
    met = t.hits.join(t.predictions, "DocID")
    count = lambda d, n: d.groupBy(F.col("TrueLabel").alias("Class")).agg(F.countDistinct("Term").alias(n))
    return count(met, "nProposed").join(count(met.where("RelPos < 0.02"), "nSurvived"), "Class", "left").fillna(0, ["nSurvived"])


@query("apl_table_naive", "SELECT 'Amount' AS Measure, round(avg(Amount), 4) AS Naive, round(avg(CASE WHEN Status = 'F' THEN Amount END), 4) AS Rule, round(avg(CASE WHEN Status = 'F' THEN Amount END) / avg(Amount) - 1, 6) AS Change FROM spans WHERE Label = 'MONEY'")
def naive_table(t: Tables) -> DataFrame:
    naive, rule = F.avg("Amount"), F.avg(F.when(F.col("Status") == "F", F.col("Amount")))
    return t.spans.where("Label = 'MONEY'").agg(F.lit("Amount").alias("Measure"), F.round(naive, 4).alias("Naive"), F.round(rule, 4).alias("Rule"), F.round(rule / naive - 1, 6).alias("Change"))


@query("itx_table_shift", "WITH s AS (SELECT FilingDate >= DATE '1995-06-17' AS Late, ItemCode, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY FilingDate >= DATE '1995-06-17'), 6) AS Share FROM items GROUP BY 1, 2) SELECT Late, ItemCode, Share FROM s QUALIFY row_number() OVER (PARTITION BY Late ORDER BY Share DESC, ItemCode) <= 8")
def table_shift(t: Tables) -> DataFrame:
    shares = A.share_of_total(t.items.withColumn("Late", F.col("FilingDate") >= F.lit("1995-06-17").cast("date")), ["Late", "ItemCode"], ["Late"])
    return W.top_per(shares, ["Late"], 8, F.desc("Share"), F.col("ItemCode")).select("Late", "ItemCode", "Share")


@query("itm_examples", "SELECT 'shortest' AS Which, DocID, nChars FROM (SELECT * FROM register ORDER BY nChars, DocID LIMIT 3) a UNION ALL SELECT 'longest', DocID, nChars FROM (SELECT * FROM register ORDER BY nChars DESC, DocID LIMIT 3) b")
def item_examples(t: Tables) -> DataFrame:
    short = t.register.orderBy("nChars", "DocID").limit(3).select(F.lit("shortest").alias("Which"), "DocID", "nChars")
    return short.union(t.register.orderBy(F.desc("nChars"), "DocID").limit(3).select(F.lit("longest"), "DocID", "nChars"))


@query("llm_sample", "SELECT DocID, TrueLabel FROM predictions QUALIFY row_number() OVER (PARTITION BY TrueLabel ORDER BY md5('42:' || DocID), DocID) <= 6")
def stratified_sample(t: Tables) -> DataFrame:
    """Equal numbers a class, by a seeded hash."""
    return W.top_per(t.predictions, ["TrueLabel"], 6, W.seeded("DocID"), F.col("DocID")).select("DocID", "TrueLabel")


@query("llm_examples", "SELECT DocID, TrueLabel FROM predictions WHERE Fold < 4 QUALIFY row_number() OVER (PARTITION BY TrueLabel ORDER BY md5(CAST(DocID AS STRING))) = 1")
def class_examples(t: Tables) -> DataFrame:
    return first_per(t.predictions.where("Fold < 4"), ["TrueLabel"], F.md5(F.col("DocID").cast("string"))).select("DocID", "TrueLabel")


@query("ner_bench_draw", "WITH d AS (SELECT DocID FROM register ORDER BY md5(CAST(DocID AS STRING)) LIMIT 320) SELECT count(*) AS n, sha256(string_agg(CAST(DocID AS STRING), ',' ORDER BY DocID)) AS Frozen FROM d")
def bench_draw(t: Tables) -> DataFrame:
    drawn = t.register.select("DocID").orderBy(F.md5(F.col("DocID").cast("string"))).limit(320)
    return drawn.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("DocID")), lambda x: x.cast("string")), ","), 256).alias("Frozen"))


@query("ent_jump_docs", "WITH s AS (SELECT DocID, count(DISTINCT PartyKey) FILTER (abs(Start - 450) <= 150) AS a, count(DISTINCT PartyKey) FILTER (abs(Start - 450) <= 450) AS b FROM spans WHERE Label = 'ORG' GROUP BY 1) SELECT DocID, a AS FromN, b AS ToN FROM s WHERE b - a >= 2")
def jump_docs(t: Tables) -> DataFrame:
    near = lambda h: F.countDistinct(F.when(F.abs(F.col("Start") - 450) <= h, F.col("PartyKey")))
    return t.spans.where("Label = 'ORG'").groupBy("DocID").agg(near(150).alias("FromN"), near(450).alias("ToN")).where("ToN - FromN >= 2")


@query("dte_read_terms", "SELECT DocID, Start FROM (SELECT DocID, max(Start) AS Start FROM spans WHERE Label = 'MONEY' GROUP BY 1) q ORDER BY md5(CAST(DocID AS STRING)) LIMIT 12")
def read_terms(t: Tables) -> DataFrame:
    return t.spans.where("Label = 'MONEY'").groupBy("DocID").agg(F.max("Start").alias("Start")).orderBy(F.md5(F.col("DocID").cast("string"))).limit(12)
