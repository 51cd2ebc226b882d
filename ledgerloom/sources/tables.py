"""Tables of a folder, and the document shapes that the star schema stands in for.

The extractors and rules work on registers, spans and ledgers. ``SHAPES`` defines such tables over the
star schema, in SQL that reads the same in Spark and in other engines, so that a query and its SQL
form start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SHAPES: dict[str, str] = {
    # One row a document copy: three keys, filer, type, dates and measures.
    "register": """
        SELECT o_orderkey AS DocID, CAST(FLOOR(o_orderkey / 6) AS BIGINT) AS HashDocument, CAST(FLOOR(o_orderkey / 24) AS BIGINT) AS HashIndex,
            o_custkey AS CIK, CAST(o_orderdate AS DATE) AS DateFiled, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS Year,
            CASE WHEN o_orderkey % 5 < 3 THEN concat('Exhibit10.', CAST(o_orderkey % 9 AS STRING), CASE WHEN o_orderkey % 11 = 0 THEN 'A' ELSE '' END) WHEN o_orderkey % 5 = 3 THEN '8-K' ELSE 'CTO' END AS DocType,
            o_orderpriority AS Class, o_orderstatus AS FormType, CAST(o_orderkey % 997 AS BIGINT) AS nWords, CAST(o_orderkey % 6007 AS BIGINT) AS nChars,
            CAST(o_orderkey % 353 AS BIGINT) AS nNums, CAST(o_orderkey % 61 AS DOUBLE) AS pStopShort, o_totalprice AS Amount,
            CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 23 AS INT) END AS gvkey
        FROM orders""",
    # Fundamentals: a firm's quarter ends, some of them repeated.
    "fundamentals": """
        SELECT o_custkey AS CIK, CAST(o_custkey % 1000 AS BIGINT) AS gvkey, CAST(o_orderdate AS DATE) AS datadate, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS fyear,
            CAST(EXTRACT(QUARTER FROM o_orderdate) AS INT) AS fqtr, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS atq, o_orderkey AS RowKey
        FROM orders""",
    # Spans of documents, 0-based and half open, with labels, producers and parties.
    "spans": """
        SELECT l_orderkey AS DocID, CAST(l_partkey % 900 AS BIGINT) AS Start, CAST(l_partkey % 900 AS BIGINT) + CAST(l_quantity AS BIGINT) AS Stop, CAST(l_linenumber AS BIGINT) AS SpanNo,
            CASE WHEN l_linenumber = 7 THEN 'TERM' WHEN l_linenumber % 4 = 0 THEN 'DATE' WHEN l_linenumber % 4 = 1 THEN 'MONEY' WHEN l_linenumber % 4 = 2 THEN 'GPE' ELSE 'ORG' END AS Label, concat('model', CAST(l_suppkey % 3 AS STRING)) AS Producer,
            concat('P', CAST(l_suppkey % 5 AS STRING)) AS PartyKey, CASE WHEN l_returnflag = 'R' THEN 'registrant' WHEN l_returnflag = 'A' THEN 'cofiler' ELSE 'counterparty' END AS PartyRole,
            l_extendedprice AS Amount, l_discount AS Score, CAST(l_shipdate AS DATE) AS DateValue, l_linestatus AS Status, l_shipmode AS Kind
        FROM (SELECT *, CASE l_partkey % 4 WHEN 0 THEN 'RedactExplicit' WHEN 1 THEN 'RedactSymbol' WHEN 2 THEN 'OmitExplicit' ELSE 'RedactBare' END AS l_shipmode FROM lineitem) q""",
    "lens": "SELECT o_orderkey AS DocID, CAST(900 + o_orderkey % 400 AS BIGINT) AS DocLen FROM orders",
    # Items of filings, in order, one a line.
    "items": """
        SELECT l_orderkey AS HashIndex, CAST(l_linenumber AS BIGINT) AS ItemOrder, concat(CAST(1 + l_partkey % 9 AS STRING), '.', lpad(CAST(1 + l_suppkey % 5 AS STRING), 2, '0')) AS ItemCode,
            CAST(l_shipdate AS DATE) AS FilingDate, l_linenumber = 3 AS ItemFurnished
        FROM lineitem""",
    # Predictions: the true class, the predicted one, scores of three classes.
    "predictions": """
        SELECT o_orderkey AS DocID, CAST(o_orderkey % 5 AS INT) AS Fold, o_orderpriority AS TrueLabel,
            CASE WHEN o_orderkey % 10 = 0 THEN '(none)' WHEN o_custkey % 4 = 0 THEN '3-MEDIUM' WHEN o_custkey % 9 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS PredLabel,
            CASE WHEN o_orderkey % 3 = 0 THEN '2-HIGH' ELSE NULL END AS SecondLabel, round(CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000, 3) AS Score, concat('config', CAST(o_custkey % 3 AS STRING)) AS ConfigName
        FROM orders""",
    "probabilities": """
        SELECT o_orderkey AS DocID, CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'B' ELSE 'C' END AS TrueLabel,
            CAST((o_orderkey * 31) % 97 AS DOUBLE) / 300 AS P_A, CAST((o_orderkey * 17) % 89 AS DOUBLE) / 300 AS P_B, 1 - CAST((o_orderkey * 31) % 97 AS DOUBLE) / 300 - CAST((o_orderkey * 17) % 89 AS DOUBLE) / 300 AS P_C
        FROM orders""",
    # A run ledger: outcomes of documents by model and entity.
    "ledger": """
        SELECT l_orderkey AS DocID, concat('model', CAST(l_suppkey % 2 AS STRING)) AS Model, CASE l_linenumber % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'MONEY' ELSE 'GPE' END AS Entity,
            min(CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_returnflag = 'A' THEN 'hit' ELSE 'nohit' END) AS Status
        FROM lineitem GROUP BY 1, 2, 3""",
    # Text hits of terms, 1-based and inclusive.
    "hits": """
        SELECT l_orderkey AS DocID, CASE WHEN l_partkey % 3 = 0 THEN 'Pandemic' WHEN l_partkey % 3 = 1 THEN 'War' ELSE 'Climate' END AS Family,
            concat('term', CAST(l_partkey % 12 AS STRING)) AS Term, CAST(1 + l_partkey % 900 AS BIGINT) AS StartAt, CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS RelPos
        FROM lineitem""",
    # Mentions of places by name and class, attached to parties, and a gazetteer of them: every class, names with one parent or
    # two, codes that are there or 'nan', and names of two words.
    "mentions": """
        SELECT l_orderkey AS DocID, CAST(l_linenumber AS BIGINT) AS SpanNo, concat('Port ', CASE WHEN l_partkey % 3 = 0 THEN 'ham' ELSE 'Ville' END, CAST(l_partkey % 31 AS STRING)) AS Name,
            CASE l_suppkey % 4 WHEN 0 THEN 'Country' WHEN 1 THEN 'US State' WHEN 2 THEN 'US County' ELSE 'US Populated Place' END AS Class, CASE WHEN l_returnflag = 'R' THEN 'registrant' ELSE 'counterparty' END AS PartyRole
        FROM lineitem""",
    "gazetteer": """
        SELECT DISTINCT upper(concat('Port ', CASE WHEN l_partkey % 3 = 0 THEN 'ham' ELSE 'Ville' END, CAST(l_partkey % 29 AS STRING))) AS PlaceKey,
            CASE l_suppkey % 4 WHEN 0 THEN 'Country' WHEN 1 THEN 'US State' WHEN 2 THEN 'US County' ELSE 'US Populated Place' END AS Class,
            lower(concat('Port ', CASE WHEN l_partkey % 3 = 0 THEN 'ham' ELSE 'Ville' END, CAST(l_partkey % 29 AS STRING))) AS Unit,
            CASE WHEN l_partkey % 29 % 5 = 0 THEN 'nan' ELSE concat('S', CAST(l_partkey % 29 AS STRING)) END AS State, concat('C', CAST(l_partkey % 29 AS STRING)) AS County,
            CASE WHEN l_partkey % 29 % 3 = 0 THEN 'CA-QC' WHEN l_partkey % 29 % 3 = 1 THEN 'MX' ELSE 'nan' END AS Iso2, CASE WHEN l_suppkey % 4 = 0 AND l_partkey % 29 % 4 <> 0 THEN 'DEU' ELSE 'nan' END AS Iso3,
            CAST(CASE WHEN l_partkey % 29 % 7 = 3 THEN 2 ELSE 1 END AS BIGINT) AS NParent
        FROM lineitem""",
    # Contract prose, made of an order's columns.
    "contracts": """
        SELECT o_orderkey AS DocID, concat('This Agreement is dated as of ', DATETEXT(o_orderdate), ' between CUSTOMER ', CAST(o_custkey AS STRING), ' HOLDINGS, INC. and ACME TRADING L.P. It shall continue in effect for a period of ',
            CASE WHEN o_orderkey % 3 = 0 THEN 'five (5) years' WHEN o_orderkey % 3 = 1 THEN 'thirty (30) days' ELSE '18 months' END, '. The price is $', MONEYTEXT(o_totalprice),
            CASE WHEN o_orderkey % 4 = 0 THEN ' subject to [***]' WHEN o_orderkey % 4 = 1 THEN ' of which [CONFIDENTIAL TREATMENT REQUESTED]' WHEN o_orderkey % 4 = 2 THEN ' plus USD 45,000' ELSE ' or EUR 3 million' END,
            '. This Agreement shall be governed by the laws of the State of ', CASE WHEN o_orderkey % 2 = 0 THEN 'New York' ELSE 'Delaware' END, '. Notice is given at Springfield, Illinois.') AS Text
        FROM orders""",
}


def _for_spark(sql: str) -> str:
    sql = re.sub(r"DATETEXT\((\w+)\)", r"date_format(\1, 'MMMM d, yyyy')", sql)
    return re.sub(r"MONEYTEXT\((\w+)\)", r"format_number(\1, 2)", sql)


def _for_oracle(sql: str) -> str:
    sql = re.sub(r"DATETEXT\((\w+)\)", r"strftime(\1, '%B %-d, %Y')", sql)
    return re.sub(r"MONEYTEXT\((\w+)\)", r"format('{:,.2f}', \1)", sql)


class Tables:
    """Tables and shapes of one folder, by name; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in SHAPES:
            raise AttributeError(name)
        return self._shape(_for_spark(SHAPES[name]))

    def placed(self, name: str) -> DataFrame:
        """A shape of the rows of one table, with the place of each row in its files, _place: of rows that an order leaves
        tied, the first in the input is taken, whatever the partitions."""
        sql = re.sub(r"\n(\s+)FROM ", r", _place\n\1FROM ", _for_spark(SHAPES[name]), count=1)
        return self._shape(sql, F.struct("_metadata.file_path", "_metadata.row_index").alias("_place"))

    def _shape(self, sql: str, *more: Column) -> DataFrame:
        used = {t: getattr(self, t).select("*", *more) for t in TABLES if re.search(rf"\b{t}\b", sql)}
        # Tables are bound to the query by name; nothing stays registered in the session.
        return self.spark.sql(re.sub(r"\bFROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in used else m[0], sql), **used)


def oracle(sql: str) -> str:
    """``sql`` with the shapes that it names defined in front of it."""
    used = [n for n in SHAPES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    parts = ", ".join(f"{n} AS ({_for_oracle(SHAPES[n])})" for n in used)
    recursive = re.match(r"\s*WITH RECURSIVE\b", sql, re.I)
    rest = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql, flags=re.I) if re.match(r"\s*WITH\b", sql, re.I) else f" {sql}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{rest}"
