"""Files: listing, reading by path, schema-driven writing, publishing with a manifest.

Paths go through Spark's readers and the Hadoop file system, never through the local one.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a local session takes a temporary one; on a cluster no
    folder is known to be shared, so there it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written to a scratch folder and read again: cuts lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_files(spark: SparkSession, folder: str, id_name: str = "DocID", recursive: bool = False) -> DataFrame:
    """(id, Path, Bytes) of the files of a folder; the id is the file's stem. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias(id_name), F.col("path").alias("Path"), F.col("length").alias("Bytes"))


def document_path(mirror: Column, doc_type: Column, quarter: Column, doc_id: Column) -> Column:
    """A document's path as a function of type, quarter (2012.3 is 2012-3) and id."""
    return F.concat_ws("/", mirror, doc_type, F.replace(quarter.cast("string"), F.lit("."), F.lit("-")), F.concat(doc_id.cast("string"), F.lit(".parquet")))


def read_documents(spark: SparkSession, paths: Sequence[str], id_column: str = "DocID", text_column: str = "Text", max_chars: int = 0) -> DataFrame:
    """(DocID, Text) of parquet files and folders, two columns read; ``max_chars`` cuts texts and keeps offsets."""
    if not paths:
        raise ValueError("no inputs")
    text = F.col(text_column) if not max_chars else F.substring(text_column, 1, max_chars)
    return spark.read.option("recursiveFileLookup", "true").parquet(*paths).select(F.col(id_column).alias("DocID"), text.alias("Text"))


def clean_landing(raw: DataFrame, dates: Sequence[str] = (), numbers: Sequence[str] = (), nothing: Sequence[str] = ("", "NONE")) -> DataFrame:
    """All columns trimmed, marks of nothing as null, dates and integers read where they can be."""
    out = []
    for c in raw.columns:
        value = F.trim(F.col(c).cast("string"))
        value = F.when(~value.isin(list(nothing)), value)
        out.append((value.try_cast("date") if c in dates else value.try_cast("bigint") if c in numbers else value).alias(c))
    return raw.select(*out)


@dataclass(frozen=True)
class Field:
    """A published column: its name, type, and the expression that gives it (its own name if none)."""

    name: str
    kind: str
    expression: str | None = None


def conform(df: DataFrame, schema: Sequence[Field]) -> DataFrame:
    """Exactly the declared columns, in order and of their types; others are dropped, missing ones are errors."""
    if lost := [f.name for f in schema if f.expression is None and f.name not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df.select(*[F.expr(f.expression or f"`{f.name}`").cast(f.kind).alias(f.name) for f in schema])


def write_declared(df: DataFrame, schema: Sequence[Field], path: str, format_: str = "parquet", rows_per_group: int | None = None) -> None:
    """Write through a schema; an error if the table's columns are not exactly those of the schema's sources.

    Parquet is compressed by zstd, CSV by gzip; Spark's committer makes the files appear together or not at all.
    """
    writer = conform(df, schema).write.mode("errorifexists")
    if format_ == "csv":
        writer.option("header", "true").option("compression", "gzip").csv(path)
    else:
        if rows_per_group:
            writer = writer.option("parquet.block.row.count.limit", str(rows_per_group))
        writer.option("compression", "zstd").parquet(path)


def codebook(df: DataFrame, about: dict[str, str]) -> DataFrame:
    """(Column, Type, About): a dictionary of the table; columns and dictionary must be the same set."""
    if set(df.columns) != set(about):
        raise ValueError(f"dictionary and table differ: {sorted(set(df.columns) ^ set(about))}")
    return df.sparkSession.createDataFrame([(c, t, about[c]) for c, t in df.dtypes], "Column string, Type string, About string")


def stata_ready(df: DataFrame, most: int = 2045) -> DataFrame:
    """Names of at most 32 letters, digits and underscores, all different; booleans as integers; strings cut."""
    taken: set[str] = set()
    out = []
    for name, kind in df.dtypes:
        short = stem = re.sub(r"[^A-Za-z0-9_]", "_", name)[:32] or "v"
        k = 1
        while short.lower() in taken:
            k += 1
            short = f"{stem[: 31 - len(str(k))]}_{k}"
        taken.add(short.lower())
        column = F.col(f"`{name}`")
        out.append((column.cast("int") if kind == "boolean" else F.substring(column, 1, most) if kind == "string" else column).alias(short))
    return df.select(*out)


def folder_stamp(files: DataFrame, extra: str = "") -> DataFrame:
    """One hash of a listing (its number, bytes and names) and of ``extra``: what a cache is keyed by."""
    return files.agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum("Bytes"), F.sum(F.xxhash64("Path").cast("decimal(38,0)")), F.lit(extra)), 256).alias("Stamp"))


def _moved(spark: SparkSession, path: str) -> int | None:
    """When anything of a file or folder was last written, in milliseconds; None where there is nothing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    last, files = 0, fs.listFiles(at, True)
    while files.hasNext():
        last = max(last, files.next().getModificationTime())
    return last


def cache_hit(spark: SparkSession, out: str, inputs: Sequence[str], rerun: bool = False) -> bool:
    """Whether ``out`` is there and newer than all its inputs; an input that is not there makes it stale."""
    made, moved = _moved(spark, out), [_moved(spark, p) for p in inputs]
    return not rerun and made is not None and None not in moved and all(made >= m for m in moved)


def column_report(df: DataFrame, declared: Sequence[str]) -> DataFrame:
    """(Column, Status): exported, left behind, or declared but absent."""
    here, want = set(df.columns), set(declared)
    rows = [(c, "exported" if c in here & want else "left behind" if c in here else "absent") for c in sorted(here | want)]
    return df.sparkSession.createDataFrame(rows, "Column string, Status string")
