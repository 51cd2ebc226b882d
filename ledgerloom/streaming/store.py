"""The incremental store: a ledger of outcomes, spans of documents, a manifest of models.

A table is a folder of numbered parts, each a Parquet folder that is there once it is committed. A pass appends the
parts of its own documents and rewrites nothing; a reader takes, of each key, the rows of its latest part. After
``COMPACT`` parts a table's present rows are written as one full part, before which nothing is read. A job that dies leaves what
was committed before it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = "DocID long, Model string, Entity string, Status string, RunAt timestamp"
MANIFEST = "Model string, Entity string, SpecHash string"
COMPACT = 32  # parts of a table after which its present rows become one
STATUS = ["error", "timeout", "hit", "nohit"]  # an outcome earlier in the list wins


class Store:
    """A folder with the tables ledger, manifest, and spans by entity."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self, table: str) -> list[tuple[int, str]]:
        """(number, name) of the committed parts from the last full one on."""
        at = self._path(f"{self.folder}/{table}")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        found = sorted((int(n[1:]), n) for n in names if n[0] in "pf" and self._fs.exists(self._path(f"{self.folder}/{table}/{n}/_SUCCESS")))
        full = [i for i, (_, n) in enumerate(found) if n[0] == "f"]
        return found[full[-1] :] if full else found

    def append(self, table: str, rows: DataFrame, number: int | None = None, full: bool = False) -> None:
        """Commit a part; a full one stands for all before it, of which those before the last full one go."""
        before = self._parts(table)
        number = number or (before[-1][0] if before else 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/{'f' if full else 'p'}{number}")
        if full and before:
            for x in self._fs.listStatus(self._path(f"{self.folder}/{table}")):
                name = x.getPath().getName()
                if name[1:].isdigit() and int(name[1:]) < before[0][0]:
                    self._fs.delete(x.getPath(), True)

    def parts(self, table: str, schema: str) -> DataFrame:
        """All rows from the last full part on, with the number of their part."""
        paths = [f"{self.folder}/{table}/{n}" for _, n in self._parts(table)]
        part = F.regexp_extract(F.col("_metadata.file_path"), "/[pf]([0-9]+)/[^/]*$", 1).cast("long").alias("_part")
        return self.spark.read.schema(schema).parquet(*paths).select("*", part) if paths else self.spark.createDataFrame([], f"{schema}, _part long")

    def _latest(self, table: str, schema: str, key: Sequence[str]) -> DataFrame:
        """Of each key, its row in the latest part."""
        rows = self.parts(table, schema)
        rest = [c for c in rows.columns if c not in (*key, "_part")]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_part").alias("_row"))
        return last.select(*key, "_row.*").select(*[c for c in rows.columns if c != "_part"])

    def replace(self, table: str, rows: DataFrame) -> None:
        """A full part: what the table holds from now on."""
        self.append(table, rows, full=True)

    @property
    def ledger(self) -> DataFrame:
        return self._latest("ledger", LEDGER, ["DocID", "Model", "Entity"]).where("Status is not null")

    @property
    def manifest(self) -> DataFrame:
        return self._latest("manifest", MANIFEST, ["Model", "Entity"]).where("SpecHash is not null")

    def spans(self, entity: str, schema: str) -> DataFrame:
        """The spans that each document was given last; none where that was none."""
        rows = self.parts(f"spans-{entity}", schema)
        last = self.parts(f"docs-{entity}", "DocID long").groupBy("DocID").agg(F.max("_part").alias("_part"))
        return rows.join(last, ["DocID", "_part"], "left_semi").drop("_part")

    def pending(self, corpus: DataFrame, model: str, entities: Sequence[str], limit: int | None = None) -> DataFrame:
        """Documents without an outcome for every entity; a limit draws them in the order of md5(DocID)."""
        done = self.ledger.where((F.col("Model") == model) & F.col("Entity").isin(list(entities))).groupBy("DocID").agg(F.countDistinct("Entity").alias("k")).where(F.col("k") == len(set(entities)))
        left = corpus.join(done, "DocID", "left_anti")
        return left.orderBy(F.md5(F.col("DocID").cast("string"))).limit(limit) if limit else left

    def register_model(self, model: str, entities: Sequence[str], spec: str) -> None:
        """Record the hash of a model's constants; an error if it moved under the same name."""
        known = self.manifest
        moved = known.where((F.col("Model") == model) & F.col("Entity").isin(list(entities)) & (F.col("SpecHash") != spec)).count()
        if moved:
            raise ValueError(f"the constants of {model} changed; give it another name or clear it")
        new = self.spark.createDataFrame([(model, e, spec) for e in entities], MANIFEST)
        self._add("manifest", new.join(known, ["Model", "Entity"], "left_anti"), MANIFEST, ["Model", "Entity"])

    def _add(self, table: str, rows: DataFrame, schema: str, key: Sequence[str]) -> None:
        self.append(table, rows)
        if len(self._parts(table)) > COMPACT:
            self.replace(table, self._latest(table, schema, key))

    def write_outcomes(self, docs: DataFrame, found: DataFrame, model: str, entities: Sequence[str]) -> None:
        """An outcome for each document and entity, in place of earlier ones: error before timeout before hit.

        ``found`` has rows of spans (DocID, Label, LabelRaw, Start); a document without any has none.
        """
        status = F.when(F.col("LabelRaw").startswith("error:"), "error").when(F.col("LabelRaw").startswith("timeout:"), "timeout").when(F.col("Start").isNotNull(), "hit").otherwise("nohit")
        rank = F.array_position(F.array(*[F.lit(s) for s in STATUS]), status)
        # A document's rows are met once: its worst failure, if any, and the set of what it has spans of.
        failed = F.min(F.when(F.col("LabelRaw").rlike("^(error|timeout):"), rank)).alias("f")
        marks = found.groupBy("DocID").agg(failed, F.collect_set(F.when(F.col("Start").isNotNull(), F.col("Label"))).alias("hits"))
        grid = docs.select("DocID").distinct().join(marks, "DocID", "left").select("DocID", "f", "hits", F.explode(F.array(*[F.lit(e) for e in dict.fromkeys(entities)])).alias("Entity"))
        outcome = F.when(F.col("f").isNotNull(), F.element_at(F.array(*[F.lit(s) for s in STATUS]), F.col("f").cast("int"))).when(F.array_contains("hits", F.col("Entity")), "hit").otherwise("nohit")
        new = grid.select("DocID", F.lit(model).alias("Model"), "Entity", outcome.alias("Status"), F.current_timestamp().alias("RunAt"))
        self._add("ledger", new, LEDGER, ["DocID", "Model", "Entity"])

    def write_spans(self, entity: str, docs: DataFrame, rows: DataFrame) -> None:
        """The spans of ``docs`` in place of those they had; the table's columns are those of its first write."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        spans, ids = f"spans-{entity}", f"docs-{entity}"
        there = self._parts(spans)
        if there and self.spark.read.parquet(f"{self.folder}/{spans}/{there[0][1]}").dtypes != rows.dtypes:
            raise ValueError(f"the columns of {entity} are fixed")
        number = max([n for n, _ in there + self._parts(ids)], default=0) + 1
        self.append(spans, rows, number)
        self.append(ids, docs.select(F.col("DocID").cast("long")).distinct(), number)  # only now are the spans seen
        if len(self._parts(ids)) > COMPACT:
            whole = self.spans(entity, schema)
            every = self.parts(ids, "DocID long").select("DocID").distinct()
            self.append(spans, whole, number + 1, full=True)
            self.append(ids, every, number + 1, full=True)

    def clear(self, model: str, entity: str | None = None) -> None:
        """Forget one model, or one entity of it: later rows without an outcome hide those there were."""
        gone = (F.col("Model") == model) & (F.lit(entity is None) | (F.col("Entity") == F.lit(entity)))
        self._add("ledger", self.ledger.where(gone).withColumn("Status", F.lit(None).cast("string")), LEDGER, ["DocID", "Model", "Entity"])
        self._add("manifest", self.manifest.where(gone).withColumn("SpecHash", F.lit(None).cast("string")), MANIFEST, ["Model", "Entity"])

    def run_pass(self, corpus: DataFrame, extract: Callable[[DataFrame], DataFrame], model: str, entities: Sequence[str], spec: str, limit: int | None = None) -> int:
        """Extract what is pending; spans are written before outcomes, so a crash between repeats work and loses none."""
        self.register_model(model, entities, spec)
        todo, staged = self.pending(corpus, model, entities, limit), f"{self.folder}/staged/docs"
        todo.write.mode("overwrite").parquet(staged)
        return self._run(self.spark.read.schema(todo.schema).parquet(staged), extract, model, entities)

    def run_chunks(self, corpus: DataFrame, rules: Callable[[DataFrame], DataFrame], model: str, entities: Sequence[str], spec: str, chunks: int) -> list[int]:
        """A pass over what is pending, committed chunk by chunk: documents are dealt by a hash, once; the numbers of
        documents done are returned. A pass that dies does again only the chunks that it had not committed."""
        self.register_model(model, entities, spec)
        dealt = f"{self.folder}/staged/chunks"
        todo = self.pending(corpus, model, entities).withColumn("_chunk", F.pmod(F.xxhash64("DocID"), F.lit(chunks)))
        todo.write.mode("overwrite").partitionBy("_chunk").parquet(dealt)
        kept = self.spark.read.schema(todo.schema).parquet(dealt)
        return [self._run(kept.where(F.col("_chunk") == k).drop("_chunk"), rules, model, entities) for k in range(chunks)]

    def _run(self, docs: DataFrame, extract: Callable[[DataFrame], DataFrame], model: str, entities: Sequence[str]) -> int:
        """Extract ``docs``, which are stored: they are read again for each table that is written."""
        staged = f"{self.folder}/staged/spans"
        extract(docs).write.mode("overwrite").parquet(staged)
        found = self.spark.read.parquet(staged)
        for entity in entities:
            self.write_spans(entity, docs, found.where((F.col("Label") == entity) & F.col("Start").isNotNull()))
        self.write_outcomes(docs, found, model, entities)
        return docs.count()


def run_plan(corpus: DataFrame, ledger: DataFrame, runs: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(Model, Entity, nDone, nPending): what passes over the corpus would do, before any is started; no text is read."""
    wanted = corpus.sparkSession.createDataFrame([(m, e) for m, entities in runs for e in entities], "Model string, Entity string")
    done = ledger.join(corpus.select("DocID").distinct(), "DocID", "left_semi").groupBy("Model", "Entity").agg(F.countDistinct("DocID").alias("n"))
    size = corpus.agg(F.countDistinct("DocID").alias("all"))  # one row
    n = F.coalesce("n", F.lit(0)).cast("long")
    return wanted.join(done, ["Model", "Entity"], "left").crossJoin(size).select("Model", "Entity", n.alias("nDone"), (F.col("all") - n).alias("nPending"))


def policy_hash(parameters: dict, specs: Sequence[str]) -> str:
    """A name for a rule pass: sixteen digits of its parameters and of what it reads."""
    return hashlib.sha256(json.dumps([parameters, sorted(specs)], sort_keys=True).encode()).hexdigest()[:16]


def summary(ledger: DataFrame) -> DataFrame:
    """Outcomes by model and entity."""
    return ledger.groupBy("Model", "Entity").agg(F.count("*").alias("n"), *[F.count_if(F.col("Status") == s).alias(f"n_{s}") for s in STATUS])


def without_outcome(corpus: DataFrame, ledger: DataFrame, plan: Sequence[tuple[str, str]]) -> DataFrame:
    """(DocID, Model, Entity) that the plan wants and the ledger lacks."""
    wanted = corpus.sparkSession.createDataFrame(list(plan), "Model string, Entity string")
    return corpus.select("DocID").crossJoin(F.broadcast(wanted)).join(ledger, ["DocID", "Model", "Entity"], "left_anti")


def reconcile(wanted: DataFrame, cached: DataFrame, measure: Callable[[DataFrame], DataFrame], key: str = "DocID") -> DataFrame:
    """What is cached and still wanted, and a measure of the rest."""
    return cached.join(wanted, key, "left_semi").unionByName(measure(wanted.join(cached, key, "left_anti")))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """New rows in place of old ones of the same key; the columns ``keep`` stay as they first were."""
    first = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
    updated = new.join(first, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new, key, "left_anti").unionByName(updated)


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of events by type, for a batch or a stream (an extension: late events beyond the watermark
    are left out of a stream)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("Total")).select(F.col("w.start").cast("timestamp_ntz").alias("WindowStart"), "event_type", "n", "Total")


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """(user_id, Session, n, StartAt, StopAt): events of a user with no gap of more than ``gap_seconds`` between them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    marked = events.withColumn("new", F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0)).withColumn("Session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("user_id", "Session").agg(F.count("*").alias("n"), F.min("ts").alias("StartAt"), F.max("ts").alias("StopAt"))
