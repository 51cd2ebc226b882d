"""The incremental store, publishing, parties, and other operators without SQL."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import spans as S
from ledgerloom.operators import classify as C
from ledgerloom.operators import joins as J
from ledgerloom.operators import parties as P
from ledgerloom.operators.joins import assert_unique, no_collision
from ledgerloom.operators.windows import folds
from ledgerloom.plans.aggregate_queries import ntile_all
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.sources import files as X
from ledgerloom.sources.tables import Tables
from ledgerloom.streaming import store as St


@pytest.fixture
def store(spark, tmp_path):
    return St.Store(spark, str(tmp_path / "store"))


def docs_of(spark, *ids):
    return spark.createDataFrame([(i, f"On March {i}, 2011" if i % 2 else "nothing") for i in ids], "DocID long, Text string")


def run(store, corpus, **more):
    return store.run_pass(corpus, lambda d: S.extract(d, ["DATE", "MONEY"], model="m"), "m", ["DATE", "MONEY"], "spec", **more)


def test_a_pass_does_only_what_is_pending(spark, store):
    assert run(store, docs_of(spark, 1, 2, 3)) == 3
    assert run(store, docs_of(spark, 1, 2, 3, 4, 5)) == 2
    assert run(store, docs_of(spark, 1, 2, 3, 4, 5)) == 0
    got = {(r.DocID, r.Entity): r.Status for r in store.ledger.collect()}
    assert got == {(i, e): "hit" if e == "DATE" and i % 2 else "nohit" for i in range(1, 6) for e in ("DATE", "MONEY")}
    assert sorted(r.DocID for r in store.spans("DATE", S.SCHEMA).collect()) == [1, 3, 5]


def test_a_pass_that_dies_is_repeated_without_doubles(spark, store, monkeypatch):
    """The first run dies after its spans and before its outcomes; passes append and rewrite nothing."""
    whole = store.write_outcomes
    monkeypatch.setattr(store, "write_outcomes", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(store, docs_of(spark, 1, 2, 3))
    monkeypatch.setattr(store, "write_outcomes", whole)
    first = store._parts("spans-DATE")
    assert store.ledger.count() == 0 and run(store, docs_of(spark, 1, 2, 3)) == 3
    assert sorted(r.DocID for r in store.spans("DATE", S.SCHEMA).collect()) == [1, 3]
    assert store._parts("spans-DATE")[: len(first)] == first


def test_spans_of_a_document_read_again_are_replaced_also_by_none(spark, store):
    schema = "DocID long, Start long"
    both, none = spark.createDataFrame([(1, 5), (2, 6)], schema), spark.createDataFrame([], schema)
    store.write_spans("X", both, both)
    store.write_spans("X", both.where("DocID = 1"), none)
    assert [tuple(r) for r in store.spans("X", schema).collect()] == [(2, 6)]


def test_many_parts_become_one(spark, store, monkeypatch):
    monkeypatch.setattr(St, "COMPACT", 3)
    for i in range(1, 7):
        run(store, docs_of(spark, *range(1, i + 1)))
    assert len(store._parts("ledger")) <= 4 and len(store._parts("spans-DATE")) <= 4
    assert sorted(r.DocID for r in store.spans("DATE", S.SCHEMA).collect()) == [1, 3, 5]
    assert store.ledger.count() == 12 and run(store, docs_of(spark, *range(1, 7))) == 0


def test_chunks_are_committed_one_by_one(spark, store):
    rules = lambda d: S.extract(d, ["DATE"], model="m")
    done = store.run_chunks(docs_of(spark, *range(1, 21)), rules, "m", ["DATE"], "spec", 3)
    assert sum(done) == 20 and len(done) == 3
    assert sum(store.run_chunks(docs_of(spark, *range(1, 25)), rules, "m", ["DATE"], "spec", 2)) == 4
    assert store.spans("DATE", S.SCHEMA).count() == 12


def test_cache_is_good_until_an_input_moves(spark, tmp_path):
    import time

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(source)
    assert not X.cache_hit(spark, out, [source])
    time.sleep(1.1)
    spark.range(3).write.parquet(out)
    assert X.cache_hit(spark, out, [source]) and not X.cache_hit(spark, out, [source], rerun=True)
    time.sleep(1.1)
    spark.range(4).write.mode("append").parquet(source)
    assert not X.cache_hit(spark, out, [source]) and not X.cache_hit(spark, out, [str(tmp_path / "gone")])


def test_limits_draw_the_same_documents(spark, store):
    corpus = docs_of(spark, *range(1, 30))
    draw = lambda: [r.DocID for r in store.pending(corpus, "m", ["DATE"], 5).collect()]
    assert draw() == draw() and len(draw()) == 5


def test_a_moved_spec_is_refused_until_cleared(spark, store):
    run(store, docs_of(spark, 1))
    with pytest.raises(ValueError):
        store.register_model("m", ["DATE"], "other")
    store.clear("m")
    store.register_model("m", ["DATE"], "other")
    assert store.ledger.count() == 0


def test_failures_outrank_hits(spark, store):
    docs = docs_of(spark, 1, 2)
    found = spark.createDataFrame([(1, "DATE", "Text", 3), (1, None, "error:ValueError", None)], "DocID long, Label string, LabelRaw string, Start long")
    store.write_outcomes(docs, found, "m", ["DATE"])
    assert {(r.DocID, r.Status) for r in store.ledger.collect()} == {(1, "error"), (2, "nohit")}


def test_columns_of_a_table_are_fixed(spark, store):
    rows = spark.createDataFrame([(1, 2)], "DocID long, Start long")
    store.write_spans("X", rows, rows)
    with pytest.raises(ValueError):
        store.write_spans("X", rows, rows.withColumn("New", F.lit(1)))


def test_publishing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 3000, True)], ["a column with spaces and many letters in it", "b", "c"])
    ready = X.stata_ready(df)
    assert all(len(c) <= 32 and " " not in c for c in ready.columns) and len(ready.first()[1]) == 2045
    with pytest.raises(ValueError):
        X.conform(df, [X.Field("missing", "int")])
    with pytest.raises(ValueError):
        X.codebook(df, {"b": "text"})
    with pytest.raises(ValueError):
        no_collision(df, df, ["b"])
    with pytest.raises(ValueError):
        assert_unique(df.union(df), "b")
    assert X.folder_stamp(spark.createDataFrame([("p", 3)], "Path string, Bytes long")).count() == 1


def test_parties_of_long_chains_settle(spark):
    """A chain of 40 names, each the start of the next: more steps than any fixed number of rounds once allowed."""
    rows = [(1, " ".join(f"W{j}" for j in range(i + 1))) for i in range(40)]
    got = P.group_parties(spark.createDataFrame(rows, "DocID long, Key string")).collect()
    assert {r.PartyKey for r in got} == {"W0"}


def test_parties_merge_within_a_document(spark):
    rows = [(1, "ACME"), (1, "ACME TRADING"), (1, "ACME TRADING NORTH"), (1, "BETA"), (1, "GAMMA BETA"), (2, "BETA"), (2, "X BETA"), (2, "Y BETA"), (3, "ACME")]
    got = {(r.DocID, r.Key): (r.PartyKey, r.MergeKind) for r in P.group_parties(spark.createDataFrame(rows, "DocID long, Key string")).collect()}
    assert got[1, "ACME TRADING NORTH"] == ("ACME", "prefix") and got[1, "GAMMA BETA"] == ("BETA", "fragment")
    assert got[2, "BETA"] == ("BETA", "alone") and got[2, "X BETA"][0] == "X BETA" and got[3, "ACME"] == ("ACME", "alone")


def test_pairs_by_stretches_are_those_of_all_pairs(spark, monkeypatch):
    """Spans that cross many stretches, touch edges or lie apart: the pairs within reach, each once."""
    import random

    monkeypatch.setattr(J, "BIN", 50)
    rng = random.Random(6)
    draw = lambda: [(rng.randrange(3), a, a + rng.choice([1, 10, 49, 50, 51, 220])) for a in (rng.choice([rng.randrange(600), 50 * rng.randrange(12)]) for _ in range(60))]
    spans, others = draw(), draw()
    for reach in (0, 10, 130):
        left = spark.createDataFrame([(*x, i) for i, x in enumerate(spans)], "DocID long, Start long, Stop long, I long")
        right = spark.createDataFrame([(*x, i) for i, x in enumerate(others)], "DocID long, A long, B long, K long")
        got = [(r.I, r.K) for r in J.near_pairs(left, right, "A", "B", reach).where(f"greatest(A - Stop, Start - B, 0) <= {reach}").collect()]
        want = [(i, k) for i, (d, a, b) in enumerate(spans) for k, (e, x, y) in enumerate(others) if d == e and max(x - b, a - y, 0) <= reach]
        assert sorted(got) == want


def test_greedy_cover_is_the_plain_loop(spark):
    power = {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.6}
    held = {"a": {1, 2, 3}, "b": {2, 3}, "c": {3, 4, 5}, "d": {6}}
    stats = spark.createDataFrame([("K", t, p) for t, p in power.items()], "Class string, Term string, Power double")
    incidence = spark.createDataFrame([("K", d, t) for t, ds in held.items() for d in ds], "Class string, DocID long, Term string")
    size = spark.createDataFrame([("K", 10)], "Class string, NClass long")
    got = [(r.Term, r.Rank, r.Gain, r.Covered) for r in C.greedy_cover(stats, incidence, size, 0.15).orderBy("Rank").collect()]
    assert got == [("a", 1, 3, 3), ("c", 2, 2, 5)]


def test_folds_are_even_and_repeat(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}") for i in range(300)], "DocID long, Class string")
    got = folds(df, "Class", "DocID").toPandas()
    sizes = got.groupby(["Class", "Fold"]).size()
    assert sizes.max() - sizes.min() <= 1
    again = folds(df.repartition(5), "Class", "DocID").toPandas()
    assert got.sort_values("DocID").Fold.tolist() == again.sort_values("DocID").Fold.tolist()


def test_ntile_over_the_whole_table(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(23)], "k long, v long")
    got = ntile_all(df, 4, "v", "k", name="t").toPandas().sort_values(["v", "k"]).t.tolist()
    assert got == [1] * 6 + [2] * 6 + [3] * 6 + [4] * 5


def test_events_as_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "events")
    events.write.parquet(source)
    stream = St.event_counts(spark.readStream.schema(events.schema).parquet(source))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = St.event_counts(events).toPandas()
    got = spark.table("counted").toPandas()
    key = ["WindowStart", "event_type"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_split_check_reads_each_side_once(spark):
    from ledgerloom.plans.catalog import QUERIES

    plan = QUERIES["apl_check_split"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # the whole and its halves


def test_outcomes_meet_the_spans_once(spark, store, monkeypatch):
    """Failures before hits, an outcome for every document and entity, and one join of documents with what was found."""
    added = []
    add = store._add
    monkeypatch.setattr(store, "_add", lambda table, rows, *rest: (added.append(rows), add(table, rows, *rest)))
    rows = [(1, "A", "x", 3), (1, "A", "x", 9), (2, None, "timeout:T", None), (2, "A", "x", 1), (2, None, "error:E", None), (3, "B", "x", 0), (4, None, None, None), (9, "A", "x", 1)]
    found = spark.createDataFrame(rows, "DocID long, Label string, LabelRaw string, Start long")
    store.write_outcomes(docs_of(spark, 1, 2, 3, 4, 5, 5), found, "m", ["A", "B"])
    got = sorted((r.DocID, r.Entity, r.Status) for r in store.ledger.collect())
    assert got == [(1, "A", "hit"), (1, "B", "nohit"), (2, "A", "error"), (2, "B", "error"), (3, "A", "nohit"), (3, "B", "hit"), (4, "A", "nohit"), (4, "B", "nohit"), (5, "A", "nohit"), (5, "B", "nohit")]
    assert added[0]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_texts_of_chunks_are_stored_once(spark, store):
    import os

    assert sum(store.run_chunks(docs_of(spark, *range(1, 9)), lambda d: S.extract(d, ["DATE"], columns=["DocID", "Start", "Label", "LabelRaw"]), "m", ["DATE"], "spec", 3)) == 8
    assert sorted(os.listdir(f"{store.folder}/staged")) == ["chunks", "spans"]
    assert sorted(r.DocID for r in store.spans("DATE", "DocID long, Start long, Label string, LabelRaw string").collect()) == [1, 3, 5, 7]


def test_offsets_of_every_entity_and_document_are_audited(spark, tmp_path, monkeypatch):
    """All spans are moved by one: the audit counts each of them, of three entities and all documents."""
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(24).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    extract = S.extract
    found = extract(Tables(spark, str(tmp_path)).contracts, ["DATE", "MONEY", "REDACT"]).where("Start is not null").select("DocID", "Label").collect()
    assert len({r.DocID for r in found}) == 24 and {r.Label for r in found} == {"DATE", "MONEY", "REDACT"}
    monkeypatch.setattr(S, "extract", lambda *a, **k: extract(*a, **k).withColumn("Start", F.col("Start") + 1))
    assert QUERIES["ent_check_offsets"](spark, str(tmp_path)).first()[0] == len(found)
