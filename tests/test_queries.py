"""Every registered query of the library beside its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

from ledgerloom.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture
def tied(tmp_path):
    """Two clauses of one place and number, in this order, and a place name within them; an order without clauses."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from datetime import datetime

    day = datetime(2001, 2, 3)
    line = lambda flag, status, quantity, number: {"l_orderkey": 1, "l_partkey": 8, "l_suppkey": 5, "l_linenumber": number, "l_quantity": quantity, "l_extendedprice": 1.0, "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": flag, "l_linestatus": status, "l_shipdate": day}
    lines = [line("A", "O", 9.0, 3), line("N", "O", 5.0, 3), line("N", "O", 9.0, 3), line("N", "O", 2.0, 2)]
    pq.write_table(pa.Table.from_pylist(lines).cast(pq.read_schema(f"{FOLDER}/lineitem.parquet"), safe=False), tmp_path / "lineitem.parquet")
    orders = pq.read_table(f"{FOLDER}/orders.parquet").slice(0, 2).to_pylist()
    pq.write_table(pa.Table.from_pylist([o | {"o_orderkey": k} for k, o in enumerate(orders, 1)], pq.read_schema(f"{FOLDER}/orders.parquet")), tmp_path / "orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("name", "want"), [("ent_party_facts", (1, "P0", "cofiler", 1, 8, 17)), ("ent_party_names", (1, "P0", "RedactExplicit", False, 3, 17))])
def test_of_tied_rows_the_first_in_the_input_counts(spark, tied, name, want):
    assert [tuple(r) for r in QUERIES[name](spark, tied).collect()] == [want]


def test_the_first_of_tied_parties_is_located(spark, tied):
    assert {tuple(r) for r in QUERIES["ent_locate_party"](spark, tied).collect()} == {(1, "P0", 8, "first"), (2, None, None, "no entity")}


def test_repeated_clauses_are_one_row(spark, tied):
    assert [tuple(r) for r in QUERIES["geo_release_law"](spark, tied).orderBy("Stop").collect()] == [(1, 8, 13, 3, "RedactExplicit"), (1, 8, 17, 3, "RedactExplicit")]


@pytest.mark.parametrize(("name", "column"), [("ent_party_facts", "l_partkey"), ("ent_party_names", "l_partkey"), ("ent_party_names", "l_quantity"), ("ent_party_names", "l_linestatus"), ("ent_locate_party", "l_partkey"), ("itm_runs", "l_quantity"), ("itm_run_sum", "l_quantity"), ("itm_run_paste", "l_quantity")])
def test_nulls_are_last_as_in_sql(spark, tmp_path, name, column):
    """Five lines an order, one without a number, in any sequence; some nulls in a column. No two are tied, as SQL may take any of tied rows."""
    import random
    from datetime import datetime

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    draw, lines = random.Random(5), []
    for key in range(1, 41):
        for number in draw.sample([1, 2, 3, 4, None], 5):
            line = {"l_orderkey": key, "l_partkey": draw.randint(1, 900), "l_suppkey": 5, "l_linenumber": number, "l_quantity": float(draw.randint(1, 50)), "l_extendedprice": 1.0, "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": draw.choice("ARN"), "l_linestatus": draw.choice("FO"), "l_shipdate": datetime(2001, 2, 3)}
            lines.append(line | ({column: None} if draw.random() < 0.4 else {}))
    pq.write_table(pa.Table.from_pylist(lines).cast(pq.read_schema(f"{FOLDER}/lineitem.parquet"), safe=False), tmp_path / "lineitem.parquet")
    pq.write_table(pa.Table.from_pylist([{"o_orderkey": k} for k in range(1, 43)], pq.read_schema(f"{FOLDER}/orders.parquet")), tmp_path / "orders.parquet")
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    assert differences(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) == ""
