"""Every query with SQL against DuckDB on the smallest tables, and the entry module's contract."""

import math
import os

import duckdb
import pytest
from slotstream.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the bundled tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def rows(items):
    return sorted((tuple(map(plain, r)) for r in items), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for n in NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_wire_headers_agree_with_their_rows(spark):
    got = catalog.QUERIES["shred_wire_roundtrip"](spark, SF).collect()
    assert {r.type for r in got} >= {"Data", "Code"}
    assert all(r.n == r.same for r in got if r.error is None)
    assert all(r.error == "bad_coding" for r in got if r.error is not None)


def test_rs_recover_runs_every_set(spark):
    from slotstream.sources import tables

    got = {(r.slot, r.fec_set): (r.recovered, r.exact) for r in catalog.QUERIES["rs_recover"](spark, SF).collect()}
    keys = [tuple(r) for r in tables.VIEWS["v_shred"](spark, SF).select("slot", "fec_set").distinct().collect()]
    assert got == {(s, f): (len({(s + f) % 4, (s * 3 + 1) % 4}), True) for s, f in keys}


def test_entrypoint_rank_beyond_ten_thousand_peers(spark):
    from slotstream.plans import peers

    n = 10_020  # odd stakes come first in the result, and here last in rank
    rows = spark.range(n).selectExpr("id AS pubkey", "7L AS shred_version", f"CASE WHEN id < {n - 20} THEN 100000 - 2 * id ELSE 99 END AS stake")
    got = peers.entrypoint_rank(rows).collect()
    assert [tuple(r) for r in got] == [(n - 20 + k, n - 19 + k, 49) for k in range(15)]


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns[0] == "slot" and frame.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
