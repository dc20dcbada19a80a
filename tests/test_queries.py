"""Every registered query with SQL gives the same rows as that SQL."""

import os

import duckdb
import pytest

from wayfare import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    order = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    assert columns == [cursor.description[i][0] for i in order]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())


def test_numbers_of_events_with_null_and_negative_ids(spark, tmp_path):
    """As in the SQL, no spelling goes to a row whose id leaves a remainder other than 0 to 4, or none."""
    rows = [(n, None if n is not None and n % 7 == 0 else v) for n in (*range(-12, 12), None) for v in (12.75, -0.5, 3e9)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = catalog.coerce_numeric(spark, str(tmp_path))
    assert df.columns == ["event_id", "as_int", "as_float"]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(catalog.ORACLE_SQL["coerce_numeric"]).fetchall()))
