"""Every query of the catalogue against its SQL, or at least for rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from weftline.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(rows):
    return sorted(tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf, db, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    rel = db.sql(catalog.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    assert got == plain(rel.project(",".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["conv_id", "n_messages", "fp", "is_dup", "score", "approved"]
