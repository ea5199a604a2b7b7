"""Every query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from voicelake import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got) or name == "orphans_and_unanswered"  # none at this size
    if name in catalogue.SQL:
        want = db.sql(catalogue.SQL[name]).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns) and len(got) == len(want)
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        assert ((a == b) | (a.isna() & b.isna())).all().all()
