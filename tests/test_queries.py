"""Each query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from contactloom.plans import more, numeric, relational

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted({**relational.SQL, **more.SQL}))
def test_same_as_sql(spark, db, name):
    got, want = {**relational.QUERIES, **more.QUERIES}[name](spark, SF).toPandas(), db.execute({**relational.SQL, **more.SQL}[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    got, want = (x[names].sort_values(names).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["distance_expected_isotonic", "classwise_balance", "hmm_segments", "cluster_candidates", "structure_coords"])
def test_kernels_give_rows(spark, name):
    assert numeric.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
