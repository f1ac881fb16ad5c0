"""Every file-system query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sectorlake.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(ORACLES[name]).df()
    assert sorted(want.columns) == cols
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x
    text = lambda df: sorted(str(tuple(map(plain, row))) for row in df[cols].astype(object).itertuples(index=False, name=None))
    assert text(got.select(*cols).toPandas()) == text(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
