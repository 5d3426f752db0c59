"""Every registered query of the reference's operators against its oracle, at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from siltstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def normal(frame):
    def one(x):
        if isinstance(x, np.ndarray):
            return repr(x.tolist())
        if x is None or pd.isna(x):
            return "null"
        if isinstance(x, float | np.floating):
            return str(int(x)) if float(x).is_integer() else repr(round(float(x), 9))
        return str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(one, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.toPandas()) == normal(want.df())


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_module(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "id", "score", "rank"]
