"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from matchflow import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(df):
    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name in plans.ORACLES:
        want = duck.execute(plans.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
