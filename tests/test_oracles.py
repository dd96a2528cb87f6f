"""Every catalogue query against its DuckDB equivalent on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from proofline import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return base


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, numbers rounded, in order."""
    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
            return str(bool(x))
        try:
            return f"{float(x):.9g}"
        except (TypeError, ValueError):
            return str(x)

    columns = sorted(df.columns)
    return sorted(tuple(value(x) for x in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    a, b = plain(got), plain(want)
    assert len(a) == len(b) and a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
