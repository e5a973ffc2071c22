"""Operators that SQL can express, against their SQL."""

import duckdb
import pytest

from twinspect.llm import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    """The rows in an order of their own; integers with and without missing values are the same numbers."""
    value = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    plain = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(value, r)) for r in plain.where(plain.notna(), None).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_operator_equals_its_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)
