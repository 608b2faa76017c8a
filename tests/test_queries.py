"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tests.conftest import SF
from voltframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return int(v) if hasattr(v, "__index__") else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_queries_without_sql_run_and_agree_with_themselves(spark, name):
    first = registry.QUERIES[name](spark, SF)
    assert rows(first.toPandas()) == rows(registry.QUERIES[name](spark, SF).toPandas())
