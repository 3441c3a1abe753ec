"""Every registered query with SQL against that SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from patchloom.plans import queries_code, queries_files, queries_refs, queries_splits, registry  # noqa: F401  they register their queries
from patchloom.plans.inputs import TABLES


@pytest.fixture(scope="module")
def oracle(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return connection


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(value: object) -> str:
        if value is None or value is pd.NA or value is pd.NaT or value != value:
            return "~"
        return str(round(float(value), 6)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    names = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, small, oracle, name):
    want, found = oracle.sql(registry.SQL[name]).df(), registry.QUERIES[name](spark, small).toPandas()
    assert sorted(want.columns) == sorted(found.columns)
    assert plain(want) == plain(found)


SLOW = {"forest_metrics", "svc_metrics", "adaboost_metrics"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - SLOW))
def test_query_runs(spark, small, name):
    registry.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
