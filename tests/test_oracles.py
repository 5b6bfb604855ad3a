"""Every query with SQL against DuckDB on the smallest tables, and a run of those without."""

import duckdb
import pytest

from lattica.plans import kernel_queries, scene_queries, space_queries  # noqa: F401  (register more queries)
from lattica.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for name in frame.columns:
        if frame[name].dtype.kind in "iufb":
            frame[name] = frame[name].astype(float).round(6)
    return sorted((tuple(map(str, r)) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    ours, theirs = plans.QUERIES[name](spark, sf).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
