import duckdb
import pytest

from specloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    clean = lambda v: None if v is None or v != v else v
    rows = lambda frame: sorted(repr([clean(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
    ours, theirs = Q.QUERIES[name](spark, DATA).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_registry():
    numbers = sorted(int(name[2:].split("_")[0]) for name in Q.QUERIES)
    assert numbers == list(range(1, 11)) and set(Q.ORACLE_SQL) <= set(Q.QUERIES)
