import duckdb
import pytest

import __spark_entry__ as entry
from specloom import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else v
    return columns, sorted(repr([clean(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["window_assign", "dft_mirror", "s1_auto", "s2_cross", "s3_auto_half", "s4_auto", "s3_relational", "s2_err", "spectrum_union", "s2_bounds", "s4_mask", "s2_arcsinh", "taper_table", "chunk_count",
     "s2_cross_arcsinh", "s2_display", "s3_display", "s4_display", "s4_mask_im", "map_limits_im", "order_fetch", "orders_signed", "cross_key_check", "save_load_roundtrip", "dft_coeffs_full", "s4_relational"]
)
def test_query_equals_sql(spark, duck, name):
    assert rows_of(entry.queries()[name](spark, DATA).toPandas()) == rows_of(duck.sql(entry.oracle_sql()[name]).df())
