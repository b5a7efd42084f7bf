"""Each registered query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from frameloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = ("events", "embeddings", "conversations", "lineitem")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (bool, int)):
        return round(float(value), 5)
    return value


def key(row):
    return tuple((v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(frame.columns)
    ours = sorted([tuple(plain(v) for v in r) for r in frame.select(*columns).collect()], key=key)
    sql = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted([tuple(plain(v) for v in r) for r in duck.execute(f"SELECT {sql} FROM ({catalogue.oracle_sql()[name]})").fetchall()], key=key)
    assert len(ours) == len(theirs)
    assert ours == theirs


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
def test_streaming_replay_equals_batch(spark):
    rows = [sorted(map(tuple, catalogue.queries()[n](spark, str(DATA)).collect())) for n in ("unit_filter_stream", "stateful_stream_replay")]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_folds_give_rows(spark, name):
    frame = catalogue.queries()[name](spark, str(DATA))
    assert frame.count() > 0
