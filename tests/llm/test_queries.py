"""The registered queries against their SQL, and the pipeline, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from frameloom.llm import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    frame = registry.queries()[name](spark, str(DATA))
    columns = sorted(frame.columns)
    plain = lambda rows: sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(frame.select(*columns).collect()) == plain(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, str(DATA))
    assert set(docs.columns) < set(out.columns)
    n, ids = out.count(), out.select("doc_id").distinct().count()
    assert n == ids and 0.5 * docs.count() < n < docs.count()
