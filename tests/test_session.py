"""Tables in the shared folder."""

from frameloom.session import drop_written, written


def test_written_and_dropped(spark):
    made = written(spark.range(10).selectExpr("id", "id % 3 AS k"))
    assert made.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") in ("false", "true")
    drop_written(spark)
    empty = written(spark.range(0))
    assert empty.count() == 0 and empty.dtypes == spark.range(0).dtypes
