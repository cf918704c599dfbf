import pytest

from mixloom import session


def test_driver_reads_are_bounded(spark):
    assert len(session.bounded_rows(spark.range(5), 5, "rows")) == 5
    with pytest.raises(ValueError, match="more than 4 rows"):
        session.bounded_rows(spark.range(5), 4, "rows")


def test_spread_reaches_all_cores(spark):
    few = spark.range(100).coalesce(1)
    assert session.spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(9)
    assert session.spread(many).rdd.getNumPartitions() == 9


def test_cut_forgets_its_plan(spark):
    df = session.cut(spark.range(10).selectExpr("id * 2 AS x"))
    assert sorted(r.x for r in df.collect()) == list(range(0, 20, 2))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_package_is_sent_once(spark):
    session.ship(spark)
    before = len(spark.sparkContext._python_includes)
    session.ship(spark)
    assert len(spark.sparkContext._python_includes) == before and "mixloom.zip" in spark.sparkContext._python_includes
