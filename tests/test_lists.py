import pytest

from quillstone import lists

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["token_reconciled", "token_holders"])
def test_tasks_follow_the_lines(spark, monkeypatch, name):
    """Ten times the lines are ten times the tasks that join and group them, so that a task's memory stays as it is."""
    monkeypatch.setattr(lists, "LINES", 200, raising=False)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    held = lists.t(spark, DATA, "lineitem")
    rows = lists.lines_of_orders(lists.t(spark, DATA, "orders"), held, lists.parts_of(held))
    assert rows.rdd.getNumPartitions() == -(-lines // 200) > 20
    plan = getattr(lists, name)(spark, DATA)._jdf.queryExecution().toString()
    assert f", {-(-lines // 200)})" in plan and "REPARTITION_BY_NUM" in plan
