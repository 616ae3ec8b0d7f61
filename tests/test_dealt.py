"""Large groupings are dealt over tasks of a size."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from tessera.operators import connections
from tessera.operators import graph as operators
from tessera.plans import graph as plans
from tessera.plans import registry, temporal
from tessera.sources import graph


def test_grouped_edges_stay_of_a_size_in_a_task(spark, monkeypatch):
    plain = graph.relation(spark, DATA, "edge").where("rel IN ('touched', 'supplied_by')")
    whole = rows(plain.toPandas())
    monkeypatch.setitem(graph.GROUPED, "edge", ("lineitem", "l_orderkey", 500))
    edges = graph.relation(spark, DATA, "edge").where("rel IN ('touched', 'supplied_by')")
    assert rows(edges.toPandas()) == whole
    assert edges.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0] < 1_500


def test_backlinks_are_the_same_when_dealt(spark, duck, monkeypatch):
    monkeypatch.setattr(plans, "LINES", 500)
    monkeypatch.setitem(graph.GROUPED, "edge", ("lineitem", "l_orderkey", 500))
    for name in ("backlinks", "outgoing"):
        assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).fetch_df())


@pytest.mark.parametrize("name", ["neighbourhood", "neighbourhood_fold"])
def test_neighbourhoods_are_dealt_by_the_line_items(spark, duck, monkeypatch, name):
    monkeypatch.setattr(plans, "LINES", 500)
    got = registry.queries()[name](spark, DATA)
    assert got.rdd.getNumPartitions() >= 10
    assert rows(got.toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).fetch_df())


def test_combined_top_ranks_as_grouped_top_does(spark):
    data = [(i % 7 if i % 11 else None, f"r{i * i % 3}", i * 37 % 500 if i % 13 else None) for i in range(5_000)]
    df = spark.createDataFrame(data, "id long, rel string, other long").repartition(5).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        got = rows(connections.combined_top(df, ["id", "rel"], "other", 3, tasks=9).toPandas())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == rows(connections.grouped_top(df, ["id", "rel"], [F.asc("other")], 3).toPandas())


def test_cochange_meets_over_tasks_of_a_size(spark, duck, monkeypatch):
    monkeypatch.setattr(operators, "MEETING", 500, raising=False)
    tasks, met = [], operators._met

    def seen(*args):
        tasks.append(met(*args))
        return tasks[-1]

    monkeypatch.setattr(operators, "_met", seen)
    assert rows(registry.queries()["cochange"](spark, DATA).toPandas()) == rows(duck.execute(registry.oracle_sql()["cochange"]).fetch_df())
    assert tasks[0].rdd.getNumPartitions() >= 10


def test_file_history_is_dealt_by_the_line_items(spark, duck, monkeypatch):
    monkeypatch.setattr(plans, "LINES", 500)
    got = registry.queries()["file_history"](spark, DATA)
    assert got.rdd.getNumPartitions() >= 10
    assert rows(got.toPandas()) == rows(duck.execute(registry.oracle_sql()["file_history"]).fetch_df())


def test_related_page_meets_nodes_over_tasks_of_a_size(spark, duck, monkeypatch):
    monkeypatch.setattr(plans, "NODES", 200, raising=False)
    tasks, stored = [], operators.stored
    monkeypatch.setattr(operators, "stored", lambda df: (tasks.append(df.rdd.getNumPartitions()), stored(df))[1])
    assert rows(registry.queries()["related_page"](spark, DATA).toPandas()) == rows(duck.execute(registry.oracle_sql()["related_page"]).fetch_df())
    assert tasks and tasks[0] >= 10


def test_path_periods_group_changes_once(spark, duck, monkeypatch):
    """Counts, periods along the chain, periods of all commits and the tree come from one grouping, dealt by the line items."""
    monkeypatch.setattr(temporal, "LINES", 500, raising=False)
    got = registry.queries()["path_periods"](spark, DATA)
    assert len(re.findall(r"Aggregate \[repository#\d+L?, path#\d+L?", got._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert rows(got.toPandas()) == rows(duck.execute(registry.oracle_sql()["path_periods"]).fetch_df())
