"""Domains at scale: functions are joined where they are, calls are found once."""

from pyspark.sql import functions as F

from logloom.operators import graph
from logloom.plans import domain_queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_functions_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: plans.append(_plan(df)) or write(df))
    functions, calls = domain_queries.modules_of(spark, SF)
    index = graph.domain_index(functions, calls, functions.select("fid", F.lit("").alias("summary")))
    told = [*plans, _plan(index)]
    # calls, edges of the index and of the search for wide functions, its five rounds, entries, the index
    assert len(told) == 10
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in told)


def test_calls_are_found_once(spark):
    _, calls = domain_queries.modules_of(spark, SF)
    assert not any("lineitem" in f for f in calls.inputFiles())
