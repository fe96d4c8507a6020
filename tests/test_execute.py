"""Workloads side by side: order of results does not matter, endless statements are stopped, nothing piles up."""

import threading

import pytest

from greenframe.operators import benchmark
from greenframe.plans import execute

ENDLESS = "SELECT sum(id % 7) AS s FROM range(0, 1000000000000000000, 1, 2)"


def test_two_hundred_statements_and_one_without_end(spark):
    statements = [(i, f"SELECT {i} AS a UNION ALL SELECT 0", "x") for i in range(200)]
    statements.insert(3, (999, ENDLESS, "x"))
    statements.insert(5, (998, "SELECT no_such_column", "x"))
    got = {r["query_id"]: r for r in execute.run_workload(statements, spark, at_once=8, limit_s=30.0).collect()}
    assert len(got) == 202 and got["999"]["error"] == "stopped after 30.0 s" and "no_such_column" in got["998"]["error"]
    assert all(got[str(i)]["rows"] == 2 and got[str(i)]["error"] is None for i in range(200))


def test_so_many_at_once_and_no_more(spark):
    running, most, lock = [0], [0], threading.Lock()

    def work(row, stopped):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        spark.range(1000).count()
        with lock:
            running[0] -= 1
        return (row,)

    got = execute.side_by_side(iter(range(12)), work, spark, "n int", at_once=3)
    assert sorted(r["n"] for r in got.collect()) == list(range(12)) and most[0] <= 3
    assert execute.side_by_side([], work, spark, "n int").count() == 0


def test_a_fault_of_the_work_is_raised(spark):
    def work(row, stopped):
        raise KeyError("fault")

    with pytest.raises(KeyError):
        execute.side_by_side(range(5), work, spark, "n int")


def test_pairs_that_do_not_end_are_wrong(spark):
    rows = [(1, "SELECT 1 AS a", "SELECT 1 AS a"), (2, "SELECT 1 AS a", "SELECT 2 AS a"), (3, ENDLESS, "SELECT 1 AS s"), (4, "SELECT", "SELECT 1")]
    pairs = spark.createDataFrame(rows, "query_id int, generated_sql string, ground_truth_sql string")
    got = dict(map(tuple, benchmark.execution_match_quality(pairs, spark, limit_s=30.0).collect()))
    assert got == {1: "Correct", 2: "Wrong", 3: "Wrong", 4: "Wrong"}
