"""Physical plans: what must and must not be in them."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from greenframe.operators import telemetry as tm
from greenframe.plans.queries.support import phases, table, telemetry

QUERIES = entry.queries()
JOINING = [
    "green_score_by_phase", "phase_slices", "samples_in_calls", "co2_by_phase", "padded_runs", "best_rewrites", "result_differences",
    "join_through_sql", "table_metrics", "schema_insights", "numeric_description", "semantic_summary", "entity_sensitivity",
    "foreign_keys", "imputed_neighbours", "imputed_iteratively", "reviewed_values", "latency_distribution", "match_details",
    "synthetic_lines_compared", "synthetic_orders_checked",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINING)
def test_no_cross_joins(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(QUERIES["filter_less"](spark, folder))
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,20.0)]" in text
    assert "ReadSchema: struct<l_quantity:double>" in text


def test_intervals_join_on_equality(spark, folder):
    text = plan(tm.join_intervals(telemetry(spark, folder), phases(spark, folder), ["user_id"], "ts", "t_start", "t_end"))
    assert "_slot_at" in text and ("BroadcastHashJoin" in text or "SortMergeJoin" in text or "ShuffledHashJoin" in text)


def test_a_long_run_is_shuffled_once(spark, folder):
    """Beyond the shuffle of the samples there are only those of one row per part."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(tm.sample_dt(telemetry(spark, folder), ["user_id"], "ts", ["event_id"], parts=400))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    # samples by part; part ends by part and by run; the cuts and the carries are bounded by the shares and broadcast
    assert len(exchanges) == 3 and sum("_run_part" in line for line in exchanges) == 2
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") >= 2


def test_rank_limits_come_before_the_shuffle(spark, folder):
    from pyspark.sql import Window

    events = table(spark, folder, "events")
    order = Window.partitionBy("event_type").orderBy("value")
    text = plan(events.withColumn("r", F.row_number().over(order)).filter("r <= 5"))
    assert "WindowGroupLimit" in text and "Partial" in text
