"""Cutting long runs into parts must not change any result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from greenframe.operators import ordered as od
from greenframe.operators import telemetry as tm

RUN, TIE = ["run"], ["id"]


@pytest.fixture(scope="module")
def samples(spark):
    """One run with most of the rows, ties in time, a gap, small runs and a single sample."""
    rng = random.Random(3)
    rows, number = [], 0
    for run, count in (("hot", 900), ("small", 25), ("exact", 20), ("more", 21), ("one", 1)):
        at = datetime(2024, 1, 1)
        for i in range(count):
            at += timedelta(seconds=rng.choice([0, 1, 1, 2, 3600 if i == count // 2 else 1]))
            rows.append((run, at, number, rng.uniform(0, 100)))
            number += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, ts timestamp, id long, cpu_percent double")
    return tm.with_power(df).cache()


def same(a, b):
    def rows(df):
        return sorted((tuple(round(v, 7) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert rows(a) == rows(b)


def rates():
    return {"co2_g": F.col("co2_gs"), "energy_j": F.col("power_w")}


@pytest.mark.parametrize("parts", [24, 9])
def test_cut_equals_plain(samples, parts):
    same(tm.sample_dt(samples, RUN, "ts", TIE), tm.sample_dt(samples, RUN, "ts", TIE, parts))
    same(tm.integrate(samples, RUN, "ts", TIE, rates()), tm.integrate(samples, RUN, "ts", TIE, rates(), parts))
    same(tm.cumulative_co2(samples, RUN, "ts", TIE), tm.cumulative_co2(samples, RUN, "ts", TIE, parts=parts))
    same(tm.smooth(samples, RUN, "ts", TIE, "cpu_percent"), tm.smooth(samples, RUN, "ts", TIE, "cpu_percent", parts=parts))


def test_history_over_all_operations(samples):
    operations = samples.select("ts", "id", F.col("co2_gs").alias("co2_g"), F.col("power_w").alias("energy_wh"))
    same(tm.kpi_history(operations, "ts", TIE), tm.kpi_history(operations, "ts", TIE, parts=20))


def test_smoothing_starts_above_twenty_rows(samples):
    smoothed = {r["run"]: r for r in tm.smooth(samples, RUN, "ts", TIE, "cpu_percent").groupBy("run").agg(
        F.count("smooth").alias("n"), F.count_if(F.col("smooth") == F.col("cpu_percent")).alias("raw")).collect()}
    assert (smoothed["exact"]["n"], smoothed["exact"]["raw"]) == (20, 20)
    assert smoothed["more"]["n"] == 2


def test_a_single_sample_is_padded(samples):
    padded = tm.pad_single_sample(samples.select("run", "ts", "cpu_percent"), RUN, "ts")
    one = padded.filter("run = 'one'").orderBy("ts").collect()
    assert [r["cpu_percent"] for r in one][::2] == [0.0, 0.0] and len(one) == 3
    assert (one[2]["ts"] - one[0]["ts"]).total_seconds() == 2
    assert padded.count() == samples.count() + 2


def test_phase_boundaries_belong_to_both_phases(spark, samples):
    t0 = datetime(2024, 1, 1)
    points = spark.createDataFrame([("r", t0 + timedelta(seconds=i), i, 10.0) for i in range(7)], "run string, ts timestamp, id long, w double")
    marks = spark.createDataFrame(
        [("r", "a", t0, t0 + timedelta(seconds=2)), ("r", "b", t0 + timedelta(seconds=2), t0 + timedelta(seconds=5)),
         ("r", "empty", t0 + timedelta(hours=1), t0 + timedelta(hours=2)), ("x", "a", t0, t0 + timedelta(seconds=9))],
        "run string, phase string, t_start timestamp, t_end timestamp")
    found = {r["phase"]: r for r in tm.phase_integrals(points, marks, RUN, "phase", "ts", TIE, {"j": F.col("w")}).collect()}
    assert {p: (r["samples"], r["j"]) for p, r in found.items()} == {"a": (3, 20.0), "b": (4, 30.0)}
    cut = tm.phase_integrals(points, marks, RUN, "phase", "ts", TIE, {"j": F.col("w")}, parts=5)
    assert {r["phase"]: r["j"] for r in cut.collect()} == {"a": 20.0, "b": 30.0}


def test_a_sample_in_two_intervals_counts_once(spark, samples):
    t0 = datetime(2024, 1, 1)
    points = spark.createDataFrame([("r", t0 + timedelta(seconds=i)) for i in range(10)], "run string, ts timestamp")
    calls = spark.createDataFrame([("r", t0, t0 + timedelta(seconds=5)), ("r", t0 + timedelta(seconds=3), t0 + timedelta(seconds=6))],
                                  "run string, t_start timestamp, t_end timestamp")
    assert tm.in_any_interval(points, calls, RUN, "ts", "t_start", "t_end").count() == 7


def test_no_part_of_a_run_is_large(spark):
    """A burst of equal times, a dense run beside a long sparse one, and many short ones."""
    day = 86_400_000_000
    burst = spark.range(6000).selectExpr("'burst' AS run", "CASE WHEN id < 5000 THEN 7 ELSE id * 1000 END AS us", "id")
    dense = spark.range(5000).selectExpr("'dense' AS run", "id AS us", "id")
    sparse = spark.range(5000).selectExpr("'sparse' AS run", f"id * {day} AS us", "id")
    short = spark.range(4000).selectExpr("concat('s', id % 400) AS run", "id * 10 AS us", "id")
    df = burst.unionByName(dense).unionByName(sparse).unionByName(short).selectExpr("run", "timestamp_micros(us) AS ts", "id", "1.0D AS v")
    parts = 20
    cuts = od.long_runs(df, RUN, "ts", TIE, parts)
    sizes = od.OrderedRuns(df, RUN, "ts", TIE, cuts).df.groupBy(od.KEY).count().select(f"{od.KEY}.*", "count").collect()
    assert cuts.share == 1000 and max(r["count"] for r in sizes) <= 1.7 * cuts.share
    assert {r[od.PART] for r in sizes if r["run"].startswith("s") and r["run"] != "sparse"} == {-1}
    same(tm.sample_dt(df, RUN, "ts", TIE, parts), tm.sample_dt(df, RUN, "ts", TIE, 1))
    plain = tm.smooth(df, RUN, "ts", TIE, "v", parts=1)
    same(tm.smooth(df, RUN, "ts", TIE, "v", parts=parts), plain)
    assert od.long_runs(df, RUN, "ts", TIE, 1) is None and od.long_runs(df.filter("false"), RUN, "ts", TIE, 4) is None


def test_a_run_without_a_name_is_cut_too(spark):
    df = spark.range(500).selectExpr("CAST(NULL AS string) AS run", "timestamp_seconds(id) AS ts", "id", "1.0D AS co2_gs")
    got = tm.cumulative_co2(df, RUN, "ts", TIE, parts=10).orderBy("id").collect()
    assert [r["cumulative_g"] for r in got] == [float(i) for i in range(500)]


def test_intervals_of_mixed_lengths(spark):
    """One week-long interval among second-long ones, and single moments: what is joined stays in proportion."""
    t0 = datetime(2024, 1, 1)
    rng = random.Random(4)
    points = [("r", t0 + timedelta(milliseconds=rng.randrange(7 * 86_400_000)), i) for i in range(3000)]
    marks = [("r", t0, t0 + timedelta(days=7), -1)] + [("r", t0 + timedelta(seconds=300 * i), t0 + timedelta(seconds=300 * i + rng.choice([0, 1, 1, 60])), i) for i in range(2000)]
    marks += [("r", p, p, 5000 + i) for _, p, i in points[:50]] + [("r", t0 + timedelta(days=2), t0, 9999), ("x", t0, t0 + timedelta(days=9), 9998)]
    samples = spark.createDataFrame(points, "run string, ts timestamp, id long")
    intervals = spark.createDataFrame(marks, "run string, t_start timestamp, t_end timestamp, mark long")
    got = sorted((r["id"], r["mark"]) for r in tm.join_intervals(samples, intervals, RUN, "ts", "t_start", "t_end").collect())
    assert got == sorted((i, m) for _, p, i in points for run, a, b, m in marks if run == "r" and a <= p <= b)
    short = intervals.filter("mark >= 0 AND mark <> 9998")
    once = [r["id"] for r in tm.in_any_interval(samples.unionAll(samples), short, RUN, "ts", "t_start", "t_end").collect()]
    assert sorted(once) == sorted(2 * [i for _, p, i in points if any(a <= p <= b for run, a, b, m in marks if run == "r" and m >= 0)])
    # no interval lies in more than two slots
    lengths = spark.createDataFrame([(2**k + d,) for k in range(0, 50) for d in (-1, 0, 1)], "n long")
    assert lengths.filter(F.pow(F.lit(2.0), tm._level(F.col("n")) * tm.LEVEL_BITS) < F.col("n")).count() == 0
