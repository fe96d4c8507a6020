"""Energy and CO2 queries; ``events`` stands in for power telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenframe.functions import energy
from greenframe.operators import telemetry as tm
from greenframe.operators.ordered import epoch_micros
from greenframe.plans.queries.support import (
    EVEN_SAMPLES_SQL,
    EVEN_TDP,
    PHASES_SQL,
    SAMPLES_SQL,
    phases,
    rounded,
    table,
    telemetry,
)

RUN, TIE = ["user_id"], ["event_id"]


def _rates():
    return {"co2_g": F.col("co2_gs"), "energy_j": F.col("power_w")}


def _samples(spark, folder):
    return tm.with_power(telemetry(spark, folder))


def _even_samples(spark, folder):
    return tm.with_power(telemetry(spark, folder), tdp=EVEN_TDP)


def _r(digits, *columns):
    return [F.round(c, digits).alias(c) for c in columns]


def green_score_by_phase(spark, folder):
    found = tm.phase_integrals(_samples(spark, folder), phases(spark, folder), RUN, "phase", "ts", TIE, _rates())
    score = energy.green_score(F.round("co2_g", 6), "samples", F.round("seconds", 6))
    return found.withColumn("score", score).select(
        "user_id", "phase", "samples", *_r(4, "co2_g"), *_r(2, "energy_j"), *_r(6, "seconds"),
        "score", energy.score_zone("score").alias("zone"),
    )


PHASE_SUMS_SQL = f"""WITH {SAMPLES_SQL}, {PHASES_SQL},
integrals AS (
  SELECT user_id, phase, count(*) AS samples, sum(co2_gs * dt_s) AS co2_g,
         sum(power_w * dt_s) AS energy_j, sum(dt_s) AS seconds
  FROM sliced GROUP BY user_id, phase)"""

SCORE_SQL = """CASE WHEN {co2} <= 0 OR {s} <= 0 THEN 100 WHEN {rows} <= 0 THEN 0
  ELSE CAST(trunc(greatest(0, least(100, (log10({rows} / (greatest({co2}, 1e-4) * greatest({s}, 1e-4))) + 1) / 6 * 100))) AS INTEGER) END"""
ZONE_SQL = "CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Poor' END"


def _score_sql(co2="co2_g", rows="samples", seconds="seconds"):
    return SCORE_SQL.format(co2=rounded(co2, 6), rows=rows, s=rounded(seconds, 6))


def power_columns(spark, folder):
    return _even_samples(spark, folder).select(
        "event_id", *_r(6, "power_w"),
        F.round(F.col("co2_gs") * 1000, 6).alias("co2_mg_per_s"),
        F.round(energy.co2_kg_per_h("co2_gs"), 6).alias("co2_kg_per_h"),
        energy.power_band("power_w", EVEN_TDP).alias("band"),
        energy.power_alarm("power_w", EVEN_TDP).alias("alarm"),
    )


def gpu_power(spark, folder):
    reading = F.when(F.col("event_id") % 3 != 0, F.col("cpu_percent") * 1.7)
    return telemetry(spark, folder).select(
        "event_id", F.round(energy.gpu_power_w("cpu_percent", reading), 6).alias("gpu_w")
    )


def host_tdp(spark, folder):
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey", energy.estimate_tdp(F.col("p_size") % 12, F.col("p_retailprice") * 3).alias("tdp_w")
    )


def sample_spacing(spark, folder):
    return tm.sample_dt(telemetry(spark, folder), RUN, "ts", TIE).select("event_id", "user_id", *_r(6, "dt_s"))


def run_integrals(spark, folder):
    return tm.integrate(_samples(spark, folder), RUN, "ts", TIE, _rates()).select(
        "user_id", "samples", *_r(4, "co2_g"), *_r(2, "energy_j"), *_r(6, "seconds")
    )


def fixed_step_integrals(spark, folder):
    samples = _even_samples(spark, folder)
    return tm.integrate_fixed_step(samples, RUN, F.col("co2_gs"), F.col("power_w")).select(
        "user_id", *_r(8, "co2_g"), *_r(6, "energy_wh")
    )


def running_co2(spark, folder):
    return tm.cumulative_co2(_samples(spark, folder), RUN, "ts", TIE).select(
        "event_id", "user_id", *_r(4, "cumulative_g")
    )


def phase_slices(spark, folder):
    sliced = tm.slice_phase(_samples(spark, folder), phases(spark, folder), RUN, "phase", "ts", TIE)
    return sliced.select("event_id", "user_id", "phase", *_r(6, "dt_s"))


def _calls(spark, folder):
    """An hour after every purchase counts as a call."""
    bought = table(spark, folder, "events").filter("event_type = 'purchase'")
    return bought.select("user_id", F.col("ts").alias("t_start"), F.expr("ts + INTERVAL 1 HOUR").alias("t_end"))


def samples_in_calls(spark, folder):
    inside = tm.in_any_interval(telemetry(spark, folder), _calls(spark, folder), RUN, "ts", "t_start", "t_end")
    return inside.select("event_id", "user_id", "event_type")


def metric_summary(spark, folder):
    samples = _samples(spark, folder).withColumn("gpu_percent", F.when(F.col("event_id") % 2 == 0, F.col("cpu_percent") / 2))
    return tm.metric_summary(samples, "cpu_percent", "gpu_percent", "co2_gs")


def smoothed_load(spark, folder):
    return tm.smooth(telemetry(spark, folder), RUN, "ts", TIE, "cpu_percent").select(
        "event_id", "user_id", *_r(6, "smooth")
    )


def _by_hour(spark, folder):
    """Telemetry with one short run per user and hour, many of a single sample."""
    return telemetry(spark, folder).withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))


def padded_runs(spark, folder):
    samples = _by_hour(spark, folder).select("user_id", "hour", "ts", "cpu_percent")
    padded = tm.pad_single_sample(samples, ["user_id", "hour"], "ts")
    return padded.select("user_id", "hour", epoch_micros(padded, "ts").alias("t"), *_r(6, "cpu_percent"))


def co2_equivalents(spark, folder):
    runs = tm.integrate(_samples(spark, folder), RUN, "ts", TIE, _rates())
    # runs of even users count as sinks, so that the guard for amounts <= 0 shows
    signed = runs.withColumn("g", F.round(F.when(F.col("user_id") % 2 == 0, -F.col("co2_g")).otherwise(F.col("co2_g")), 4))
    return signed.select(
        "user_id", *[F.round(c, 4).alias(n) for n, c in energy.co2_equivalents("g").items()]
    )


def session_totals(spark, folder):
    runs = tm.integrate(_samples(spark, folder), RUN, "ts", TIE, _rates())
    exact = runs.select(F.round("co2_g", 6).alias("co2_g"), F.round("seconds", 6).alias("seconds"), F.col("samples").alias("rows"))
    return tm.session_metrics(exact).select(
        *_r(3, "total_co2_g"), "queries_executed", *_r(6, "avg_green_score", "session_duration_s")
    )


def _operations(spark, folder):
    samples = _even_samples(spark, folder)
    return samples.select(
        "ts", "event_id", F.col("event_type").alias("operation"),
        (F.col("co2_gs") * 0.5).alias("co2_g"), (F.col("power_w") * 0.5 / 3600).alias("energy_wh"),
    )


def operation_history(spark, folder):
    return tm.kpi_history(_operations(spark, folder), "ts", TIE).select(
        "event_id", "operation", *_r(8, "total_co2_g", "total_energy_wh")
    )


def latest_operation(spark, folder):
    return tm.last_operation(_operations(spark, folder), "ts", TIE).select("event_id", "operation", *_r(8, "co2_g"))


def co2_by_phase(spark, folder):
    found = tm.phase_integrals(_samples(spark, folder), phases(spark, folder), RUN, "phase", "ts", TIE, _rates())
    return tm.phase_totals(found, "phase").select("phase", *_r(3, "total_co2_g"))


def best_and_worst_run(spark, folder):
    runs = tm.integrate(_samples(spark, folder), RUN, "ts", TIE, _rates())
    exact = runs.select("user_id", *_r(6, "co2_g", "seconds"), F.col("samples").alias("rows"))
    return tm.best_worst_query(exact, "user_id").select("kind", "query", *_r(4, "co2_g"), *_r(6, "seconds"), "score")


def telemetry_from_json(spark, folder):
    from greenframe.sources.files import flatten_telemetry

    events = table(spark, folder, "events")
    # one nested sample as text per event; every third has no GPU
    cpu = F.struct(F.least("value", F.lit(100.0)).alias("percent"), (F.least("value", F.lit(100.0)) * 0.65).alias("power_w"))
    gpu = F.when(F.col("event_id") % 3 != 0, F.struct((F.col("value") / 10).alias("percent"), (F.col("value") / 4).alias("power_w")))
    text = events.select("event_id", F.to_json(F.struct(F.col("ts").alias("timestamp"), cpu.alias("cpu"), gpu.alias("gpu"))).alias("sample"))
    return flatten_telemetry(text, "sample").select(
        "event_id", F.round(F.col("`cpu.percent`"), 6).alias("cpu_percent"),
        F.round(F.col("`gpu.percent`"), 6).alias("gpu_percent"),
        F.round(F.col("`cpu.power_w`") + F.col("`gpu.power_w`"), 6).alias("total_w"),
    )


QUERIES = {
    "green_score_by_phase": green_score_by_phase,
    "power_columns": power_columns,
    "gpu_power": gpu_power,
    "host_tdp": host_tdp,
    "sample_spacing": sample_spacing,
    "run_integrals": run_integrals,
    "fixed_step_integrals": fixed_step_integrals,
    "running_co2": running_co2,
    "phase_slices": phase_slices,
    "samples_in_calls": samples_in_calls,
    "metric_summary": metric_summary,
    "smoothed_load": smoothed_load,
    "padded_runs": padded_runs,
    "co2_equivalents": co2_equivalents,
    "session_totals": session_totals,
    "operation_history": operation_history,
    "latest_operation": latest_operation,
    "co2_by_phase": co2_by_phase,
    "best_and_worst_run": best_and_worst_run,
    "telemetry_from_json": telemetry_from_json,
}

_RUNS_SQL = f"""WITH {SAMPLES_SQL},
stepped AS (
  SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 0.0) AS dt_s
  FROM samples),
runs AS (
  SELECT user_id, count(*) AS samples, sum(co2_gs * dt_s) AS co2_g, sum(power_w * dt_s) AS energy_j, sum(dt_s) AS seconds
  FROM stepped GROUP BY user_id)"""

_OPERATIONS_SQL = f"""WITH {EVEN_SAMPLES_SQL},
operations AS (
  SELECT ts, event_id, event_type AS operation, co2_gs * 0.5 AS co2_g, power_w * 0.5 / 3600 AS energy_wh FROM samples)"""

ORACLES = {
    "green_score_by_phase": f"""{PHASE_SUMS_SQL},
scored AS (SELECT *, {_score_sql()} AS score FROM integrals)
SELECT user_id, phase, samples, {rounded('co2_g', 4)} AS co2_g, {rounded('energy_j', 2)} AS energy_j,
       {rounded('seconds', 6)} AS seconds, score, {ZONE_SQL} AS zone FROM scored""",
    "power_columns": f"""WITH {EVEN_SAMPLES_SQL}
SELECT event_id, {rounded('power_w', 6)} AS power_w, {rounded('co2_gs * 1000', 6)} AS co2_mg_per_s,
       {rounded('co2_gs * 3.6', 6)} AS co2_kg_per_h,
       CASE WHEN power_w < 72.0::DOUBLE * 0.3::DOUBLE THEN 'low' WHEN power_w < 72.0::DOUBLE * 0.7::DOUBLE THEN 'medium' ELSE 'high' END AS band,
       power_w >= 72.0::DOUBLE * 0.9::DOUBLE AS alarm FROM samples""",
    "gpu_power": f"""WITH {SAMPLES_SQL}
SELECT event_id, {rounded('CASE WHEN event_id % 3 <> 0 THEN cpu_percent * 1.7 ELSE cpu_percent / 100.0 * 150.0 END', 6)} AS gpu_w
FROM samples""",
    "host_tdp": """WITH hosts AS (SELECT p_partkey, p_size % 12 AS cores, p_retailprice * 3 AS mhz FROM part)
SELECT p_partkey, CAST(CASE WHEN mhz > 4000 AND cores >= 8 THEN 125 WHEN mhz > 4000 AND cores >= 4 THEN 95
  WHEN mhz > 4000 THEN 65 WHEN mhz > 3000 AND cores >= 6 THEN 65 WHEN mhz > 3000 AND cores >= 4 THEN 45 ELSE 65 END AS DOUBLE) AS tdp_w
FROM hosts""",
    "sample_spacing": f"{_RUNS_SQL} SELECT event_id, user_id, {rounded('dt_s', 6)} AS dt_s FROM stepped",
    "run_integrals": f"""{_RUNS_SQL} SELECT user_id, samples, {rounded('co2_g', 4)} AS co2_g,
  {rounded('energy_j', 2)} AS energy_j, {rounded('seconds', 6)} AS seconds FROM runs""",
    "fixed_step_integrals": f"""WITH {EVEN_SAMPLES_SQL}
SELECT user_id, {rounded('sum(co2_gs) * 0.5', 8)} AS co2_g, {rounded('sum(power_w) * 0.5 / 3600', 6)} AS energy_wh
FROM samples GROUP BY user_id""",
    "running_co2": f"""{_RUNS_SQL} SELECT event_id, user_id,
  {rounded('sum(co2_gs * dt_s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 4)} AS cumulative_g
FROM stepped""",
    "phase_slices": f"WITH {SAMPLES_SQL}, {PHASES_SQL} SELECT event_id, user_id, phase, {rounded('dt_s', 6)} AS dt_s FROM sliced",
    "samples_in_calls": """SELECT event_id, user_id, event_type FROM events s WHERE EXISTS (
  SELECT 1 FROM events c WHERE c.event_type = 'purchase' AND c.user_id = s.user_id
    AND s.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR)""",
    "metric_summary": f"""WITH {SAMPLES_SQL},
long AS (
  SELECT 'CPU %' AS metric, cpu_percent AS v, 2 AS digits FROM samples
  UNION ALL SELECT 'GPU %', CASE WHEN event_id % 2 = 0 THEN cpu_percent / 2 ELSE 0 END, 2 FROM samples
  UNION ALL SELECT 'CO2 (g/s)', co2_gs, 6 FROM samples),
stats AS (SELECT metric, min(v) AS lo, max(v) AS hi, avg(v) AS mid, sum(v) AS total FROM long GROUP BY metric)
SELECT metric,
  CASE WHEN metric = 'CO2 (g/s)' THEN {rounded('lo', 6)} ELSE {rounded('lo', 2)} END AS min,
  CASE WHEN metric = 'CO2 (g/s)' THEN {rounded('hi', 6)} ELSE {rounded('hi', 2)} END AS max,
  CASE WHEN metric = 'CO2 (g/s)' THEN {rounded('mid', 6)} ELSE {rounded('mid', 2)} END AS mean,
  CASE WHEN metric = 'CO2 (g/s)' THEN {rounded('total * 0.5', 4)} ELSE 0.0 END AS total_co2_g
FROM stats""",
    "smoothed_load": f"""WITH {SAMPLES_SQL},
framed AS (
  SELECT event_id, user_id, cpu_percent, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
    avg(cpu_percent) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean
  FROM samples)
SELECT event_id, user_id, {rounded('CASE WHEN n <= 20 THEN cpu_percent WHEN rn >= 20 THEN mean END', 6)} AS smooth FROM framed""",
    "padded_runs": """WITH runs AS (
  SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, epoch_us(ts) AS t, least(value, 100.0) AS cpu_percent FROM events),
single AS (SELECT user_id, hour, min(t) AS t FROM runs GROUP BY user_id, hour HAVING count(*) = 1)
SELECT user_id, hour, t, cpu_percent FROM runs
UNION ALL SELECT user_id, hour, t - 1000000, 0.0 FROM single
UNION ALL SELECT user_id, hour, t + 1000000, 0.0 FROM single""",
    "co2_equivalents": f"""{_RUNS_SQL},
signed AS (SELECT user_id, {rounded('CASE WHEN user_id % 2 = 0 THEN -co2_g ELSE co2_g END', 4)} AS g FROM runs)
SELECT user_id, {rounded('greatest(g, 0) / 8.22', 4)} AS phones, {rounded('greatest(g, 0) / 120', 4)} AS car_km,
  {rounded('greatest(g, 0) / 120 * 1000', 4)} AS car_m, {rounded('g * 100', 4)} AS led_hours FROM signed""",
    "session_totals": f"""{_RUNS_SQL}
SELECT {rounded('sum(co2_g)', 3)} AS total_co2_g, count(*) AS queries_executed,
  {rounded(f'avg({_score_sql()})', 6)} AS avg_green_score, {rounded('sum(seconds)', 6)} AS session_duration_s FROM runs""",
    "operation_history": f"""{_OPERATIONS_SQL}
SELECT event_id, operation,
  {rounded('sum(co2_g) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 8)} AS total_co2_g,
  {rounded('sum(energy_wh) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 8)} AS total_energy_wh FROM operations""",
    "latest_operation": f"""{_OPERATIONS_SQL}
SELECT event_id, operation, {rounded('co2_g', 8)} AS co2_g FROM operations ORDER BY ts DESC, event_id DESC LIMIT 1""",
    "co2_by_phase": f"{PHASE_SUMS_SQL} SELECT phase, {rounded('sum(co2_g)', 3)} AS total_co2_g FROM integrals GROUP BY phase",
    "best_and_worst_run": f"""{_RUNS_SQL},
scored AS (SELECT user_id AS query, {rounded('co2_g', 6)} AS co2_g, {rounded('seconds', 6)} AS seconds, {_score_sql()} AS score FROM runs)
SELECT 'best' AS kind, query, {rounded('co2_g', 4)} AS co2_g, {rounded('seconds', 6)} AS seconds, score
FROM (SELECT * FROM scored ORDER BY co2_g, query LIMIT 1)
UNION ALL SELECT 'worst', query, {rounded('co2_g', 4)}, {rounded('seconds', 6)}, score
FROM (SELECT * FROM scored ORDER BY co2_g DESC, query LIMIT 1)""",
    "telemetry_from_json": f"""SELECT event_id, {rounded('least(value, 100.0)', 6)} AS cpu_percent,
  {rounded('CASE WHEN event_id % 3 <> 0 THEN value / 10 ELSE 0 END', 6)} AS gpu_percent,
  {rounded('least(value, 100.0) * 0.65 + CASE WHEN event_id % 3 <> 0 THEN value / 4 ELSE 0 END', 6)} AS total_w FROM events""",
}
