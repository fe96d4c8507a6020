"""Shared by the query modules: table access and SQL snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenframe.sources.files import read_parquet

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet", spread)


def rounded(sql: str, digits: int) -> str:
    """Decimal rounding, as Spark rounds doubles (halves of the printed value go up)."""
    return f"CAST(ROUND(CAST({sql} AS DECIMAL(28, 10)), {digits}) AS DOUBLE)"


def rounded_as_printed(sql: str, digits: int) -> str:
    """As :func:`rounded`, for values that come close to a half: every printed digit counts."""
    return f"CAST(ROUND(CAST(CAST({sql} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` read as CPU load samples: one run per user."""
    return table(spark, folder, "events").select(
        "user_id", "event_type", "event_id", "ts", F.least(F.col("value"), F.lit(100.0)).alias("cpu_percent")
    )


def samples_sql(tdp: float) -> str:
    return f"""
samples AS (
  SELECT user_id, event_type, event_id, ts, least(value, 100.0) AS cpu_percent,
         least(value, 100.0) / 100.0 * {tdp} AS power_w,
         least(value, 100.0) / 100.0 * {tdp} / 3600000.0 * 250.0 AS co2_gs
  FROM events)"""


SAMPLES_SQL = samples_sql(65.0)
# at 72 W the per-sample amounts have few decimals, so that sums in any order round alike
EVEN_TDP = 72.0
EVEN_SAMPLES_SQL = samples_sql(EVEN_TDP)


def phases(spark: SparkSession, folder: str) -> DataFrame:
    """Each run cut into three phases of equal length that share their end points."""
    spans = table(spark, folder, "events").groupBy("user_id").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1")
    ).withColumn("third", F.expr("timestampdiff(MICROSECOND, t0, t1) div 3"))
    cuts = [("generation", 0), ("execution", 1), ("rewrite", 2)]
    parts = [
        F.struct(
            F.lit(name).alias("phase"),
            F.expr(f"timestampadd(MICROSECOND, third * {i}, t0)").alias("t_start"),
            F.expr(f"timestampadd(MICROSECOND, third * {i + 1}, t0)").alias("t_end"),
        )
        for i, (name, _) in enumerate(cuts)
    ]
    return spans.select("user_id", F.inline(F.array(*parts)))


PHASES_SQL = """
spans AS (
  SELECT user_id, min(ts) AS t0, (epoch_us(max(ts)) - epoch_us(min(ts))) // 3 AS third
  FROM events GROUP BY user_id),
phases AS (
  SELECT user_id, p.phase, t0 + to_microseconds(third * p.i) AS t_start,
         t0 + to_microseconds(third * (p.i + 1)) AS t_end
  FROM spans, (VALUES ('generation', 0), ('execution', 1), ('rewrite', 2)) AS p(phase, i)),
sliced AS (
  SELECT s.*, p.phase,
         coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (
           PARTITION BY s.user_id, p.phase ORDER BY ts, event_id)) / 1e6, 0.0) AS dt_s
  FROM samples s JOIN phases p
    ON s.user_id = p.user_id AND s.ts BETWEEN p.t_start AND p.t_end)"""
