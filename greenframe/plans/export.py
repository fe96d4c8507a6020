"""The whole profile of a collection of tables, written below one folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenframe.operators import profile, quality
from greenframe.sources.tables import Tables


def _json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_profile(spark: SparkSession, tables: Tables, path: str, as_of: datetime, keys: dict[str, list[str]] | None = None,
                   queues: Tables | None = None) -> dict[str, list[str]]:
    """Write metrics, insights, descriptions, correlations, semantics, anomalies and open imputations per table.

    ``keys`` names the columns that order a table (default: its first column);
    ``queues`` holds pending imputations by table name. Empty tables are left
    out. Returns the parts written per table.
    """
    written: dict[str, list[str]] = {}
    summary = spark.createDataFrame([(len(tables), sorted(tables))], "tables_count int, tables_list array<string>")
    _json(summary.withColumn("exported_at", F.current_timestamp()), f"{path}/db_summary.json")
    for name, df in tables.items():
        if df.isEmpty():
            continue
        key = (keys or {}).get(name, [df.columns[0]])
        base, parts = f"{path}/{name}", written.setdefault(name, [])

        def put(part: str, frame: DataFrame, save=_csv, base=base, parts=parts) -> None:
            save(frame, f"{base}/{part}")
            parts.append(part)

        columns = F.array(*[F.lit(c) for c in df.columns]).alias("columns")
        put("metrics.json", profile.table_metrics(df).select(
            "rows", "cols", F.col("missing_cells").alias("missing_values_total"),
            F.round("missing_pct", 2).alias("missing_values_pct"), "duplicate_rows",
            F.round("size_mb", 2).alias("memory_usage_mb"), columns), _json)
        put("schema_insights.json", profile.schema_insights(df, key).select(
            "column", F.col("category").alias("type"), F.round("unique_pct", 2).alias("unique_pct"),
            F.round("missing_pct", 2).alias("missing_pct"), "sensitive", F.col("reasons").alias("sensitive_reasons")), _json)
        numeric = profile.columns_of(df, "numeric")
        if numeric:
            put("descriptive_stats_numeric.csv", profile.describe_numeric(df))
        if profile.columns_of(df, "text"):
            put("descriptive_stats_text.csv", profile.describe_text(df))
        if len(numeric) >= 2:
            put("correlations_matrix.csv", profile.correlation_matrix(df))
            put("correlations_top_pairs.csv", profile.top_correlations(df, 50))
        put("profiling/semantic.csv", quality.semantic_report(df).withColumn("matches", F.to_json("matches")))
        put("profiling/missing_heatmap_stats.csv", profile.missing_by_column(df))
        put("profiling/anomalies.csv", quality.anomaly_report(df, as_of))
        if queues and name in queues:
            put("imputation_queue.json", queues[name], _json)
    return written
