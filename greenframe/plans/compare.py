"""Comparing a query with its rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_alternatives(originals: DataFrame, candidates: DataFrame, run: list[str]) -> DataFrame:
    """Per run the successful rewrite that saves most CO2, if one is faster than the original.

    ``originals`` has (run, duration, co2_g), ``candidates`` (run, position, sql,
    status, duration, rows). CO2 of a rewrite is scaled by its duration; equal
    savings go to the earlier candidate.
    """
    base = originals.select(*run, F.col("duration").alias("orig_duration"), F.col("co2_g").alias("orig_co2"))
    faster = candidates.filter("status = 'success'").join(base, run).filter(
        "duration < orig_duration AND orig_duration > 0"
    )
    priced = faster.withColumn(
        "est_co2", F.col("orig_co2") * (F.col("duration") / F.col("orig_duration"))
    ).withColumn("saving_g", F.col("orig_co2") - F.col("est_co2")).filter("saving_g > 0")
    best = F.min_by(
        F.struct("position", "sql", "rows", "duration", "est_co2", "saving_g",
                 (F.col("saving_g") / F.col("orig_co2") * 100.0).alias("saving_pct")),
        F.struct((-F.col("saving_g")).alias("order"), "position"),
    )
    return priced.groupBy(*run).agg(best.alias("best")).select(*run, "best.*")


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with ``copies`` = copies in ``a`` minus copies in ``b``.

    Columns are matched by name. Both sides are counted in one aggregation, so
    copies are added up before the shuffle.
    """
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(a.columns)} and {sorted(b.columns)}")
    both = a.withColumn("copies", F.lit(1)).unionByName(b.withColumn("copies", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("copies").alias("copies")).filter("copies <> 0")


def results_equivalent(a: DataFrame, b: DataFrame) -> bool:
    """Same rows with the same number of copies, whatever the order of rows and columns."""
    if set(a.columns) != set(b.columns):
        return False
    return row_differences(a, b).isEmpty()
