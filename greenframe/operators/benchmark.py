"""Comparing models, engines and queries on their measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenframe.functions import fixed_values as fixed
from greenframe.functions.sqltext import canonical_sql
from greenframe.operators.quantiles import exact_quantiles
from greenframe.plans.compare import results_equivalent
from greenframe.plans.execute import side_by_side

MEASURES = ["co2_g", "energy_j", "time_s"]


def model_totals(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Generation plus execution, over all databases, per model (and ``group``)."""
    return results.groupBy(*(group or []), "model").agg(*[
        F.sum(F.coalesce(F.col(f"gen_{m}"), F.lit(0.0)) + F.coalesce(F.col(f"exec_{m}"), F.lit(0.0))).alias(f"total_{m}")
        for m in MEASURES
    ])


def race_winner(totals: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The model with least CO2, against the one with most; a later name wins a tie.

    Savings are in grams and in per cent of the loser, 0 where that emitted nothing.
    """
    ranked = totals.groupBy(*(group or []), "total_co2_g").agg(F.max("model").alias("model"), F.min("model").alias("rival"))
    lowest = F.min(F.struct("total_co2_g", "model"))
    highest = F.max(F.struct("total_co2_g", F.col("rival").alias("model")))
    ends = ranked.groupBy(*(group or [])).agg(lowest.alias("w"), highest.alias("l"))
    saving = F.col("l.total_co2_g") - F.col("w.total_co2_g")
    return ends.select(
        *(group or []), F.col("w.model").alias("winner"), F.col("l.model").alias("loser"), saving.alias("saving_g"),
        F.when(F.col("l.total_co2_g") > 0, saving / F.col("l.total_co2_g") * 100).otherwise(0.0).alias("saving_pct"),
    )


def phase_breakdown(results: DataFrame) -> DataFrame:
    """(model, db, phase, co2_g, energy_j, time_s): one row per phase instead of one column set."""
    phases = [
        F.struct(F.lit(name).alias("phase"), *[F.col(f"{prefix}_{m}").alias(m) for m in MEASURES])
        for name, prefix in (("Generation", "gen"), ("Execution", "exec"))
    ]
    return results.select("model", "db", F.inline(F.array(*phases)))


def generation_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.sum("co2_g").alias("total_co2_g"), F.avg("co2_g").alias("avg_co2_g"), F.avg("latency_s").alias("avg_latency_s")
    )


def latency_distribution(results: DataFrame) -> DataFrame:
    """(dbms, min, q25, q50, q75, max) of the latency, exact."""
    ends = results.groupBy("dbms").agg(F.min("latency_s").alias("min"), F.max("latency_s").alias("max"))
    quartiles = exact_quantiles(results, ["dbms"], "latency_s", [0.25, 0.5, 0.75])
    named = quartiles.withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    return ends.join(named, "dbms").select("dbms", "min", "q25", "q50", "q75", "max")


def co2_by_dbms(results: DataFrame) -> DataFrame:
    return results.groupBy("dbms").agg(F.sum("co2_g").alias("co2_g"))


def match_details(generated: DataFrame, truth: DataFrame, key: str = "query_id") -> DataFrame:
    """Each generated statement with its ground truth, Correct if equal up to case, blanks at the ends and ``;``.

    A missing statement is Wrong.
    """
    joined = generated.join(truth, key, "left")
    same = canonical_sql("generated_sql") == canonical_sql(F.coalesce("ground_truth_sql", F.lit("nan")))
    return joined.withColumn("status", F.when(same, "Correct").otherwise("Wrong"))


def match_quality(details: DataFrame) -> DataFrame:
    """Accuracy %, precision, recall and F1; a missing statement counts as a miss, not as a wrong answer."""
    right = F.count_if(F.col("status") == "Correct")
    missing = F.count_if((F.col("status") == "Wrong") & F.col("generated_sql").isNull())
    counts = details.agg(F.count(F.lit(1)).alias("total"), right.alias("tp"), missing.alias("fn"))
    counts = counts.withColumn("fp", F.col("total") - F.col("tp") - F.col("fn"))
    zero = F.lit(0.0)
    rates = counts.select(
        "tp", "fp", "fn",
        F.coalesce(F.try_divide("tp", "total") * 100, zero).alias("accuracy"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero).alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), zero))


def execution_match_quality(pairs: DataFrame, spark: SparkSession, at_once: int = 4, limit_s: float | None = None) -> DataFrame:
    """(query_id, status): run both statements and compare their results, ``at_once`` pairs at a time.

    ``pairs`` has query_id, generated_sql and ground_truth_sql; the statements
    come to the driver, the compared rows and the results do not. A pair that
    takes longer than ``limit_s`` seconds is stopped and counts as wrong.
    """
    def work(row, stopped) -> tuple:
        try:
            same = results_equivalent(spark.sql(row["generated_sql"]), spark.sql(row["ground_truth_sql"]))
        except Exception:  # noqa: BLE001 - a statement that does not run, or not to its end, is not correct
            same = False
        return row["query_id"], "Correct" if same else "Wrong"

    kind = dict(pairs.dtypes)["query_id"]
    rows = pairs.select("query_id", "generated_sql", "ground_truth_sql").toLocalIterator()
    return side_by_side(rows, work, spark, f"query_id {kind}, status string", at_once, limit_s)


def workload_queries(workload: DataFrame, question: str, query_id: str = "query_id") -> DataFrame:
    """(query_id, question, dbms, query): the known engine columns of a workload, one row per statement."""
    engines = [c for c in fixed.DBMS_COLUMNS if c in workload.columns]
    if not engines:
        raise ValueError(f"no column named after an engine: {fixed.DBMS_COLUMNS}")
    return workload.select(query_id, question, *[F.col(f"`{e}`") for e in engines]).unpivot(
        [query_id, question], [F.col(f"`{e}`") for e in engines], "dbms", "query"
    )
