"""Model, engine and query comparison; ``events`` stands in for measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenframe.operators import benchmark
from greenframe.plans import execute
from greenframe.plans.queries.support import rounded, table


def _r(digits, *columns):
    return [F.round(c, digits).alias(c) for c in columns]


def _race(spark, folder):
    """Two models on five databases: even events are generation, odd ones execution."""
    events = table(spark, folder, "events").withColumn("model", F.concat(F.lit("model_"), (F.col("user_id") % 2).cast("string")))
    value = F.col("value").cast("decimal(18,2)")
    generation, execution = F.when(F.col("event_id") % 2 == 0, value), F.when(F.col("event_id") % 2 == 1, value)
    return events.groupBy("model", F.col("event_type").alias("db")).agg(*[
        (F.sum(part).cast("double") / scale).alias(f"{prefix}_{measure}")
        for prefix, part in (("gen", generation), ("exec", execution))
        for measure, scale in (("co2_g", 1000), ("energy_j", 10), ("time_s", 100))
    ])


RACE_SQL = """
race AS (
  SELECT 'model_' || (user_id % 2) AS model, event_type AS db, """ + ", ".join(
    f"CAST(sum(CASE WHEN event_id % 2 = {odd} THEN CAST(value AS DECIMAL(18, 2)) END) AS DOUBLE) / {scale} AS {prefix}_{measure}"
    for prefix, odd in (("gen", 0), ("exec", 1))
    for measure, scale in (("co2_g", 1000), ("energy_j", 10), ("time_s", 100))
) + """
  FROM events GROUP BY ALL)"""


def _results(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_type").alias("dbms"), F.col("value").alias("latency_s"), (F.col("value") / 1000).alias("co2_g")
    )


def model_totals(spark, folder):
    return benchmark.model_totals(_race(spark, folder)).select("model", *_r(4, "total_co2_g", "total_energy_j", "total_time_s"))


def race_winner(spark, folder):
    totals = benchmark.model_totals(_race(spark, folder))
    return benchmark.race_winner(totals).select("winner", "loser", *_r(5, "saving_g"), *_r(4, "saving_pct"))


def race_winner_by_db(spark, folder):
    totals = benchmark.model_totals(_race(spark, folder), ["db"])
    return benchmark.race_winner(totals, ["db"]).select("db", "winner", "loser", *_r(5, "saving_g"), *_r(4, "saving_pct"))


def phase_breakdown(spark, folder):
    return benchmark.phase_breakdown(_race(spark, folder)).select("model", "db", "phase", *_r(5, "co2_g", "energy_j", "time_s"))


def generation_summary(spark, folder):
    return benchmark.generation_summary(_results(spark, folder)).select(*_r(4, "total_co2_g"), *_r(8, "avg_co2_g", "avg_latency_s"))


def latency_distribution(spark, folder):
    return benchmark.latency_distribution(_results(spark, folder)).select("dbms", *_r(6, "min", "q25", "q50", "q75", "max"))


def co2_by_dbms(spark, folder):
    return benchmark.co2_by_dbms(_results(spark, folder)).select("dbms", *_r(4, "co2_g"))


def _generated(spark, folder):
    """A statement about each labelled text: right ones differ in case and ``;`` only, toxic ones are missing."""
    labels = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "left")
    truth = F.concat(F.lit("SELECT doc_id FROM documents WHERE text = '"), F.replace(F.coalesce("text", F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))
    right = F.concat(F.lit("  "), F.lower(truth), F.lit(";"))
    generated = F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("quality") == 1, right).otherwise(F.concat(truth, F.lit(" LIMIT 1")))
    return (
        labels.select(F.col("doc_id").alias("query_id"), generated.alias("generated_sql")),
        labels.select(F.col("doc_id").alias("query_id"), truth.alias("ground_truth_sql")),
    )


def match_details(spark, folder):
    return benchmark.match_details(*_generated(spark, folder)).select("query_id", "status")


def match_quality(spark, folder):
    quality = benchmark.match_quality(benchmark.match_details(*_generated(spark, folder)))
    return quality.select("tp", "fp", "fn", *_r(6, "accuracy", "precision", "recall", "f1"))


def execution_match(spark, folder):
    """One pair per market segment: the same rows by another predicate, or one row more or less."""
    customer = table(spark, folder, "customer")
    execute.register({"customer": customer})
    segments = customer.select(F.col("c_mktsegment").alias("query_id")).distinct()
    truth = F.format_string("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = '%s'", "query_id")
    same = F.format_string("SELECT c_acctbal, c_custkey FROM customer WHERE c_mktsegment IN ('%s')", "query_id")
    fewer = F.concat(truth, F.lit(" AND c_custkey > (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')"))
    pairs = segments.select(
        "query_id", truth.alias("ground_truth_sql"), F.when(F.col("query_id") == "BUILDING", fewer).otherwise(same).alias("generated_sql"))
    return benchmark.execution_match_quality(pairs, spark)


def workload_queries(spark, folder):
    documents = table(spark, folder, "documents")
    statement = F.concat(F.lit("SELECT "), F.col("doc_id").cast("string"))
    workload = documents.select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("question"), statement.alias("MySQL"),
        F.concat(statement, F.lit(";")).alias("SQL Server"), F.col("lang").alias("Oracle"))
    return benchmark.workload_queries(workload, "question")


QUERIES = {
    f.__name__: f
    for f in (
        model_totals, race_winner, race_winner_by_db, phase_breakdown, generation_summary, latency_distribution,
        co2_by_dbms, match_details, match_quality, execution_match, workload_queries,
    )
}

_MEASURES = ("co2_g", "energy_j", "time_s")
_STATUS = "CASE WHEN toxic = 0 AND quality = 1 THEN 'Correct' ELSE 'Wrong' END"


def _totals(group: str) -> str:
    sums = ", ".join(f"sum(gen_{m} + exec_{m}) AS total_{m}" for m in _MEASURES)
    return f"WITH {RACE_SQL}, totals AS (SELECT {group}model, {sums} FROM race GROUP BY ALL)"


def _winner(group: str, match: str) -> str:
    return f"""SELECT {group}w.model AS winner, l.model AS loser, {rounded('l.total_co2_g - w.total_co2_g', 5)} AS saving_g,
  {rounded('CASE WHEN l.total_co2_g > 0 THEN (l.total_co2_g - w.total_co2_g) / l.total_co2_g * 100 ELSE 0 END', 4)} AS saving_pct
FROM totals w JOIN totals l ON w.model <> l.model {match}
WHERE w.total_co2_g < l.total_co2_g OR (w.total_co2_g = l.total_co2_g AND w.model > l.model)"""


ORACLES = {
    "model_totals": f"{_totals('')} SELECT model, " + ", ".join(f"{rounded(f'total_{m}', 4)} AS total_{m}" for m in _MEASURES) + " FROM totals",
    "race_winner": f"{_totals('')} {_winner('', '')}",
    "race_winner_by_db": f"{_totals('db, ')} {_winner('w.db, ', 'AND w.db = l.db')}",
    "phase_breakdown": f"WITH {RACE_SQL} " + " UNION ALL ".join(
        f"SELECT model, db, '{phase}' AS phase, " + ", ".join(f"{rounded(f'{p}_{m}', 5)} AS {m}" for m in _MEASURES) + " FROM race"
        for phase, p in (("Generation", "gen"), ("Execution", "exec"))),
    "generation_summary": f"""SELECT {rounded('sum(value / 1000)', 4)} AS total_co2_g, {rounded('avg(value / 1000)', 8)} AS avg_co2_g,
  {rounded('avg(value)', 8)} AS avg_latency_s FROM events""",
    "latency_distribution": f"""SELECT event_type AS dbms, {rounded('min(value)', 6)} AS min, {rounded('quantile_cont(value, 0.25)', 6)} AS q25,
  {rounded('quantile_cont(value, 0.5)', 6)} AS q50, {rounded('quantile_cont(value, 0.75)', 6)} AS q75, {rounded('max(value)', 6)} AS max
FROM events GROUP BY event_type""",
    "co2_by_dbms": f"SELECT event_type AS dbms, {rounded('sum(value / 1000)', 4)} AS co2_g FROM events GROUP BY event_type",
    "match_details": f"SELECT doc_id AS query_id, {_STATUS} AS status FROM labels",
    "match_quality": f"""WITH c AS (SELECT count(*) FILTER ({_STATUS} = 'Correct') AS tp, count(*) FILTER (toxic = 1) AS fn, count(*) AS n FROM labels),
r AS (SELECT tp, n - tp - fn AS fp, fn, tp / n * 100.0 AS accuracy, tp / (n - fn) AS precision, tp / (tp + fn) AS recall FROM c)
SELECT tp, fp, fn, {rounded('accuracy', 6)} AS accuracy, {rounded('precision', 6)} AS precision, {rounded('recall', 6)} AS recall,
  {rounded('2 * precision * recall / (precision + recall)', 6)} AS f1 FROM r""",
    "execution_match": """SELECT DISTINCT c_mktsegment AS query_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Wrong' ELSE 'Correct' END AS status
FROM customer""",
    "workload_queries": """SELECT doc_id AS query_id, text AS question, 'MySQL' AS dbms, 'SELECT ' || doc_id AS query FROM documents
UNION ALL SELECT doc_id, text, 'SQL Server', 'SELECT ' || doc_id || ';' FROM documents""",
}
