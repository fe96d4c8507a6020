"""SQL pass-through and workload runs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from greenframe.functions import fixed_values as fixed
from greenframe.session import scratch_path
from greenframe.sources.tables import Tables


@dataclass
class QueryOutcome:
    dataframe: DataFrame | None = None
    error: str | None = None

    @property
    def rows(self) -> int:
        """Counts on demand, so that asking for the rows alone runs the query once."""
        return self.dataframe.count() if self.dataframe is not None else 0


def register(tables: Tables) -> None:
    """Make the tables known to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str) -> QueryOutcome:
    """The result of a statement, or the text of what was wrong with it."""
    if not isinstance(sql, str) or not sql.strip():
        return QueryOutcome(error="the query is empty or not text")
    try:
        return QueryOutcome(dataframe=spark.sql(sql))
    except Exception as error:  # noqa: BLE001 - handed to the caller as text
        return QueryOutcome(error=str(error))


RESULT_SCHEMA = "query_id string, query string, dbms string, latency_s double, co2_g double, rows long, error string"


def _executed(spark: SparkSession, sql: str) -> tuple[int, str | None]:
    """Run a query to its last row and column without keeping the result."""
    outcome = run_sql(spark, sql)
    if outcome.error is not None:
        return 0, outcome.error
    try:
        if not outcome.dataframe.columns:
            return 0, None
        seen = Observation()
        observed = outcome.dataframe.observe(seen, F.count(F.lit(1)).alias("rows"))
        observed.write.format("noop").mode("overwrite").save()
        return seen.get["rows"], None
    except Exception as error:  # noqa: BLE001 - one failing query does not stop the others
        return 0, str(error)


POOL = "greenframe-workload"


def side_by_side(rows: Iterable, work: Callable, spark: SparkSession, schema: str, at_once: int = 4, limit_s: float | None = None) -> DataFrame:
    """``work(row, stopped)`` of every row, ``at_once`` at a time; a result row is written as soon as it is there.

    The Spark jobs of a row run under a tag of their own and in one of ``at_once`` pools, so that with a fair scheduler
    (``spark.scheduler.mode=FAIR``) they share the executors; with a plain one, a row that fills them all holds up the
    others. Jobs that still run after ``limit_s`` seconds are cancelled by the tag, as often as the row starts new ones;
    ``stopped()`` tells ``work`` of it. Neither rows nor results pile up on the driver: it holds those being worked on.
    """
    context, folder = spark.sparkContext, scratch_path(spark, "side-by-side")
    free, failed = threading.Semaphore(at_once), []

    def one(row, number: int) -> None:
        tag, done, over = f"greenframe-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def watch() -> None:
            if not done.wait(limit_s):
                over.set()
                while not done.wait(0.2):
                    context.cancelJobsWithTag(tag)

        context.setLocalProperty("spark.scheduler.pool", f"{POOL}-{number % at_once}")
        context.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True) if limit_s else None
        try:
            if watcher:
                watcher.start()
            try:
                result = work(row, over.is_set)
            finally:
                done.set()
                if watcher:
                    watcher.join()
                context.removeJobTag(tag)
            # a folder for each, since two writers must not share one
            spark.createDataFrame([result], schema).coalesce(1).write.parquet(f"{folder}/number={number}")
        except Exception as error:  # noqa: BLE001 - raised again by the caller's thread
            failed.append(error)
        finally:
            free.release()

    spark.createDataFrame([], schema).write.parquet(f"{folder}/number=-1")
    with ThreadPoolExecutor(at_once) as pool:
        for number, row in enumerate(rows):
            free.acquire()
            if failed:
                break
            pool.submit(one, row, number)
    if failed:
        raise failed[0]
    return spark.read.schema(f"{schema}, number int").parquet(folder).drop("number")


def run_workload(queries: DataFrame | Iterable[tuple], spark: SparkSession, cpu_percent: float = 100.0,
                 tdp: float = fixed.CPU_TDP_W, emission_factor: float = fixed.EMISSION_FACTOR_G_PER_KWH,
                 at_once: int = 1, limit_s: float | None = None) -> DataFrame:
    """Execute (query_id, query, dbms) rows and report what each took.

    CO2 is estimated from the elapsed time at ``cpu_percent`` of ``tdp``; only with one query ``at_once`` is a query's
    time its own. A query that runs longer than ``limit_s`` seconds is stopped and reported as an error. The query texts
    come to the driver one partition at a time; the data they query does not, nor do the results.
    """
    if isinstance(queries, DataFrame):
        queries = queries.select("query_id", "query", "dbms").toLocalIterator()
    grams_per_second = cpu_percent / 100.0 * tdp / 3_600_000.0 * emission_factor

    def work(row, stopped) -> tuple:
        query_id, sql, dbms = row
        began = time.perf_counter()
        rows, error = _executed(spark, sql)
        elapsed = time.perf_counter() - began
        if error is not None and stopped():
            error = f"stopped after {limit_s} s"
        return str(query_id), sql, dbms, elapsed, elapsed * grams_per_second, rows, error

    return side_by_side(queries, work, spark, RESULT_SCHEMA, at_once, limit_s)
