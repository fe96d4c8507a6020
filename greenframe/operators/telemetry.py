"""Power telemetry: sample spacing, integrals, phases, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenframe.functions import energy
from greenframe.functions import fixed_values as fixed
from greenframe.operators.ordered import (
    PART,
    Cuts,
    OrderedRuns,
    epoch_micros,
    long_runs,
)


def with_power(df: DataFrame, percent: str = "cpu_percent", tdp: float = fixed.CPU_TDP_W,
               emission_factor: float = fixed.EMISSION_FACTOR_G_PER_KWH) -> DataFrame:
    """Add ``power_w`` and ``co2_gs`` to CPU load samples."""
    return df.withColumn("power_w", energy.cpu_power_w(percent, tdp)).withColumn(
        "co2_gs", energy.co2_g_per_s("power_w", emission_factor)
    )


def _add_dt(df: DataFrame, run: list[str], time: str, tie: list[str], cuts: Cuts | None) -> DataFrame:
    now = epoch_micros(df, time)
    runs = OrderedRuns(df, run, time, tie, cuts)
    seconds = (now - F.col("_previous")) / 1e6
    stepped = runs.with_previous(now, "_previous")
    return stepped.withColumn("dt_s", F.coalesce(seconds, F.lit(0.0))).drop("_previous")


def sample_dt(df: DataFrame, run: list[str], time: str, tie: list[str],
              parts: int | None = None) -> DataFrame:
    """Add ``dt_s``: seconds since the previous sample of the run, 0 for the first."""
    return _add_dt(df, run, time, tie, long_runs(df, run, time, tie, parts))


def integrate(df: DataFrame, run: list[str], time: str, tie: list[str], rates: dict[str, Column],
              parts: int | None = None) -> DataFrame:
    """Per run: the sum of rate * dt for every rate, the seconds covered and the sample count.

    Parts of a long run are summed on their own; only the step from one part
    to the next is added afterwards, on one row per part.
    """
    return _integrate(df, run, time, tie, rates, long_runs(df, run, time, tie, parts))


def _integrate(df: DataFrame, run: list[str], time: str, tie: list[str], rates: dict[str, Column],
               cuts: Cuts | None) -> DataFrame:
    now = epoch_micros(df, time)
    runs = OrderedRuns(df, run, time, tie, cuts)
    values = {name: F.coalesce(rate, F.lit(0.0)) for name, rate in rates.items()}
    steps = runs.df.withColumn("_t", now).withColumn(
        "_dt", F.coalesce((F.col("_t") - F.lag("_t").over(runs.within)) / 1e6, F.lit(0.0))
    )
    inner = [F.sum(value * F.col("_dt")).alias(name) for name, value in values.items()]
    if not runs.cut:
        return steps.groupBy(*run).agg(
            *inner, F.sum("_dt").alias("seconds"), F.count(F.lit(1)).alias("samples")
        )
    first = F.struct("_t", *runs.order[1:])
    runs.df = steps
    pieces = runs.per_part(
        *inner,
        *[F.min_by(value, first).alias(f"_f_{name}") for name, value in values.items()],
        F.min("_t").alias("_start"),
        F.max("_t").alias("_end"),
        F.sum("_dt").alias("seconds"),
        F.count(F.lit(1)).alias("samples"),
    )
    gap = F.coalesce((F.col("_start") - F.lag("_end").over(runs.across)) / 1e6, F.lit(0.0))
    return pieces.withColumn("_gap", gap).groupBy(*run).agg(
        *[(F.sum(name) + F.sum(F.col(f"_f_{name}") * F.col("_gap"))).alias(name) for name in rates],
        (F.sum("seconds") + F.sum("_gap")).alias("seconds"),
        F.sum("samples").alias("samples"),
    )


def integrate_fixed_step(df: DataFrame, run: list[str], co2_gs: Column, power_w: Column,
                         step_s: float = fixed.SAMPLE_STEP_S) -> DataFrame:
    """CO2 and energy with the nominal spacing instead of the recorded one."""
    return df.groupBy(*run).agg(
        (F.sum(F.coalesce(co2_gs, F.lit(0.0))) * step_s).alias("co2_g"),
        (F.sum(F.coalesce(power_w, F.lit(0.0))) * step_s / 3600.0).alias("energy_wh"),
    )


def cumulative_co2(df: DataFrame, run: list[str], time: str, tie: list[str], co2_gs: str = "co2_gs",
                   parts: int | None = None) -> DataFrame:
    """Add ``cumulative_g``: CO2 of the run so far."""
    cuts = long_runs(df, run, time, tie, parts)
    stepped = _add_dt(df, run, time, tie, cuts)
    grams = F.coalesce(F.col(co2_gs), F.lit(0.0)) * F.col("dt_s")
    runs = OrderedRuns(stepped, run, time, tie, cuts)
    return runs.with_running_sums({"cumulative_g": grams})


#: Slots of one level are so many times (as a power of two) as wide as those of the level below.
LEVEL_BITS = 3


def _level(length: Column) -> Column:
    """The lowest level whose slots are at least as wide as an interval, so that it lies in two of them at most."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) / LEVEL_BITS).cast("int")


def _slot(micros: Column, level: Column) -> Column:
    return F.floor(micros / F.pow(F.lit(2.0), level * LEVEL_BITS)).cast("long")


def _disjoint(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The time that the intervals of each key cover, as intervals that do not touch."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    marked = intervals.select(*keys, start, end).withColumn("_reach", F.max(end).over(before))
    apart = F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)).cast("int")
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("_number", F.sum(apart).over(upto))
    return numbered.groupBy(*keys, "_number").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_number")


def join_intervals(samples: DataFrame, intervals: DataFrame, keys: list[str], time: str,
                   start: str, end: str, how: str = "inner") -> DataFrame:
    """Samples with the intervals of the same ``keys`` that contain them, both ends included.

    Each interval is filed at the level whose time slots are as wide as itself, so it takes two slots at most, however
    short the others are; a sample looks into one slot of each level there is (one for lengths that differ by less than
    eight times, a dozen from milliseconds to months). So this is an equality join on (keys, level, slot), and a long
    run with many intervals is spread over its slots. ``left_semi`` gives each sample of any interval once.
    """
    intervals = intervals.filter(F.col(start) <= F.col(end))
    semi, columns = how == "left_semi", samples.columns
    if semi:
        intervals = _disjoint(intervals, keys, start, end)
    first, last = epoch_micros(intervals, start), epoch_micros(intervals, end)
    levels = [r["l"] for r in intervals.select(_level(last - first).alias("l")).distinct().collect()]
    filed = intervals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(start).alias("_start"),
        F.col(end).alias("_end"),
        *[F.col(c) for c in intervals.columns if c not in (*keys, start, end)],
        _level(last - first).alias("_level_at"), first.alias("_first"), last.alias("_last"),
    )
    filed = filed.withColumn("_slot_at", F.explode(F.sequence(_slot(F.col("_first"), F.col("_level_at")), _slot(F.col("_last"), F.col("_level_at")))))
    probes = F.array(*[F.struct(F.lit(x).alias("l"), _slot(epoch_micros(samples, time), F.lit(x)).alias("s")) for x in sorted(levels) or [0]])
    left = samples.withColumn("_probe", F.explode(probes))
    condition = (F.col("_probe.l") == F.col("_level_at")) & (F.col("_probe.s") == F.col("_slot_at")) & (
        F.col(time) >= F.col("_start")) & (F.col(time) <= F.col("_end"))
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_k_{key}"))
    joined = left.join(filed, condition)
    if semi:
        return joined.select(*columns)
    return joined.drop("_probe", "_level_at", "_slot_at", "_first", "_last", *[f"_k_{k}" for k in keys]).withColumnsRenamed(
        {"_start": start, "_end": end}
    )


def slice_phase(samples: DataFrame, phases: DataFrame, run: list[str], phase: str, time: str, tie: list[str],
                start: str = "t_start", end: str = "t_end",
                parts: int | None = None) -> DataFrame:
    """Samples of each (run, phase); ``dt_s`` starts anew at 0 in every slice."""
    inside = join_intervals(samples, phases, run, time, start, end)
    # a slice is never longer than the run it is cut from
    return _add_dt(inside, [*run, phase], time, tie, long_runs(samples, run, time, tie, parts))


def phase_integrals(samples: DataFrame, phases: DataFrame, run: list[str], phase: str, time: str,
                    tie: list[str], rates: dict[str, Column], start: str = "t_start", end: str = "t_end",
                    parts: int | None = None) -> DataFrame:
    """CO2, energy or any other rate integrated per (run, phase)."""
    inside = join_intervals(samples, phases, run, time, start, end)
    return _integrate(inside, [*run, phase], time, tie, rates, long_runs(samples, run, time, tie, parts))


def in_any_interval(samples: DataFrame, intervals: DataFrame, keys: list[str], time: str,
                    start: str, end: str) -> DataFrame:
    """Samples that lie in at least one interval, each once."""
    return join_intervals(samples, intervals, keys, time, start, end, "left_semi")


def metric_summary(samples: DataFrame, cpu: str, gpu: str, co2_gs: str,
                   step_s: float = fixed.SAMPLE_STEP_S) -> DataFrame:
    """Minimum, maximum and mean of load and CO2 rate, one row per metric."""
    metrics = [("CPU %", cpu, 2), ("GPU %", gpu, 2), ("CO2 (g/s)", co2_gs, 6)]
    wide = samples.agg(
        *[
            f(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{n}_{i}")
            for i, (_, c, _) in enumerate(metrics)
            for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sum", F.sum))
        ]
    )
    rows = [
        F.struct(
            F.lit(label).alias("metric"),
            *[F.round(f"{n}_{i}", digits).alias(n) for n in ("min", "max", "mean")],
            (F.round(F.col(f"sum_{i}") * step_s, 4) if column == co2_gs else F.lit(0.0)).alias("total_co2_g"),
        )
        for i, (label, column, digits) in enumerate(metrics)
    ]
    return wide.select(F.inline(F.array(*rows)))


def smooth(df: DataFrame, run: list[str], time: str, tie: list[str], value: str, out: str = "smooth",
           rows: int = fixed.SMOOTHING_ROWS, parts: int | None = None) -> DataFrame:
    """Rolling mean over ``rows`` rows for runs longer than that; shorter runs stay as they are.

    The first ``rows - 1`` values of a smoothed run are null.
    """
    cuts = long_runs(df, run, time, tie, parts)
    numbered = OrderedRuns(df, run, time, tie, cuts).with_row_numbers("_rn")
    if cuts:
        # equal slices by row number, each preceded by the tail of the slice before
        size = max(cuts.share, 4 * rows)
        piece = F.floor((F.col("_rn") - 1) / size)
        tail = F.col("_rn") > (piece + 1) * size - (rows - 1)
        pieces = F.when(tail, F.array(piece, piece + 1)).otherwise(F.array(piece))
        framed = numbered.withColumn("_home", piece).withColumn(PART, F.explode(pieces))
        keys = [*run, PART]
    else:
        framed, keys = numbered, run
    frame = Window.partitionBy(*keys).orderBy("_rn").rowsBetween(-(rows - 1), 0)
    averaged = framed.withColumn("_mean", F.avg(value).over(frame)).withColumn("_n", F.count(value).over(frame))
    if cuts:
        averaged = averaged.filter(F.col("_home") == F.col(PART)).drop("_home", PART)
        lengths = df.groupBy(F.struct(*run).alias("_of")).agg(F.count(F.lit(1)).alias("_len"))
        averaged = averaged.withColumn("_of", F.struct(*run)).join(lengths, "_of").drop("_of")
    else:
        averaged = averaged.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*run)))
    rolled = F.when(F.col("_n") >= rows, F.col("_mean"))
    return averaged.withColumn(
        out, F.when(F.col("_len") > rows, rolled).otherwise(F.col(value))
    ).drop("_rn", "_mean", "_n", "_len")


def pad_single_sample(df: DataFrame, run: list[str], time: str) -> DataFrame:
    """Runs of one sample get an all-zero sample one second before and after it."""
    others = [c for c in df.columns if c not in (*run, time)]
    single = (
        df.groupBy(*run)
        .agg(F.count(F.lit(1)).alias("_n"), F.any_value(time).alias(time))
        .filter("_n = 1")
    )
    types = dict(df.dtypes)
    around = single.select(
        *run,
        F.explode(
            F.array(F.col(time) - F.expr("INTERVAL 1 SECOND"), F.col(time) + F.expr("INTERVAL 1 SECOND"))
        ).alias(time),
        *[F.lit(0).cast(types[c]).alias(c) for c in others],
    )
    return df.unionByName(around.select(*df.columns))


def session_metrics(runs: DataFrame, co2_g: str = "co2_g", seconds: str = "seconds",
                    rows: str = "rows") -> DataFrame:
    """Totals over all runs, with the mean of the score each run earned."""
    scored = runs.withColumn("_score", energy.green_score(co2_g, rows, seconds))
    return scored.agg(
        F.sum(co2_g).alias("total_co2_g"),
        F.count(F.lit(1)).alias("queries_executed"),
        F.avg("_score").alias("avg_green_score"),
        F.sum(seconds).alias("session_duration_s"),
    )


def kpi_history(operations: DataFrame, time: str, tie: list[str], co2_g: str = "co2_g",
                energy_wh: str = "energy_wh", parts: int | None = None) -> DataFrame:
    """Operation log with the running totals of CO2 and energy."""
    logged = operations.withColumn("_all", F.lit(1))
    runs = OrderedRuns(logged, ["_all"], time, tie, long_runs(logged, ["_all"], time, tie, parts))
    sums = {
        "total_co2_g": F.coalesce(F.col(co2_g), F.lit(0.0)),
        "total_energy_wh": F.coalesce(F.col(energy_wh), F.lit(0.0)),
    }
    return runs.with_running_sums(sums).drop("_all")


def last_operation(operations: DataFrame, time: str, tie: list[str]) -> DataFrame:
    """The most recent entry of the operation log."""
    newest = F.max_by(F.struct(*operations.columns), F.struct(time, *tie))
    return operations.agg(newest.alias("last")).select("last.*")


def phase_totals(integrals: DataFrame, phase: str, co2_g: str = "co2_g") -> DataFrame:
    return integrals.groupBy(phase).agg(F.sum(co2_g).alias("total_co2_g"))


def best_worst_query(results: DataFrame, query: str, co2_g: str = "co2_g", seconds: str = "seconds",
                     rows: str = "rows") -> DataFrame:
    """The queries with the lowest and the highest CO2, with time and score; ties go to the smaller name."""
    scored = results.select(
        F.col(query).alias("query"),
        F.col(co2_g).alias("co2_g"),
        F.col(seconds).alias("seconds"),
        energy.green_score(co2_g, rows, seconds).alias("score"),
    )
    low = F.min(F.struct("co2_g", "query", "seconds", "score"))
    high = F.min(F.struct((-F.col("co2_g")).alias("minus"), "query", "co2_g", "seconds", "score"))
    ends = scored.agg(low.alias("low"), high.alias("high"))
    rows_ = [
        F.struct(F.lit(kind).alias("kind"), *[F.col(f"{side}.{c}").alias(c) for c in ("query", "co2_g", "seconds", "score")])
        for kind, side in (("best", "low"), ("worst", "high"))
    ]
    return ends.select(F.inline(F.array(*rows_)))
