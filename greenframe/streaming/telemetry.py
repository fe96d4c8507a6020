"""Windows, sessions, live integrals, phase tags and alarms on a telemetry stream.

Nothing is kept longer than the watermark asks for. The live integral keeps its
state per time bucket rather than per run, so that a run holding most of the
stream is spread over tasks; :func:`finish_integrals` joins the buckets up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from greenframe.functions import energy
from greenframe.operators.ordered import OrderedRuns, long_runs
from greenframe.operators.telemetry import join_intervals


def telemetry_stream(spark: SparkSession, folder: str, schema: T.StructType, time: str = "ts", key: str | None = None,
                     delay: str = "10 minutes", fmt: str = "parquet", files: str | None = None,
                     files_per_batch: int = 100) -> DataFrame:
    """Samples as they arrive in ``folder``, with a watermark; repeats of ``key`` are dropped within it."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    if files:
        reader = reader.option("pathGlobFilter", files)
    stream = reader.load(folder).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return stream.dropDuplicatesWithinWatermark([key]) if key else stream


def power_windows(stream: DataFrame, run: list[str], time: str, length: str, slide: str | None = None,
                  power: str = "power_w", co2_gs: str = "co2_gs", step_s: float = 0.5) -> DataFrame:
    """Mean and peak power and CO2 per run and tumbling (or, with ``slide``, sliding) window."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    found = stream.groupBy(window, *run).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(power).alias("avg_power_w"), F.max(power).alias("max_power_w"),
        (F.sum(co2_gs) * step_s).alias("co2_g"),
    )
    return found.select(*run, F.col("window.start").alias("start"), F.col("window.end").alias("end"),
                        "samples", "avg_power_w", "max_power_w", "co2_g")


def run_sessions(stream: DataFrame, run: list[str], time: str, gap: str, power: str = "power_w") -> DataFrame:
    """Stretches of a run without a pause longer than ``gap``.

    Start and end are taken from the samples: a filter on the bounds of the
    session column itself would be applied before the samples are merged.
    """
    found = stream.groupBy(F.session_window(time, gap).alias("w"), *run).agg(
        F.min(time).alias("start"), (F.max(time) + F.expr(f"INTERVAL {gap}")).alias("end"),
        F.count(F.lit(1)).alias("samples"), F.max(power).alias("max_power_w"),
    )
    return found.select(*run, "start", "end", "samples", "max_power_w")


# ---- runs that share a state ------------------------------------------------

#: Runs of a time bucket are dealt to so many states: most runs have a few samples in a bucket, and a call per run and
#: bucket costs more than its samples. Fixed, since a stream that is started again must find its states.
SLICES = 64


def _sliced(stream: DataFrame, run: list[str], time: str, bucket_seconds: int, slices: int, others: list[Column]) -> DataFrame:
    """(_r0, .., _t, bucket, _slice, others): samples with their runs as texts, in which nulls stay nulls and no digit is lost."""
    micros = F.unix_micros(time)
    as_text = [(F.hex(r) if dict(stream.dtypes)[r] == "binary" else F.col(r).cast("string")).alias(f"_r{i}") for i, r in enumerate(run)]
    return stream.select(
        *as_text, F.col(time), micros.alias("_t"), F.floor(micros / (bucket_seconds * 1_000_000)).cast("long").alias("bucket"),
        F.pmod(F.xxhash64(*run, F.lit(7)), F.lit(slices)).alias("_slice"), *others,
    )


def _unsliced(updates: DataFrame, stream: DataFrame, run: list[str]) -> DataFrame:
    types = dict(stream.dtypes)
    back = [(F.unhex(f"_r{i}") if types[r] == "binary" else F.col(f"_r{i}").cast(types[r])).alias(r) for i, r in enumerate(run)]
    return updates.select(*back, *[c for c in updates.columns if c not in {f"_r{i}" for i in range(len(run))}])


def _run_codes(frame: pd.DataFrame, texts: list[str]) -> np.ndarray:
    """A number from 0 for each run; a null is a run of its own."""
    return frame.groupby(texts, dropna=False, sort=False).ngroup().to_numpy("int64")


def _expires(state: GroupState, bucket: int, width_us: int) -> None:
    state.setTimeoutTimestamp(max((int(bucket) + 1) * width_us // 1000, int(state.getCurrentWatermarkMs()) + 1))


def _starts_of(sorted_codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))


# ---- sessions that are still running ----------------------------------------

STRETCH = ["starts", "lasts", "counts", "peaks"]
OPEN = "starts array<long>, lasts array<long>, counts array<long>, peaks array<double>"


def _merged(codes, starts, lasts, counts, peaks, gap_us: int):
    """Stretches (sorted here) of one run that lie closer together than ``gap_us`` become one."""
    order = np.lexsort((lasts, starts, codes))
    codes, starts, lasts, counts, peaks = (x[order] for x in (codes, starts, lasts, counts, peaks))
    reach = pd.Series(lasts).groupby(codes).cummax().to_numpy()
    fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (starts[1:] - reach[:-1] >= gap_us)])
    first = np.flatnonzero(fresh)
    return codes[first], order[first], starts[first], np.maximum.reduceat(lasts, first), np.add.reduceat(counts, first), np.fmax.reduceat(peaks, first)


def live_sessions(stream: DataFrame, run: list[str], time: str, gap_seconds: int, power: str = "power_w",
                  bucket_seconds: int = 86_400, slices: int = SLICES) -> DataFrame:
    """Update stream of (run, bucket) with the sessions inside the bucket so far, those still running included.

    The state of a bucket is its sessions only; new samples are merged into them, whatever their order, and it goes
    when the watermark has passed the bucket. Its runs are dealt to ``slices`` states. :func:`finish_sessions` joins
    sessions across buckets.
    """
    gap, width = gap_seconds * 1_000_000, bucket_seconds * 1_000_000
    texts = [f"_r{i}" for i in range(len(run))]
    rows = _sliced(stream, run, time, bucket_seconds, slices, [F.col(power).cast("double").alias("_w")])

    def update(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = pd.DataFrame(dict(zip([*texts, *STRETCH], state.get))) if state.exists else None
        parts = [] if held is None else [held]
        for frame in frames:
            parts.append(pd.DataFrame({**{c: frame[c] for c in texts}, "starts": frame["_t"], "lasts": frame["_t"], "counts": 1, "peaks": frame["_w"]}))
        every = pd.concat(parts, ignore_index=True)
        codes = _run_codes(every, texts)
        kinds = ("int64", "int64", "int64", "float64")
        runs, rows_of, *merged = _merged(codes, *(every[c].to_numpy(k) for c, k in zip(STRETCH, kinds)), gap)
        names, lists = every[texts].iloc[rows_of].to_numpy(object), [x.tolist() for x in merged]
        state.update((*([r[i] for r in names] for i in range(len(texts))), *lists))
        _expires(state, key[-1], width)
        came = set(codes[0 if held is None else len(held):].tolist())
        starts = _starts_of(runs)
        out = [
            [*names[a], key[-1], *(x[a:b] for x in lists)]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(runs)]) if int(runs[a]) in came
        ]
        yield pd.DataFrame(out, columns=[*texts, "bucket", *STRETCH])

    listed = ", ".join(f"{c} array<string>" for c in texts)
    schema = ", ".join([*[f"{c} string" for c in texts], "bucket long", OPEN])
    found = rows.groupBy("_slice", "bucket").applyInPandasWithState(update, schema, f"{listed}, {OPEN}", "update", GroupStateTimeout.EventTimeTimeout)
    return _unsliced(found, stream, run)


def finish_sessions(buckets: DataFrame, run: list[str], gap_seconds: int) -> DataFrame:
    """(run, start, end, samples, max_power_w): sessions of buckets, joined where they go on in the next one."""
    each = buckets.select(*run, F.explode(F.arrays_zip("starts", "lasts", "counts", "peaks")).alias("s"))
    each = each.select(*run, F.timestamp_micros("s.starts").alias("start"), F.col("s.starts").alias("_t"), F.col("s.lasts").alias("_last"), F.col("s.counts").alias("_c"), F.col("s.peaks").alias("_p"))
    cuts = long_runs(each, run, "start", ["_last"])
    before = OrderedRuns(each, run, "start", ["_last"], cuts).with_previous(F.col("_last"), "_before")
    fresh = F.coalesce(F.col("_t") - F.col("_before") >= gap_seconds * 1_000_000, F.lit(True)).cast("long")
    numbered = OrderedRuns(before, run, "start", ["_last"], cuts).with_running_sums({"_session": fresh})
    found = numbered.groupBy(*run, "_session").agg(
        F.min("start").alias("start"), (F.timestamp_micros(F.max("_last")) + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("end"),
        F.sum("_c").alias("samples"), F.max("_p").alias("max_power_w"),
    )
    return found.drop("_session")


def phase_tags(stream: DataFrame, phases: DataFrame, run: list[str], time: str, start: str = "t_start",
               end: str = "t_end") -> DataFrame:
    """The stream joined with a static table of phases."""
    return join_intervals(stream, phases, run, time, start, end)


def alarms(stream: DataFrame, power: str = "power_w", max_w: float = 200.0) -> DataFrame:
    """Samples at 90 % of ``max_w`` or more."""
    return stream.filter(energy.power_alarm(power, max_w))


# ---- live integral ----------------------------------------------------------

STATE = ("first array<long>, last array<long>, n array<long>, sums array<double>, firsts array<double>, "
         "times array<long>, ties array<long>, rates array<double>")


def _folded(totals, codes, times, rates):
    """``totals`` (first, last, n, sums, firsts by run) with samples added that are sorted by run and time; a copy."""
    first, last, n, sums, firsts = (x.copy() for x in totals)
    if len(times):
        at = _starts_of(codes)
        who, ends = codes[at], np.append(at[1:], len(times))
        fresh = n[who] == 0
        before = np.concatenate([[0], times[:-1]])
        before[at] = np.where(fresh, times[at], last[who])
        first[who] = np.where(fresh, times[at], first[who])
        firsts[who] = np.where(fresh[:, None], rates[at], firsts[who])
        sums[who] += np.add.reduceat(((times - before) / 1e6)[:, None] * rates, at, axis=0)
        last[who] = times[ends - 1]
        n[who] += ends - at
    return first, last, n, sums, firsts


def live_integrals(stream: DataFrame, run: list[str], time: str, tie: str, rates: dict[str, Column],
                   bucket_seconds: int = 3600, slices: int = SLICES) -> DataFrame:
    """Update stream of (run, bucket): first and last sample, count and the integral of every rate so far.

    Samples may come in any order within the watermark: those it has passed are folded, the others kept aside. The runs
    of a bucket are dealt to ``slices`` states. ``tie`` is a whole number.
    """
    names, width = list(rates), bucket_seconds * 1_000_000
    m, texts = len(names), [f"_r{i}" for i in range(len(run))]
    rows = _sliced(stream, run, time, bucket_seconds, slices, [
        F.col(tie).cast("long").alias("_tie"), *[F.coalesce(rate, F.lit(0.0)).alias(name) for name, rate in rates.items()]])
    columns = [*texts, "bucket", "first_us", "last_us", "samples", *names, *[f"first_{n}" for n in names]]

    def update(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        # runs with totals come first, then a row per sample kept aside, then the new samples
        known, aside = pd.DataFrame(columns=texts, dtype=object), pd.DataFrame(columns=texts, dtype=object)
        times, ties, values = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros((0, m))]
        totals = [np.zeros(0, "int64")] * 3 + [np.zeros((0, m))] * 2
        if state.exists:
            held = state.get
            k = len(texts)
            known, aside = pd.DataFrame(dict(zip(texts, held[:k])), dtype=object), pd.DataFrame(dict(zip(texts, held[k:2 * k])), dtype=object)
            totals = [*(np.array(x, "int64") for x in held[2 * k:2 * k + 3]), *(np.array(x, float).reshape(-1, m) for x in held[2 * k + 3:2 * k + 5])]
            times, ties, values = [np.array(held[-3], "int64")], [np.array(held[-2], "int64")], [np.array(held[-1], float).reshape(-1, m)]
        parts = [known, aside]
        for frame in frames:
            parts.append(frame[texts])
            times.append(frame["_t"].to_numpy("int64"))
            ties.append(frame["_tie"].to_numpy("int64"))
            values.append(frame[names].to_numpy(float))
        every = pd.concat(parts, ignore_index=True)
        codes = _run_codes(every, texts)
        # a run is numbered where it comes first, so the known ones keep their places
        firsts_of = np.unique(codes, return_index=True)[1]
        named, more = every[texts].iloc[firsts_of].to_numpy(object), len(firsts_of) - len(known)
        totals = [np.concatenate([x, np.zeros((more, *x.shape[1:]), x.dtype)]) for x in totals]
        codes, came = codes[len(known):], np.unique(codes[len(known) + len(aside):])
        times, ties, values = np.concatenate(times), np.concatenate(ties), np.concatenate(values)
        order = np.lexsort((ties, times, codes))
        codes, times, ties, values = codes[order], times[order], ties[order], values[order]
        settled = times < state.getCurrentWatermarkMs() * 1000
        totals = _folded(totals, codes[settled], times[settled], values[settled])
        codes, times, ties, values = codes[~settled], times[~settled], ties[~settled], values[~settled]
        state.update((
            *(named[:, i].tolist() for i in range(len(texts))), *(named[codes, i].tolist() for i in range(len(texts))),
            *(x.ravel().tolist() for x in totals), times.tolist(), ties.tolist(), values.ravel().tolist(),
        ))
        _expires(state, key[-1], width)
        first, last, n, sums, firsts = (x[came] for x in _folded(totals, codes, times, values))
        cells = [*named[came].T, np.full(len(came), key[-1]), first, last, n, *sums.T, *firsts.T]
        yield pd.DataFrame(dict(zip(columns, cells)), columns=columns)

    listed = ", ".join(f"{side}{c} array<string>" for side in ("known", "aside") for c in texts)
    schema = ", ".join([*[f"{c} string" for c in texts], "bucket long, first_us long, last_us long, samples long",
                        *[f"{n} double" for n in names], *[f"first_{n} double" for n in names]])
    found = rows.groupBy("_slice", "bucket").applyInPandasWithState(update, schema, f"{listed}, {STATE}", "update", GroupStateTimeout.EventTimeTimeout)
    return _unsliced(found, stream, run)


def finish_integrals(buckets: DataFrame, run: list[str], names: list[str]) -> DataFrame:
    """Per run: the integrals over all buckets, with the steps from one bucket to the next."""
    order = Window.partitionBy(*run).orderBy("bucket")
    gap = F.coalesce((F.col("first_us") - F.lag("last_us").over(order)) / 1e6, F.lit(0.0))
    return buckets.withColumn("_gap", gap).groupBy(*run).agg(
        *[(F.sum(n) + F.sum(F.col(f"first_{n}") * F.col("_gap"))).alias(n) for n in names], F.sum("samples").alias("samples")
    )


# ---- running a stream over what is there ------------------------------------


def late_rows(query) -> int:
    """Rows that came behind the watermark and were left out by the first operator that keeps state."""
    operators = [p.stateOperators for p in query.recentProgress]
    return sum(x[-1].numRowsDroppedByWatermark for x in operators if x)


def drain(stream: DataFrame, target: str, late: list[int] | None = None) -> DataFrame:
    """Process all files there are, appending final rows to Parquet below ``target``; ``late`` takes the number of late rows.

    Called again for the same target with a stream over more files, it goes on where it stopped.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{target}/data")
        .option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if late is not None:
        late.append(late_rows(query))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{target}/data")


def drain_updates(stream: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Process all files there are; the last update of every key.

    Each batch goes to a folder of its own, so that a repeated batch replaces itself.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/data/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    updates = stream.sparkSession.read.schema(schema).parquet(f"{target}/data")
    others = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*others), "batch").alias("newest")
    return updates.groupBy(*keys).agg(newest).select(*keys, "newest.*")
