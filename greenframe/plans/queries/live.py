"""Streaming queries: ``events`` arriving as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenframe.operators.telemetry import with_power
from greenframe.plans.queries.support import EVEN_SAMPLES_SQL, EVEN_TDP, PHASES_SQL, phases, rounded, table
from greenframe.session import scratch_path
from greenframe.streaming import telemetry as live

RUN = ["user_id"]
#: The events arrive in so many parts, one after the other in time, and the stream is stopped and started again half-way.
PARTS, FILES = 4, 4
#: An event comes again with the next part at the latest; what comes later than this is late.
DELAY = "10 days"


def _arrive(events, feed: str, part: int, late: bool) -> None:
    """One part of the events as files: out of order, some events twice, some of the part before again.

    With ``late``, some events of the first eighth of the time come with the last part only.
    """
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    eighth = F.least(F.floor((F.unix_micros("ts") - first) * 8 / (last - first + 1)), F.lit(7))
    held = (eighth == 0) & (F.col("event_id") % 50 == 7) if late else F.lit(False)
    home = F.when(held, PARTS - 1).otherwise(F.floor(eighth * PARTS / 8))
    again = F.when((F.col("event_id") % 10 == 3) & ~held & (home + 1 < PARTS), home + 1)
    twice = F.when((F.col("event_id") % 25 == 1) & ~held, home)
    comes = events.withColumn("_part", F.explode(F.array_compact(F.array(home, again, twice))))
    comes.filter(F.col("_part") == part).drop("_part").repartition(FILES, F.xxhash64("event_id", F.lit(part))).write.mode("append").parquet(feed)


def _streamed(spark, folder, label, make, keys=None, late=None):
    """The events as a stream of files without repeats, through ``make``; all parts, with a restart between them."""
    target = scratch_path(spark, label)
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    result = None
    for part in range(PARTS):
        _arrive(events, f"{target}/feed", part, late is not None)
        if part % 2:
            stream = live.telemetry_stream(spark, f"{target}/feed", events.schema, key="event_id", delay=DELAY, files_per_batch=FILES)
            stream = make(with_power(stream.withColumn("cpu_percent", F.least("value", F.lit(100.0))), tdp=EVEN_TDP))
            result = live.drain_updates(stream, target, keys) if keys else live.drain(stream, target, late)
    return result


def _r(digits, *columns):
    return [F.round(c, digits).alias(c) for c in columns]


def _text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def stream_power_windows(spark, folder):
    latest = _streamed(spark, folder, "windows", lambda s: live.power_windows(s, RUN, "ts", "6 hours"), [*RUN, "start", "end"])
    return latest.select("user_id", _text("start"), "samples", *_r(8, "avg_power_w", "co2_g"), *_r(4, "max_power_w"))


def stream_sliding_windows(spark, folder):
    latest = _streamed(spark, folder, "sliding", lambda s: live.power_windows(s, [], "ts", "1 hour", "30 minutes"), ["start", "end"])
    return latest.select(_text("start"), "samples", *_r(8, "co2_g"), *_r(4, "max_power_w"))


def stream_sessions(spark, folder):
    """Sessions with pauses of up to four hours, those still running included."""
    gap = 4 * 3600
    buckets = _streamed(spark, folder, "sessions", lambda s: live.live_sessions(s, RUN, "ts", gap), [*RUN, "bucket"])
    return live.finish_sessions(buckets, RUN, gap).select("user_id", _text("start"), "samples", *_r(4, "max_power_w"))


def stream_integrals(spark, folder):
    rates = {"co2_g": F.col("co2_gs"), "energy_j": F.col("power_w")}
    buckets = _streamed(spark, folder, "integrals", lambda s: live.live_integrals(s, RUN, "ts", "event_id", rates, 86_400), [*RUN, "bucket"])
    return live.finish_integrals(buckets, RUN, list(rates)).select("user_id", *_r(4, "co2_g"), *_r(2, "energy_j"), "samples")


def stream_phase_tags(spark, folder):
    marks = phases(spark, folder).withColumns({c: F.col(c).cast("timestamp") for c in ("t_start", "t_end")})
    return _streamed(spark, folder, "phases", lambda s: live.phase_tags(s, marks, RUN, "ts").select("event_id", "user_id", "phase"))


def stream_alarms(spark, folder):
    return _streamed(spark, folder, "alarms", lambda s: live.alarms(s, max_w=EVEN_TDP).select("event_id", "user_id", F.round("power_w", 4).alias("power_w")))


def stream_without_repeats(spark, folder):
    return _streamed(spark, folder, "unique", lambda s: s.select("event_id", "user_id"))


def stream_late_rows(spark, folder):
    """The events that came in time, and how many did not."""
    late: list[int] = []
    kept = _streamed(spark, folder, "late", lambda s: s.select("event_id", "user_id"), late=late)
    return kept.withColumn("late_rows", F.lit(sum(late)).cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_power_windows, stream_sliding_windows, stream_sessions, stream_integrals, stream_phase_tags, stream_alarms,
        stream_without_repeats, stream_late_rows,
    )
}

_START = "strftime({}, '%Y-%m-%d %H:%M:%S.%f') AS start"
_WINDOW = f"count(*) AS samples, {rounded('sum(co2_gs) * 0.5', 8)} AS co2_g, {rounded('max(power_w)', 4)} AS max_power_w"

ORACLES = {
    "stream_power_windows": f"""WITH {EVEN_SAMPLES_SQL}
SELECT user_id, {_START.format("time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')")}, {rounded('avg(power_w)', 8)} AS avg_power_w, {_WINDOW}
FROM samples GROUP BY user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')""",
    "stream_sliding_windows": f"""WITH {EVEN_SAMPLES_SQL},
placed AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS s FROM samples, range(0, 2) AS r(i))
SELECT {_START.format('s')}, {_WINDOW} FROM placed GROUP BY s""",
    "stream_sessions": f"""WITH {EVEN_SAMPLES_SQL},
marked AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM samples),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked),
sessions AS (SELECT user_id, session, min(ts) AS s, count(*) AS samples, max(power_w) AS w FROM numbered GROUP BY user_id, session)
SELECT user_id, {_START.format('s')}, samples, {rounded('w', 4)} AS max_power_w FROM sessions""",
    "stream_integrals": f"""WITH {EVEN_SAMPLES_SQL},
stepped AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 0.0) AS dt_s FROM samples)
SELECT user_id, {rounded('sum(co2_gs * dt_s)', 4)} AS co2_g, {rounded('sum(power_w * dt_s)', 2)} AS energy_j, count(*) AS samples
FROM stepped GROUP BY user_id""",
    "stream_phase_tags": f"WITH {EVEN_SAMPLES_SQL}, {PHASES_SQL} SELECT event_id, user_id, phase FROM sliced",
    "stream_alarms": f"""WITH {EVEN_SAMPLES_SQL} SELECT event_id, user_id, {rounded('power_w', 4)} AS power_w FROM samples WHERE power_w >= 72.0 * 0.9""",
    "stream_without_repeats": "SELECT event_id, user_id FROM events",
    "stream_late_rows": """WITH placed AS (SELECT *, event_id % 50 = 7 AND (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 8
  < (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events) AS late FROM events)
SELECT event_id, user_id, (SELECT count(*) FROM placed WHERE late) AS late_rows FROM placed WHERE NOT late""",
}
