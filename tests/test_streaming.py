"""Streams over several files, with late-looking order inside the watermark, against the batch result."""

from datetime import datetime, timedelta
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from greenframe.operators import telemetry as tm
from greenframe.streaming import telemetry as live


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Five files; neighbouring files overlap in time and repeat a few samples."""
    rng, folder = Random(9), str(tmp_path_factory.mktemp("feed"))
    rows = []
    for i in range(600):
        run = "hot" if i % 3 else f"r{i % 5}"
        rows.append((run, datetime(2024, 1, 1) + timedelta(seconds=30 * i + rng.randrange(20)), i, rng.uniform(0, 100)))
    schema = "run string, ts timestamp, id long, cpu_percent double"
    for part in range(5):
        piece = rows[max(0, part * 120 - 3):(part + 1) * 120]
        # swap the order within the file and hand some samples over to the next one
        late = piece[-6:-3] if part < 4 else []
        keep = [r for r in piece if r not in late]
        if part:
            keep += carried
        carried = late
        rng.shuffle(keep)
        spark.createDataFrame(keep, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, tm.with_power(spark.createDataFrame(rows, schema)).cache()


def opened(spark, feed):
    folder, batch = feed
    stream = live.telemetry_stream(spark, folder, batch.select("run", "ts", "id", "cpu_percent").schema, key="id", files_per_batch=1)
    return tm.with_power(stream)


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_repeats_are_dropped(spark, feed, tmp_path):
    got = live.drain(opened(spark, feed).select("id"), str(tmp_path))
    assert sorted(r["id"] for r in got.collect()) == list(range(600))


def test_windows(spark, feed, tmp_path):
    for slide in (None, "5 minutes"):
        make = lambda df: live.power_windows(df, ["run"], "ts", "10 minutes", slide)  # noqa: E731, B023
        got = live.drain_updates(make(opened(spark, feed)), str(tmp_path / str(slide)), ["run", "start", "end"])
        assert rows(got) == rows(make(feed[1]))


def test_sessions(spark, feed, tmp_path):
    make = lambda df: live.run_sessions(df, ["run"], "ts", "2 minutes")
    got = live.drain(make(opened(spark, feed)), str(tmp_path))
    # what the watermark has not passed stays open; after the removal of repeats it trails by a batch
    latest = feed[1].agg(F.max("ts")).first()[0]
    found, every = set(rows(got)), set(rows(make(feed[1])))
    closed = set(rows(make(feed[1]).filter(F.col("end") <= F.lit(latest - timedelta(minutes=75)))))
    assert found <= every and closed <= found and len(closed) > 100


@pytest.mark.parametrize("bucket", [60, 3600, 10**6])
def test_live_integral(spark, feed, tmp_path, bucket):
    rates = {"co2_g": F.col("co2_gs"), "energy_j": F.col("power_w")}
    updates = live.live_integrals(opened(spark, feed), ["run"], "ts", "id", rates, bucket)
    buckets = live.drain_updates(updates, str(tmp_path), ["run", "bucket"])
    got = live.finish_integrals(buckets, ["run"], list(rates))
    want = tm.integrate(feed[1], ["run"], "ts", ["id"], rates).drop("seconds")
    assert rows(got) == rows(want)


def test_phase_tags_and_alarms(spark, feed, tmp_path):
    t0 = datetime(2024, 1, 1)
    marks = spark.createDataFrame([("hot", "a", t0, t0 + timedelta(hours=1)), ("hot", "b", t0 + timedelta(minutes=50), t0 + timedelta(hours=2))],
                                  "run string, phase string, t_start timestamp, t_end timestamp")
    make = lambda df: live.phase_tags(df, marks, ["run"], "ts").select("id", "phase")
    assert rows(live.drain(make(opened(spark, feed)), str(tmp_path / "p"))) == rows(make(feed[1]))
    loud = lambda df: live.alarms(df, max_w=65.0).select("id")
    assert rows(live.drain(loud(opened(spark, feed)), str(tmp_path / "a"))) == rows(loud(feed[1]))


@pytest.mark.parametrize("bucket", [300, 10**7])
def test_running_sessions(spark, feed, tmp_path, bucket):
    updates = live.live_sessions(opened(spark, feed), ["run"], "ts", 120, bucket_seconds=bucket)
    got = live.finish_sessions(live.drain_updates(updates, str(tmp_path), ["run", "bucket"]), ["run"], 120)
    assert rows(got) == rows(live.run_sessions(feed[1], ["run"], "ts", "2 minutes"))


def test_a_stopped_stream_goes_on(spark, feed, tmp_path):
    """Half of the files, a stop, and the rest from the checkpoint: as one batch, late rows counted."""
    import glob
    import shutil

    folder, batch = feed
    files = sorted(glob.glob(f"{folder}/*.parquet"), key=lambda f: (Path(f).stat().st_mtime_ns, f))
    arrived, target, late = tmp_path / "arrived", str(tmp_path / "out"), []
    arrived.mkdir()
    schema = batch.select("run", "ts", "id", "cpu_percent").schema
    for half in (files[:2], files[2:]):
        for f in half:
            shutil.copy2(f, arrived)
        stream = live.telemetry_stream(spark, str(arrived), schema, key="id", delay="2 hours", files_per_batch=1)
        got = live.drain(stream.select("id"), target, late)
    assert sorted(r["id"] for r in got.collect()) == list(range(600)) and late == [0, 0]
    old = spark.createDataFrame([("r0", datetime(2023, 12, 1), 10_000, 5.0), ("r0", datetime(2023, 12, 2), 10_001, 5.0)], schema)
    old.coalesce(1).write.mode("append").parquet(str(arrived))
    got = live.drain(stream.select("id"), target, late)
    assert got.count() == 600 and late == [0, 0, 2]


def test_runs_of_a_bucket_share_states(spark, tmp_path):
    """Hundreds of runs in four states, a null and numbers beyond 2**53 among them; the results are those of the whole."""
    folder = str(tmp_path / "feed")
    batch = spark.range(3000).select(
        F.when(F.col("id") % 300 != 5, F.lit(2**60) + F.col("id") % 300).alias("run"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7 % 20_000).alias("ts"),
        "id", (F.col("id") % 101).cast("double").alias("cpu_percent"))
    batch.repartition(3).write.parquet(folder)
    stream = lambda: tm.with_power(live.telemetry_stream(spark, folder, batch.schema, key="id", files_per_batch=1, delay="2 days"))
    rates = {"co2_g": F.col("co2_gs"), "energy_j": F.col("power_w")}
    for name, updates, keys in (
        ("s", live.live_sessions(stream(), ["run"], "ts", 120, bucket_seconds=10**9, slices=4), ["run", "bucket"]),
        ("i", live.live_integrals(stream(), ["run"], "ts", "id", rates, 10**9, slices=4), ["run", "bucket"]),
    ):
        found = live.drain_updates(updates, str(tmp_path / name), keys)
        states = spark.read.format("statestore").option("operatorId", 0).load(str(tmp_path / name / "progress")).count()
        assert states <= 4 and found.count() == 300
        if name == "s":
            assert rows(live.finish_sessions(found, ["run"], 120)) == rows(live.run_sessions(tm.with_power(batch), ["run"], "ts", "2 minutes"))
        else:
            assert rows(live.finish_integrals(found, ["run"], list(rates)).filter("run IS NOT NULL")) == rows(tm.integrate(tm.with_power(batch), ["run"], "ts", ["id"], rates).drop("seconds").filter("run IS NOT NULL"))
