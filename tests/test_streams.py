"""Streams of job events in several batches, their timers and what is left of their state."""

import random

import pytest
from pyspark.sql import functions as F

from mediaspan.sources.scratch import folder
from mediaspan.streaming import jobs as J

SF = "/root/testdata/sf0.001"
LOG = "job_id long, event_id long, at timestamp, status string, progress int"
MINUTE = 60_000_000


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def replayed(spark, log, batches, op):
    """The operator over the log's rows in so many batches, one file each, and the query's last progress."""
    path, out, state = folder(spark), folder(spark), folder(spark)
    for i in range(batches):
        spark.createDataFrame(log[i::1] if batches == 1 else log[i * len(log) // batches : (i + 1) * len(log) // batches], LOG).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    query = op(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(op(stream).schema).parquet(out), query.lastProgress


@pytest.fixture(scope="module")
def log(spark):
    path = f"{SF}/events.parquet"
    events = J.job_log(spark.read.parquet(path).select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", "props"))
    return [tuple(r) for r in events.orderBy("at", "event_id").collect()]


def shuffled(log, seed, width=6 * MINUTE):
    """Each event up to six minutes late."""
    rng = random.Random(seed)
    return sorted(log, key=lambda r: r[2].timestamp() * 1e6 + rng.randrange(width))


@pytest.mark.parametrize("op", [J.lifecycle, lambda s: J.changes(s.drop("progress"))])
def test_batches_and_order_of_arrival_do_not_matter(spark, log, op):
    once, _ = replayed(spark, log, 1, op)
    some, _ = replayed(spark, shuffled(log, 3), 5, op)
    assert rows(once) == rows(some) and len(rows(once)) > 300


def at(minutes, job=1, event=None, status="running", progress=None):
    import datetime

    return (job, minutes if event is None else event, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes), status, progress)


def verdicts(df):
    return [(r.event_id, r.verdict, r.reason) for r in df.orderBy("at_us", F.col("event_id").asc_nulls_last()).where("job_id = 1").collect()]


def test_a_timer_fails_a_stalled_job_and_its_state_goes(spark):
    op = lambda s: J.lifecycle(s, stale_us=60 * MINUTE, expire_us=120 * MINUTE)
    tail = [at(m, job=2, event=m, status="queued") for m in (400, 1000, 3000)]
    first = [at(0, status="queued"), at(10, progress=5), at(20, progress=3), at(30, status="queued"), at(40, progress=7)]
    out, last = replayed(spark, first + tail, 4, op)
    assert verdicts(out) == [(0, "accepted", None), (10, "accepted", None), (20, "rejected", "progress"), (30, "rejected", "move"), (40, "accepted", None), (None, "failed", "stalled")]
    # Job 1 is forgotten; of job 2 only the event that the watermark hasn't passed is held.
    assert sum(s["numRowsTotal"] for s in last["stateOperators"]) == 1


def test_a_job_that_ended_stays_so_until_it_is_forgotten(spark):
    op = lambda s: J.lifecycle(s, stale_us=60 * MINUTE, expire_us=120 * MINUTE)
    log = [at(0), at(5, status="succeeded", progress=80), at(6), at(124), at(130), at(1000, job=2)]
    out, _ = replayed(spark, log, 3, op)
    assert verdicts(out) == [(0, "accepted", None), (5, "accepted", None), (6, "rejected", "ended"), (124, "rejected", "ended"), (130, "accepted", None), (None, "failed", "stalled")]


def test_neighbouring_jobs_share_a_row_of_state(spark):
    log = [at(j / 100, job=j, event=j, status="queued") for j in range(64)] + [at(30, job=0, event=64, status="queued")]
    out, last = replayed(spark, log, 2, J.lifecycle)
    assert out.count() == 64 and {r.verdict for r in out.collect()} == {"accepted"}
    # 64 jobs are known and one event of job 0 is held.
    assert sum(s["numRowsTotal"] for s in last["stateOperators"]) == 4


def test_neighbouring_jobs_do_not_matter_to_each_other(spark):
    op = lambda s: J.lifecycle(s, stale_us=60 * MINUTE, expire_us=120 * MINUTE)
    rng = random.Random(5)
    log = [at(m, job=rng.randrange(-20, 20), event=m, status=rng.choice(["queued", "running", "running", "succeeded", "failed"]), progress=rng.choice([None, m % 97])) for m in range(0, 3000, 5)]
    near, _ = replayed(spark, log, 3, op)
    apart, _ = replayed(spark, [(1000 * r[0], *r[1:]) for r in log], 3, op)
    assert rows(near) == rows(apart.withColumn("job_id", (F.col("job_id") / 1000).cast("long")))
    assert {r.reason for r in near.collect()} == {None, "ended", "move", "progress", "stalled"}


def test_large_ids_beside_a_stalled_job_are_exact_and_events_without_a_time_are_left_out(spark):
    big = 2**53
    log = [at(0, event=big + 1), at(1, job=big + 1, event=big + 3), (1, 7, None, "running", None), at(1000, job=2), at(1001, job=2)]
    out, _ = replayed(spark, log, 1, J.lifecycle)
    assert sorted((r.job_id, r.event_id or 0, r.verdict) for r in out.where("job_id <> 2").collect()) == [(1, 0, "failed"), (1, big + 1, "accepted"), (big + 1, 0, "failed"), (big + 1, big + 3, "accepted")]


def test_the_feed_stops_at_the_end(spark):
    log = [at(0, status="queued"), at(1, status="queued"), at(2), at(3, status="failed"), at(4), at(5, status="queued"), at(3000, status="queued"), at(9000, job=2)]
    out, _ = replayed(spark, log, 2, lambda s: J.changes(s.drop("progress")))
    assert [r.event_id for r in out.where("job_id = 1").orderBy("event_id").collect()] == [0, 2, 3, 3000]


def test_spans_are_dealt_to_windows_in_part(spark):
    spans = spark.createDataFrame([(0, 90), (30, 45), (59, 61), (150, 400), (7, 7)], "a long, b long").select(F.timestamp_micros(F.col("a") * 1_000_000).alias("at"), (F.col("a") * 1_000_000).alias("start_us"), (F.col("b") * 1_000_000).alias("end_us"))
    got = {r.window_id: (r.speech_us // 1_000_000, r.ratio) for r in J.density(spans, 60_000_000).collect()}
    assert got == {0: (76, 1.0), 1: (31, 0.516667), 2: (30, 0.5), 3: (60, 1.0), 4: (60, 1.0), 5: (60, 1.0), 6: (40, 0.666667)}
    assert sum(v for v, _ in got.values()) == 90 + 15 + 2 + 250
