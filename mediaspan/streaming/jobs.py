"""Streams of job events: duplicates, densities, sessions and change-only feeds."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
# The statuses that end a job, and those that may follow each one.
TERMINAL = ("succeeded", "failed", "cancelled")
MOVES = {"": ("queued", "running"), "queued": ("queued", "running", "cancelled", "failed"), "running": ("running", "succeeded", "cancelled", "failed")}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of (event_id, at, job_id, event_type, value)."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("job_id"), "event_type", "value", "props")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def unique(stream: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark is past them."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def job_log(stream: DataFrame) -> DataFrame:
    """events() as a job log: job_id, event_id, at, status, progress."""
    status = F.element_at(F.create_map(*[F.lit(x) for pair in (("view", "queued"), ("click", "running"), ("purchase", "succeeded"), ("error", "failed"), ("signup", "running")) for x in pair]), F.col("event_type"))
    return stream.select("job_id", "event_id", "at", status.alias("status"), F.get_json_object("props", "$.k").cast("int").alias("progress"))


def density(spans: DataFrame, width_us: int = HOUR_US, late: str = "10 minutes") -> DataFrame:
    """spans(at, start_us, end_us), `at` being the time of their start: how much of each tumbling window
    they fill. A span is dealt to every window that it meets, with its length within it."""
    met = spans.withWatermark("at", late).where("end_us > start_us").withColumn("w", F.explode(F.sequence(F.floor(F.col("start_us") / width_us), F.floor((F.col("end_us") - 1) / width_us))))
    inside = F.least("end_us", (F.col("w") + 1) * width_us) - F.greatest("start_us", F.col("w") * width_us)
    out = met.groupBy(F.col("w").alias("window_id")).agg(F.sum(inside).alias("speech_us"), F.count("*").alias("n"))
    return out.withColumn("ratio", F.round(F.least(F.lit(1.0), F.col("speech_us") / width_us), 6))


def utterances(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a job's events without a gap."""
    return stream.withWatermark("at", late).groupBy("job_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("job_id", F.col("session_window.start").alias("start"), "n")


class Fold:
    """What a job's events do to its state, in order of their time.

    `on` gets a job's state (None at first) and an event, `overdue` a state whose `due` time the
    watermark has passed; both give the new state (None: forgotten) and rows to emit.
    """

    def on(self, job: int, state: dict | None, event: dict) -> tuple[dict | None, list[tuple]]:
        raise NotImplementedError

    def due(self, state: dict) -> int:
        raise NotImplementedError

    def overdue(self, job: int, state: dict) -> tuple[dict | None, list[tuple]]:
        raise NotImplementedError


def _ms(us: int) -> int:
    return -(-us // 1000)


#: Job ids alike but for so many bits at the end share a state and a call of Python, which takes milliseconds however few its rows are.
TOGETHER_BITS = 4
#: Results in one text, as Python passes texts on by the ten thousand.
PASSED_ROWS = 50


def in_order(stream: DataFrame, fold: Fold, columns: list[str], schema: str, late: str = "10 minutes") -> DataFrame:
    """stream(job_id, event_id, at, columns) folded by job in order of (at, event_id), whatever the order of arrival.

    A job's state holds the events that the watermark hasn't passed yet, so what comes out doesn't
    depend on how events are dealt into batches; a timer in event time calls the job when the
    watermark passes its next event or the time its state is due, also if nothing comes in.
    Events later than the watermark are dropped by Spark, those without a time here.

    Jobs whose ids differ in the last TOGETHER_BITS bits only share a row of state and its timer.
    Events and results pass between Spark and Python as JSON: it is read only when something is due.
    """

    def call(_, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        due, known, waiting = held.get if held.exists else (None, "[]", "")
        if not held.hasTimedOut:
            texts = [waiting] if waiting else []
            for rows in frames:
                texts += rows["event"].tolist()
                first = _ms(int(rows["us"].min()))
                due = first if due is None else min(due, first)
            waiting = ",".join(texts)
        passed, out = held.getCurrentWatermarkMs(), []
        if due < passed:
            jobs, left, times = {job: (state, []) for job, state in json.loads(known)}, [], []
            for event in json.loads(f"[{waiting}]"):
                values = list(event.values())
                jobs.setdefault(values[0], (None, []))[1].append(values)
            for job, (state, events) in jobs.items():
                events.sort(key=lambda x: (x[1], x[2] is None, x[2]))
                ready = bisect_left(events, passed, key=lambda x: _ms(x[1]))
                for values in events[:ready]:
                    state, rows = fold.on(job, state, dict(zip(names, values, strict=True)))
                    out += rows
                while state is not None and _ms(fold.due(state)) < passed:
                    state, rows = fold.overdue(job, state)
                    out += rows
                jobs[job] = state
                left += events[ready:]
                times += [_ms(x[1]) for x in events[ready : ready + 1]] + ([] if state is None else [_ms(fold.due(state))])
            due = min(times, default=None)
            known = json.dumps([[job, state] for job, state in jobs.items() if state is not None])
            waiting = json.dumps([dict(enumerate(x)) for x in left])[1:-1]
        if due is None:
            held.remove()
        else:
            held.update((due, known, waiting))
            held.setTimeoutTimestamp(max(passed + 1, due))
        if out:
            yield pd.DataFrame({"rows": [json.dumps(out[i : i + PASSED_ROWS]) for i in range(0, len(out), PASSED_ROWS)]})

    names = ["job_id", "at", "event_id", *columns]
    values = [F.col("job_id"), F.unix_micros("at"), F.col("event_id"), *map(F.col, columns)]
    event = F.to_json(F.struct(*[v.alias(str(i)) for i, v in enumerate(values)]), {"ignoreNullFields": "false"})
    rows = stream.withWatermark("at", late).where("at IS NOT NULL").select(F.shiftright("job_id", TOGETHER_BITS).alias("jobs"), "at", F.unix_micros("at").alias("us"), event.alias("event"))
    done = rows.groupBy("jobs").applyInPandasWithState(call, "rows string", "due long, known string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    fields = [x.split() for x in schema.split(",")]
    return done.select(F.explode(F.from_json("rows", "array<array<string>>")).alias("row")).select(*[F.col("row")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])


class Changes(Fold):
    """Rows whose status differs from the last one; after a terminal status none until the job is
    forgotten, `expire_us` after its last change of status."""

    def __init__(self, terminal: tuple[str, ...], expire_us: int):
        self.terminal, self.expire_us = terminal, expire_us

    def on(self, job, state, event):
        if state is not None and event["at"] > self.due(state):
            state = None
        if state is not None and (state["status"] in self.terminal or state["status"] == event["status"]):
            return state, []
        return {"status": event["status"], "at": event["at"]}, [(job, event["event_id"], event["status"])]

    def due(self, state):
        return state["at"] + self.expire_us

    def overdue(self, job, state):
        return None, []


def changes(stream: DataFrame, terminal: tuple[str, ...] = TERMINAL, expire_us: int = DAY_US, late: str = "10 minutes") -> DataFrame:
    """stream(job_id, event_id, at, status): see Changes."""
    return in_order(stream, Changes(terminal, expire_us), ["status"], "job_id long, event_id long, status string", late)


class Lifecycle(Fold):
    """Judges each event of a job: accepted, or rejected (`move` isn't allowed from the status it has,
    it has `ended`, or its `progress` would go back); a running job without an accepted event for
    `stale_us` failed then. Jobs are forgotten `expire_us` after their last accepted event or end."""

    def __init__(self, moves: dict[str, tuple[str, ...]], stale_us: int, expire_us: int):
        self.moves, self.stale_us, self.expire_us = moves, stale_us, expire_us

    def on(self, job, state, event):
        out = []
        while state is not None and event["at"] > self.due(state):
            state, rows = self.overdue(job, state)
            out += rows
        status, progress = event["status"], event["progress"]
        before = state or {"status": "", "progress": None, "ended": False}
        if before["ended"]:
            reason = "ended"
        elif status not in self.moves.get(before["status"], ()):
            reason = "move"
        elif progress is not None and before["progress"] is not None and progress < before["progress"]:
            reason = "progress"
        else:
            reason = None
            done = 100 if status == "succeeded" else before["progress"] if progress is None else progress
            state = {"status": status, "progress": done, "at": event["at"], "ended": status in TERMINAL}
        return state, [*out, (job, event["event_id"], event["at"], status, "rejected" if reason else "accepted", reason)]

    def due(self, state):
        return state["at"] + (self.stale_us if state["status"] == "running" and not state["ended"] else self.expire_us)

    def overdue(self, job, state):
        if state["status"] == "running" and not state["ended"]:
            at = self.due(state)
            return {**state, "status": "failed", "ended": True, "at": at}, [(job, None, at, "failed", "failed", "stalled")]
        return None, []


def lifecycle(stream: DataFrame, moves: dict[str, tuple[str, ...]] = MOVES, stale_us: int = 2 * HOUR_US, expire_us: int = DAY_US, late: str = "10 minutes") -> DataFrame:
    """stream(job_id, event_id, at, status, progress) -> job_id, event_id, at_us, status, verdict, reason; see Lifecycle.

    `moves` gives the statuses that may follow each one, "" standing for a job not known yet.
    """
    return in_order(stream, Lifecycle(moves, stale_us, expire_us), ["status", "progress"], "job_id long, event_id long, at_us long, status string, verdict string, reason string", late)


def throttled(stream: DataFrame, least_us: int = 3_600_000_000) -> DataFrame:
    """At most one row of a job in `least_us`, each with the best value so far (in cents)."""

    def emit(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, best = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for event, at, value in zip(rows["event_id"], rows["at"], rows["value"], strict=True):
            us, best = at.value // 1000, max(best, round(value * 100))
            if last is None or us - last >= least_us:
                out.append((key[0], event, best))
                last = us
        state.update((last, best))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "best"])

    return stream.groupBy("job_id").applyInPandasWithState(emit, "job_id long, event_id long, best long", "last long, best long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over what is there now, into Parquet below `folder`, and reads the result."""
    spark = stream.sparkSession
    if mode == "complete":
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")
        writer = stream.writeStream.foreachBatch(put).outputMode("complete")
    else:
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").outputMode(mode)
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
