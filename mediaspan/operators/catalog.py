"""Catalogue operators over versioned rows: latest, upsert, boards, roll-ups, settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.functions import text as T

STATUSES = ("posted", "discarded", "saved", "exported", "approved", "new")


def latest(rows: DataFrame, keys, order: list[Column]) -> DataFrame:
    """Each key's first row by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def ranked(rows: DataFrame, order: list[Column], parts: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with `place`, from 1, in one order over all of them, ties as they fall.

    Rows are dealt into `parts` ranges of the order and numbered within each; what goes through one
    task is a count for each range. `kept` writes the dealt rows, so that both steps see the same.
    """
    dealt = kept(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(counts), "_part").withColumn("place", place.cast("long")).drop("_part", "_before")


def upsert(stored: DataFrame, changes: DataFrame, keys, at: str, keep=()) -> DataFrame:
    """stored with changes put in: a key's last change by `at` wins, columns in `keep` stay as stored."""
    newest = latest(changes, keys, [F.col(at).desc()])
    kept = stored.join(newest.select(*keys), list(keys), "left_anti")
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
    met = newest.join(old, list(keys), "left")
    changed = reduce(lambda df, c: df.withColumn(c, F.coalesce(f"_old_{c}", c)).drop(f"_old_{c}"), keep, met)
    return kept.unionByName(changed.select(*stored.columns))


def insert_new(stored: DataFrame, rows: DataFrame, keys, at: str) -> DataFrame:
    """Rows whose key is not stored yet, the first of each key by `at`."""
    return latest(rows, keys, [F.col(at).asc()]).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def clip_status(posted: Column, discarded: Column, saved: Column, exported: Column, approved: Column) -> Column:
    """The first that holds of posted, discarded, saved, exported, approved; else new."""
    flags = (posted, discarded, saved, exported, approved)
    out = F.lit("new")
    for flag, name in reversed(list(zip(flags, STATUSES, strict=False))):
        out = F.when(flag, name).otherwise(out)
    return out


def status_counts(rows: DataFrame, keys, status: str, statuses=STATUSES) -> DataFrame:
    """By key a column for each status, 0 where none, and the total."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses], F.count("*").alias("total"))


def batch_status(rows: DataFrame, keys, status: str, done: str = "succeeded") -> DataFrame:
    """succeeded if all items have the status `done`, failed if none, partial otherwise."""
    good, n = F.count_if(F.col(status) == done), F.count("*")
    return rows.groupBy(*keys).agg(good.alias("done"), n.alias("items")).withColumn("status", F.when(F.col("done") == F.col("items"), "succeeded").when(F.col("done") == 0, "failed").otherwise("partial"))


def rescaled(score: Column, parts: Column, legacy: tuple[str, ...], by: float = 3.5) -> Column:
    """Scores of old rows, those that have all the legacy parts, on the scale of new ones."""
    old = reduce(lambda a, k: a & F.coalesce(F.map_contains_key(parts, k), F.lit(False)), legacy, F.lit(True))
    return F.when(old, F.round(score / by, 1)).otherwise(score)


def is_draft(path: Column, purpose: Column) -> Column:
    """By what a render was made for, or its file's name."""
    return F.coalesce(purpose == "draft", F.lit(False)) | F.coalesce(F.startswith(F.regexp_extract(path, "([^/]*)$", 1), F.lit("draft")), F.lit(False))


def board(clips: DataFrame, states: DataFrame, items: DataFrame) -> DataFrame:
    """clips(run_id, clip_key, pos, rank), states(run_id, clip_key, posted, discarded, saved, approved),
    items(run_id, clip_key, artifact_id, status, exported_at, draft) -> a row a clip of each run:
    run_id, clip_key, rank, place, exports, newest, status.

    Of clips of one key the first by pos counts. Exports are succeeded items with an artifact that is
    no draft; place is by rank, clips without one last.
    """
    first = latest(clips, ["run_id", "clip_key"], [F.col("pos").asc()])
    good = (F.col("status") == "succeeded") & F.col("artifact_id").isNotNull() & ~F.coalesce(F.col("draft"), F.lit(False))
    exports = items.where(good).groupBy("run_id", "clip_key").agg(F.count("*").alias("exports"), F.max("exported_at").alias("newest"))
    rows = first.select("run_id", "clip_key", "rank", "pos").join(states, ["run_id", "clip_key"], "left").join(exports, ["run_id", "clip_key"], "left").fillna(0, ["exports"])
    held = [F.coalesce(F.col(c), F.lit(False)) for c in ("posted", "discarded", "saved")]
    status = clip_status(*held, F.col("exports") > 0, F.coalesce(F.col("approved"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("rank").asc_nulls_last(), "pos"))
    return rows.select("run_id", "clip_key", "rank", place.alias("place"), "exports", "newest", status.alias("status"))


def other_exports(renders: DataFrame, items: DataFrame) -> DataFrame:
    """renders(project_id, artifact_id, created_at, draft) that no item names, whatever became of it, and
    that are no drafts; place: newest first by project."""
    loose = renders.where(~F.coalesce(F.col("draft"), F.lit(False))).join(items.where(F.col("artifact_id").isNotNull()).select("artifact_id"), "artifact_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("created_at").desc(), "artifact_id"))
    return loose.select("project_id", "artifact_id", "created_at", place.alias("place"))


def episodes(projects: DataFrame, sources: DataFrame, archived: DataFrame, local: DataFrame) -> DataFrame:
    """projects(project_id), sources(project_id, source_id, url), archived(episode_id), local(episode_id,
    project_id: what earlier local episodes hold) -> episode_id, url, projects (ascending), hidden.

    Projects are grouped by the video that a source's address names; a project with sources of which
    none has an address, and that no group holds, is a local episode of its own. Archived
    episodes are hidden, and local ones all of whose projects a group holds.
    """
    named = sources.withColumn("episode_id", T.video_id(F.col("url"))).where("episode_id IS NOT NULL").select("episode_id", "project_id").distinct()
    held = named.select("project_id").distinct()
    bare = sources.groupBy("project_id").agg(F.count("url").alias("n")).where("n = 0").select("project_id")
    alone = projects.select("project_id").join(bare, "project_id", "left_semi").join(held, "project_id", "left_anti")
    own = local.select("episode_id", "project_id").unionByName(alone.select(F.concat(F.lit("local-"), F.col("project_id").cast("string")).alias("episode_id"), "project_id")).distinct()
    marked = own.join(held.withColumn("_held", F.lit(True)), "project_id", "left").select("episode_id", "project_id", F.lit(False).alias("url"), F.col("_held").isNotNull().alias("_held"))
    both = named.select("episode_id", "project_id", F.lit(True).alias("url"), F.lit(False).alias("_held")).unionByName(marked)
    rows = both.groupBy("episode_id", "url").agg(F.array_sort(F.collect_set("project_id")).alias("projects"), F.bool_and("_held").alias("_covered"))
    gone = archived.select("episode_id", F.lit(True).alias("_gone")).distinct()
    return rows.join(gone, "episode_id", "left").select("episode_id", "url", "projects", (F.col("_gone").isNotNull() | F.col("_covered")).alias("hidden"))


def merged_settings(base: DataFrame, override: DataFrame, keys) -> DataFrame:
    """Settings as (keys, path, value): overrides win, other paths stay."""
    o = override.select(*keys, "path", F.col("value").alias("_o"))
    return base.join(o, [*keys, "path"], "full").select(*keys, "path", F.coalesce("_o", "value").alias("value"))


def changed_settings(before: DataFrame, after: DataFrame) -> DataFrame:
    """The leaves of `after` that are not the same in `before`."""
    return after.exceptAll(before)


def with_dimension(rows: DataFrame, dimension: DataFrame, on, how: str = "inner", most_rows: int = 100_000) -> DataFrame:
    """rows joined to a dimension table: broadcast where a count proves it small, else left to Spark."""
    small = dimension.limit(most_rows + 1).count() <= most_rows
    return rows.join(F.broadcast(dimension) if small else dimension, on, how)


def leaves(documents: DataFrame, column: str = "settings", depth: int = 6) -> DataFrame:
    """documents(k, a JSON object as text) -> k, path, value: its leaves, as arrays of keys and JSON text.

    Arrays and empty objects are leaves; what lies deeper than `depth` is one leaf.
    """
    kind = "array<struct<path: array<string>, value: string>>"
    nodes = lambda path, text: F.transform(F.map_entries(F.from_json(text, "map<string, variant>")), lambda e: F.struct(F.concat(path, F.array(e["key"])).alias("path"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))
    # Documents that lie in one file are read by one task: they are dealt out before they grow.
    rows = documents.repartition("k").select("k", F.coalesce(nodes(F.array().cast("array<string>"), F.col(column)), F.array()).cast(kind).alias("nodes"))
    for _ in range(depth - 1):
        inner = lambda n: F.when(n["value"].startswith("{") & (n["value"] != "{}"), nodes(n["path"], n["value"])).otherwise(F.array(n))
        rows = rows.withColumn("nodes", F.flatten(F.transform("nodes", inner)).cast(kind))
    return rows.select("k", F.explode("nodes").alias("n")).select("k", "n.path", "n.value")


def settings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves (k, path, value) of two documents a key -> op, k, path, value: `set` what is new or
    changed in after, `unset` what it has no more (value null). A section in place of a leaf, or a
    leaf in place of a section, is an unset and sets."""
    both = before.select("k", "path", F.col("value").alias("_b")).join(after.select("k", "path", F.col("value").alias("_a")), ["k", "path"], "full")
    changed = both.where(~F.col("_a").eqNullSafe(F.col("_b")))
    return changed.select(F.when(F.col("_a").isNull(), "unset").otherwise("set").alias("op"), "k", "path", F.col("_a").alias("value"))


def apply_diff(before: DataFrame, diff: DataFrame) -> DataFrame:
    """The leaves of `before` after the diff; leaves that a set path runs through, or ends above, go."""
    sets, unsets = diff.where("op = 'set'").select("k", "path", "value"), diff.where("op = 'unset'").select("k", "path")
    kept = without_paths(before.join(unsets, ["k", "path"], "left_anti"), sets)
    return kept.unionByName(sets)


def without_paths(override: DataFrame, change: DataFrame) -> DataFrame:
    """override(k, path, value) without the leaves that `change` mentions: at, below or above its paths.
    A document's paths meet as one row, as its leaves came from one."""
    paths = change.groupBy("k").agg(F.collect_list("path").alias("_paths"))
    head = lambda p, q: F.slice(p, F.lit(1), F.size(q)) == q
    met = override.join(paths, "k", "left").withColumn("_hit", F.exists("_paths", lambda p: head(p, F.col("path")) | head(F.col("path"), p)))
    return met.where(~F.coalesce("_hit", F.lit(False))).select("k", "path", "value")


def spread(rows: DataFrame, keys, order: list, most: int) -> DataFrame:
    """At most `most` rows of each key, evenly spread: places round(i * (n - 1) / (most - 1)), half to even."""
    by = Window.partitionBy(*keys)
    placed = rows.withColumn("_k", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    steps = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(1, most - 1))).cast("int"))
    return placed.where((F.col("_n") <= most) | F.array_contains(steps, F.col("_k"))).drop("_k", "_n")


def content_key(*columns: str) -> Column:
    """A hash of the columns' canonical JSON, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def invalid_transitions(log: DataFrame, job: str, order: list[str], ends=("succeeded", "failed")) -> DataFrame:
    """Rows of a job log that come after the job's first final status, or whose progress falls
    below the best before."""
    by = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("status").isin(*ends).cast("int")).over(by), F.lit(0)) == 1
    back = F.coalesce(F.col("progress") < F.max("progress").over(by), F.lit(False))
    return log.withColumn("reason", F.when(ended, "ended").when(back, "progress")).where("reason IS NOT NULL")


def stalled(log: DataFrame, job: str, at: str, cutoff_us: int) -> DataFrame:
    """Jobs whose last row runs and is older than the cutoff before the log's end."""
    last = latest(log, [job], [F.col(at).desc(), F.col("event_id").desc()])
    end = log.agg(F.max(at).alias("_end"))
    return last.crossJoin(F.broadcast(end)).where((F.col("status") == "running") & (F.col("_end") - F.col(at) > cutoff_us)).select(job, at)
