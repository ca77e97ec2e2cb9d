"""Operators on clips under review: acceptance, merging rounds, boards, labels, composed rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.operators import spans as S


def accepted(pieces: DataFrame, keys, least_us: int, most_us: int, envelope_us: int, most_pieces: int = 15) -> DataFrame:
    """Clips of pieces(keys, start_us, end_us) within the bounds: count, total, envelope."""
    size = F.sum(F.col("end_us") - F.col("start_us"))
    clip = pieces.groupBy(*keys).agg(F.count("*").alias("n"), size.alias("total_us"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return clip.where((F.col("n") <= most_pieces) & F.col("total_us").between(least_us, most_us) & (F.col("end_us") - F.col("start_us") <= envelope_us))


def topped_up(first: DataFrame, second: DataFrame, bucket_us: int, keys=("media_id",)) -> DataFrame:
    """The first round's rows (keys, id, start_us, end_us, score), and those of the second that overlap
    none of them, ranked together by score, start and id."""
    hit = S.overlap_join(second, S.right_side(first.select(*keys, "start_us", "end_us")), bucket_us, keys).select(*keys, "id").distinct()
    both = first.unionByName(second.join(hit, [*keys, "id"], "left_anti"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "start_us", "id")))


def fold_patches(patches: pd.DataFrame) -> pd.DataFrame:
    """A row's state after its patches in order: only given fields change, the change time only when
    something does, and the reason goes unless the status is discarded."""
    state = {"status": None, "reason": None, "changed_at": None}
    for p in patches.sort_values("at").to_dict("records"):
        new = dict(state)
        new.update({k: p[k] for k in ("status", "reason") if isinstance(p[k], str)})
        if new["status"] != "discarded":
            new["reason"] = None
        if new != state:
            state = {**new, "changed_at": p["at"]}
    return pd.DataFrame([{"k": patches["k"].iloc[0], **state}]).astype({"changed_at": "Int64"})


def patched(patches: DataFrame) -> DataFrame:
    """patches(k, at, status, reason) folded by key in order of `at`, as fold_patches does: the status is
    the last one given, the reason the last one given since the status became discarded."""
    order = Window.partitionBy("k").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.col("status") == "discarded", F.lit(False))
    rows = patches.select("k", "at", F.last("status", ignorenulls=True).over(upto).alias("status"), F.col("reason").alias("_given"))
    rows = rows.withColumn("_since", F.count_if(~gone).over(upto))
    streak = Window.partitionBy("k", "_since").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reason", F.when(gone, F.last(F.when(gone, F.col("_given")), ignorenulls=True).over(streak)))
    same = F.col("status").eqNullSafe(F.lag("status").over(order)) & F.col("reason").eqNullSafe(F.lag("reason").over(order))
    rows = rows.withColumn("_same", same).withColumn("_last", F.lead(F.lit(1)).over(order).isNull())
    rows = rows.withColumn("changed_at", F.last(F.when(~F.col("_same"), F.col("at")), ignorenulls=True).over(upto)).where("_last")
    return rows.select(F.col("k").cast("long").alias("k"), "status", "reason", F.col("changed_at").cast("long").alias("changed_at"))


def nearest_label(units: DataFrame, keys=("media_id",)) -> DataFrame:
    """units(keys, unit, mid, label or null): a null takes the nearest labelled unit's label, the
    earlier of equals."""
    order = Window.partitionBy(*keys).orderBy("mid", "unit")
    seen = F.when(F.col("label").isNotNull(), F.struct("mid", "label"))
    back = F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(seen, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = units.withColumn("_b", back).withColumn("_a", ahead)
    nearer = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("mid") - F.col("_b.mid") <= F.col("_a.mid") - F.col("mid")))
    return rows.withColumn("label", F.when(nearer, F.col("_b.label")).otherwise(F.col("_a.label"))).drop("_a", "_b")


def balanced_accuracy(rows: DataFrame, keys, truth: Column, predicted: Column) -> DataFrame:
    """Half the sum of both classes' shares of right answers, in millionths; null without a class."""
    hit = F.try_divide(F.count_if(truth & predicted), F.count_if(truth)) + F.try_divide(F.count_if(~truth & ~predicted), F.count_if(~truth))
    return rows.groupBy(*keys).agg(F.round(hit / 2, 6).alias("accuracy"))


def linear_picks(rows: DataFrame, keys, order: list, k: int) -> DataFrame:
    """k rows of each key at places floor(i * (n - 1) / (k - 1)); all rows of smaller keys."""
    by = Window.partitionBy(*keys)
    placed = rows.withColumn("_k", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(1, k - 1))).cast("int"))
    return placed.where((F.col("_n") <= k) | F.array_contains(steps, F.col("_k"))).drop("_k", "_n")


def shot_windows(beats: DataFrame, pad_us: int, keys=("plan_id",)) -> DataFrame:
    """beats(keys, shot, start_us, end_us) -> each shot's window, widened by half a crossfade except
    at the first start and the last end; needed_us."""
    shot = beats.groupBy(*keys, "shot").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    order = Window.partitionBy(*keys).orderBy("start_us", "shot")
    head = F.when(F.lag("shot").over(order).isNull(), 0).otherwise(pad_us)
    tail = F.when(F.lead("shot").over(order).isNull(), 0).otherwise(pad_us)
    out = shot.withColumn("_h", head).withColumn("_t", tail)
    out = out.withColumn("start_us", F.col("start_us") - F.col("_h")).withColumn("end_us", F.col("end_us") + F.col("_t")).drop("_h", "_t")
    return out.withColumn("needed_us", F.col("end_us") - F.col("start_us"))


def retime(needed_us: Column, have_us: Column, low: float = 0.5, high: float = 1.5) -> tuple[Column, Column]:
    """The factor by which a take is slowed, and whether it is out of range."""
    factor = F.try_divide(needed_us, have_us)
    return factor, ~F.coalesce(factor.between(low, high), F.lit(False))


def boundaries(segments: DataFrame, keys=("plan_id",)) -> DataFrame:
    """A row for every inner boundary: the wanted fade, and the one that fits half of either side."""
    order = Window.partitionBy(*keys).orderBy("pos")
    size = F.col("end_us") - F.col("start_us")
    after = F.lead(size).over(order)
    rows = segments.withColumn("_after", after).withColumn("next_pos", F.lead("pos").over(order)).where("next_pos IS NOT NULL")
    return rows.select(*keys, "pos", "next_pos", F.col("fade_us").alias("wanted_us"), F.least("fade_us", F.floor(size / 2), F.floor(F.col("_after") / 2)).alias("fade_us"))


def default_roles(confirmed: DataFrame, suggested: DataFrame, keys) -> DataFrame:
    """Each key's confirmed role, else the suggested one, else ignore."""
    both = suggested.select(*keys, F.col("role").alias("_s")).join(confirmed.select(*keys, F.col("role").alias("_c")), list(keys), "full")
    return both.select(*keys, F.coalesce("_c", "_s", F.lit("ignore")).alias("role"))


def expected_roles(frames: DataFrame, keys) -> DataFrame:
    """frames(keys, role, expected): true where a window has frames and all have the expected role."""
    return frames.groupBy(*keys).agg((F.coalesce(F.bool_and(F.col("role") == F.col("expected")), F.lit(False)) & (F.count("role") > 0)).alias("ok"))


def candidates(providers: dict[str, tuple[DataFrame, dict[str, str]]], longest: int = 300) -> DataFrame:
    """Each provider's table, with what it calls ref, title, note, and seconds or ms, in one schema:
    provider, ref, title (untitled if missing), note (cut to `longest` characters, empty if missing), seconds."""
    out = None
    for name, (rows, columns) in providers.items():
        seconds = F.col(columns["seconds"]).cast("double") if "seconds" in columns else F.col(columns["ms"]) / 1000
        one = rows.select(F.lit(name).alias("provider"), F.col(columns["ref"]).cast("string").alias("ref"), F.coalesce(columns["title"], F.lit("untitled")).alias("title"), F.substring(F.coalesce(columns["note"], F.lit("")), 1, longest).alias("note"), seconds.alias("seconds"))
        out = one if out is None else out.unionByName(one)
    return out


def retention(files: DataFrame, days: int, listed: int = 20) -> DataFrame:
    """files(store, path, bytes, age) older than `days`: by store how many, their bytes, and the `listed`
    oldest paths. The listing is a window's head, so no task holds a store's files."""
    old = files.where(F.col("age") > days)
    place = F.row_number().over(Window.partitionBy("store").orderBy(F.col("age").desc(), "path"))
    head = old.withColumn("n", place).where(F.col("n") <= listed).groupBy("store").agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("f"))
    sums = old.groupBy("store").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return sums.join(head, "store").select("store", "files", "bytes", F.transform("f", lambda x: x["path"]).alias("first"))
