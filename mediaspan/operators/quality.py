"""Checks on logs, streams and layouts of finished media."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scene_cuts(lines: DataFrame) -> DataFrame:
    """lines(media_id, line_no, line) with `pts_time:T` and `score=S` -> cuts t_us, score; of equal
    times the last line counts."""
    t = F.regexp_extract("line", r"pts_time:([0-9.]+)", 1)
    s = F.regexp_extract("line", r"score=([0-9.]+)", 1)
    found = lines.where((t != "") & (s != "")).select("media_id", "line_no", F.round(t.cast("double") * 1_000_000).cast("long").alias("t_us"), s.cast("double").alias("score"))
    return found.groupBy("media_id", "t_us").agg(F.max_by("score", "line_no").alias("score"))


def durations_in_log(text: Column, name: str) -> Column:
    """All numbers behind `name:` in a log, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(name + r":\s*(-?[0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))


def log_summary(rows: DataFrame, name: str) -> DataFrame:
    """rows(media_id, log) -> count, total and longest of the durations named in the log, in milliseconds."""
    ms = F.transform(durations_in_log(F.col("log"), name), lambda x: F.round(x * 1000).cast("long"))
    found = rows.withColumn("_d", F.coalesce(ms, F.array().cast("array<bigint>")))
    return found.select("media_id", F.size("_d").alias("n"), F.aggregate("_d", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_ms"), F.coalesce(F.array_max("_d"), F.lit(0).cast("long")).alias("longest_ms"))


def usable_duration(streams: Column, whole: Column) -> Column:
    """The shortest positive duration of the audio and video streams(kind, duration as text), else the whole's."""
    fine = F.filter(streams, lambda s: s["kind"].isin("audio", "video") & (F.coalesce(s["duration"].try_cast("double"), F.lit(0.0)) > 0))
    return F.coalesce(F.array_min(F.transform(fine, lambda s: s["duration"].try_cast("double"))), whole)


def last_json(text: Column) -> Column:
    """The last flat JSON object in a log."""
    return F.element_at(F.filter(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda x: x != ""), -1)


def occlusions(boxes: DataFrame, covers: DataFrame) -> DataFrame:
    """boxes(id, canvas, x0, y0, x1, y1) that meet covers(canvas, platform, name, cx0, cy0, cx1, cy1):
    codes platform:name by box. Covers are a small table of each canvas."""
    met = boxes.join(covers, "canvas").where("x1 > cx0 AND x0 < cx1 AND y1 > cy0 AND y0 < cy1")
    return met.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "platform", "name"))), ",").alias("codes"))


def right_limit(rows: DataFrame, covers: DataFrame) -> DataFrame:
    """rows(id, canvas, y0, y1) -> the least left edge of a cover that the vertical span meets."""
    return rows.join(covers, "canvas").where("y1 > cy0 AND y0 < cy1").groupBy("id").agg(F.min("cx0").alias("limit_x"))


def checks(rows: DataFrame, warnings: list[str]) -> DataFrame:
    """rows(id, first: codes, second: codes) -> one row a code of either: warning or fail, pass without any."""
    codes = F.array_union(F.coalesce("first", F.array().cast("array<string>")), F.coalesce("second", F.array().cast("array<string>")))
    code = F.explode_outer(codes)
    return rows.select("id", code.alias("code")).withColumn("state", F.when(F.col("code").isNull(), "pass").when(F.col("code").isin(*warnings), "warning").otherwise("fail"))


def median_faces(samples: DataFrame, least_score: float = 0.6, least_area: float = 0.035) -> DataFrame:
    """samples(media_id, sample, score, area) -> the median number of faces a sample, cut to a whole."""
    n = samples.groupBy("media_id", "sample").agg(F.count_if((F.col("score") >= least_score) & (F.col("area") >= least_area)).alias("n"))
    return n.groupBy("media_id").agg(F.floor(F.median("n")).cast("long").alias("faces"))


def camera_role(faces: Column, share: Column, airtime: Column, least_airtime: float = 0.01) -> Column:
    """A camera group's suggested role by faces, the subject's share of voice and the group's airtime; null if open.

    Without faces or airtime it is ignored; a clear share of voice is the subject's; three faces
    are a wide shot. Two faces are the subject's from a share of 0.3 on, a wide shot up to 0.12;
    one face with a share up to 0.35 is an interviewer's.
    """
    role = F.when((faces == 0) | (airtime < least_airtime), "ignore").when(share >= 0.6, "subject").when(faces >= 3, "wide")
    role = role.when((faces == 2) & (share >= 0.3), "subject").when((faces == 2) & (share <= 0.12), "wide")
    return role.when((faces == 1) & (share <= 0.35), "interviewers")


def effective_role(confirmed: Column, suggested: Column) -> Column:
    return F.coalesce(confirmed, suggested, F.lit("ignore"))


def face_groups(faces: DataFrame, width: float = 0.08) -> DataFrame:
    """faces(scene, center, area) -> scene, face, mean, n, area: a scene's faces as people, left to right.

    In order of their centres, each face joins the first group whose mean centre is at most
    `width` away, and moves that mean; else it begins a group. area is the group's mean. Only a
    scene's few samples meet in one list.
    """

    def people(scene, faces):
        sums: list[list[float]] = []  # of centres, of areas, and how many
        for center, area in faces:
            near = next((g for g in sums if abs(g[0] / g[2] - center) <= width), None)
            if near is None:
                sums.append(near := [0.0, 0.0, 0])
            near[0], near[1], near[2] = near[0] + center, near[1] + area, near[2] + 1
        return [(scene, k, c / n, n, a / n) for k, (c, a, n) in enumerate(sums)]

    def fold(batches):
        # Scenes follow each other, and one may go on in the next batch.
        scene, faces = None, []
        for batch in batches:
            out = []
            for s, *face in zip(*(batch.column(c).to_pylist() for c in ("scene", "center", "area")), strict=True):
                if faces and s != scene:
                    out += people(scene, faces)
                    faces = []
                scene = s
                faces.append(face)
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=names)
        if faces:
            yield pa.record_batch([pa.array(c) for c in zip(*people(scene, faces), strict=True)], names=names)

    names = ["scene", "face", "mean", "n", "area"]
    rows = faces.select(F.col("scene").cast("long").alias("scene"), F.col("center").cast("double").alias("center"), F.col("area").cast("double").alias("area"))
    return rows.repartition("scene").sortWithinPartitions("scene", "center", "area").mapInArrow(fold, "scene long, face long, mean double, n long, area double")


def most_momentary(rows: DataFrame) -> DataFrame:
    """rows(media_id, log) -> the greatest momentary loudness `M:` in the log above -120, null without one."""
    found = F.transform(F.regexp_extract_all("log", F.lit(r"\bM:\s*(-?[0-9.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    return rows.select("media_id", F.array_max(F.filter(found, lambda x: x > -120)).alias("loudness"))


def keyframes(lines: DataFrame) -> DataFrame:
    """lines(media_id, line_no, line) with `pts_time:T` -> t_us in order: idx counts by time, then line."""
    t = F.regexp_extract("line", r"pts_time:\s*([0-9.]+)", 1)
    found = lines.where(t != "").select("media_id", "line_no", F.round(t.try_cast("double") * 1_000_000).cast("long").alias("t_us")).where("t_us IS NOT NULL")
    return found.select("media_id", (F.row_number().over(Window.partitionBy("media_id").orderBy("t_us", "line_no")) - 1).alias("idx"), "t_us")


def media_duration(whole: Column, streams: Column) -> Column:
    """A medium's duration: the container's (text), else that of the first stream that has one, else 0."""
    each = F.filter(F.transform(streams, lambda s: s["duration"].try_cast("double")), lambda x: x.isNotNull())
    return F.coalesce(whole.try_cast("double"), F.try_element_at(each, F.lit(1)), F.lit(0.0))


def outside_safe_zone(boxes: DataFrame, zones: DataFrame, tolerance: int = 2) -> DataFrame:
    """boxes(id, canvas, x0, y0, x1, y1) and a zone(canvas, zx0, zy0, zx1, zy1) a canvas -> id, outside:
    whether a box leaves its zone by more than `tolerance` pixels; false where a canvas has no zone."""
    inside = (F.col("x0") >= F.col("zx0") - tolerance) & (F.col("y0") >= F.col("zy0") - tolerance) & (F.col("x1") <= F.col("zx1") + tolerance) & (F.col("y1") <= F.col("zy1") + tolerance)
    return boxes.join(zones, "canvas", "left").select("id", (~F.coalesce(inside, F.lit(True))).alias("outside"))


def _micros(log: Column, name: str) -> Column:
    found = F.transform(durations_in_log(log, name), lambda x: F.round(x * 1_000_000).cast("long"))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def picture_faults(rows: DataFrame) -> DataFrame:
    """rows(media_id, log, duration_us) -> count, total and longest of black and frozen spans.

    A freeze that begins and has no duration behind it runs to the end of the medium. A null log has none.
    """
    black, frozen, begun = _micros(F.col("log"), "black_duration"), _micros(F.col("log"), "freeze_duration"), _micros(F.col("log"), "freeze_start")
    to_end = F.greatest(F.col("duration_us") - F.try_element_at(begun, F.lit(-1)), F.lit(0)).cast("long")
    found = rows.select("media_id", black.alias("black"), F.when(F.size(begun) > F.size(frozen), F.concat(frozen, F.array(to_end))).otherwise(frozen).alias("freeze"))
    zero = F.lit(0).cast("long")
    sums = [(F.size(n).alias(f"{n}_n"), F.aggregate(n, zero, lambda a, x: a + x).alias(f"{n}_total_us"), F.coalesce(F.array_max(n), zero).alias(f"{n}_longest_us")) for n in ("black", "freeze")]
    return found.select("media_id", *sums[0], *sums[1])


def loudness(rows: DataFrame) -> DataFrame:
    """rows(media_id, log) -> the measures of the log's last report, null where it has none or they are not finite."""
    report = F.try_element_at(F.regexp_extract_all("log", F.lit(r'(\{[^{}]*"input_i"[^{}]*\})'), F.lit(1)), F.lit(-1))
    names = {"input_i": "integrated_lufs", "input_lra": "range_lu", "input_tp": "true_peak_dbfs", "input_thresh": "threshold_lufs"}
    number = {out: F.get_json_object("_report", f"$.{name}").try_cast("double") for name, out in names.items()}
    return rows.withColumn("_report", report).select("media_id", *(F.when(F.abs(x) < float("inf"), x).alias(out) for out, x in number.items()))
