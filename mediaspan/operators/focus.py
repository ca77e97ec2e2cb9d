"""Where to look in a scene: frames to sample, and the point that a crop is centred on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.operators.quality import face_groups

# A sample's distance from a cut, the shortest span that gets samples off its middle,
# samples a scene; the least score and height of a face, and the share of a crop that faces may fill.
CUT_MARGIN, LONG, SAMPLES = 200_000, 1_500_000, 3
MIN_SCORE, MIN_HEIGHT, FIT = 0.6, 0.08, 0.92


def _milli(us: Column) -> Column:
    return (F.floor((us + 500) / 1000) * 1000).cast("long")


def sample_times(spans: DataFrame) -> DataFrame:
    """spans(scene, scene_start_us, scene_end_us, start_is_cut, end_is_cut, pos, start_us, end_us) -> scene, t_us.

    At most 3 times a scene, to the millisecond and 0.2 s inside its cuts: the middles of its spans
    (of more than 3 spans the first, the middle and the last one's), then the quarters of its longest
    spans from 1.5 s. A scene without room between its cuts has its middle. Only the spans of one
    scene, of which an edit has a few, meet in an array.
    """
    low, high = F.col("scene_start_us") + F.when(F.col("start_is_cut"), CUT_MARGIN).otherwise(0), F.col("scene_end_us") - F.when(F.col("end_is_cut"), CUT_MARGIN).otherwise(0)
    inside = lambda us: _milli(F.least(F.greatest(us, F.col("low")), F.col("high")))
    bounds = ["scene", "scene_start_us", "scene_end_us", "start_is_cut", "end_is_cut"]
    scene = spans.groupBy(*bounds).agg(F.sort_array(F.collect_list(F.struct("pos", "start_us", "end_us"))).alias("s")).withColumn("low", low).withColumn("high", high)
    last = F.size("s") - 1
    picks = F.when(last < SAMPLES, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0), F.bround(last / 2).cast("int"), last))
    middle = F.transform(picks, lambda i: inside(F.floor((F.col("s")[i]["start_us"] + F.col("s")[i]["end_us"]) / 2)))
    length = lambda x: x["end_us"] - x["start_us"]
    longest = F.sort_array(F.transform(F.filter("s", lambda x: length(x) >= LONG), lambda x: F.struct((-length(x)).alias("less"), x["pos"].alias("pos"), x["start_us"].alias("start_us"), x["end_us"].alias("end_us"))))
    quarters = F.flatten(F.transform(longest, lambda x: F.array(inside(x["start_us"] + F.floor(length(x) / 4)), inside(x["start_us"] + F.floor(length(x) * 3 / 4)))))
    times = scene.withColumn("first", F.array_distinct(middle)).withColumn("more", quarters)
    more = F.slice(F.array_except("more", "first"), F.lit(1), SAMPLES - F.size("first"))
    whole = F.array(_milli(F.floor((F.col("scene_start_us") + F.col("scene_end_us")) / 2)))
    return times.select("scene", F.explode(F.when(F.col("low") >= F.col("high"), whole).otherwise(F.array_sort(F.concat("first", more)))).alias("t_us"))


def focus(scenes: DataFrame, faces: DataFrame) -> DataFrame:
    """scenes(scene, crop_width, manual_x, side), faces(scene, score, x, width, height) -> scene, focus_x, reason.

    Without a face that counts: the manual point. Where all faces fit in 0.92 of the crop: the middle
    of them all. Else the mean centre of a person: of the one on `side` (left or right), else of the
    largest. The crop stays within the picture. Positions are shares of the picture's width.
    """
    kept = faces.where((F.col("score") >= MIN_SCORE) & (F.col("height") >= MIN_HEIGHT))
    edges = kept.groupBy("scene").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"))
    people = face_groups(kept.select("scene", (F.col("x") + F.col("width") / 2).alias("center"), (F.col("width") * F.col("height")).alias("area")))
    people = people.groupBy("scene").agg(F.min("mean").alias("leftmost"), F.max("mean").alias("rightmost"), F.min_by("mean", F.struct(-F.col("area"), "face")).alias("largest"))
    rows = scenes.join(edges, "scene", "left").join(people, "scene", "left")
    fits = F.col("right") - F.col("left") <= FIT * F.col("crop_width")
    reason = F.when(F.col("left").isNull(), "no_faces").when(fits, "all_faces").when(F.col("side").isin("left", "right"), "primary_side").otherwise("largest_face")
    rows = rows.withColumn("reason", reason)
    at = (
        F.when(F.col("reason") == "no_faces", F.col("manual_x")).when(F.col("reason") == "all_faces", (F.col("left") + F.col("right")) / 2)
        .when(F.col("reason") == "largest_face", F.col("largest")).when(F.col("side") == "left", F.col("leftmost")).otherwise(F.col("rightmost"))
    )
    half = F.least(F.col("crop_width"), F.lit(1.0)) / 2
    return rows.select("scene", F.round(F.least(F.greatest(at, half), 1 - half), 6).alias("focus_x"), "reason")
