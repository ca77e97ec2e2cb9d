"""Rules on proposed clips, and on samples of sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.functions import text as T
from mediaspan.operators import spans as S

# Bounds of a teaser, how far it may stand out of its piece, and bounds of a clip.
TEASER_US, SLACK_US, MOST_PIECES, SCORES = (1_200_000, 4_500_000), 10_000, 15, (1, 10)

# Words that point back at something said before.
POINTERS = ("isso", "isto", "esse", "essa", "esses", "essas", "ele", "ela", "eles", "elas", "aquilo", "aquele", "aquela")


def dangling(pieces: DataFrame, pointers: tuple[str, ...] = POINTERS) -> DataFrame:
    """pieces(media_id, pos, text) after the first one that open with a pointer: media_id, pos, opens."""
    opens = T.token(F.element_at(F.split(F.btrim("text"), " "), 1))
    return pieces.where(F.col("pos") > 0).withColumn("opens", opens).where(F.col("opens").isin(*pointers)).select("media_id", "pos", "opens")


def teasers(clips: DataFrame, pieces: DataFrame, units: DataFrame) -> DataFrame:
    """clips(media_id, clip_id, ids), pieces(media_id, clip_id, from_id, to_id, start_us, end_us),
    units(media_id, unit, start_us, end_us), numbered without holes -> media_id, clip_id, start_us, end_us, reason.

    The ids must be known units, one after another, inside one piece by number and (pieces may have
    been trimmed since) by time, and last 1.2 to 4.5 s; the first rule broken is the reason,
    without a span. No ids are no teaser: both null.
    """
    known = units.groupBy("media_id").agg(F.max("unit").alias("_most"))
    first, last = F.element_at("ids", 1), F.element_at("ids", -1)
    rows = clips.select("media_id", "clip_id", "ids").where(F.size("ids") > 0).withColumn("_a", first).withColumn("_b", last).join(known, "media_id", "left")
    rows = rows.withColumn("_unknown", F.coalesce(F.exists("ids", lambda i: i.isNull() | (i < 0) | (i > F.col("_most"))), F.lit(True)))
    steps = F.forall(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.get("ids", i) == F.col("_a") + i)
    # Both ends of a clip meet the units in one join, so the units pass the shuffle once.
    ends = rows.select("media_id", "clip_id", "_a", "_b", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("unit"))
    met = ends.join(units.select("media_id", "unit", "start_us", "end_us"), ["media_id", "unit"]).groupBy("media_id", "clip_id")
    met = met.agg(F.max(F.when(F.col("unit") == F.col("_a"), F.col("start_us"))).alias("_s"), F.max(F.when(F.col("unit") == F.col("_b"), F.col("end_us"))).alias("_e"))
    rows = rows.join(met, ["media_id", "clip_id"], "left")
    own = rows.select("media_id", "clip_id", "_a", "_b", "_s", "_e").join(pieces, ["media_id", "clip_id"])
    inside = (F.col("from_id") <= F.col("_a")) & (F.col("_b") <= F.col("to_id"))
    within = (F.col("_s") >= F.col("start_us") - SLACK_US) & (F.col("_e") <= F.col("end_us") + SLACK_US)
    own = own.groupBy("media_id", "clip_id").agg(F.bool_or(inside).alias("_inside"), F.bool_or(within).alias("_within"))
    rows = rows.withColumn("_steps", F.coalesce(steps, F.lit(False))).join(own, ["media_id", "clip_id"], "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    size = F.col("_e") - F.col("_s")
    reason = (
        F.when(F.col("_unknown"), "unknown").when(~F.col("_steps"), "not_consecutive").when(no(F.col("_inside")), "not_in_one_piece").when(no(F.col("_within")), "trimmed_away")
        .when(size < TEASER_US[0], "too_short").when(size > TEASER_US[1], "too_long")
    )
    good = rows.select("media_id", "clip_id", reason.alias("reason"), "_s", "_e")
    spans = [F.when(F.col("reason").isNull(), F.col(c)).alias(n) for c, n in (("_s", "start_us"), ("_e", "end_us"))]
    return clips.select("media_id", "clip_id").join(good.select("media_id", "clip_id", *spans, "reason"), ["media_id", "clip_id"], "left")


def judged(clips: DataFrame, pieces: DataFrame, durations: DataFrame, total_us: tuple[int | None, int | None] = (None, None), envelope_us: int | None = None) -> DataFrame:
    """clips(media_id, clip_id, score, headline), pieces(media_id, clip_id, start_us, end_us) -> media_id, clip_id,
    total_us, reason: null where the clip is accepted, else the first of: its score isn't 1 to 10, it
    has no piece or too many, no headline, its pieces' total is out of bounds, its envelope too
    long, or it ends beyond the medium."""
    size = F.sum(F.col("end_us") - F.col("start_us"))
    parts = pieces.groupBy("media_id", "clip_id").agg(F.count("*").alias("n"), size.alias("total_us"), F.min("start_us").alias("a"), F.max("end_us").alias("b"))
    rows = clips.join(parts, ["media_id", "clip_id"], "left").join(durations.select("media_id", "duration_us"), "media_id", "left")
    low, high = (F.lit(x).cast("long") for x in total_us)
    reason = (
        F.when(~F.coalesce(F.col("score").between(*SCORES), F.lit(False)), "score").when(F.coalesce("n", F.lit(0)) == 0, "no_pieces").when(F.col("n") > MOST_PIECES, "many_pieces")
        .when(F.btrim(F.coalesce("headline", F.lit(""))) == "", "headline").when(F.col("total_us") < low, "short").when(F.col("total_us") > high, "long")
        .when(F.col("b") - F.col("a") > F.lit(envelope_us).cast("long"), "envelope").when(F.col("b") > F.col("duration_us"), "beyond_end")
    )
    return rows.select("media_id", "clip_id", "total_us", reason.alias("reason"))


def dropped(verdicts: DataFrame) -> DataFrame:
    """judged() -> media_id, accepted, dropped, and the number of each reason as a map."""
    by = verdicts.groupBy("media_id", "reason").agg(F.count("*").alias("n"))
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons")
    n = F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("accepted")
    return by.groupBy("media_id").agg(n, F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("dropped"), listed)


def voice_accepted(pieces: DataFrame, turns: DataFrame, speaker: str, bucket_us: int, least: float = 0.5) -> DataFrame:
    """pieces(media_id, clip_id, start_us, end_us), turns(media_id, speaker, start_us, end_us) -> media_id, clip_id,
    pieces, editorial, envelope, accepted.

    The shares are of the time at which anyone speaks the time at which only the speaker does: within
    the pieces, and from the first one's start to the last one's end. A clip needs `least` of the
    former, and of the latter too if it is one piece; where nobody speaks a share is 0.
    """
    keys = ("media_id", "clip_id")
    whole = pieces.groupBy(*keys).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("pieces"))
    near = S.overlap_join(whole.select(*keys, "start_us", "end_us"), S.right_side(turns.select("media_id", "speaker", "start_us", "end_us")), bucket_us)
    said = near.select(*keys, "speaker", F.col("right_start_us").alias("start_us"), F.col("right_end_us").alias("end_us"))
    share = lambda spans, name: S.exclusive_time(spans, said, speaker, bucket_us, keys).select(*keys, F.col("share").alias(name))
    rows = whole.select(*keys, "pieces").join(share(pieces.select(*keys, "start_us", "end_us"), "editorial"), list(keys), "left").join(share(whole.select(*keys, "start_us", "end_us"), "envelope"), list(keys), "left").fillna(0.0, ["editorial", "envelope"])
    good = (F.col("editorial") >= least) & ((F.col("pieces") > 1) | (F.col("envelope") >= least))
    return rows.withColumn("accepted", good)


def blocks(samples: DataFrame, points: int) -> DataFrame:
    """samples(media_id, pos from 0, x) -> media_id, block, peak, rms at `points` blocks a medium.

    A block has ceil(samples / points) places; places without a sample, up to the last block's end,
    count as 0, and blocks without any are there too.
    """
    n = samples.groupBy("media_id").agg((F.max("pos") + 1).alias("_n")).withColumn("_size", F.ceil(F.col("_n") / points))
    every = n.select("media_id", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("block"))
    own = samples.join(n.select("media_id", "_size"), "media_id").groupBy("media_id", F.floor(F.col("pos") / F.col("_size")).alias("block"))
    own = own.agg(F.max(F.abs("x")).alias("peak"), F.sum(F.col("x") * F.col("x")).alias("_squares"))
    rows = every.join(own, ["media_id", "block"], "left")
    return rows.select("media_id", "block", F.coalesce("peak", F.lit(0)).alias("peak"), F.sqrt(F.coalesce("_squares", F.lit(0)) / F.col("_size")).alias("rms"))


def room_tone(samples: DataFrame, pauses: DataFrame, rate: int, bucket_us: int, most: int = 5) -> DataFrame:
    """samples(media_id, pos, x), pauses(media_id, start_us, end_us) -> the `most` quietest pauses of a
    medium: rank, start_us, end_us, n, dbfs (of the samples' RMS, 1e-9 at least).

    Pauses of 0.2 s and more count, without a fifth of their length, 50 ms at most, at either end.
    """
    length = F.col("end_us") - F.col("start_us")
    margin = F.least(F.lit(50_000), F.floor(length / 5))
    inner = pauses.where(length >= 200_000).select("media_id", F.floor((F.col("start_us") + margin) * rate / 1_000_000).alias("start_us"), F.floor((F.col("end_us") - margin) * rate / 1_000_000).alias("end_us"), F.col("start_us").alias("_a"), F.col("end_us").alias("_b"))
    dots = samples.select("media_id", "x", F.col("pos").alias("right_start_us"), (F.col("pos") + 1).alias("right_end_us"))
    met = S.overlap_join(inner, dots, max(1, bucket_us * rate // 1_000_000)).groupBy("media_id", "_a", "_b").agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("x")).alias("_m"))
    level = 20 * F.log10(F.greatest(F.sqrt("_m"), F.lit(1e-9)))
    rows = met.withColumn("dbfs", F.round(level, 3)).withColumn("rank", F.row_number().over(Window.partitionBy("media_id").orderBy("dbfs", "_a")))
    return rows.where(F.col("rank") <= most).select("media_id", "rank", F.col("_a").alias("start_us"), F.col("_b").alias("end_us"), "n", "dbfs")


def signal_stats(samples: DataFrame, clip: float = 0.999, jump: float = 0.95) -> DataFrame:
    """samples(media_id, pos, left, right) -> peak, clipped and jumps over both channels, and their
    correlation, within -1 and 1; null where a channel is flat."""
    order = Window.partitionBy("media_id").orderBy("pos")
    sides = ("left", "right")
    rows = samples.withColumns({f"_{s}": F.abs(F.col(s) - F.lag(s).over(order)) for s in sides})
    count = lambda test: sum((F.count_if(test(s)) for s in sides), F.lit(0))
    flat: Column = (F.min("left") == F.max("left")) | (F.min("right") == F.max("right"))
    shared = F.try_divide(F.covar_pop("left", "right"), F.stddev_pop("left") * F.stddev_pop("right"))
    corr = F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shared)))
    return rows.groupBy("media_id").agg(F.max(F.greatest(F.abs("left"), F.abs("right"))).alias("peak"), count(lambda s: F.abs(s) >= clip).alias("clipped"), count(lambda s: F.col(f"_{s}") >= jump).alias("jumps"), corr.alias("correlation"))
