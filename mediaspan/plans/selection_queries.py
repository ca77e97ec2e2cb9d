"""Queries on proposed clips, samples and analysis documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.operators import selection as C
from mediaspan.operators import words as W
from mediaspan.sources import adapters as A
from mediaspan.sources import io
from mediaspan.sources.scratch import folder, kept

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


# Cues serve as units: ten of them are a clip, whose pieces are its first four (the first one cut by
# 0.4 s at its start) and its seventh to ninth; ids begin somewhere, and some are broken.
CUES = """n AS (SELECT *, row_number() OVER w AS k, coalesce(start_us - lag(end_us) OVER w > 650000, false) AS cut FROM words WINDOW w AS (PARTITION BY media_id ORDER BY idx)),
  f AS (SELECT media_id, k, 0::BIGINT AS part, 1 AS c, start_us AS begun FROM n WHERE k = 1
    UNION ALL SELECT media_id, k, CASE WHEN y THEN part + 1 ELSE part END, CASE WHEN y THEN 1 ELSE c + 1 END, CASE WHEN y THEN start_us ELSE begun END FROM (SELECT n.media_id, n.k, n.start_us, part, c, begun, c >= 5 OR cut OR n.end_us - begun > 3000000 AS y FROM f JOIN n ON n.media_id = f.media_id AND n.k = f.k + 1)),
  g AS (SELECT f.part AS unit, f.media_id, min(start_us) AS start_us, max(end_us) AS end_us FROM f JOIN n USING (media_id, k) GROUP BY f.media_id, f.part),
  un AS (SELECT media_id, unit, start_us, greatest(start_us + 50000, least(end_us, coalesce(lead(start_us) OVER (PARTITION BY media_id ORDER BY unit), end_us))) AS end_us FROM g)"""
TEASED = f"""{CUES}, pc AS (SELECT media_id, unit // 10 AS clip_id, CASE WHEN unit % 10 < 5 THEN 0 ELSE 1 END AS part, min(unit) AS from_id, max(unit) AS to_id, min(start_us) + CASE WHEN min(unit % 10) = 0 THEN 400000 ELSE 0 END AS start_us, max(end_us) AS end_us FROM un WHERE unit % 10 IN (0, 1, 2, 3, 6, 7, 8) GROUP BY 1, 2, 3),
  cl AS (SELECT media_id, unit // 10 AS clip_id, CASE (media_id + unit // 10) % 7 WHEN 3 THEN [] WHEN 5 THEN [unit // 10 * 10 + 1, unit // 10 * 10 + 3] WHEN 6 THEN [unit // 10 * 10 + 8, unit // 10 * 10 + 900] ELSE range(unit // 10 * 10 + (media_id + unit // 10) % 9, unit // 10 * 10 + (media_id + unit // 10) % 9 + 1 + unit // 10 % 3) END AS ids FROM un GROUP BY ALL)"""


def teased(spark, d):
    units = kept(W.caption_cues(A.words(spark, d)).select("media_id", F.col("cue").alias("unit"), "start_us", "end_us"))
    place = F.col("unit") % 10
    rows = units.withColumn("clip_id", F.floor(F.col("unit") / 10))
    pieces = rows.where(place.isin(0, 1, 2, 3, 6, 7, 8)).groupBy("media_id", "clip_id", F.when(place < 5, 0).otherwise(1).alias("part"))
    pieces = pieces.agg(F.min("unit").alias("from_id"), F.max("unit").alias("to_id"), (F.min("start_us") + F.when(F.min(place) == 0, 400_000).otherwise(0)).alias("start_us"), F.max("end_us").alias("end_us")).drop("part")
    c, m = F.col("clip_id"), (F.col("media_id") + F.col("clip_id")) % 7
    begin = c * 10 + (F.col("media_id") + c) % 9
    ids = F.when(m == 3, F.array().cast("array<bigint>")).when(m == 5, F.array(c * 10 + 1, c * 10 + 3)).when(m == 6, F.array(c * 10 + 8, c * 10 + 900)).otherwise(F.sequence(begin, begin + c % 3))
    # Units are numbered without holes, so each clip has its first one.
    return rows.where(place == 0).select("media_id", "clip_id").withColumn("ids", ids), pieces, units


@query("d07_teasers", A.sql("words", f"""{TEASED}, x AS (SELECT cl.media_id, clip_id, ids, (SELECT max(unit) FROM un WHERE un.media_id = cl.media_id) AS most, a.start_us AS s, b.end_us AS e FROM cl LEFT JOIN un a ON a.media_id = cl.media_id AND a.unit = ids[1] LEFT JOIN un b ON b.media_id = cl.media_id AND b.unit = ids[-1]),
  y AS (SELECT *, CASE WHEN len(ids) = 0 THEN NULL WHEN list_max(ids) > most THEN 'unknown' WHEN ids <> range(ids[1], ids[1] + len(ids)) THEN 'not_consecutive' WHEN NOT EXISTS (SELECT 1 FROM pc WHERE pc.media_id = x.media_id AND pc.clip_id = x.clip_id AND from_id <= ids[1] AND ids[-1] <= to_id) THEN 'not_in_one_piece'
    WHEN NOT EXISTS (SELECT 1 FROM pc WHERE pc.media_id = x.media_id AND pc.clip_id = x.clip_id AND s >= pc.start_us - 10000 AND e <= pc.end_us + 10000) THEN 'trimmed_away' WHEN e - s < 1200000 THEN 'too_short' WHEN e - s > 4500000 THEN 'too_long' END AS reason FROM x)
  SELECT media_id, clip_id, CASE WHEN reason IS NULL THEN s END AS start_us, CASE WHEN reason IS NULL THEN e END AS end_us, reason FROM y"""))
def _(spark, d):
    return C.teasers(*teased(spark, d))


# Clips without their first headline or piece, with odd scores, and media that end early.
JUDGED = f"""{TEASED}, v AS (SELECT cl.media_id, cl.clip_id, (cl.media_id + 3 * cl.clip_id) % 13 AS score, cl.clip_id % 5 = 4 AS bare, (SELECT max(end_us) FROM un WHERE un.media_id = cl.media_id) - 2000000 AS duration_us, count(pc.part) AS n, CAST(sum(pc.end_us - pc.start_us) AS BIGINT) AS total_us, min(pc.start_us) AS a, max(pc.end_us) AS b
    FROM cl LEFT JOIN pc ON pc.media_id = cl.media_id AND pc.clip_id = cl.clip_id AND pc.clip_id % 8 <> 7 GROUP BY ALL),
  jd AS (SELECT media_id, clip_id, total_us, CASE WHEN score NOT BETWEEN 1 AND 10 THEN 'score' WHEN n = 0 THEN 'no_pieces' WHEN n > 15 THEN 'many_pieces' WHEN bare THEN 'headline' WHEN total_us < 13000000 THEN 'short' WHEN total_us > 19500000 THEN 'long' WHEN b - a > 28000000 THEN 'envelope' WHEN b > duration_us THEN 'beyond_end' END AS reason FROM v)"""


def verdicts(spark, d):
    clips, pieces, units = teased(spark, d)
    c = F.col("clip_id")
    clips = clips.select("media_id", "clip_id", ((F.col("media_id") + 3 * c) % 13).alias("score"), F.when(c % 5 == 4, " ").otherwise("a headline").alias("headline"))
    durations = units.groupBy("media_id").agg((F.max("end_us") - 2_000_000).alias("duration_us"))
    return C.judged(clips, pieces.where(c % 8 != 7), durations, (13_000_000, 19_500_000), 28_000_000)


@query("h09_judged", A.sql("words", f"{JUDGED} SELECT * FROM jd"))
def _(spark, d):
    return verdicts(spark, d)


@query("h09_dropped", A.sql("words", f"{JUDGED} SELECT media_id, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS dropped, count(*) FILTER (reason = 'score') AS by_score FROM jd GROUP BY 1"))
def _(spark, d):
    return C.dropped(verdicts(spark, d)).select("media_id", "accepted", "dropped", F.coalesce(F.try_element_at("reasons", F.lit("score")), F.lit(0)).alias("by_score"))


# Events as two channels of samples: thousandths of a user's events in order.
SAMPLES = "sm AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, (event_id * 7919 % 2001 - 1000) / 1000.0::DOUBLE AS l, CASE WHEN user_id % 9 = 0 THEN 0.5::DOUBLE ELSE (event_id * 7919 % 2001 - 1000 + event_id % 500) / 1500.0::DOUBLE END AS r FROM timed)"


def samples(spark, d):
    at = F.col("event_id")
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("pos")
    left = at * 7919 % 2001 - 1000
    right = F.when(F.col("user_id") % 9 == 0, F.lit(0.5)).otherwise((left + at % 500) / 1500)
    return A._timed(spark, d).select(F.col("user_id").alias("media_id"), pos, (left / 1000).alias("left"), right.alias("right"))


@query("g08_waveform", A.sql("timed", f"{SAMPLES}, zz AS (SELECT media_id, CAST(ceil((max(pos) + 1) / 16) AS BIGINT) AS size FROM sm GROUP BY 1), o AS (SELECT sm.media_id, pos // size AS block, max(abs(l)) AS peak, sum(l * l) AS q FROM sm JOIN zz USING (media_id) GROUP BY 1, 2)\n  SELECT zz.media_id, b.block, coalesce(peak, 0) AS peak, round(sqrt(coalesce(q, 0) / size), 6) AS rms FROM zz CROSS JOIN (SELECT unnest(range(16)) AS block) b LEFT JOIN o ON o.media_id = zz.media_id AND o.block = b.block"))
def _(spark, d):
    return C.blocks(samples(spark, d).withColumn("x", F.col("left")), 16).withColumn("rms", F.round("rms", 6))


# A hundred samples a second; every eight of them a pause begins, of 0.19 s and more.
@query("g09_room_tone", A.sql("timed", f"""{SAMPLES}, p AS (SELECT media_id, pos * 10000 AS a, pos * 10000 + 190000 + pos % 5 * 40000 AS b FROM sm WHERE pos % 8 = 0), q AS (SELECT *, least(50000, (b - a) // 5) AS m FROM p WHERE b - a >= 200000),
  s AS (SELECT q.media_id, a, b, count(*) AS n, avg(l * l) AS m2 FROM q JOIN sm ON sm.media_id = q.media_id AND pos >= (a + m) * 100 // 1000000 AND pos < (b - m) * 100 // 1000000 GROUP BY 1, 2, 3), t AS (SELECT *, round(20 * log10(greatest(sqrt(m2), 1e-9)), 3) AS dbfs FROM s)
  SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY dbfs, a) AS INTEGER) AS rank, a AS start_us, b AS end_us, n, dbfs FROM t QUALIFY rank <= 5"""))
def _(spark, d):
    s = samples(spark, d)
    pauses = s.where("pos % 8 = 0").select("media_id", (F.col("pos") * 10_000).alias("start_us"), (F.col("pos") * 10_000 + 190_000 + F.col("pos") % 5 * 40_000).alias("end_us"))
    return C.room_tone(s.withColumnRenamed("left", "x"), pauses, 100, 1_000_000)


@query("g11_signal_stats", A.sql("timed", f"""{SAMPLES}, j AS (SELECT *, abs(l - lag(l) OVER w) AS dl, abs(r - lag(r) OVER w) AS dr FROM sm WINDOW w AS (PARTITION BY media_id ORDER BY pos))
  SELECT media_id, max(greatest(abs(l), abs(r))) AS peak, count(*) FILTER (abs(l) >= 0.9) + count(*) FILTER (abs(r) >= 0.9) AS clipped, count(*) FILTER (dl >= 0.95) + count(*) FILTER (dr >= 0.95) AS jumps, CASE WHEN min(l) < max(l) AND min(r) < max(r) THEN round(corr(l, r), 6) END AS correlation FROM j GROUP BY 1"""))
def _(spark, d):
    return C.signal_stats(samples(spark, d), clip=0.9).withColumn("correlation", F.round("correlation", 6))


@query("a02_analysis_tracks", A.sql("words", """v AS (SELECT media_id, 'vad' AS track, idx // 6 AS n, min(start_us) AS start_us, max(end_us) AS end_us, NULL::DOUBLE AS value FROM words GROUP BY media_id, idx // 6)
  SELECT media_id, track, row_number() OVER (PARTITION BY media_id ORDER BY n) - 1 AS pos, start_us, end_us, value FROM v UNION ALL SELECT media_id, 'density', row_number() OVER (PARTITION BY media_id ORDER BY n) - 1, start_us, end_us, n % 5 / 4.0::DOUBLE FROM v
  UNION ALL SELECT media_id, 'fillers', row_number() OVER (PARTITION BY media_id ORDER BY n) - 1, start_us, end_us, 0.9 FROM v WHERE n % 4 = 0"""))
def _(spark, d):
    """Analysis documents written from the words, one a recording, and read back."""
    spans = A.words(spark, d).groupBy("media_id", F.floor(F.col("idx") / 6).alias("n")).agg((F.min("start_us") / 1_000_000).alias("start"), (F.max("end_us") / 1_000_000).alias("end"))
    row = lambda when, *extra: F.array_sort(F.collect_list(F.when(when, F.struct("start", "end", *extra))))
    whole = spans.groupBy("media_id").agg(row(F.lit(True)).alias("vad"), row(F.lit(False)).alias("pauses"), row(F.lit(True), (F.col("n") % 5 / 4).alias("speech_ratio")).alias("speech_density"), row(F.col("n") % 4 == 0, F.lit("hesitation").alias("kind"), F.lit(0.9).alias("confidence")).alias("fillers"))
    path = folder(spark)
    whole.select(F.to_json(F.struct("media_id", "vad", "pauses", "speech_density", "fillers")).alias("value")).write.text(path)
    tracks, _ = io.analysis_tracks(*io.documents(spark, path, io.TRACKS))
    return tracks.select("media_id", "track", "pos", "start_us", "end_us", "value")


# Three turns are a clip, its pieces the first and, 0.7 s shorter, the third of them.
@query("k14_voice_shares", A.sql("turns", """pc AS (SELECT media_id, pos // 3 AS clip_id, start_us AS a, end_us - CASE pos % 3 WHEN 2 THEN 700000 ELSE 0 END AS b FROM turns WHERE pos % 3 <> 1), en AS (SELECT media_id, clip_id, min(a) AS a, max(b) AS b, count(*) AS pieces FROM pc GROUP BY 1, 2),
  tn AS (SELECT en.media_id, clip_id, speaker = 'user' AS own, t.start_us AS a, t.end_us AS b FROM en JOIN turns t ON t.media_id = en.media_id AND t.start_us < en.b AND en.a < t.end_us),
  ed AS (SELECT media_id, clip_id, unnest([a, b]) AS t FROM pc UNION SELECT media_id, clip_id, unnest([a, b]) FROM tn), el AS (SELECT *, lead(t) OVER (PARTITION BY media_id, clip_id ORDER BY t) AS n FROM ed),
  fl AS (SELECT el.media_id, el.clip_id, n - t AS us, EXISTS (SELECT 1 FROM pc p WHERE p.media_id = el.media_id AND p.clip_id = el.clip_id AND p.a <= t AND p.b >= n) AS cut, t >= en.a AND n <= en.b AS wide,
    EXISTS (SELECT 1 FROM tn x WHERE x.media_id = el.media_id AND x.clip_id = el.clip_id AND own AND x.a <= t AND x.b >= n) AS me, EXISTS (SELECT 1 FROM tn x WHERE x.media_id = el.media_id AND x.clip_id = el.clip_id AND NOT own AND x.a <= t AND x.b >= n) AS they FROM el JOIN en ON en.media_id = el.media_id AND en.clip_id = el.clip_id WHERE n IS NOT NULL),
  sh AS (SELECT media_id, clip_id, round(coalesce(sum(us) FILTER (cut AND me AND NOT they), 0) / sum(us) FILTER (cut AND (me OR they)), 6) AS editorial, round(coalesce(sum(us) FILTER (wide AND me AND NOT they), 0) / sum(us) FILTER (wide AND (me OR they)), 6) AS envelope FROM fl GROUP BY 1, 2),
  r AS (SELECT media_id, clip_id, pieces, coalesce(editorial, 0) AS editorial, coalesce(envelope, 0) AS envelope FROM en LEFT JOIN sh USING (media_id, clip_id)) SELECT *, editorial >= 0.5 AND (pieces > 1 OR envelope >= 0.5) AS accepted FROM r"""))
def _(spark, d):
    turns = A.turns(spark, d)
    pieces = turns.where("pos % 3 <> 1").select("media_id", F.floor(F.col("pos") / 3).alias("clip_id"), "start_us", (F.col("end_us") - F.when(F.col("pos") % 3 == 2, 700_000).otherwise(0)).alias("end_us"))
    return C.voice_accepted(pieces, turns, "user", 10_000_000)
