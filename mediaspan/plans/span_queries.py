"""Queries of the interval algebra and its joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.operators import spans as S
from mediaspan.sources import adapters as A

HOURS = 4 * 3600 * 1_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def union_sql(source: str, out: str, key: str = "media_id") -> str:
    return f"""{out}_n AS (SELECT {key}, start_us, end_us, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY {key} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {source} WHERE end_us > start_us),
      {out}_g AS (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM {out}_n),
      {out} AS (SELECT {key}, min(start_us) AS start_us, max(end_us) AS end_us FROM {out}_g GROUP BY {key}, g)"""


def subtract_sql(a: str, b: str, out: str) -> str:
    """By elementary intervals between all edges: another way than the sweep."""
    return f"""{union_sql(a, out + '_a')}, {union_sql(b, out + '_b')},
      {out}_t AS (SELECT media_id, start_us AS t FROM {out}_a UNION SELECT media_id, end_us FROM {out}_a UNION SELECT media_id, start_us FROM {out}_b UNION SELECT media_id, end_us FROM {out}_b),
      {out}_e AS (SELECT media_id, t AS start_us, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS end_us FROM {out}_t),
      {out}_k AS (SELECT * FROM {out}_e e WHERE end_us IS NOT NULL
        AND EXISTS (SELECT 1 FROM {out}_a a WHERE a.media_id = e.media_id AND a.start_us <= e.start_us AND a.end_us >= e.end_us)
        AND NOT EXISTS (SELECT 1 FROM {out}_b b WHERE b.media_id = e.media_id AND b.start_us <= e.start_us AND b.end_us >= e.end_us)),
      {union_sql(out + '_k', out)}"""


def intersect_sql(a: str, b: str, out: str) -> str:
    return f"""{union_sql(a, out + '_a')}, {union_sql(b, out + '_b')},
      {out} AS (SELECT a.media_id, greatest(a.start_us, b.start_us) AS start_us, least(a.end_us, b.end_us) AS end_us FROM {out}_a a JOIN {out}_b b ON a.media_id = b.media_id AND a.start_us < b.end_us AND b.start_us < a.end_us)"""


OWN, OTHER = "own AS (SELECT * FROM tracks WHERE label = 'click')", "other AS (SELECT * FROM tracks WHERE label <> 'click')"
LIMIT = "(SELECT media_id, max(end_us) - 3600000000 AS duration_us FROM tracks GROUP BY media_id)"


def durations(spark, d, minus=0):
    return A.tracks(spark, d).groupBy("media_id").agg((F.max("end_us") - minus).alias("duration_us"))


@query("b01_union", A.sql("spans", f"{union_sql('spans', 'u')} SELECT * FROM u"))
def _(spark, d):
    return S.union(A.spans(spark, d))


@query("b02_union_clamped", A.sql("tracks", f"c AS (SELECT t.media_id, start_us, least(end_us, duration_us) AS end_us FROM tracks t JOIN {LIMIT} USING (media_id)), {union_sql('c', 'u')} SELECT * FROM u"))
def _(spark, d):
    return S.union_clamped(A.tracks(spark, d), durations(spark, d, 3_600_000_000))


@query("b03_union_first", A.sql("clips", f"{union_sql('clips', 'u')} SELECT u.media_id, u.start_us, u.end_us, (SELECT c.clip_id FROM clips c WHERE c.media_id = u.media_id AND c.start_us >= u.start_us AND c.end_us <= u.end_us AND c.end_us > c.start_us ORDER BY c.start_us, c.end_us, c.clip_id LIMIT 1) AS clip_id FROM u"))
def _(spark, d):
    return S.union_first(A.clips(spark, d), "clip_id")


@query("b04_union_padded", A.sql("clips", f"p AS (SELECT media_id, greatest(start_us - 600000000, 0) AS start_us, end_us + 600000000 AS end_us FROM clips), {union_sql('p', 'u')} SELECT * FROM u"))
def _(spark, d):
    return S.union(S.padded(A.clips(spark, d), 600_000_000))


@query("b05_subtract", A.sql("tracks clips decisions", f"{subtract_sql('clips', 'decisions', 's')} SELECT * FROM s"))
def _(spark, d):
    return S.subtract(A.clips(spark, d), A.decisions(spark, d))


@query("b06_intersect", A.sql("clips decisions", f"{intersect_sql('clips', 'decisions', 'x')} SELECT * FROM x"))
def _(spark, d):
    return S.intersect(A.clips(spark, d), A.decisions(spark, d), HOURS)


@query("b07_intersect_or_all", A.sql("clips decisions", f"r AS (SELECT * FROM decisions WHERE media_id < 6), {intersect_sql('clips', 'r', 'x')}, {union_sql('clips', 'w')} SELECT * FROM x UNION ALL SELECT * FROM w WHERE media_id NOT IN (SELECT media_id FROM r)"))
def _(spark, d):
    return S.intersect_or_all(A.clips(spark, d), A.decisions(spark, d).where("media_id < 6"), HOURS)


@query("b08_gaps", A.sql("tracks clips", f"""lim AS {LIMIT}, {union_sql('clips', 'u')},
  e AS (SELECT media_id, start_us, end_us FROM u UNION ALL SELECT media_id, 0, 0 FROM lim UNION ALL SELECT media_id, duration_us, duration_us FROM lim),
  o AS (SELECT e.media_id, max(end_us) OVER (PARTITION BY e.media_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, least(start_us, duration_us) AS b FROM e JOIN lim USING (media_id))
  SELECT media_id, a AS start_us, b AS end_us FROM o WHERE b - a >= 180000"""))
def _(spark, d):
    return S.gaps(A.clips(spark, d), durations(spark, d, 3_600_000_000))


@query("b09_subject_only", A.sql("tracks", f"{OWN}, {OTHER}, po AS (SELECT media_id, greatest(start_us - 300000, 0) AS start_us, end_us + 300000 AS end_us FROM own), pt AS (SELECT media_id, greatest(start_us - 400000, 0) AS start_us, end_us + 400000 AS end_us FROM other), {subtract_sql('po', 'pt', 's')} SELECT * FROM s"))
def _(spark, d):
    t = A.tracks(spark, d)
    return S.subtract(S.padded(t.where("label = 'click'"), 300_000), S.padded(t.where("label <> 'click'"), 400_000))


@query("b10_exclusive_share", A.sql("tracks clips decisions", f"""tv AS (SELECT media_id, label AS speaker, start_us, end_us FROM tracks WHERE label IN ('view', 'purchase', 'signup')),
  ov AS (SELECT * FROM tv WHERE speaker = 'view'), nv AS (SELECT * FROM tv WHERE speaker <> 'view'),
  {intersect_sql('ov', 'clips', 'xo')}, {intersect_sql('nv', 'clips', 'xn')}, {intersect_sql('tv', 'clips', 'xt')}, {subtract_sql('xo', 'xn', 's')}
  SELECT m.media_id, CAST(coalesce(alone_us, 0) AS BIGINT) AS alone_us, CAST(coalesce(any_us, 0) AS BIGINT) AS any_us, round(coalesce(coalesce(alone_us, 0) / nullif(coalesce(any_us, 0), 0), 0), 6) AS share
  FROM (SELECT DISTINCT media_id FROM clips) m LEFT JOIN (SELECT media_id, sum(end_us - start_us) AS alone_us FROM s GROUP BY 1) USING (media_id) LEFT JOIN (SELECT media_id, sum(end_us - start_us) AS any_us FROM xt GROUP BY 1) USING (media_id)"""))
def _(spark, d):
    t = A.tracks(spark, d).where("label in ('view', 'purchase', 'signup')").withColumnRenamed("label", "speaker")
    return S.exclusive_time(A.clips(spark, d), t, "view", HOURS)


@query("b11_overlap_share", A.sql("tracks clips", """SELECT c.media_id, c.clip_id AS id, CAST(coalesce(sum(CASE WHEN t.label = 'view' THEN least(c.end_us, t.end_us) - greatest(c.start_us, t.start_us) ELSE 0 END), 0) AS BIGINT) AS own_us,
  CAST(coalesce(sum(least(c.end_us, t.end_us) - greatest(c.start_us, t.start_us)) FILTER (t.media_id IS NOT NULL), 0) AS BIGINT) AS any_us,
  round(sum(CASE WHEN t.label = 'view' THEN least(c.end_us, t.end_us) - greatest(c.start_us, t.start_us) ELSE 0 END) / sum(least(c.end_us, t.end_us) - greatest(c.start_us, t.start_us)) FILTER (t.media_id IS NOT NULL), 6) AS share
  FROM clips c LEFT JOIN tracks t ON t.label <> 'click' AND t.media_id = c.media_id AND c.start_us < t.end_us AND t.start_us < c.end_us AND c.end_us > c.start_us GROUP BY 1, 2"""))
def _(spark, d):
    t = A.tracks(spark, d).where("label <> 'click'").withColumnRenamed("label", "speaker")
    return S.overlap_shares(A.clips(spark, d).withColumnRenamed("clip_id", "id"), t, "view", HOURS)


DOMINANT = """m AS (SELECT c.media_id, c.clip_id AS id, t.label, CAST(sum(least(c.end_us, t.end_us) - greatest(c.start_us, t.start_us)) AS BIGINT) AS us, min(t.start_us) AS first_us, c.end_us - c.start_us AS size
  FROM clips c JOIN tracks t ON t.label <> 'click' AND t.media_id = c.media_id AND c.start_us < t.end_us AND t.start_us < c.end_us GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY media_id, id ORDER BY us DESC, first_us, label) AS rank FROM m)"""


def dominant(spark, d):
    return S.dominant(A.clips(spark, d).withColumnRenamed("clip_id", "id"), A.tracks(spark, d).where("label <> 'click'").drop("id"), "label", HOURS)


@query("b12_dominant", A.sql("tracks clips", f"{DOMINANT} SELECT media_id, id, label, us FROM r WHERE rank = 1"))
def _(spark, d):
    return dominant(spark, d).where("rank = 1").select("media_id", "id", "label", "us")


@query("b13_truth", A.sql("tracks clips", f"""{DOMINANT} SELECT a.media_id, a.id, CASE WHEN 10 * a.us >= 8 * a.size AND 10 * coalesce(b.us, 0) < 2 * a.size THEN a.label END AS truth
  FROM r a LEFT JOIN r b ON a.media_id = b.media_id AND a.id = b.id AND b.rank = 2 WHERE a.rank = 1"""))
def _(spark, d):
    sizes = A.clips(spark, d).select("media_id", F.col("clip_id").alias("id"), (F.col("end_us") - F.col("start_us")).alias("size"))
    r = dominant(spark, d).groupBy("media_id", "id").agg(F.max(F.when(F.col("rank") == 1, F.col("us"))).alias("a"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("us"))), F.lit(0)).alias("b"), F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("label"))
    return r.join(sizes, ["media_id", "id"]).select("media_id", "id", F.when((10 * F.col("a") >= 8 * F.col("size")) & (10 * F.col("b") < 2 * F.col("size")), F.col("label")).alias("truth"))


@query("b14_coverage", A.sql("clips decisions", f"{union_sql('decisions', 'u')} SELECT c.media_id, c.clip_id, CAST(coalesce(sum(least(c.end_us, u.end_us) - greatest(c.start_us, u.start_us)) FILTER (u.media_id IS NOT NULL), 0) AS BIGINT) AS covered_us, coalesce(10 * sum(least(c.end_us, u.end_us) - greatest(c.start_us, u.start_us)) FILTER (u.media_id IS NOT NULL) >= 9 * any_value(c.end_us - c.start_us), false) AS covered FROM clips c LEFT JOIN u ON u.media_id = c.media_id AND c.start_us < u.end_us AND u.start_us < c.end_us AND c.end_us > c.start_us GROUP BY 1, 2"))
def _(spark, d):
    clips = A.clips(spark, d)
    met = S.overlap_join(clips, S.right_side(S.union(A.decisions(spark, d))), HOURS)
    sums = met.groupBy("media_id", "clip_id").agg(F.sum(S.overlap(F.col("start_us"), F.col("end_us"), F.col("right_start_us"), F.col("right_end_us"))).alias("covered_us"))
    out = clips.join(sums, ["media_id", "clip_id"], "left").fillna(0, ["covered_us"])
    return out.select("media_id", "clip_id", "covered_us", ((F.col("covered_us") > 0) & (10 * F.col("covered_us") >= 9 * (F.col("end_us") - F.col("start_us")))).alias("covered"))


@query("b16_any_overlap", A.sql("clips decisions", "SELECT media_id, clip_id FROM clips c WHERE end_us > start_us AND EXISTS (SELECT 1 FROM decisions x WHERE x.media_id = c.media_id AND x.end_us > x.start_us AND c.start_us < x.end_us AND x.start_us < c.end_us)"))
def _(spark, d):
    return S.overlap_join(A.clips(spark, d), S.right_side(A.decisions(spark, d).select("media_id", "start_us", "end_us")), HOURS).select("media_id", "clip_id").distinct()


@query("b17_exclude", A.sql("clips decisions", "SELECT media_id, clip_id FROM clips c WHERE NOT EXISTS (SELECT 1 FROM decisions x WHERE x.media_id = c.media_id AND c.end_us > c.start_us AND x.end_us > x.start_us AND c.start_us < x.end_us AND x.start_us < c.end_us)"))
def _(spark, d):
    hit = QUERIES["b16_any_overlap"](spark, d)
    return A.clips(spark, d).select("media_id", "clip_id").join(hit, ["media_id", "clip_id"], "left_anti")


@query("b18_asof", A.sql("points clips", """SELECT p.media_id, p.point_id, p.t_us, (SELECT CASE WHEN c.end_us > p.t_us THEN c.clip_id END FROM clips c WHERE c.media_id = p.media_id AND c.start_us <= p.t_us ORDER BY c.start_us DESC, c.clip_id DESC LIMIT 1) AS clip_id FROM points p"""))
def _(spark, d):
    return S.asof(A.points(spark, d), A.clips(spark, d), "clip_id")


NEAR = 900_000_000


@query("b19_nearest", A.sql("points clips", f"SELECT c.media_id, c.clip_id AS id, c.start_us AS t_us, (SELECT p.t_us FROM points p WHERE p.media_id = c.media_id AND abs(p.t_us - c.start_us) <= {NEAR} ORDER BY abs(p.t_us - c.start_us), p.t_us LIMIT 1) AS near_us FROM clips c"))
def _(spark, d):
    rows = A.clips(spark, d).select("media_id", F.col("clip_id").alias("id"), F.col("start_us").alias("t_us"))
    return S.nearest(rows, A.points(spark, d), NEAR)


@query("b20_point_inside", A.sql("points clips", "SELECT p.media_id, p.point_id, min(c.clip_id) AS clip_id FROM points p JOIN clips c ON c.media_id = p.media_id AND p.t_us > c.start_us + 15000 AND p.t_us < c.end_us - 15000 GROUP BY 1, 2"))
def _(spark, d):
    dot = A.points(spark, d).select("media_id", "point_id", F.col("t_us").alias("right_start_us"), (F.col("t_us") + 1).alias("right_end_us"))
    met = S.overlap_join(A.clips(spark, d), dot, HOURS)
    met = met.where((F.col("right_start_us") > F.col("start_us") + 15_000) & (F.col("right_start_us") < F.col("end_us") - 15_000))
    return met.groupBy("media_id", "point_id").agg(F.min("clip_id").alias("clip_id"))


@query("b21_scenes", A.sql("tracks points", f"""lim AS {LIMIT}, t AS (SELECT DISTINCT p.media_id, t_us FROM points p JOIN lim USING (media_id) WHERE t_us > 0 AND t_us < duration_us UNION SELECT media_id, 0 FROM lim UNION SELECT media_id, duration_us FROM lim),
  o AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t_us) - 1 AS idx, t_us AS start_us, lead(t_us) OVER (PARTITION BY media_id ORDER BY t_us) AS end_us FROM t) SELECT media_id, CAST(idx AS INTEGER) AS idx, start_us, end_us FROM o WHERE end_us IS NOT NULL"""))
def _(spark, d):
    return S.points_to_spans(A.points(spark, d), durations(spark, d, 3_600_000_000))


@query("b22_split", A.sql("points clips", """c AS (SELECT media_id, clip_id AS id, start_us, end_us FROM clips WHERE end_us > start_us),
  e AS (SELECT media_id, id, start_us AS t, end_us FROM c UNION SELECT c.media_id, c.id, p.t_us, c.end_us FROM c JOIN points p ON p.media_id = c.media_id AND p.t_us > c.start_us + 1000 AND p.t_us < c.end_us - 1000)
  SELECT media_id, id, t AS start_us, coalesce(lead(t) OVER (PARTITION BY media_id, id ORDER BY t), end_us) AS end_us, CAST(row_number() OVER (PARTITION BY media_id, id ORDER BY t) - 1 AS INTEGER) AS scene FROM e"""))
def _(spark, d):
    return S.split(A.clips(spark, d).withColumnRenamed("clip_id", "id"), A.points(spark, d), HOURS)


def runs_sql(end: str) -> str:
    return f"""o AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY media_id ORDER BY start_us, id) THEN 0 ELSE 1 END AS n FROM tracks), g AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY start_us, id ROWS UNBOUNDED PRECEDING) AS g FROM o),
  r AS (SELECT media_id, g, any_value(label) AS label, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM g GROUP BY media_id, g) SELECT media_id, label, start_us, {end} AS end_us, n FROM r"""


@query("b23_shots", A.sql("tracks", runs_sql("coalesce(lead(start_us) OVER (PARTITION BY media_id ORDER BY g), end_us)")))
def _(spark, d):
    return S.runs(A.tracks(spark, d), "label", ["start_us", "id"], end="next")


@query("b24_merge_turns", A.sql("tracks", runs_sql("end_us")))
def _(spark, d):
    return S.runs(A.tracks(spark, d), "label", ["start_us", "id"])


@query("b25_bridge", A.sql("clips", """o AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us) < 50000 THEN 0 ELSE 1 END AS n FROM clips WHERE end_us > start_us), g AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM o)
  SELECT media_id, min(start_us) AS start_us, arg_max(end_us, (start_us, end_us)) AS end_us, count(*) AS parts FROM g GROUP BY media_id, g"""))
def _(spark, d):
    return S.bridge(A.clips(spark, d))


@query("b26_clean_turns", A.sql("turns", """SELECT media_id, pos, start_us, least(end_us, start_us + 6000000) AS end_us FROM turns t WHERE speaker = 'user' AND end_us - start_us >= 3000000
  AND NOT EXISTS (SELECT 1 FROM turns o WHERE o.media_id = t.media_id AND o.speaker <> 'user' AND o.start_us < t.end_us AND t.start_us < o.end_us)"""))
def _(spark, d):
    return S.clean_turns(A.turns(spark, d), "user", 10_000_000)


@query("b27_crops", A.sql("clips", """c AS (SELECT *, (end_us - start_us) // 3000000000 AS k, end_us - start_us AS n FROM clips WHERE end_us > start_us),
  h AS (SELECT media_id, clip_id, start_us, end_us, unnest(range(k)) AS i FROM c WHERE n > 6000000000)
  SELECT media_id, clip_id, start_us AS crop_start_us, end_us AS crop_end_us FROM c WHERE n <= 6000000000 UNION ALL SELECT media_id, clip_id, start_us + i * 3000000000, start_us + (i + 1) * 3000000000 FROM h
  UNION ALL SELECT media_id, clip_id, end_us - 3000000000, end_us FROM c WHERE n > 6000000000 AND n - k * 3000000000 > 500000000"""))
def _(spark, d):
    return S.crops(A.clips(spark, d), 6_000_000_000, 3_000_000_000, 500_000_000).select("media_id", "clip_id", "crop_start_us", "crop_end_us")


@query("b28_footage_windows", A.sql("tracks clips decisions", f"""v AS (SELECT media_id, start_us + 300000 AS start_us, end_us - 300000 AS end_us FROM tracks WHERE label = 'view'), {intersect_sql('v', 'clips', 'x')},
  p AS (SELECT media_id, greatest(start_us - 500000, 0) AS start_us, end_us + 500000 AS end_us FROM decisions), {subtract_sql('x', 'p', 's')} SELECT * FROM s WHERE end_us - start_us >= 1200000"""))
def _(spark, d):
    shots = A.tracks(spark, d).where("label = 'view'").withColumn("start_us", F.col("start_us") + 300_000).withColumn("end_us", F.col("end_us") - 300_000)
    found = S.subtract(S.intersect(shots, A.clips(spark, d), HOURS), S.padded(A.decisions(spark, d), 500_000))
    return found.where("end_us - start_us >= 1200000")


SEGMENTS = "seg AS (SELECT media_id AS plan_id, row_number() OVER (PARTITION BY media_id ORDER BY start_us, clip_id) - 1 AS pos, clip_id % 4 AS piece, start_us, end_us, (clip_id % 3) * 400000000 AS fade_us FROM clips WHERE end_us > start_us)"


def segments(spark, d):
    order = Window.partitionBy("media_id").orderBy("start_us", "clip_id")
    return A.clips(spark, d).where("end_us > start_us").select(F.col("media_id").alias("plan_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), (F.col("clip_id") % 4).alias("piece"), "start_us", "end_us", ((F.col("clip_id") % 3) * 400_000_000).alias("fade_us"))


TIMELINE = f"""{SEGMENTS}, b AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE least(fade_us, (end_us - start_us) // 2, lag(end_us - start_us) OVER w // 2) END AS back FROM seg WINDOW w AS (PARTITION BY plan_id ORDER BY pos)),
  t AS (SELECT *, CAST(coalesce(sum(end_us - start_us) OVER (PARTITION BY plan_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - sum(back) OVER (PARTITION BY plan_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS out_us FROM b)"""


@query("b29_output_starts", A.sql("clips", f"{TIMELINE} SELECT plan_id, pos, out_us FROM t"))
def _(spark, d):
    return S.timeline(segments(spark, d)).select("plan_id", "pos", "out_us")


@query("b30_timeline_duration", A.sql("clips", f"{SEGMENTS}, n AS (SELECT *, lead(pos) OVER (PARTITION BY plan_id ORDER BY pos) AS after FROM seg) SELECT plan_id, greatest(0, CAST(sum(end_us - start_us) - sum(CASE WHEN after IS NOT NULL THEN fade_us ELSE 0 END) AS BIGINT)) AS duration_us FROM n GROUP BY 1"))
def _(spark, d):
    after = F.lead("pos").over(Window.partitionBy("plan_id").orderBy("pos"))
    rows = segments(spark, d).withColumn("fade", F.when(after.isNotNull(), F.col("fade_us")).otherwise(0))
    return rows.groupBy("plan_id").agg(F.greatest(F.lit(0).cast("long"), F.sum(F.col("end_us") - F.col("start_us")) - F.sum("fade")).alias("duration_us"))


@query("b31_remap", A.sql("clips points", f"{TIMELINE} SELECT t.plan_id, t.pos, p.point_id, p.t_us - t.start_us + t.out_us AS out_us FROM t JOIN points p ON p.media_id = t.plan_id AND p.t_us >= t.start_us AND p.t_us < t.end_us"))
def _(spark, d):
    plan = S.timeline(segments(spark, d)).withColumnRenamed("plan_id", "media_id")
    dot = A.points(spark, d).select("media_id", "point_id", F.col("t_us").alias("right_start_us"), (F.col("t_us") + 1).alias("right_end_us"))
    met = S.overlap_join(plan, dot, HOURS)
    return met.select(F.col("media_id").alias("plan_id"), "pos", "point_id", (F.col("right_start_us") - F.col("start_us") + F.col("out_us")).alias("out_us"))


@query("b32_junctions", A.sql("clips", f"{TIMELINE}, j AS (SELECT *, lag(piece) OVER (PARTITION BY plan_id ORDER BY pos) AS prior FROM t) SELECT plan_id, pos, prior, piece, out_us FROM j WHERE prior <> piece"))
def _(spark, d):
    order = Window.partitionBy("plan_id").orderBy("pos")
    return S.timeline(segments(spark, d)).withColumn("prior", F.lag("piece").over(order)).where("prior <> piece").select("plan_id", "pos", "prior", "piece", "out_us")


@query("b33_blocks", A.sql("clips", f"""{SEGMENTS}, o AS (SELECT *, CASE WHEN piece = lag(piece) OVER (PARTITION BY plan_id ORDER BY pos) THEN 0 ELSE 1 END AS n FROM seg), g AS (SELECT *, sum(n) OVER (PARTITION BY plan_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM o),
  r AS (SELECT plan_id, g, any_value(piece) AS piece, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM g GROUP BY 1, 2) SELECT plan_id, CAST(g AS BIGINT) AS block, piece, n, us, CAST(us * 1000000 // sum(us) OVER (PARTITION BY plan_id) AS BIGINT) AS ppm FROM r"""))
def _(spark, d):
    order = Window.partitionBy("plan_id").orderBy("pos")
    new = F.when(F.col("piece") == F.lag("piece").over(order), 0).otherwise(1)
    rows = segments(spark, d).withColumn("_new", new).withColumn("block", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("plan_id", "block").agg(F.first("piece").alias("piece"), F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    return out.withColumn("ppm", F.floor(F.col("us").cast("decimal(38,0)") * 1_000_000 / F.sum("us").over(Window.partitionBy("plan_id"))).cast("long"))


@query("b34_source_window", A.sql("clips", f"{SEGMENTS} SELECT plan_id, piece = 0 AS teaser, min(start_us) AS start_us, max(end_us) AS end_us FROM seg GROUP BY ALL"))
def _(spark, d):
    return segments(spark, d).groupBy("plan_id", (F.col("piece") == 0).alias("teaser")).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


MATCH = """m AS (SELECT c.media_id, c.clip_id, x.decision_id, x.verdict, least(c.end_us, x.end_us) - greatest(c.start_us, x.start_us) AS both_us, c.end_us - c.start_us + x.end_us - x.start_us AS sum_us
  FROM clips c JOIN decisions x ON x.media_id = c.media_id AND c.start_us < x.end_us AND x.start_us < c.end_us AND c.end_us > c.start_us AND x.end_us > x.start_us),
  r AS (SELECT *, row_number() OVER (PARTITION BY media_id, clip_id ORDER BY both_us / (sum_us - both_us) DESC, decision_id) AS n FROM m)"""


def matched(spark, d):
    return S.best_match(A.clips(spark, d), A.decisions(spark, d), HOURS)


@query("f05_overlap_join", A.sql("clips decisions", f"{MATCH} SELECT media_id, clip_id, decision_id, both_us FROM m"))
def _(spark, d):
    met = S.overlap_join(A.clips(spark, d), S.right_side(A.decisions(spark, d)), HOURS)
    return met.select("media_id", "clip_id", "decision_id", S.overlap(F.col("start_us"), F.col("end_us"), F.col("right_start_us"), F.col("right_end_us")).alias("both_us"))


@query("f04_overlap_semi", A.sql("clips decisions", "SELECT * FROM clips c WHERE end_us > start_us AND EXISTS (SELECT 1 FROM decisions x WHERE x.media_id = c.media_id AND x.end_us > x.start_us AND x.start_us < c.end_us AND c.start_us < x.end_us)"))
def _(spark, d):
    return S.overlap_semi(A.clips(spark, d), A.decisions(spark, d))


@query("f09_best_match", A.sql("clips decisions", f"{MATCH} SELECT media_id, clip_id, decision_id, verdict, both_us, sum_us - both_us AS all_us, 2 * both_us >= sum_us - both_us AS matched FROM r WHERE n = 1"))
def _(spark, d):
    return matched(spark, d).select("media_id", "clip_id", "decision_id", "verdict", "both_us", "all_us", (2 * F.col("both_us") >= F.col("all_us")).alias("matched"))


@query("k13_coverage", A.sql("clips decisions", f"""{MATCH}, b AS (SELECT media_id, decision_id, verdict FROM r WHERE n = 1 AND 2 * both_us >= sum_us - both_us)
  SELECT x.media_id, CAST(count(*) FILTER (x.verdict = 'approved') AS BIGINT) AS approved, CAST(count(*) FILTER (x.verdict = 'rejected') AS BIGINT) AS rejected,
  CAST(count(*) FILTER (x.verdict = 'approved' AND f.decision_id IS NOT NULL) AS BIGINT) AS approved_met, CAST(count(*) FILTER (x.verdict = 'rejected' AND f.decision_id IS NOT NULL) AS BIGINT) AS rejected_met,
  round(count(*) FILTER (x.verdict = 'approved' AND f.decision_id IS NOT NULL) / nullif(count(*) FILTER (x.verdict = 'approved'), 0), 6) AS coverage
  FROM decisions x LEFT JOIN (SELECT DISTINCT media_id, decision_id FROM b) f ON f.media_id = x.media_id AND f.decision_id = x.decision_id GROUP BY 1"""))
def _(spark, d):
    met = matched(spark, d).where(2 * F.col("both_us") >= F.col("all_us")).select("media_id", "decision_id").distinct().withColumn("met", F.lit(True))
    rows = A.decisions(spark, d).join(met, ["media_id", "decision_id"], "left")
    yes, hit = F.col("verdict") == "approved", F.col("met").isNotNull()
    out = rows.groupBy("media_id").agg(F.count_if(yes).alias("approved"), F.count_if(~yes).alias("rejected"), F.count_if(yes & hit).alias("approved_met"), F.count_if(~yes & hit).alias("rejected_met"))
    return out.withColumn("coverage", F.round(F.try_divide("approved_met", "approved"), 6))


@query("f10_unique", A.sql("tracks", """k AS (SELECT media_id, label, min(id) AS id, count(*) AS n FROM tracks GROUP BY 1, 2) SELECT media_id, label, CASE WHEN n = 1 THEN id END AS id, n <> 1 AS ambiguous FROM k"""))
def _(spark, d):
    k = A.tracks(spark, d).groupBy("media_id", "label").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return k.select("media_id", "label", F.when(F.col("n") == 1, F.col("first")).alias("id"), (F.col("n") != 1).alias("ambiguous"))
