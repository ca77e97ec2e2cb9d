"""Queries on edit plans, vectors, signals and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.functions import text as T
from mediaspan.operators import plan as P
from mediaspan.operators import spans as S
from mediaspan.operators import vectors as V
from mediaspan.plans.span_queries import HOURS, intersect_sql, segments, union_sql
from mediaspan.sources import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


PAUSES = "n AS (SELECT media_id, idx, word, end_us, lead(start_us) OVER (PARTITION BY media_id ORDER BY idx) AS after FROM words), cuts AS (SELECT media_id, idx, after - end_us AS gap_us, end_us + 80000 AS cut_start_us, after - 60000 AS cut_end_us FROM n WHERE after - end_us >= 500000 AND NOT (regexp_matches(word, '[.!?…]$') AND after - end_us <= 900000) AND after - 60000 - end_us - 80000 >= 100000)"
LENGTHS = "lens AS (SELECT media_id, max(end_us) AS duration_us FROM words GROUP BY 1)"
BEST = f"{PAUSES}, {LENGTHS}, k AS (SELECT cuts.*, duration_us, row_number() OVER (PARTITION BY media_id ORDER BY cut_end_us - cut_start_us DESC, cut_start_us) AS n FROM cuts JOIN lens USING (media_id)), best AS (SELECT * FROM k WHERE n <= ceil(CAST(duration_us * 2.5 AS DOUBLE) / 30000000))"


def lengths(spark, d):
    return A.words(spark, d).groupBy("media_id").agg(F.max("end_us").alias("duration_us"))


def best(spark, d):
    return P.best_cuts(P.candidate_pauses(A.words(spark, d)), lengths(spark, d), 2.5)


@query("e01_candidate_pauses", A.sql("words", f"{PAUSES} SELECT * FROM cuts"))
def _(spark, d):
    return P.candidate_pauses(A.words(spark, d))


@query("e03_best_cuts", A.sql("words", f"{BEST} SELECT media_id, idx, gap_us, cut_start_us, cut_end_us FROM best"))
def _(spark, d):
    return best(spark, d)


KEPT = f"""{BEST}, e AS (SELECT media_id, cut_start_us AS a, cut_end_us AS b FROM best UNION ALL SELECT media_id, 0, 0 FROM lens UNION ALL SELECT media_id, duration_us, duration_us FROM lens),
  o AS (SELECT media_id, max(b) OVER (PARTITION BY media_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x, a AS y FROM e),
  s AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY x) AS pos FROM o WHERE y - x > 500000),
  g AS (SELECT *, count(*) FILTER (pos = 1 OR y - x >= 720000) OVER (PARTITION BY media_id ORDER BY pos) AS g FROM s),
  f AS (SELECT media_id, g, min(x) AS x, max(y) AS y FROM g GROUP BY 1, 2),
  h AS (SELECT media_id, CASE WHEN g = 1 AND y - x < 720000 AND EXISTS (SELECT 1 FROM f n WHERE n.media_id = f.media_id AND n.g = 2) THEN 2 ELSE g END AS g, x, y FROM f),
  q AS (SELECT media_id, g, min(x) AS start_us, max(y) AS end_us FROM h GROUP BY 1, 2),
  z AS (SELECT media_id, duration_us, count(g) > 1 AND duration_us - sum(end_us - start_us) >= 700000 AS fine FROM lens LEFT JOIN q USING (media_id) GROUP BY 1, 2),
  kept AS (SELECT media_id, start_us, end_us FROM q JOIN z USING (media_id) WHERE fine UNION ALL SELECT media_id, 0, duration_us FROM z WHERE fine IS NOT TRUE)"""


@query("e04_kept_segments", A.sql("words", f"{KEPT} SELECT * FROM kept"))
def _(spark, d):
    return P.kept_segments(best(spark, d), lengths(spark, d))


@query("e05_protect", A.sql("clips points tracks", """w AS (SELECT media_id, start_us, end_us FROM tracks WHERE label = 'purchase' AND end_us > start_us), c AS (SELECT * FROM clips WHERE end_us > start_us)
  SELECT c.media_id, c.clip_id AS id, least(c.start_us, coalesce(greatest(min(w.start_us) - 100000, 0), c.start_us)) AS start_us, greatest(c.end_us, coalesce(max(w.end_us) + 200000, c.end_us)) AS end_us
  FROM c LEFT JOIN w ON w.media_id = c.media_id AND w.start_us < c.end_us AND c.start_us < w.end_us GROUP BY c.media_id, c.clip_id, c.start_us, c.end_us"""))
def _(spark, d):
    segs = A.clips(spark, d).where("end_us > start_us").withColumnRenamed("clip_id", "id")
    return P.protect_boundaries(segs, A.tracks(spark, d).where("label = 'purchase'"), 100_000, 200_000, HOURS)


FRAMES = "fr AS (SELECT media_id, start_us AS t_us, (id * 7919) % 1000 * 1000 AS level FROM tracks WHERE label <> 'click')"
RADIUS = 1_800_000_000


@query("e02_quiet_boundary", A.sql("tracks clips decisions", f"""{FRAMES}, near AS (SELECT c.media_id, c.clip_id, c.start_us, f.t_us, f.level, abs(f.t_us - c.start_us) AS away FROM clips c JOIN fr f ON f.media_id = c.media_id AND f.t_us BETWEEN c.start_us - {RADIUS} AND c.start_us + {RADIUS}),
  usual AS (SELECT clip_id, list_sort(list(level)) AS l FROM near GROUP BY 1), p AS (SELECT clip_id, coalesce(nullif(l[CAST(round_even((len(l) - 1) * 0.9::DOUBLE, 0) AS BIGINT) + 1], 0), nullif(l[-1], 0), 1)::DOUBLE AS high FROM usual),
  ok AS (SELECT n.*, least(2.0::DOUBLE, level / high) + away / {RADIUS}.0::DOUBLE * 0.32::DOUBLE AS cost FROM near n JOIN p USING (clip_id) WHERE NOT EXISTS (SELECT 1 FROM decisions b WHERE b.media_id = n.media_id AND b.end_us > b.start_us AND n.t_us BETWEEN b.start_us AND b.end_us)),
  first AS (SELECT clip_id, t_us FROM ok QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY cost, t_us) = 1)
  SELECT c.media_id, c.clip_id AS id, c.start_us AS t_us, coalesce(q.t_us, c.start_us) AS quiet_us FROM clips c LEFT JOIN first q USING (clip_id)"""))
def _(spark, d):
    frames = A.tracks(spark, d).where("label <> 'click'").select("media_id", F.col("start_us").alias("t_us"), ((F.col("id") * 7919) % 1000 * 1000).alias("level"))
    targets = A.clips(spark, d).select("media_id", F.col("clip_id").alias("id"), F.col("start_us").alias("t_us"))
    return P.quiet_boundaries(targets, frames, A.decisions(spark, d), RADIUS)


@query("e08_within_ceiling", A.sql("clips", """seg AS (SELECT media_id AS plan_id, row_number() OVER (PARTITION BY media_id ORDER BY start_us, clip_id) - 1 AS pos, end_us - start_us AS n FROM clips WHERE end_us > start_us),
  r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY plan_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM seg) SELECT plan_id, pos, upto FROM r WHERE upto <= 200000000000"""))
def _(spark, d):
    order = Window.partitionBy("plan_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return segments(spark, d).withColumn("upto", F.sum(F.col("end_us") - F.col("start_us")).over(order)).where("upto <= 200000000000").select("plan_id", "pos", "upto")


@query("e13_diagnostics", A.sql("words", f"{BEST} SELECT lens.media_id, count(idx) AS n_cuts, CAST(coalesce(sum(cut_end_us - cut_start_us), 0) AS BIGINT) AS saved_us FROM lens LEFT JOIN best USING (media_id) GROUP BY 1"))
def _(spark, d):
    sums = best(spark, d).groupBy("media_id").agg(F.count("idx").alias("n_cuts"), F.sum(F.col("cut_end_us") - F.col("cut_start_us")).alias("saved_us"))
    return lengths(spark, d).select("media_id").join(sums, "media_id", "left").fillna(0)


@query("e14_violations", A.sql("clips", """seg AS (SELECT media_id AS plan_id, clip_id, start_us, end_us, start_us + (clip_id % 5) * 4000 AS audio_start_us, end_us + (clip_id % 7) * 4000 AS audio_end_us FROM clips)
  SELECT plan_id, clip_id, concat_ws(',', CASE WHEN end_us <= start_us THEN 'empty' END, CASE WHEN abs((audio_end_us - audio_start_us) - (end_us - start_us)) > 10000 THEN 'length' END, CASE WHEN audio_start_us - start_us > 12000 THEN 'offset' END) AS issues FROM seg
  WHERE end_us <= start_us OR abs((audio_end_us - audio_start_us) - (end_us - start_us)) > 10000 OR audio_start_us - start_us > 12000"""))
def _(spark, d):
    seg = A.clips(spark, d).withColumn("a0", F.col("start_us") + (F.col("clip_id") % 5) * 4000).withColumn("a1", F.col("end_us") + (F.col("clip_id") % 7) * 4000)
    issues = F.array_compact(F.array(F.when(F.expr("end_us <= start_us"), "empty"), F.when(F.expr("abs((a1 - a0) - (end_us - start_us)) > 10000"), "length"), F.when(F.expr("a0 - start_us > 12000"), "offset")))
    return seg.withColumn("issues", issues).where(F.size("issues") > 0).select(F.col("media_id").alias("plan_id"), "clip_id", F.array_join("issues", ",").alias("issues"))


@query("e16_footage_candidates", A.sql("clips points", """m AS (SELECT p.media_id, p.point_id, c.clip_id, round(0.6 * exp(-abs(c.start_us - p.t_us) / 600000000.0) + 0.3 * least(1.0, (c.end_us - c.start_us) / 6000000000.0) + 0.1 * (c.clip_id % 2), 4) AS score
  FROM points p JOIN clips c ON c.media_id = p.media_id AND c.end_us > c.start_us AND p.t_us >= c.start_us - 3600000000 AND p.t_us < c.end_us + 3600000000), r AS (SELECT *, row_number() OVER (PARTITION BY media_id, point_id ORDER BY score DESC, clip_id) AS place FROM m) SELECT media_id, point_id, clip_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3"""))
def _(spark, d):
    dot = A.points(spark, d).select("media_id", "point_id", F.col("t_us").alias("right_start_us"), (F.col("t_us") + 1).alias("right_end_us"))
    wide = A.clips(spark, d).where("end_us > start_us").select("media_id", "clip_id", F.col("start_us").alias("s"), F.col("end_us").alias("e"), F.greatest(F.col("start_us") - 3_600_000_000, F.lit(0)).alias("start_us"), (F.col("end_us") + 3_600_000_000).alias("end_us"))
    met = S.overlap_join(wide, dot, HOURS)
    score = F.round(0.6 * F.exp(-F.abs(F.col("s") - F.col("right_start_us")) / 600_000_000) + 0.3 * F.least(F.lit(1.0), (F.col("e") - F.col("s")) / 6_000_000_000) + 0.1 * (F.col("clip_id") % 2), 4)
    place = F.row_number().over(Window.partitionBy("media_id", "point_id").orderBy(F.col("score").desc(), "clip_id"))
    return met.withColumn("score", score).withColumn("place", place).where("place <= 3").select("media_id", "point_id", "clip_id", "place")


SCORED = "sc AS (SELECT media_id, clip_id AS id, start_us, end_us, (clip_id * 7919) % 1000 AS score FROM clips WHERE end_us > start_us)"


def scored(spark, d):
    return A.clips(spark, d).where("end_us > start_us").select("media_id", F.col("clip_id").alias("id"), "start_us", "end_us", ((F.col("clip_id") * 7919) % 1000).alias("score"))


def greedy_sql(clash: str) -> str:
    """The choice in order, as a recursion that carries what is kept."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, start_us, id) AS k FROM sc),
      g AS (SELECT media_id, k, [id] AS kept, [start_us] AS ks, [end_us] AS ke FROM o WHERE k = 1 UNION ALL
        SELECT o.media_id, o.k, CASE WHEN {clash} THEN kept ELSE list_append(kept, o.id) END, CASE WHEN {clash} THEN ks ELSE list_append(ks, o.start_us) END, CASE WHEN {clash} THEN ke ELSE list_append(ke, o.end_us) END FROM g JOIN o ON o.media_id = g.media_id AND o.k = g.k + 1),
      z AS (SELECT media_id, unnest(kept) AS id FROM g WHERE k = (SELECT max(k) FROM o WHERE o.media_id = g.media_id)) SELECT media_id, id FROM z"""


# One of a medium's picks for each 60 hours of its own.
@query("e18_spaced", A.sql("clips", f"{SCORED}, " + greedy_sql("len(list_filter(ks, lambda x: abs(x - o.start_us) < 7200000000)) > 0").replace("SELECT media_id, id FROM z", """, du AS (SELECT media_id, greatest(2, (max(end_us) - min(start_us)) // 216000000000) AS most FROM sc GROUP BY 1)
  SELECT media_id, id FROM (SELECT z.media_id, z.id, most, row_number() OVER (PARTITION BY z.media_id ORDER BY score DESC, start_us, z.id) AS n FROM z JOIN sc ON sc.media_id = z.media_id AND sc.id = z.id JOIN du ON du.media_id = z.media_id) WHERE n <= most""")))
def _(spark, d):
    rows = scored(spark, d)
    durations = rows.groupBy("media_id").agg((F.max("end_us") - F.min("start_us")).alias("duration_us"))
    return P.spaced(rows.withColumnRenamed("start_us", "t_us").drop("end_us"), 7_200_000_000, durations=durations, every_us=216_000_000_000).select("media_id", "id")


@query("h05_without_overlaps", A.sql("clips", f"{SCORED}, " + greedy_sql("len(list_filter(range(1, len(ks) + 1), lambda i: ks[i] < o.end_us AND ke[i] > o.start_us)) > 0")))
def _(spark, d):
    return P.without_overlaps(scored(spark, d)).select("media_id", "id")


# One step of the recursion looks at one segment of a medium's list.
@query("e06_absorb_short", A.sql("clips", f"""{union_sql('clips', 'u')}, g AS (SELECT media_id, list({{'a': start_us, 'b': end_us}} ORDER BY start_us) AS rs, 1::BIGINT AS i FROM u GROUP BY 1
    UNION ALL SELECT media_id, CASE how WHEN 'keep' THEN rs WHEN 'drop' THEN rs[1:i - 1] || rs[i + 1:] WHEN 'prev' THEN rs[1:i - 2] || [{{'a': rs[i - 1].a, 'b': greatest(rs[i - 1].b, r.b)}}] || rs[i + 1:] ELSE rs[1:i - 1] || [{{'a': least(rs[i + 1].a, r.a), 'b': rs[i + 1].b}}] || rs[i + 2:] END, CASE how WHEN 'keep' THEN i + 1 ELSE greatest(1, i - 1) END
    FROM (SELECT *, CASE WHEN r.b - r.a >= 3600000000 THEN 'keep' WHEN least(before, after) > 900000000 THEN 'drop' WHEN before <= after THEN 'prev' ELSE 'next' END AS how
      FROM (SELECT *, rs[i] AS r, CASE WHEN i > 1 THEN rs[i].a - rs[i - 1].b ELSE 1::BIGINT << 60 END AS before, CASE WHEN i < len(rs) THEN rs[i + 1].a - rs[i].b ELSE 1::BIGINT << 60 END AS after FROM g WHERE len(rs) > 1 AND i <= len(rs)))),
  z AS (SELECT media_id, unnest(rs) AS r FROM g WHERE len(rs) = 1 OR i > len(rs)) SELECT media_id, r.a AS start_us, r.b AS end_us FROM z"""))
def _(spark, d):
    return P.absorb_short(S.union(A.clips(spark, d)), 3_600_000_000, 900_000_000)


@query("e25_offered_duration", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 6 THEN 4 WHEN l_quantity <= 12 THEN 8 WHEN l_quantity <= 24 THEN 16 WHEN l_quantity <= 45 THEN 30 END AS offered, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = A.table(spark, d, "lineitem")
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey", P.offered_duration(F.col("l_quantity"), [4, 8, 16, 30], 1.5).alias("offered")).agg(F.count("*").alias("n"))


@query("e28_round_robin", A.sql("tracks", """n AS (SELECT media_id, label, id, row_number() OVER (PARTITION BY media_id, label ORDER BY start_us, id) - 1 AS k FROM tracks), s AS (SELECT n_nationkey AS sound, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place FROM nation),
  r AS (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region), l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT label FROM tracks)),
  m AS (SELECT s.*, label, count(*) OVER (PARTITION BY label) AS total FROM s JOIN r ON s.n_regionkey = r.r_regionkey JOIN l USING (i)) SELECT n.media_id, n.label, n.id, m.sound FROM n JOIN m ON m.label = n.label AND m.place = n.k % m.total"""))
def _(spark, d):
    labels = A.tracks(spark, d).select("label").distinct().withColumn("i", F.row_number().over(Window.orderBy("label")) - 1)
    regions = A.table(spark, d, "region").select("r_regionkey", (F.row_number().over(Window.orderBy("r_regionkey")) - 1).alias("i"))
    place = (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("long")
    sounds = A.table(spark, d, "nation").withColumn("place", place).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).join(labels, "i").select("label", "place", F.col("n_nationkey").alias("sound"))
    return P.round_robin(A.tracks(spark, d), sounds, "label", ["start_us", "id"], ["media_id"]).select("media_id", "label", "id", "sound")


@query("e32_reel", """WITH r AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) % 10000 AS n FROM customer) SELECT c_nationkey, c_custkey, CAST(coalesce(sum(n + 60) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_cs FROM r""")
def _(spark, d):
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = A.table(spark, d, "customer").withColumn("n", F.round(F.col("c_acctbal") * 100).cast("long") % 10_000)
    return rows.select("c_nationkey", "c_custkey", F.coalesce(F.sum(F.col("n") + 60).over(order), F.lit(0)).cast("long").alias("start_cs"))


@query("g05_airtime", A.sql("tracks", """b AS (SELECT media_id, label, (end_us - start_us) // 600000 AS n FROM tracks WHERE end_us > start_us), g AS (SELECT media_id, label, CAST(sum(n) AS BIGINT) AS airtime, count(*) AS shots, median(n) AS middle FROM b GROUP BY 1, 2)
  SELECT media_id, label, airtime, shots, middle, round(airtime / sum(airtime) OVER (PARTITION BY media_id), 6) AS share FROM g"""))
def _(spark, d):
    b = A.tracks(spark, d).where("end_us > start_us").withColumn("n", F.floor((F.col("end_us") - F.col("start_us")) / 600_000))
    g = b.groupBy("media_id", "label").agg(F.sum("n").alias("airtime"), F.count("*").alias("shots"), F.median("n").alias("middle"))
    return g.withColumn("share", F.round(F.col("airtime") / F.sum("airtime").over(Window.partitionBy("media_id")), 6))


DAY = 86_400_000_000


@query("g07_union_density", A.sql("clips", f"""{union_sql('clips', 'u')}, b AS (SELECT media_id, start_us, end_us, unnest(range(start_us // {DAY}, (end_us - 1) // {DAY} + 1)) AS w FROM u)
  SELECT media_id, w AS window_id, CAST(sum(least(end_us, (w + 1) * {DAY}) - greatest(start_us, w * {DAY})) AS BIGINT) AS speech_us FROM b GROUP BY 1, 2"""))
def _(spark, d):
    u = S.union(A.clips(spark, d)).withColumn("window_id", F.explode(F.sequence(F.floor(F.col("start_us") / DAY), F.floor((F.col("end_us") - 1) / DAY))))
    return u.groupBy("media_id", "window_id").agg(F.sum(F.least("end_us", (F.col("window_id") + 1) * DAY) - F.greatest("start_us", F.col("window_id") * DAY)).alias("speech_us"))


@query("g08_blocks", A.sql("timed", "v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, (end_us - start_us) // 600000 - 2000 AS x FROM timed) SELECT user_id, pos // 16 AS block, max(abs(x)) AS peak, CAST(sum(x * x) AS BIGINT) // 16 AS mean_square FROM v GROUP BY 1, 2"))
def _(spark, d):
    t = A._timed(spark, d).withColumn("pos", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    v = t.select("user_id", F.floor(F.col("pos") / 16).alias("block"), (F.floor((F.col("end_us") - F.col("start_us")) / 600_000) - 2000).alias("x"))
    return v.groupBy("user_id", "block").agg(F.max(F.abs("x")).alias("peak"), F.expr("sum(x * x) div 16").alias("mean_square"))


@query("g11_signal", A.sql("timed", """v AS (SELECT user_id, event_id, (end_us - start_us) // 600000 AS x FROM timed), l AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM v)
  SELECT user_id, max(x) AS peak, count(*) FILTER (x >= 9990) AS clipped, count(*) FILTER (abs(x - p) >= 9500) AS jumps FROM l GROUP BY 1"""))
def _(spark, d):
    x = F.floor((F.col("end_us") - F.col("start_us")) / 600_000)
    v = A._timed(spark, d).withColumn("x", x).withColumn("p", F.lag("x").over(Window.partitionBy("user_id").orderBy("event_id")))
    return v.groupBy("user_id").agg(F.max("x").alias("peak"), F.count_if(F.col("x") >= 9990).alias("clipped"), F.count_if(F.abs(F.col("x") - F.col("p")) >= 9500).alias("jumps"))


@query("g12_discontinuities", A.sql("timed", "p AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN end_us END AS t FROM timed), l AS (SELECT *, lag(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM p) SELECT user_id, count(*) FILTER (t < prior - 500000) AS n FROM l GROUP BY 1"))
def _(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    p = A._timed(spark, d).withColumn("t", F.when(F.col("event_type") != "error", F.col("end_us")))
    return p.withColumn("prior", F.last("t", ignorenulls=True).over(order)).groupBy("user_id").agg(F.count_if(F.col("t") < F.col("prior") - 500_000).alias("n"))


@query("g19_percentile", A.sql("tracks", "r AS (SELECT media_id, end_us - start_us AS n, row_number() OVER (PARTITION BY media_id ORDER BY end_us - start_us) - 1 AS k, count(*) OVER (PARTITION BY media_id) AS total FROM tracks) SELECT media_id, any_value(n) AS p90 FROM r WHERE k = round_even((total - 1) * 0.9, 0) GROUP BY 1"))
def _(spark, d):
    sizes = A.tracks(spark, d).groupBy("media_id").agg(F.array_sort(F.collect_list(F.col("end_us") - F.col("start_us"))).alias("a"))
    return sizes.select("media_id", F.element_at("a", (F.bround((F.size("a") - 1) * F.lit(0.9)) + 1).cast("int")).alias("p90"))


@query("j02_mean", A.sql("keyframes", "e AS (SELECT media_id, label, unnest(v) AS x, unnest(range(len(v))) AS place FROM keyframes), s AS (SELECT media_id, label, place, CAST(sum(x) AS BIGINT) AS x FROM e GROUP BY 1, 2, 3) SELECT media_id, label, array_to_string(list(x ORDER BY place), ',') AS v FROM s GROUP BY 1, 2"))
def _(spark, d):
    return V.sums(A.keyframes(spark, d), ["media_id", "label"]).select("media_id", "label", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


SCORES = "e AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS place FROM keyframes), m AS (SELECT label, place, CAST(sum(x) AS BIGINT) AS x FROM e GROUP BY 1, 2), p AS (SELECT label, list(x ORDER BY place) AS v FROM m GROUP BY 1)"


def profiled(spark, d):
    frames = A.keyframes(spark, d)
    return V.scores(frames, V.sums(frames, ["label"]), ["label"])


@query("j04_scores", A.sql("keyframes", f"{SCORES} SELECT k.idx, k.label, CAST(list_inner_product(CAST(k.v AS DOUBLE[]), CAST(p.v AS DOUBLE[])) AS BIGINT) AS score FROM keyframes k JOIN p USING (label)"))
def _(spark, d):
    return profiled(spark, d).select("idx", "label", "score")


@query("j05_leave_one_out", A.sql("keyframes", f"{SCORES} SELECT k.idx, k.label, CAST(list_inner_product(CAST(k.v AS DOUBLE[]), CAST(p.v AS DOUBLE[])) - list_inner_product(CAST(k.v AS DOUBLE[]), CAST(k.v AS DOUBLE[])) AS BIGINT) AS score FROM keyframes k JOIN p USING (label)"))
def _(spark, d):
    return profiled(spark, d).select("idx", "label", (F.col("score") - V.dot("v", "v")).alias("score"))


CALIBRATED = """sc AS (SELECT media_id, v[1] AS score, label < 5 AS positive FROM keyframes), ds AS (SELECT media_id, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM sc GROUP BY 1, 2),
  c AS (SELECT media_id, score, lead(score) OVER w AS nx, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS lp, sum(q) OVER (w ROWS UNBOUNDED PRECEDING) AS lq, sum(p) OVER (PARTITION BY media_id) AS ap, sum(q) OVER (PARTITION BY media_id) AS aq FROM ds WINDOW w AS (PARTITION BY media_id ORDER BY score)),
  b AS (SELECT media_id, score + nx AS twice, CAST((ap - lp) * aq + lq * ap AS BIGINT) AS good FROM c WHERE nx IS NOT NULL AND ap > 0 AND aq > 0), t AS (SELECT *, max(good) OVER (PARTITION BY media_id) AS top FROM b),
  r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY twice) AS k, count(*) OVER (PARTITION BY media_id) AS n FROM t WHERE good = top) SELECT media_id, twice, good FROM r WHERE k = n // 2 + 1"""


@query("j06_calibrate", A.sql("keyframes", CALIBRATED))
def _(spark, d):
    rows = A.keyframes(spark, d).select("media_id", F.col("v")[0].alias("score"), (F.col("label") < 5).alias("positive"))
    return V.calibrate(rows, ["media_id"])


@query("j11_clusters")
def _(spark, d):
    return V.cluster(A.keyframes(spark, d), 900.0)


# Vectors as tables of (row, place, x), so that lengths and means are plain sums.
FLAT = "e AS (SELECT media_id, idx, label, unnest(v)::DOUBLE AS x, unnest(range(len(v))) AS place FROM keyframes), l AS (SELECT idx, sqrt(sum(x * x)) AS len FROM e GROUP BY 1), u AS (SELECT e.*, CASE WHEN len > 0 THEN x / len ELSE x END AS y FROM e JOIN l USING (idx))"
SIX = "round({}, 6) AS score"


@query("j02_mean_direction", A.sql("keyframes", f"{FLAT}, s AS (SELECT media_id, label, place, sum(x) AS x FROM e GROUP BY ALL) SELECT media_id, label, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY media_id, label)), 6) AS x FROM s"))
def _(spark, d):
    m = V.mean_unit(A.keyframes(spark, d), ["media_id", "label"])
    return m.select("media_id", "label", F.posexplode("v").alias("place", "x")).select("media_id", "label", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


# Spans of five frames of 70 ms; the last one of a medium may be too short.
@query("j03_span_direction", A.sql("keyframes", f"{FLAT}, s AS (SELECT media_id, idx % 64 // 5 AS span, place, sum(y) AS x, count(*) AS n, max(idx % 64) - min(idx % 64) + 1 AS frames FROM u GROUP BY ALL) SELECT media_id, span, place, n, CASE WHEN frames * 70000 >= 300000 THEN round(x / sqrt(sum(x * x) OVER (PARTITION BY media_id, span)), 6) END AS x FROM s"))
def _(spark, d):
    at = F.col("idx") % 64
    rows = A.keyframes(spark, d).select("media_id", F.floor(at / 5).alias("span"), (at * 70_000).alias("start_us"), ((at + 1) * 70_000).alias("end_us"), "v")
    out = V.span_embeddings(rows, ["media_id", "span"])
    out = out.select("media_id", "span", "n", F.posexplode(F.coalesce("v", F.array_repeat(F.lit(None).cast("double"), 64))).alias("place", "x"))
    return out.select("media_id", "span", F.col("place").cast("long").alias("place"), "n", F.round("x", 6).alias("x"))


@query("j04_cosines", A.sql("keyframes", f"{FLAT}, s AS (SELECT label, place, sum(x) AS x FROM e GROUP BY ALL), p AS (SELECT label, place, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM s) SELECT idx, u.label, {SIX.format('sum(y * p.x)')} FROM u JOIN p USING (label, place) GROUP BY idx, u.label"))
def _(spark, d):
    frames = A.keyframes(spark, d)
    return V.cosines(frames, V.sums(frames, ["label"]), ["label"]).select("idx", "label", F.round("score", 6).alias("score"))


@query("j05_without_own", A.sql("keyframes", f"{FLAT}, s AS (SELECT label, place, sum(y) AS x, count(*) AS n FROM u GROUP BY ALL), o AS (SELECT idx, u.label, n, y, s.x - y AS rest FROM u JOIN s USING (label, place)) SELECT idx, label, CASE WHEN max(n) > 1 THEN round(sum(y * rest) / sqrt(sum(rest * rest)), 6) END AS score FROM o GROUP BY 1, 2"))
def _(spark, d):
    return V.without_own(A.keyframes(spark, d), ["label"]).select("idx", "label", F.round("score", 6).alias("score"))


CENTRES = f"{FLAT}, c AS (SELECT media_id, label AS centre, place, avg(x) AS x FROM e GROUP BY ALL)"


@query("j12_nearest_centre", A.sql("keyframes", f"{CENTRES}, d AS (SELECT e.media_id, idx, centre, sqrt(sum((e.x - c.x) * (e.x - c.x))) AS distance FROM e JOIN c ON c.media_id = e.media_id AND c.place = e.place GROUP BY ALL) SELECT media_id, idx, centre, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY idx ORDER BY distance, centre) = 1"))
def _(spark, d):
    frames = A.keyframes(spark, d)
    centres = V.sums(frames, ["media_id", "label"]).select("media_id", F.col("label").alias("centre"), F.transform("v", lambda x: x / F.col("n")).alias("v"))
    return V.nearest_centre(frames, centres, ["media_id"]).withColumn("distance", F.round("distance", 6))


@query("j13_renumber", A.sql("tracks", "g AS (SELECT media_id, label, CAST(sum((end_us - start_us) // 600000) AS BIGINT) AS airtime FROM tracks GROUP BY 1, 2) SELECT media_id, label, CAST(row_number() OVER (PARTITION BY media_id ORDER BY airtime DESC, label) - 1 AS INTEGER) AS group_id FROM g"))
def _(spark, d):
    g = A.tracks(spark, d).groupBy("media_id", "label").agg(F.sum(F.floor((F.col("end_us") - F.col("start_us")) / 600_000)).alias("airtime"))
    return g.select("media_id", "label", (F.row_number().over(Window.partitionBy("media_id").orderBy(F.col("airtime").desc(), "label")) - 1).alias("group_id"))


@query("j14_medoid", A.sql("keyframes", f"{CENTRES}, d AS (SELECT e.media_id, e.label, idx, sqrt(sum((e.x - c.x) * (e.x - c.x))) AS distance FROM e JOIN c ON c.media_id = e.media_id AND c.centre = e.label AND c.place = e.place GROUP BY ALL) SELECT media_id, label, idx, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY media_id, label ORDER BY round(distance, 9), idx) = 1"))
def _(spark, d):
    return V.medoids(A.keyframes(spark, d), ["media_id", "label"]).withColumn("distance", F.round("distance", 6))


@query("j15_airtime", A.sql("points", "SELECT media_id, point_id, coalesce(lead(t_us) OVER (PARTITION BY media_id ORDER BY t_us, point_id), (SELECT max(t_us) FROM points q WHERE q.media_id = p.media_id) + 1000000) - t_us AS airtime_us FROM points p"))
def _(spark, d):
    order = Window.partitionBy("media_id").orderBy("t_us", "point_id")
    last = F.max("t_us").over(Window.partitionBy("media_id")) + 1_000_000
    return A.points(spark, d).select("media_id", "point_id", (F.coalesce(F.lead("t_us").over(order), last) - F.col("t_us")).alias("airtime_us"))


@query("a09_clip_key", "SELECT o_orderkey, o_orderkey % 9 || ':' || (o_orderkey // 4) || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END || ':' || (o_orderkey + 60) || ':fast' AS k FROM orders")
def _(spark, d):
    o = F.col("o_orderkey")
    return A.table(spark, d, "orders").select("o_orderkey", T.clip_key(o % 9, o / 4, o + 60, F.lit("fast")).alias("k"))


@query("k12_start_safe", A.sql("tracks clips points", """w AS (SELECT * FROM tracks WHERE label = 'purchase' AND end_us > start_us), e AS (SELECT media_id, clip_id, start_us AS t FROM clips)
  SELECT e.media_id, e.clip_id, count(w.id) = 0 AS safe FROM e LEFT JOIN w ON w.media_id = e.media_id AND e.t > w.start_us + 15000 AND e.t < w.end_us - 15000 GROUP BY 1, 2"""))
def _(spark, d):
    dot = A.clips(spark, d).select("media_id", "clip_id", F.col("start_us").alias("right_start_us"), (F.col("start_us") + 1).alias("right_end_us"))
    met = S.overlap_join(A.tracks(spark, d).where("label = 'purchase'"), dot, HOURS)
    cut = met.where((F.col("right_start_us") > F.col("start_us") + 15_000) & (F.col("right_start_us") < F.col("end_us") - 15_000)).select("media_id", "clip_id").distinct().withColumn("cut", F.lit(True))
    return A.clips(spark, d).select("media_id", "clip_id").join(cut, ["media_id", "clip_id"], "left").select("media_id", "clip_id", F.col("cut").isNull().alias("safe"))
