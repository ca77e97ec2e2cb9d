"""Queries on edits, with their SQL where a plain statement exists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.operators import edits as E
from mediaspan.operators import spans as S
from mediaspan.operators import words as W
from mediaspan.plans.span_queries import HOURS, union_sql
from mediaspan.plans.word_queries import fold_sql
from mediaspan.sources import adapters as A
from mediaspan.sources.scratch import kept

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: Units as the recursion of d02_units finds them, then the ranges of each clip folded in order of place.
PIECES = A.sql("words", fold_sql("unit", "", "CAST(0 AS BIGINT) AS part, start_us AS begun, end_us - start_us >= 8000000 OR regexp_matches(word, '[.!?…,;:]$') AND end_us - start_us >= 1200000 AS done",
  """CASE WHEN done OR n.start_us - n.prior_end >= 600000 THEN part + 1 ELSE part END, CASE WHEN done OR n.start_us - n.prior_end >= 600000 THEN n.start_us ELSE begun END,
  n.end_us - CASE WHEN done OR n.start_us - n.prior_end >= 600000 THEN n.start_us ELSE begun END >= 8000000 OR regexp_matches(n.word, '[.!?…,;:]$') AND n.end_us - CASE WHEN done OR n.start_us - n.prior_end >= 600000 THEN n.start_us ELSE begun END >= 1200000""")
  .replace("SELECT f.part AS unit", ", un AS (SELECT f.part AS unit") + """), rg AS (SELECT media_id, unit // 12 AS clip_id, unit AS a, unit + n_words % 3 AS b FROM un WHERE n_words > 3),
  kn AS (SELECT rg.*, row_number() OVER (PARTITION BY rg.media_id, clip_id ORDER BY a) AS k FROM rg WHERE EXISTS (SELECT 1 FROM un WHERE un.media_id = rg.media_id AND un.unit = rg.b)),
  fo AS (SELECT media_id, clip_id, k, [{'a': a, 'b': b}] AS ps FROM kn WHERE k = 1 UNION ALL SELECT n.media_id, n.clip_id, n.k, CASE WHEN n.a <= ps[-1].b THEN ps WHEN n.a = ps[-1].b + 1 THEN list_append(ps[:-2], {'a': ps[-1].a, 'b': n.b}) ELSE list_append(ps, {'a': n.a, 'b': n.b}) END FROM fo JOIN kn n ON n.media_id = fo.media_id AND n.clip_id = fo.clip_id AND n.k = fo.k + 1),
  la AS (SELECT *, unnest(range(len(ps))) AS piece FROM fo QUALIFY row_number() OVER (PARTITION BY media_id, clip_id ORDER BY k DESC) = 1)
  SELECT la.media_id, clip_id, piece, ps[piece + 1].a AS from_id, ps[piece + 1].b AS to_id, x.start_us, y.end_us FROM la JOIN un x ON x.media_id = la.media_id AND x.unit = ps[piece + 1].a JOIN un y ON y.media_id = la.media_id AND y.unit = ps[piece + 1].b WHERE y.end_us - x.start_us >= 600000""")


@query("d06_pieces", PIECES)
def _(spark, d):
    units = kept(W.selection_units(A.words(spark, d)))
    pos = F.row_number().over(Window.partitionBy("media_id").orderBy("unit"))
    pick = units.where("n_words > 3").withColumn("pos", pos)
    ranges = pick.select("media_id", F.floor(F.col("unit") / 12).alias("clip_id"), F.col("pos").cast("long").alias("pos"), F.col("unit").alias("from_id"), (F.col("unit") + F.col("n_words") % 3).alias("to_id"))
    return E.resolve_pieces(ranges, units)


@query("d12_cut_timings", A.sql("turns", """b AS (SELECT media_id, pos, start_us AS fs, start_us + 400000 + (pos % 3) * 150000 AS fe, end_us AS le, speaker = 'system' AS silent FROM turns), n AS (SELECT media_id, max(le) AS narration FROM b WHERE NOT silent GROUP BY 1),
  s AS (SELECT b.media_id, b.pos, narration, CASE WHEN lag(le) OVER w IS NULL THEN 0 ELSE greatest(lag(le) OVER w + 50000, CASE WHEN fe - fs > 600000 THEN fe - 350000 ELSE fs END - 200000) + 800000 END AS start_us FROM b JOIN n USING (media_id) WHERE NOT silent WINDOW w AS (PARTITION BY b.media_id ORDER BY pos))
  SELECT media_id, pos AS beat, start_us, coalesce(lead(start_us) OVER (PARTITION BY media_id ORDER BY pos), narration + 1500000) - start_us AS duration_us FROM s
  UNION ALL SELECT media_id, pos, narration + 1500000 + CAST(coalesce(sum(le - fs) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT), le - fs FROM b JOIN n USING (media_id) WHERE silent"""))
def _(spark, d):
    t, silent = A.turns(spark, d), F.col("speaker") == "system"
    beats = t.select("media_id", F.col("pos").alias("beat"), F.col("start_us").alias("first_start_us"), (F.col("start_us") + 400_000 + (F.col("pos") % 3) * 150_000).alias("first_end_us"), F.col("end_us").alias("last_end_us"), F.when(silent, F.col("end_us") - F.col("start_us")).alias("hold_us"))
    ends = beats.where("hold_us IS NULL").groupBy("media_id").agg(F.max("last_end_us").alias("narration_us"))
    return E.cut_timings(beats, ends, 800_000)


TOLERANCE = 600_000_000


@query("e10_snap", A.sql("tracks clips points", f"""g AS (SELECT media_id, clip_id AS id, start_us, end_us FROM clips WHERE end_us > start_us), w AS (SELECT media_id, greatest(start_us - 15000, 0) AS a, end_us + 15000 AS b FROM tracks WHERE label = 'purchase' AND end_us + 15001 > greatest(start_us - 15000, 0)),
  n AS (SELECT g.*, (SELECT p.t_us FROM points p WHERE p.media_id = g.media_id AND abs(p.t_us - g.start_us) <= {TOLERANCE} ORDER BY abs(p.t_us - g.start_us), p.t_us LIMIT 1) AS ns, (SELECT p.t_us FROM points p WHERE p.media_id = g.media_id AND abs(p.t_us - g.end_us) <= {TOLERANCE} ORDER BY abs(p.t_us - g.end_us), p.t_us LIMIT 1) AS ne FROM g),
  o AS (SELECT n.*, EXISTS (SELECT 1 FROM w WHERE w.media_id = n.media_id AND ns BETWEEN a AND b) AS bs, EXISTS (SELECT 1 FROM w WHERE w.media_id = n.media_id AND ne BETWEEN a AND b) AS be FROM n),
  m AS (SELECT *, CASE WHEN ns IS NOT NULL AND NOT bs AND ns <= end_us - 200000 THEN ns ELSE start_us END AS s FROM o) SELECT media_id, id, s AS start_us, CASE WHEN ne IS NOT NULL AND NOT be AND ne >= s + 200000 THEN ne ELSE end_us END AS end_us FROM m"""))
def _(spark, d):
    segs = A.clips(spark, d).where("end_us > start_us").select("media_id", F.col("clip_id").alias("id"), "start_us", "end_us")
    return E.snap_to_cuts(segs, A.points(spark, d), A.tracks(spark, d).where("label = 'purchase'"), TOLERANCE, HOURS)


def _segments(spark, d):
    order = Window.partitionBy("media_id").orderBy("start_us")
    return S.union(A.clips(spark, d)).withColumn("id", F.row_number().over(order).cast("long"))


@query("e07_remove_spans", A.sql("tracks clips", f"""{union_sql('clips', 'u')}, sg AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us) AS id FROM u),
  c AS (SELECT s.media_id, s.id, s.end_us, x.start_us AS a, x.end_us AS b, row_number() OVER (PARTITION BY s.media_id, s.id ORDER BY x.start_us, x.end_us) AS k FROM sg s JOIN tracks x ON x.media_id = s.media_id AND x.label = 'error' AND x.end_us > x.start_us AND x.start_us > s.start_us AND x.end_us < s.end_us),
  g AS (SELECT media_id, id, 0::BIGINT AS k, start_us AS cur, []::STRUCT(a BIGINT, b BIGINT)[] AS ps FROM sg UNION ALL SELECT media_id, id, k, CASE WHEN y THEN b ELSE cur END, CASE WHEN y THEN list_append(ps, {{'a': cur, 'b': a}}) ELSE ps END
    FROM (SELECT c.*, cur, ps, c.b - c.a >= 20000 AND c.a - cur >= 60000000 AND c.end_us - c.b >= 60000000 AS y FROM g JOIN c ON c.media_id = g.media_id AND c.id = g.id AND c.k = g.k + 1)),
  l AS (SELECT g.media_id, g.id, list_append(ps, {{'a': cur, 'b': sg.end_us}}) AS ps FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY media_id, id ORDER BY k DESC) = 1) g JOIN sg ON sg.media_id = g.media_id AND sg.id = g.id)
  SELECT media_id, id, part, ps[part + 1].a AS start_us, ps[part + 1].b AS end_us FROM (SELECT *, unnest(range(len(ps))) AS part FROM l)"""))
def _(spark, d):
    cuts = A.tracks(spark, d).where("label = 'error' AND end_us > start_us").select("media_id", F.col("start_us").alias("cut_from"), F.col("end_us").alias("cut_to"))
    return E.remove_spans(_segments(spark, d), cuts, HOURS, 60_000_000)


@query("e09_sound_offsets")
def _(spark, d):
    frames = A.tracks(spark, d).where("label <> 'click'").select("media_id", F.col("start_us").alias("t_us"), ((F.col("id") * 7919) % 1000 * 1000).alias("level"))
    return E.sound_offsets(_segments(spark, d), frames, A.decisions(spark, d).where("end_us > start_us"), 1_800_000_000)


@query("b35_place_inserts", A.sql("clips points", f"""{union_sql('clips', 'u')}, sg AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us) AS host FROM u),
  h AS (SELECT p.media_id, p.point_id AS id, p.t_us, min(host) AS host, arg_min(sg.end_us, host) AS b FROM points p LEFT JOIN sg ON sg.media_id = p.media_id AND greatest(sg.start_us - 1000, 0) <= p.t_us AND p.t_us < sg.end_us AND (sg.end_us - p.t_us >= 499000 OR p.t_us + 900000000 <= sg.end_us + 1000) GROUP BY 1, 2, 3),
  r AS (SELECT *, coalesce(least(900000000, b - t_us), 900000000) AS n, row_number() OVER (PARTITION BY media_id ORDER BY id) AS k FROM h),
  g AS (SELECT media_id, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::VARCHAR AS state, []::STRUCT(h BIGINT, a BIGINT, b BIGINT)[] AS taken FROM r WHERE k = 1 UNION ALL SELECT media_id, k, id, state, CASE WHEN state = 'applied' THEN list_append(taken, {{'h': host, 'a': t_us, 'b': t_us + n}}) ELSE taken END
    FROM (SELECT r.*, taken, CASE WHEN host IS NULL THEN 'outside' WHEN len(list_filter(taken, lambda x: x.h = r.host AND r.t_us < x.b AND x.a < r.t_us + r.n)) > 0 THEN 'overlaps' ELSE 'applied' END AS state FROM g JOIN r ON r.media_id = g.media_id AND r.k = g.k + 1))
  SELECT r.media_id, r.id, t_us, coalesce(host, -1) AS host, n AS length_us, state FROM r JOIN g ON g.media_id = r.media_id AND g.k = r.k"""))
def _(spark, d):
    inserts = A.points(spark, d).select("media_id", F.col("point_id").alias("id"), "t_us", F.lit(900_000_000).cast("long").alias("length_us"))
    return E.place_inserts(inserts, _segments(spark, d).withColumnRenamed("id", "host"), HOURS)


@query("d14_keep_ratio", A.sql("clips decisions", f"""{union_sql('clips', 'u')}, k AS (SELECT media_id, CAST(sum(end_us - start_us) AS BIGINT) AS kept FROM u WHERE start_us % 3 <> 0 GROUP BY 1), a AS (SELECT media_id, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM u GROUP BY 1),
  s AS (SELECT media_id, coalesce(kept, 0) * 1000000 // us AS share FROM a LEFT JOIN k USING (media_id)) SELECT media_id, share, CASE WHEN share > 950000 THEN 'skip' WHEN share < 300000 THEN 'reject' ELSE 'accept' END AS verdict FROM s"""))
def _(spark, d):
    u = S.union(A.clips(spark, d)).withColumn("us", (F.col("end_us") - F.col("start_us")).cast("decimal(38,0)"))
    whole, kept = u.groupBy("media_id").agg(F.sum("us").alias("us")), u.where("start_us % 3 <> 0").groupBy("media_id").agg(F.sum("us").alias("us"))
    return E.keep_ratio(kept, whole, ["media_id"])
