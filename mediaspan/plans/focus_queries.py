"""Queries on scenes' samples and crops, with their SQL where a plain statement exists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.operators import focus, plan
from mediaspan.sources import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _sample_times(spark, d):
    """Forty clip numbers are a scene; even ones begin and every third ends at a cut."""
    rows = A.clips(spark, d).withColumn("scene", F.floor(F.col("clip_id") / 40))
    whole = Window.partitionBy("scene")
    spans = rows.select(
        "scene", F.min("start_us").over(whole).alias("scene_start_us"), F.max("end_us").over(whole).alias("scene_end_us"), (F.col("scene") % 2 == 0).alias("start_is_cut"), (F.col("scene") % 3 == 0).alias("end_is_cut"),
        F.row_number().over(whole.orderBy("start_us", "clip_id")).alias("pos"), "start_us", "end_us",
    )
    return focus.sample_times(spans)


def _focus(spark, d):
    """Four embeddings are a scene's faces, their components the boxes."""
    v = lambda k, n: F.pmod(F.col("v")[k], F.lit(n))
    rows = A.keyframes(spark, d).withColumn("scene", F.floor(F.col("idx") / 4))
    faces = rows.select("scene", ((500 + v(0, 500)) / 1000).alias("score"), (v(1, 800) / 1000).alias("x"), ((50 + v(2, 150)) / 1000).alias("width"), (v(3, 400) / 1000).alias("height"))
    side = F.when(F.col("scene") % 3 == 0, "left").when(F.col("scene") % 3 == 1, "right")
    scenes = rows.select("scene").distinct().select("scene", F.lit(0.5625).alias("crop_width"), F.lit(0.5).alias("manual_x"), side.alias("side"))
    return focus.focus(scenes, faces)


def _kind_plan(spark, d):
    """Forty event numbers are a clip: clicks its slots, every fourth purchase or error their footage."""
    rows = A.tracks(spark, d).withColumn("clip_id", F.floor(F.col("id") / 40))
    slots = rows.where("label = 'click'").select("clip_id", F.col("id").alias("slot"), F.col("start_us").alias("anchor_us"), F.lit(2_000_000).cast("long").alias("duration_us"), (F.col("id") % 40 * 8_000_000).alias("output_us"))
    footage = rows.where("label IN ('purchase', 'error')").select("clip_id", "id", F.when(F.col("id") % 3 == 0, "wide").otherwise("reaction").alias("kind"), F.col("start_us").alias("source_us"), (F.col("id") * 7 % 100).cast("double").alias("score"))
    offers = slots.select("clip_id", "slot").join(footage, "clip_id").where((F.col("id") + F.col("slot")) % 4 == 0)
    return plan.kind_plan(slots, offers.select("clip_id", "slot", "kind", "source_us", "score"))


QUERIES["e19_kind_plan"] = _kind_plan
QUERIES["e21_sample_times"] = _sample_times
QUERIES["j17_focus"] = _focus
SQL["e21_sample_times"] = A.sql("clips", """s AS (SELECT clip_id // 40 AS scene, start_us, end_us, row_number() OVER (PARTITION BY clip_id // 40 ORDER BY start_us, clip_id) - 1 AS pos FROM clips),
  b AS (SELECT scene, min(start_us) AS a, max(end_us) AS z, count(*) - 1 AS last, min(start_us) + CASE WHEN scene % 2 = 0 THEN 200000 ELSE 0 END AS low, max(end_us) - CASE WHEN scene % 3 = 0 THEN 200000 ELSE 0 END AS high FROM s GROUP BY scene),
  r AS (SELECT * FROM s JOIN b USING (scene) WHERE low < high),
  m AS (SELECT DISTINCT scene, (least(greatest((start_us + end_us) // 2, low), high) + 500) // 1000 * 1000 AS t_us FROM r WHERE last < 3 OR pos IN (0, last, last // 2 + CASE WHEN last % 2 = 1 THEN last // 2 % 2 ELSE 0 END)),
  q AS (SELECT scene, pos, end_us - start_us AS n, k, (least(greatest(start_us + (end_us - start_us) * k // 4, low), high) + 500) // 1000 * 1000 AS t_us FROM r, (VALUES (1), (3)) x(k) WHERE end_us - start_us >= 1500000),
  o AS (SELECT scene, t_us, row_number() OVER (PARTITION BY scene ORDER BY n DESC, pos, k) AS place FROM q),
  u AS (SELECT scene, t_us, row_number() OVER (PARTITION BY scene ORDER BY min(place)) AS place FROM o ANTI JOIN m USING (scene, t_us) GROUP BY scene, t_us),
  h AS (SELECT scene, count(*) AS n FROM m GROUP BY scene)
  SELECT scene, t_us FROM m UNION ALL SELECT scene, t_us FROM u JOIN h USING (scene) WHERE place <= 3 - n UNION ALL SELECT scene, ((a + z) // 2 + 500) // 1000 * 1000 FROM b WHERE low >= high""")
# The choice slot by slot, as a recursion that carries the spans and the kinds shown so far.
SQL["e19_kind_plan"] = A.sql("tracks", """r AS (SELECT *, id // 40 AS clip_id FROM tracks), sl AS (SELECT clip_id, id AS slot, start_us AS anchor, row_number() OVER (PARTITION BY clip_id ORDER BY id % 40 * 8000000, id) AS k, count(*) OVER (PARTITION BY clip_id) AS n FROM r WHERE label = 'click'),
  ft AS (SELECT clip_id, id, CASE WHEN id % 3 = 0 THEN 'wide' ELSE 'reaction' END AS kind, start_us AS source_us, (id * 7 % 100)::DOUBLE AS score FROM r WHERE label IN ('purchase', 'error')),
  of AS (SELECT sl.clip_id, slot, list({'s': source_us, 'v': score} ORDER BY score DESC, source_us) FILTER (kind = 'wide') AS w, list({'s': source_us, 'v': score} ORDER BY score DESC, source_us) FILTER (kind = 'reaction') AS c FROM sl JOIN ft ON ft.clip_id = sl.clip_id AND (ft.id + slot) % 4 = 0 GROUP BY 1, 2),
  s AS (SELECT sl.*, coalesce(w, []) AS w, coalesce(c, []) AS c FROM sl LEFT JOIN of ON of.clip_id = sl.clip_id AND of.slot = sl.slot),
  g AS (SELECT DISTINCT clip_id, 0::BIGINT AS k, NULL::BIGINT AS slot, []::STRUCT(a BIGINT, b BIGINT)[] AS used, false AS sw, false AS sc, NULL::VARCHAR AS kind, []::STRUCT(s BIGINT, v DOUBLE)[] AS own, []::STRUCT(s BIGINT, v DOUBLE)[] AS other FROM s
    UNION ALL SELECT clip_id, k, slot, CASE WHEN kind IS NOT NULL AND abs(own[1].s - anchor) >= 1000 THEN list_append(used, {'a': own[1].s - 500000, 'b': own[1].s + 2500000}) ELSE used END, sw OR coalesce(kind = 'wide', false), sc OR coalesce(kind = 'reaction', false), kind, own, other
    FROM (SELECT *, CASE kind WHEN 'wide' THEN fw ELSE fc END AS own, CASE kind WHEN 'wide' THEN fc ELSE fw END AS other
      FROM (SELECT *, CASE WHEN len(fw) = 0 AND len(fc) = 0 THEN NULL WHEN len(fw) = 0 THEN 'reaction' WHEN len(fc) = 0 THEN 'wide' ELSE first_kind END AS kind
        FROM (SELECT *, CASE WHEN n - k + 1 <= lw::INT + lc::INT AND NOT CASE wish WHEN 'wide' THEN lw ELSE lc END THEN CASE WHEN lc THEN 'reaction' ELSE 'wide' END ELSE wish END AS first_kind
          FROM (SELECT *, len(fw) > 0 AND NOT sw AS lw, len(fc) > 0 AND NOT sc AS lc, CASE WHEN n > 1 AND (k - 1) % 3 = 0 THEN 'wide' ELSE 'reaction' END AS wish
            FROM (SELECT s.clip_id, s.k, s.slot, s.anchor, s.n, g.used, g.sw, g.sc, list_filter(s.w, lambda o: len(list_filter(g.used, lambda u: o.s < u.b AND o.s + 2000000 > u.a)) = 0) AS fw, list_filter(s.c, lambda o: len(list_filter(g.used, lambda u: o.s < u.b AND o.s + 2000000 > u.a)) = 0) AS fc
              FROM g JOIN s ON s.clip_id = g.clip_id AND s.k = g.k + 1)))))),
  h AS (SELECT clip_id, slot, kind, CASE kind WHEN 'wide' THEN 'reaction' ELSE 'wide' END AS second, own[1:3] AS own, other[1:1] AS other FROM g WHERE kind IS NOT NULL)
  SELECT clip_id, slot, CAST(i - 1 AS BIGINT) AS place, CASE WHEN i <= len(own) THEN kind ELSE second END AS kind, list_concat(own, other)[i].s AS source_us, list_concat(own, other)[i].v AS score FROM h, LATERAL (SELECT unnest(range(1, len(own) + len(other) + 1)) AS i)""")
