"""Queries of the evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaspan.operators import evaluate as V
from mediaspan.plans.span_queries import HOURS
from mediaspan.sources import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}
BOUNDS = (1_500_000_000, 18_000_000_000)
DAY = 86_400_000_000


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


# Words are known of two media in three, voice of all but every sixth one.
EVIDENCE = "dur AS (SELECT media_id, max(end_us) - 7200000000 AS duration_us FROM tracks GROUP BY 1), wd AS (SELECT media_id, start_us, end_us FROM tracks WHERE label = 'purchase' AND media_id % 3 <> 0), vo AS (SELECT media_id, start_us, end_us FROM tracks WHERE label = 'view' AND media_id % 6 <> 0)"
SAFETY = f"""{EVIDENCE}, ck AS (SELECT c.*, coalesce(c.start_us >= 0 AND c.end_us > c.start_us AND c.end_us <= duration_us, false) AS fine FROM clips c LEFT JOIN dur USING (media_id)),
  hw AS (SELECT DISTINCT media_id FROM wd), hv AS (SELECT DISTINCT media_id FROM vo),
  sy AS (SELECT ck.media_id, ck.clip_id, CASE WHEN NOT fine THEN 'interval' WHEN hw.media_id IS NOT NULL THEN 'words' WHEN hv.media_id IS NOT NULL THEN 'voice' ELSE 'none' END AS method,
    CASE WHEN NOT fine THEN false WHEN hw.media_id IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM wd w WHERE w.media_id = ck.media_id AND ((w.start_us < ck.start_us AND ck.start_us < w.end_us) OR (w.start_us < ck.end_us AND ck.end_us < w.end_us)))
      WHEN hv.media_id IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM vo w WHERE w.media_id = ck.media_id AND ((w.start_us < ck.start_us AND ck.start_us < w.end_us) OR (w.start_us < ck.end_us AND ck.end_us < w.end_us))) END AS safe
    FROM ck LEFT JOIN hw ON hw.media_id = ck.media_id LEFT JOIN hv ON hv.media_id = ck.media_id)"""
# Every seventh decision waits for a person; every eleventh clip has no title.
REPORTS = f"""{SAFETY}, dc AS (SELECT *, CASE WHEN decision_id % 7 = 0 THEN 'pending' ELSE 'editor' END AS decided_by FROM decisions),
  pr AS (SELECT c.media_id, c.clip_id, x.decision_id, x.verdict, x.decided_by, least(c.end_us, x.end_us) - greatest(c.start_us, x.start_us) AS both_us, (c.end_us - c.start_us) + (x.end_us - x.start_us) AS sum_us FROM clips c JOIN dc x ON x.media_id = c.media_id AND x.start_us < c.end_us AND c.start_us < x.end_us AND c.end_us > c.start_us AND x.end_us > x.start_us),
  io AS (SELECT *, both_us / (sum_us - both_us)::DOUBLE AS iou FROM pr), bt AS (SELECT * FROM io WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY media_id, clip_id ORDER BY iou DESC, decision_id) = 1),
  rp AS (SELECT c.media_id, c.clip_id, bt.decision_id, bt.verdict, round(coalesce(iou, 0), 4) AS iou, c.clip_id % 11 <> 0 AS complete, c.end_us - c.start_us BETWEEN {BOUNDS[0]} AND {BOUNDS[1]} AS within, safe, method FROM clips c LEFT JOIN bt USING (media_id, clip_id) LEFT JOIN sy USING (media_id, clip_id))"""
METRICS = f"""{REPORTS}, dm AS (SELECT dc.*, EXISTS (SELECT 1 FROM io WHERE io.media_id = dc.media_id AND io.decision_id = dc.decision_id AND iou >= 0.5) AS hit FROM dc),
  da AS (SELECT media_id, count(*) FILTER (verdict = 'approved') AS approved, count(*) FILTER (verdict = 'approved' AND decided_by <> 'pending') AS confirmed, count(*) FILTER (verdict = 'rejected') AS rejected,
    count(*) FILTER (verdict = 'approved' AND hit) AS a, count(*) FILTER (verdict = 'approved' AND decided_by <> 'pending' AND hit) AS c, count(*) FILTER (verdict = 'rejected' AND hit) AS r FROM dm GROUP BY 1),
  ca AS (SELECT media_id, count(*) AS clips, count(*) FILTER (complete) AS f, count(*) FILTER (within) AS w, count(*) FILTER (safe) AS s, count(*) FILTER (safe IS NULL) AS u FROM rp GROUP BY 1),
  me AS (SELECT media_id, coalesce(clips, 0) AS clips, coalesce(approved, 0) AS approved, coalesce(confirmed, 0) AS confirmed, coalesce(rejected, 0) AS rejected, round(a / nullif(approved, 0), 6) AS coverage, round(c / nullif(confirmed, 0), 6) AS confirmed_coverage,
    round(r / nullif(rejected, 0), 6) AS improper, round(f / nullif(clips, 0), 6) AS completeness, round(w / nullif(clips, 0), 6) AS within_bounds, CASE WHEN u = 0 THEN round(s / nullif(clips, 0), 6) END AS boundary_safe FROM da FULL JOIN ca USING (media_id))"""


def evidence(spark, d):
    t = A.tracks(spark, d)
    return t.groupBy("media_id").agg((F.max("end_us") - 7_200_000_000).alias("duration_us")), t.where("label = 'purchase' AND media_id % 3 <> 0"), t.where("label = 'view' AND media_id % 6 <> 0")


def safety(spark, d):
    return V.boundary_safety(A.clips(spark, d), *evidence(spark, d), HOURS)


def reports(spark, d):
    title = F.when(F.col("clip_id") % 11 == 0, " ").otherwise("a title")
    clips = A.clips(spark, d).withColumn("title", title).withColumn("estimated_us", F.col("end_us") - F.col("start_us")).withColumn("complete", V.complete("title"))
    decided = A.decisions(spark, d).withColumn("decided_by", F.when(F.col("decision_id") % 7 == 0, V.PENDING).otherwise("editor"))
    return V.clip_reports(clips.drop("title"), decided, safety(spark, d), HOURS, bounds_us=BOUNDS), clips, decided


def measured(spark, d):
    rows, clips, decided = reports(spark, d)
    return V.metrics(rows, clips, decided, HOURS), rows


@query("k12_boundary_safe", A.sql("tracks clips", f"{SAFETY} SELECT media_id, clip_id, safe, method FROM sy"))
def _(spark, d):
    return safety(spark, d)


@query("k13_clip_reports", A.sql("tracks clips decisions", f"{REPORTS} SELECT * FROM rp"))
def _(spark, d):
    return reports(spark, d)[0]


@query("k13_evaluate", A.sql("tracks clips decisions", f"{METRICS} SELECT * FROM me"))
def _(spark, d):
    return measured(spark, d)[0]


THRESHOLDS = {"least_confirmed": 12, "least_rejected": 8, "least_coverage": 0.01, "most_improper": 0.04, "least_completeness": 0.9, "least_within_bounds": 0.5, "least_boundary_safe": 0.1}


@query("g20_gate", A.sql("tracks clips decisions", f"""{METRICS}, gt AS (SELECT *, concat_ws(',', CASE WHEN confirmed < 12 THEN 'confirmed' END, CASE WHEN rejected < 8 THEN 'rejected' END, CASE WHEN confirmed_coverage < 0.01 THEN 'confirmed_coverage' END, CASE WHEN improper > 0.04 THEN 'improper' END,
  CASE WHEN completeness < 0.9 THEN 'completeness' END, CASE WHEN within_bounds < 0.5 THEN 'within_bounds' END, CASE WHEN boundary_safe IS NULL THEN 'boundary_safe_unavailable' WHEN boundary_safe < 0.1 THEN 'boundary_safe' END) AS codes FROM me) SELECT media_id, codes = '' AS passed, codes FROM gt"""))
def _(spark, d):
    thresholds = spark.createDataFrame([tuple(THRESHOLDS.values())], list(THRESHOLDS))
    return V.gate(measured(spark, d)[0], thresholds).select("media_id", "passed", "codes")


@query("f10_single_match", """WITH e AS (SELECT p_partkey AS episode_id, p_size AS s, p_partkey // 7 AS t FROM part), r AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 60 END AS s, CASE WHEN c_custkey % 4 IN (0, 2) THEN c_custkey % 90 END AS t FROM customer),
  m AS (SELECT run_id, count(e.episode_id) AS n, min(e.episode_id) AS episode_id FROM r LEFT JOIN e ON (r.s IS NULL OR r.s = e.s) AND (r.t IS NULL OR r.t = e.t) GROUP BY 1) SELECT run_id, CASE WHEN n = 1 THEN episode_id END AS episode_id, n AS n_matched, CASE WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' END AS error FROM m""")
def _(spark, d):
    run = F.col("c_custkey")
    episodes = A.table(spark, d, "part").select(F.col("p_partkey").alias("episode_id"), F.col("p_size").cast("string").alias("source_hash"), F.floor(F.col("p_partkey") / 7).cast("string").alias("transcript_hash"))
    runs = A.table(spark, d, "customer").select(run.alias("run_id"), F.when(run % 4 < 2, run % 60).cast("string").alias("source_hash"), F.when((run % 4).isin(0, 2), run % 90).cast("string").alias("transcript_hash"))
    return V.episode_of(runs, episodes)


#: The first day of the events, from which their times count here.
FIRST = 1_704_067_200_000_000


@query("g07_density", A.sql("tracks clips", f"""dur AS (SELECT media_id, max(end_us) - 7200000000 - {FIRST} AS duration_us FROM tracks GROUP BY 1), w AS (SELECT media_id, duration_us, unnest(range(0, (duration_us - 1) // {DAY} + 1)) AS window_id FROM dur WHERE duration_us > 0),
  s AS (SELECT w.*, least({DAY}, duration_us - window_id * {DAY}) AS length_us, CAST(coalesce((SELECT sum(greatest(0, least(c.end_us - {FIRST}, (window_id + 1) * {DAY}, duration_us) - greatest(c.start_us - {FIRST}, window_id * {DAY}))) FROM clips c WHERE c.media_id = w.media_id AND c.end_us > c.start_us), 0) AS BIGINT) AS speech_us FROM w),
  t AS (SELECT *, CAST(sum(speech_us) OVER (PARTITION BY media_id) AS BIGINT) AS total FROM s)
  SELECT media_id, window_id, window_id * {DAY} AS start_us, length_us, speech_us, least(1.0::DOUBLE, (200000 * speech_us + length_us) // (2 * length_us) / 100000::DOUBLE) AS ratio, least(1.0::DOUBLE, (200000 * total + duration_us) // (2 * duration_us) / 100000::DOUBLE) AS overall FROM t"""))
def _(spark, d):
    spans = A.clips(spark, d).withColumns({c: F.col(c) - FIRST for c in ("start_us", "end_us")})
    return V.density(spans, evidence(spark, d)[0].withColumn("duration_us", F.col("duration_us") - FIRST), DAY)
