"""Queries on logs, streams, layouts and faces of media, with their SQL. Sixteen event numbers are a medium."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaspan.operators import edits as E
from mediaspan.operators import quality as Q
from mediaspan.sources import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}

MEDIA = "m AS (SELECT event_id // 16 AS media_id, event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
COVERS = "covers AS (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'tall' ELSE 'wide' END AS canvas, r_name AS platform, 'bar' AS name, 150 * r_regionkey::BIGINT AS cx0, 120 * r_regionkey::BIGINT AS cy0, 150 * r_regionkey::BIGINT + 200 AS cx1, 120 * r_regionkey::BIGINT + 180 AS cy1, r_regionkey FROM region)"
BOXES = "boxes AS (SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'tall' WHEN k % 3 = 0 THEN 'square' ELSE 'wide' END AS canvas, v % 900 AS x0, (k * 17) % 900 AS y0, v % 900 + 60 + k AS x1, (k * 17) % 900 + 40 AS y1 FROM m)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE {MEDIA}{',' if not sql.startswith('SELECT') else ''} {sql}"
        return f

    return put


def media(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return A.table(spark, d, "events").select(F.floor(F.col("event_id") / 16).alias("media_id"), "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"), k.alias("k"))


def number(column):
    """Hundredths as a decimal in text."""
    return F.concat(F.floor(column / 100).cast("string"), F.lit("."), F.lpad((column % 100).cast("string"), 2, "0"))


def logs(spark, d, line):
    """A medium's lines as one text, in order."""
    rows = media(spark, d).withColumn("line", line).groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("lines"))
    return rows.select("media_id", F.array_join(F.col("lines.line"), "\n").alias("log"))


def lines(spark, d):
    text = F.concat(F.lit("frame pts_time:"), number(F.col("v") % 40), F.lit(" score=0."), F.lpad((F.col("k") % 100).cast("string"), 2, "0"))
    return media(spark, d).select("media_id", F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "error", "noise").otherwise(text).alias("line"))


@query("a08_scene_cuts", "SELECT media_id, v % 40 * 10000 AS t_us, arg_max((k % 100) / 100.0::DOUBLE, event_id) AS score FROM m WHERE event_type <> 'error' GROUP BY 1, 2")
def _(spark, d):
    return Q.scene_cuts(lines(spark, d))


@query("a13_keyframes", "SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY v % 40, event_id) - 1 AS INTEGER) AS idx, v % 40 * 10000 AS t_us FROM m WHERE event_type <> 'error'")
def _(spark, d):
    return Q.keyframes(lines(spark, d))


@query("a10_picture_faults", """a AS (SELECT media_id, media_id % 7 * 5000000 AS n, list(v * 10000 ORDER BY event_id) FILTER (event_type = 'click') AS b, list(v * 10000 ORDER BY event_id) FILTER (event_type = 'signup') AS f, list(v * 10000 ORDER BY event_id) FILTER (event_type = 'view') AS s FROM m GROUP BY 1),
  e AS (SELECT media_id, coalesce(b, []) AS b, CASE WHEN coalesce(len(s), 0) > coalesce(len(f), 0) THEN list_append(coalesce(f, []), greatest(0, n - s[-1])) ELSE coalesce(f, []) END AS f FROM a)
  SELECT media_id, CAST(len(b) AS INTEGER) AS black_n, CAST(coalesce(list_sum(b), 0) AS BIGINT) AS black_total_us, coalesce(list_max(b), 0) AS black_longest_us, CAST(len(f) AS INTEGER) AS freeze_n, CAST(coalesce(list_sum(f), 0) AS BIGINT) AS freeze_total_us, coalesce(list_max(f), 0) AS freeze_longest_us FROM e""")
def _(spark, d):
    names = {"click": "black_start:1 black_duration:", "signup": "lavfi.freezedetect.freeze_duration: ", "view": "lavfi.freezedetect.freeze_start: "}
    line = F.lit("frame")
    for kind, name in names.items():
        line = F.when(F.col("event_type") == kind, F.concat(F.lit(name), number(F.col("v")))).otherwise(line)
    return Q.picture_faults(logs(spark, d, line).withColumn("duration_us", F.col("media_id") % 7 * 5_000_000))


@query("a11_loudness", """r AS (SELECT media_id, arg_max(v, event_id) FILTER (event_type = 'purchase') AS v, arg_max(k, event_id) FILTER (event_type = 'purchase') AS k FROM m GROUP BY 1)
  SELECT media_id, -(v + 1)::DOUBLE / 100 AS integrated_lufs, k::DOUBLE / 100 AS range_lu, CASE WHEN k % 5 > 0 THEN -(k + 1)::DOUBLE / 100 END AS true_peak_dbfs, -(v + 1001)::DOUBLE / 100 AS threshold_lufs FROM r""")
def _(spark, d):
    v, k = F.col("v"), F.col("k")
    peak = F.when(k % 5 > 0, F.concat(F.lit("-"), number(k + 1))).otherwise("-inf")
    report = F.concat(F.lit('{"input_i" : "-'), number(v + 1), F.lit('", "input_lra" : "'), number(k), F.lit('", "input_tp" : "'), peak, F.lit('", "input_thresh" : "-'), number(v + 1001), F.lit('"}'))
    return Q.loudness(logs(spark, d, F.when(F.col("event_type") == "purchase", report).when(F.col("event_type") == "click", '{"other": 1}').otherwise("size= N/A")))


@query("a12_momentary", "SELECT media_id, max(-(v % 20000 + 1)::DOUBLE / 100) FILTER (event_type = 'view' AND v % 20000 + 1 < 12000) AS loudness FROM m GROUP BY 1")
def _(spark, d):
    line = F.concat(F.lit("t: 1 M: -"), number(F.col("v") % 20000 + 1), F.lit(" S: -3.0"))
    return Q.most_momentary(logs(spark, d, F.when(F.col("event_type") == "view", line).otherwise("S: 5")))


def probes(spark, d):
    """A medium's streams, and the length that its container states."""
    kind = F.when(F.col("k") % 3 == 0, "audio").when(F.col("k") % 3 == 1, "video").otherwise("data")
    length = F.when(F.col("event_type") == "error", "N/A").otherwise(number(F.col("v") % 5000))
    rows = media(spark, d).select("media_id", F.struct("event_id", kind.alias("kind"), length.alias("duration")).alias("s"), F.col("v"))
    rows = rows.groupBy("media_id").agg(F.sort_array(F.collect_list("s")).alias("streams"), F.max("v").alias("v"))
    return rows.select("media_id", "streams", F.when(F.col("media_id") % 3 == 0, number(F.col("v"))).otherwise("N/A").alias("whole"))


WHOLE = "w AS (SELECT media_id, CASE WHEN media_id % 3 = 0 THEN max(v)::DOUBLE / 100 ELSE coalesce((arg_min(v % 5000, event_id) FILTER (event_type <> 'error'))::DOUBLE / 100, 0) END AS whole, (min(v % 5000) FILTER (event_type <> 'error' AND k % 3 < 2 AND v % 5000 > 0))::DOUBLE / 100 AS av FROM m GROUP BY 1)"


@query("a14_duration", f"{WHOLE} SELECT media_id, whole AS duration FROM w")
def _(spark, d):
    return probes(spark, d).select("media_id", Q.media_duration(F.col("whole"), F.col("streams")).alias("duration"))


@query("a15_usable_duration", f"{WHOLE} SELECT media_id, coalesce(av, whole) AS duration FROM w")
def _(spark, d):
    return probes(spark, d).select("media_id", Q.usable_duration(F.col("streams"), Q.media_duration(F.col("whole"), F.col("streams"))).alias("duration"))


def covers(spark, d):
    """The regions as covers of two canvases."""
    key = F.col("r_regionkey").cast("long")
    canvas = F.when(key % 2 == 0, "tall").otherwise("wide")
    return A.table(spark, d, "region").select(canvas.alias("canvas"), F.col("r_name").alias("platform"), F.lit("bar").alias("name"), (150 * key).alias("cx0"), (120 * key).alias("cy0"), (150 * key + 200).alias("cx1"), (120 * key + 180).alias("cy1"), key.alias("r_regionkey"))


def boxes(spark, d):
    x, y, k = F.col("v") % 900, F.col("k") * 17 % 900, F.col("k")
    canvas = F.when(k % 2 == 0, "tall").when(k % 3 == 0, "square").otherwise("wide")
    return media(spark, d).select(F.col("event_id").alias("id"), canvas.alias("canvas"), x.alias("x0"), y.alias("y0"), (x + 60 + k).alias("x1"), (y + 40).alias("y1"))


@query("b36_occlusions", f"{COVERS}, {BOXES} SELECT id, string_agg(DISTINCT platform || ':' || name, ',' ORDER BY platform || ':' || name) AS codes FROM boxes JOIN covers USING (canvas) WHERE NOT (x1 <= cx0 OR x0 >= cx1 OR y1 <= cy0 OR y0 >= cy1) GROUP BY 1")
def _(spark, d):
    return Q.occlusions(boxes(spark, d), covers(spark, d))


@query("b37_right_limit", f"{COVERS}, {BOXES} SELECT id, min(cx0) AS limit_x FROM boxes JOIN covers USING (canvas) WHERE NOT (y1 <= cy0 OR y0 >= cy1) GROUP BY 1")
def _(spark, d):
    return Q.right_limit(boxes(spark, d), covers(spark, d))


@query("b38_outside_zone", f"{COVERS}, {BOXES} SELECT id, canvas <> 'square' AND coalesce(x0 < cx0 + 98 OR y0 < cy0 + 98 OR x1 > cx1 + 502 OR y1 > cy1 + 502, false) AS outside FROM boxes LEFT JOIN (SELECT * FROM covers WHERE r_regionkey < 2) USING (canvas)")
def _(spark, d):
    zones = covers(spark, d).where("r_regionkey < 2").select("canvas", (F.col("cx0") + 100).alias("zx0"), (F.col("cy0") + 100).alias("zy0"), (F.col("cx1") + 500).alias("zx1"), (F.col("cy1") + 500).alias("zy1"))
    return Q.outside_safe_zone(boxes(spark, d), zones)


@query("c21_camera_roles", """g AS (SELECT media_id, max(k) % 4 AS f, CASE WHEN max(v) % 10 > 0 THEN (max(v) % 100)::DOUBLE / 100 END AS s, (min(k) % 8)::DOUBLE / 100 AS a FROM m GROUP BY 1)
  SELECT media_id, CASE WHEN f = 0 OR a < 0.01 THEN 'ignore' WHEN s >= 0.6 THEN 'subject' WHEN f >= 3 THEN 'wide' WHEN f = 2 AND s >= 0.3 THEN 'subject' WHEN f = 2 AND s <= 0.12 THEN 'wide' WHEN f = 1 AND s <= 0.35 THEN 'interviewers' END AS role FROM g""")
def _(spark, d):
    most = F.max("v")
    g = media(spark, d).groupBy("media_id").agg((F.max("k") % 4).alias("faces"), F.when(most % 10 > 0, most % 100 / 100.0).alias("share"), (F.min("k") % 8 / 100.0).alias("airtime"))
    return g.select("media_id", Q.camera_role(F.col("faces"), F.col("share"), F.col("airtime")).alias("role"))


@query("g06_median_faces", """n AS (SELECT media_id, event_id // 4 AS sample, count(*) FILTER (k >= 40 AND v % 100 >= 35) AS n FROM m GROUP BY 1, 2) SELECT media_id, CAST(floor(median(n)) AS BIGINT) AS faces FROM n GROUP BY 1""")
def _(spark, d):
    rows = media(spark, d).select("media_id", F.floor(F.col("event_id") / 4).alias("sample"), (F.col("k") / 100.0).alias("score"), (F.col("v") % 100 / 1000.0).alias("area"))
    return Q.median_faces(rows, 0.4)


@query("g22_check_rows", """g AS (SELECT media_id AS id, max(k) > 95 AS loud, count(*) FILTER (event_type = 'error') > 4 AS black, min(v) < 100 AS short FROM m GROUP BY 1)
  SELECT id, 'loud' AS code, 'warning' AS state FROM g WHERE loud UNION ALL SELECT id, 'black', 'fail' FROM g WHERE black UNION ALL SELECT id, 'short', 'fail' FROM g WHERE short UNION ALL SELECT id, NULL, 'pass' FROM g WHERE NOT (loud OR black OR short)""")
def _(spark, d):
    g = media(spark, d).groupBy(F.col("media_id").alias("id")).agg((F.max("k") > 95).alias("loud"), (F.count_if(F.col("event_type") == "error") > 4).alias("black"), (F.min("v") < 100).alias("short"))
    codes = lambda *names: F.array_compact(F.array(*(F.when(F.col(n), n) for n in names)))
    return Q.checks(g.select("id", codes("loud", "black").alias("first"), codes("loud", "short").alias("second")), ["loud"])


@query("j16_face_groups")
def _(spark, d):
    rows = media(spark, d).select(F.col("media_id").alias("scene"), (F.col("v") % 1000 / 1000.0).alias("center"), (F.col("k") / 100.0).alias("area"))
    return Q.face_groups(rows)


@query("j18_best_boxes")
def _(spark, d):
    x, k = F.col("v") % 200, F.col("k")
    return E.best_boxes(media(spark, d).select(F.col("media_id").alias("frame"), F.col("event_id").alias("id"), x.alias("x0"), k.alias("y0"), (x + 60 + k).alias("x1"), (k + 80).alias("y1"), (k * 100_000 + F.col("event_id") % 100_000).alias("score")))


_BOTH = "greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0))"
SQL["j18_best_boxes"] = f"""WITH RECURSIVE {MEDIA}, b AS (SELECT media_id AS frame, event_id AS id, row_number() OVER (PARTITION BY media_id ORDER BY k * 100000 + event_id % 100000 DESC) AS n, v % 200 AS x0, v % 200 + 60 + k AS x1, k AS y0, k + 80 AS y1, (60 + k) * 80 AS area FROM m),
  p AS (SELECT a.frame, a.n, c.n AS other, {_BOTH} AS met, a.area + c.area AS areas FROM b a JOIN b c ON a.frame = c.frame AND c.n < a.n),
  o AS (SELECT b.frame, b.n, coalesce(list(p.other) FILTER (p.met > 0.3 * (p.areas - p.met)), []) AS near FROM b LEFT JOIN p USING (frame, n) GROUP BY 1, 2),
  r AS (SELECT frame, n, [n] AS kept FROM b WHERE n = 1 UNION ALL SELECT o.frame, o.n, CASE WHEN list_has_any(r.kept, o.near) THEN r.kept ELSE list_append(r.kept, o.n) END FROM r JOIN o ON o.frame = r.frame AND o.n = r.n + 1)
  SELECT frame, id, x0, y0, x1, y1, y0 * 100000 + id % 100000 AS score FROM r JOIN b USING (frame, n) WHERE list_contains(r.kept, r.n)"""
