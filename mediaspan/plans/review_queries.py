"""Queries on clips under review, lesson shots and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.operators import review as R
from mediaspan.operators import spans as S
from mediaspan.plans.span_queries import HOURS, SEGMENTS, segments
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


@query("h09_accept", A.sql("tracks", "p AS (SELECT media_id, id // 50 AS clip, start_us, end_us FROM tracks WHERE end_us > start_us), c AS (SELECT media_id, clip, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, min(start_us) AS start_us, max(end_us) AS end_us FROM p GROUP BY 1, 2) SELECT * FROM c WHERE n <= 5 AND total_us BETWEEN 1000000000 AND 40000000000 AND end_us - start_us <= 14400000000"))
def _(spark, d):
    pieces = A.tracks(spark, d).where("end_us > start_us").withColumn("clip", F.floor(F.col("id") / 50))
    return R.accepted(pieces, ["media_id", "clip"], 1_000_000_000, 40_000_000_000, 14_400_000_000, 5)


@query("h10_top_up", A.sql("clips decisions", """a AS (SELECT media_id, clip_id AS id, start_us, end_us, (clip_id * 31) % 97 AS score FROM clips WHERE end_us > start_us), b AS (SELECT media_id, decision_id AS id, start_us, end_us, (decision_id * 17) % 89 AS score FROM decisions WHERE end_us > start_us),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.media_id = b.media_id AND a.start_us < b.end_us AND b.start_us < a.end_us)) SELECT media_id, id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY score DESC, start_us, id) AS INTEGER) AS rank FROM u"""))
def _(spark, d):
    a = A.clips(spark, d).where("end_us > start_us").select("media_id", F.col("clip_id").alias("id"), "start_us", "end_us", ((F.col("clip_id") * 31) % 97).alias("score"))
    b = A.decisions(spark, d).where("end_us > start_us").select("media_id", F.col("decision_id").alias("id"), "start_us", "end_us", ((F.col("decision_id") * 17) % 89).alias("score"))
    return R.topped_up(a, b, HOURS).select("media_id", "id", "rank")


@query("h07_linear_picks", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 3 OR k IN (0, (n - 1) // 2, n - 1)")
def _(spark, d):
    return R.linear_picks(A.table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("h12_board", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND contains(lower(o_orderpriority), 'high') ORDER BY o_orderdate DESC, o_orderkey")
def _(spark, d):
    rows = A.table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P") & F.lower("o_orderpriority").contains("high"))
    return rows.orderBy(F.col("o_orderdate").desc(), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("i04_removals", "SELECT p_partkey AS ref, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AS removed FROM part")
def _(spark, d):
    gone = A.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("ref")).distinct()
    part = A.table(spark, d, "part").select(F.col("p_partkey").alias("ref"))
    return part.join(gone, "ref", "left_anti").withColumn("removed", F.lit(False)).unionByName(part.join(gone, "ref", "left_semi").withColumn("removed", F.lit(True)))


@query("i05_append_picks", "WITH h AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS ref FROM lineitem WHERE l_returnflag = 'A'), w AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS ref FROM lineitem WHERE l_returnflag = 'N') SELECT s, ref, CAST(row_number() OVER (PARTITION BY s ORDER BY ref) AS INTEGER) AS place FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.s = w.s AND h.ref = w.ref)")
def _(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("ref"), "l_returnflag")
    have, want = (li.where(F.col("l_returnflag") == x).select("s", "ref").distinct() for x in "AN")
    return want.join(have, ["s", "ref"], "left_anti").withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy("ref")))


@query("i06_known_ranges", A.sql("clips decisions", "SELECT media_id, start_us, end_us FROM clips UNION SELECT media_id, start_us, end_us FROM decisions"))
def _(spark, d):
    columns = ["media_id", "start_us", "end_us"]
    return A.clips(spark, d).select(columns).union(A.decisions(spark, d).select(columns)).distinct().orderBy(*columns)


@query("j07_balanced_accuracy", "SELECT source, round((count(*) FILTER (toxic = 1 AND quality = 1) / nullif(count(*) FILTER (toxic = 1), 0) + count(*) FILTER (toxic <> 1 AND quality <> 1) / nullif(count(*) FILTER (toxic <> 1), 0)) / 2, 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(spark, d):
    rows = A.table(spark, d, "labels").join(A.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.balanced_accuracy(rows, ["source"], F.col("toxic") == 1, F.col("quality") == 1)


LABELS = "u AS (SELECT media_id, pos AS unit, start_us + (end_us - start_us) // 2 AS mid, CASE WHEN end_us - start_us >= 4000000 THEN speaker END AS label FROM turns)"


@query("j09_label_units", A.sql("turns", f"""{LABELS} SELECT media_id, unit, mid, coalesce(label, (SELECT v.label FROM u v WHERE v.media_id = u.media_id AND v.label IS NOT NULL ORDER BY abs(v.mid - u.mid), v.mid LIMIT 1)) AS label FROM u"""))
def _(spark, d):
    size = F.col("end_us") - F.col("start_us")
    units = A.turns(spark, d).select("media_id", F.col("pos").alias("unit"), (F.col("start_us") + F.floor(size / 2)).alias("mid"), F.when(size >= 4_000_000, F.col("speaker")).alias("label"))
    return R.nearest_label(units)


@query("j19_expected_roles", A.sql("tracks", "SELECT media_id, id // 20 AS w, coalesce(bool_and(label = CASE WHEN media_id % 2 = 0 THEN 'view' ELSE 'click' END), false) AS ok FROM tracks GROUP BY 1, 2"))
def _(spark, d):
    rows = A.tracks(spark, d).select("media_id", F.floor(F.col("id") / 20).alias("w"), F.col("label").alias("role"), F.when(F.col("media_id") % 2 == 0, "view").otherwise("click").alias("expected"))
    return R.expected_roles(rows, ["media_id", "w"])


@query("k03_patches", """WITH RECURSIVE p AS (SELECT o_custkey AS k, o_orderkey AS seen, CASE WHEN o_orderstatus = 'F' THEN 'discarded' WHEN o_orderstatus = 'O' THEN 'saved' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS reason, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  s AS (SELECT k, n, coalesce(status, NULL) AS status, CASE WHEN status = 'discarded' THEN reason END AS reason, CASE WHEN status IS NOT NULL THEN seen END AS changed_at FROM p WHERE n = 1 UNION ALL
    SELECT p.k, p.n, coalesce(p.status, s.status), CASE WHEN coalesce(p.status, s.status) = 'discarded' THEN coalesce(p.reason, s.reason) END,
    CASE WHEN coalesce(p.status, s.status) IS DISTINCT FROM s.status OR CASE WHEN coalesce(p.status, s.status) = 'discarded' THEN coalesce(p.reason, s.reason) END IS DISTINCT FROM s.reason THEN p.seen ELSE s.changed_at END FROM s JOIN p ON p.k = s.k AND p.n = s.n + 1)
  SELECT k, status, reason, changed_at FROM s WHERE n = (SELECT max(n) FROM p WHERE p.k = s.k)""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "discarded").when(F.col("o_orderstatus") == "O", "saved")
    return R.patched(o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("reason")))


@query("e24_shot_windows", A.sql("tracks", """b AS (SELECT media_id AS plan_id, id // 25 AS shot, min(start_us) AS start_us, max(end_us) AS end_us FROM tracks GROUP BY 1, 2),
  w AS (SELECT plan_id, shot, start_us - CASE WHEN lag(shot) OVER o IS NULL THEN 0 ELSE 250000 END AS start_us, end_us + CASE WHEN lead(shot) OVER o IS NULL THEN 0 ELSE 250000 END AS end_us FROM b WINDOW o AS (PARTITION BY plan_id ORDER BY start_us, shot)) SELECT *, end_us - start_us AS needed_us FROM w"""))
def _(spark, d):
    beats = A.tracks(spark, d).select(F.col("media_id").alias("plan_id"), F.floor(F.col("id") / 25).alias("shot"), "start_us", "end_us")
    return R.shot_windows(beats, 250_000)


@query("e26_retime", "SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(p_size, 0), 6) AS factor, NOT coalesce(l_quantity / nullif(p_size, 0) BETWEEN 0.5 AND 1.5, false) AS outside FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(spark, d):
    rows = A.table(spark, d, "lineitem").join(A.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    factor, outside = R.retime(F.col("l_quantity"), F.col("p_size"))
    return rows.select("l_orderkey", "l_linenumber", F.round(factor, 6).alias("factor"), outside.alias("outside"))


@query("e31_credits", "WITH f AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2), k AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY first, l_partkey) AS n FROM f) SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY n) AS credits FROM k GROUP BY 1")
def _(spark, d):
    f = A.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("first"))
    return f.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("credits"))


@query("e33_boundaries", A.sql("clips", f"{SEGMENTS}, b AS (SELECT *, lead(pos) OVER w AS next_pos, lead(end_us - start_us) OVER w AS after FROM seg WINDOW w AS (PARTITION BY plan_id ORDER BY pos)) SELECT plan_id, pos, next_pos, fade_us AS wanted_us, least(fade_us, (end_us - start_us) // 2, after // 2) AS fade_us FROM b WHERE next_pos IS NOT NULL"))
def _(spark, d):
    return R.boundaries(segments(spark, d))


@query("c22_effective_roles", "WITH s AS (SELECT c_custkey AS k, c_mktsegment AS role FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT o_custkey AS k, max(o_orderpriority) AS role FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT coalesce(s.k, c.k) AS k, coalesce(c.role, s.role, 'ignore') AS role FROM s FULL JOIN c ON s.k = c.k")
def _(spark, d):
    suggested = A.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("role"))
    confirmed = A.table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("role"))
    return R.default_roles(confirmed, suggested, ["k"])


@query("c26_normalised_clip", A.sql("turns", """r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY media_id) AS total FROM turns) SELECT media_id, min(start_us) AS start_us, max(end_us) AS end_us,
  min(start_us) + 5000000 AS hook_end_us, string_agg(CASE WHEN n = 1 THEN 'hook' WHEN n = total THEN 'payoff' ELSE 'context' END, ',' ORDER BY n) AS purposes FROM r GROUP BY 1"""))
def _(spark, d):
    by = Window.partitionBy("media_id")
    rows = A.turns(spark, d).withColumn("n", F.row_number().over(by.orderBy("pos"))).withColumn("total", F.count("*").over(by))
    purpose = F.when(F.col("n") == 1, "hook").when(F.col("n") == F.col("total"), "payoff").otherwise("context")
    out = rows.groupBy("media_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", purpose.alias("p")))), lambda x: x["p"]), ",").alias("purposes"))
    return out.withColumn("hook_end_us", F.col("start_us") + 5_000_000)


@query("d13_question", A.sql("turns", """a AS (SELECT media_id, pos, start_us AS t FROM turns WHERE speaker = 'assistant'), q AS (SELECT a.media_id, a.pos, max((u.end_us, u.pos)) AS best FROM a JOIN turns u ON u.media_id = a.media_id AND u.speaker = 'user' AND u.end_us BETWEEN a.t - 4000000 AND a.t + 500000 AND u.end_us - u.start_us >= 1000000 GROUP BY 1, 2)
  SELECT a.media_id, a.pos, best[2] AS question FROM a LEFT JOIN q USING (media_id, pos)"""))
def _(spark, d):
    t = A.turns(spark, d)
    answers = t.where("speaker = 'assistant'").select("media_id", "pos", F.greatest(F.col("start_us") - 4_000_000, F.lit(0)).alias("start_us"), (F.col("start_us") + 500_001).alias("end_us"))
    ends = t.where("speaker = 'user' AND end_us - start_us >= 1000000").select("media_id", F.col("pos").alias("question"), F.col("end_us").alias("right_start_us"), (F.col("end_us") + 1).alias("right_end_us"))
    best = S.overlap_join(answers, ends, 10_000_000).groupBy("media_id", "pos").agg(F.max_by("question", F.struct("right_start_us", "question")).alias("question"))
    return answers.select("media_id", "pos").join(best, ["media_id", "pos"], "left")


@query("g10_peak_time", A.sql("timed", "SELECT user_id, arg_min(event_id, (-((end_us - start_us) // 600000), event_id)) AS peak_id FROM timed GROUP BY 1"))
def _(spark, d):
    return A._timed(spark, d).groupBy("user_id").agg(F.min_by("event_id", F.struct(-(F.col("end_us") - F.col("start_us")), "event_id")).alias("peak_id"))


@query("g13_delta_codes", A.sql("tracks", "d AS (SELECT media_id, CAST(abs(sum(CASE WHEN label = 'view' THEN (end_us - start_us) // 600000 ELSE 0 END) - sum(CASE WHEN label = 'click' THEN (end_us - start_us) // 600000 ELSE 0 END)) AS BIGINT) AS delta, count(*) FILTER (end_us <= start_us) AS empty FROM tracks GROUP BY 1) SELECT media_id, delta, concat_ws(',', CASE WHEN delta > 100000 THEN 'drift' END, CASE WHEN empty > 0 THEN 'empty' END) AS codes FROM d"))
def _(spark, d):
    n = F.floor((F.col("end_us") - F.col("start_us")) / 600_000)
    d_ = A.tracks(spark, d).groupBy("media_id").agg(F.abs(F.sum(F.when(F.col("label") == "view", n).otherwise(0)) - F.sum(F.when(F.col("label") == "click", n).otherwise(0))).alias("delta"), F.count_if(F.col("end_us") <= F.col("start_us")).alias("empty"))
    codes = F.array_compact(F.array(F.when(F.col("delta") > 100_000, "drift"), F.when(F.col("empty") > 0, "empty")))
    return d_.select("media_id", "delta", F.array_join(codes, ",").alias("codes"))


@query("k07_cache_lookup", "WITH r AS (SELECT l_orderkey, l_linestatus, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_shipdate DESC, l_partkey DESC) AS n FROM lineitem) SELECT o_orderkey, l_partkey FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus AND n = 1")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy(F.col("l_shipdate").desc(), F.col("l_partkey").desc()))
    newest = A.table(spark, d, "lineitem").withColumn("n", n).where("n = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), "l_partkey")
    return A.table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(newest, ["o_orderkey", "o_orderstatus"], "left").select("o_orderkey", "l_partkey")


@query("k09_detail", "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, count(*) AS orders, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) FILTER (n <= 5) AS newest FROM o GROUP BY 1")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey"))
    rows = A.table(spark, d, "orders").withColumn("n", n)
    few = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "o_orderkey")))), lambda x: x["o_orderkey"].cast("string"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.array_join(few, ",").alias("newest"))


@query("k11_incomplete", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def _(spark, d):
    return A.table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("k15_scene_state", "SELECT o_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'accepted' ELSE 'pending' END AS state, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY ALL")
def _(spark, d):
    met = A.table(spark, d, "orders").join(A.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_returnflag <> 'R'")
    return met.groupBy("o_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "accepted").otherwise("pending").alias("state")).agg(F.count("*").alias("n"))


@query("k16_readiness", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'no episode' WHEN f = 0 THEN 'needs map' WHEN p = 0 THEN 'needs voice' ELSE 'ok' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, d):
    o = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    status = F.when(F.col("n").isNull(), "no episode").when(F.col("f") == 0, "needs map").when(F.col("p") == 0, "needs voice").otherwise("ok")
    return A.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("k17_first_picks", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS pick FROM lineitem GROUP BY 1")
def _(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("pick"))


# Two searches' answers with names, texts (long, blank or missing) and lengths of their own.
@query("a16_two_providers", """WITH a AS (SELECT doc_id, doc_id % 2 AS side, CASE WHEN doc_id % 5 <> 0 THEN source END AS title, CASE WHEN doc_id % 7 <> 0 THEN text END AS text, n_chars FROM documents)
  SELECT CASE side WHEN 0 THEN 'first' ELSE 'second' END AS provider, CAST(doc_id AS VARCHAR) AS ref, coalesce(title, 'untitled') AS title, md5(left(coalesce(text, ''), 300)) AS note, CASE side WHEN 0 THEN n_chars / 1000.0::DOUBLE ELSE CASE WHEN n_chars % 3 <> 0 THEN CAST(n_chars AS DOUBLE) END END AS seconds FROM a""")
def _(spark, d):
    rows = A.table(spark, d, "documents").withColumn("title", F.when(F.col("doc_id") % 5 != 0, F.col("source"))).withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    first = rows.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("title").alias("name"), F.col("text").alias("description"), F.col("n_chars").alias("length_ms"))
    second = rows.where("doc_id % 2 = 1").select(F.col("doc_id").alias("key"), "title", F.col("text").alias("prompt"), F.when(F.col("n_chars") % 3 != 0, F.col("n_chars")).alias("length_s"))
    found = R.candidates({"first": (first, {"ref": "id", "title": "name", "note": "description", "ms": "length_ms"}), "second": (second, {"ref": "key", "title": "title", "note": "prompt", "seconds": "length_s"})})
    return found.withColumn("note", F.md5("note"))


@query("a19_newest_per_number", "SELECT l_linenumber, l_suppkey, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS newest FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_linenumber", "l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("newest"))


# Documents as files, a day older for each fifty characters.
@query("a20_retention", """WITH f AS (SELECT source AS store, doc_id AS path, n_chars AS bytes, n_chars // 50 AS age FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY age DESC, path) AS n FROM f WHERE age > 30)
  SELECT store, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, string_agg(CAST(path AS VARCHAR), ',' ORDER BY n) FILTER (n <= 20) AS first FROM o GROUP BY 1""")
def _(spark, d):
    files = A.table(spark, d, "documents").select(F.col("source").alias("store"), F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"), F.floor(F.col("n_chars") / 50).alias("age"))
    return R.retention(files, 30).withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


