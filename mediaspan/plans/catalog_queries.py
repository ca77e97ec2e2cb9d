"""Queries on the catalogue, set operations, roll-ups and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.functions import text as T
from mediaspan.operators import catalog as C
from mediaspan.sources import adapters as A
from mediaspan.sources.scratch import folder, kept
from mediaspan.streaming import jobs as J

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
FLAGS = f"o_totalprice > 400000 AS posted, o_orderpriority = '5-LOW' AS discarded, o_orderkey % 7 = 0 AS saved, o_orderstatus = 'F' AS exported, o_orderstatus = 'O' AS approved"
STATUS = f"st AS (SELECT *, CASE WHEN posted THEN 'posted' WHEN discarded THEN 'discarded' WHEN saved THEN 'saved' WHEN exported THEN 'exported' WHEN approved THEN 'approved' ELSE 'new' END AS status FROM (SELECT *, {FLAGS} FROM orders))"


def orders(spark, d):
    return A.table(spark, d, "orders")


def stated(spark, d):
    return orders(spark, d).withColumn("status", C.clip_status(F.col("o_totalprice") > 400000, F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"))


@query("k01_status", f"WITH {STATUS} SELECT o_orderkey, status FROM st")
def _(spark, d):
    return stated(spark, d).select("o_orderkey", "status")


@query("g01_status_counts", f"WITH {STATUS} SELECT o_custkey, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in C.STATUSES) + ", count(*) AS total FROM st GROUP BY 1")
def _(spark, d):
    return C.status_counts(stated(spark, d), ["o_custkey"], "status")


@query("g02_rollup", f"WITH {STATUS} SELECT o_orderpriority, status, count(*) AS n FROM st GROUP BY ROLLUP (o_orderpriority, status)")
def _(spark, d):
    return stated(spark, d).rollup("o_orderpriority", "status").agg(F.count("*").alias("n"))


@query("g03_rates", "SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 6) AS rate FROM orders GROUP BY 1")
def _(spark, d):
    return orders(spark, d).groupBy("o_custkey").agg(F.round(F.try_divide(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "P")), 6).alias("rate"))


@query("g15_batch_status", "WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS items FROM orders GROUP BY 1) SELECT *, CASE WHEN done = items THEN 'succeeded' WHEN done = 0 THEN 'failed' ELSE 'partial' END AS status FROM g")
def _(spark, d):
    return C.batch_status(orders(spark, d), ["o_custkey"], "o_orderstatus", done="F")


@query("g16_next_version", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version FROM orders")
def _(spark, d):
    return orders(spark, d).select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("version"))


@query("g17_signature", "SELECT count(*) AS n, max(o_orderdate) AS newest FROM orders")
def _(spark, d):
    return orders(spark, d).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))


@query("g18_distinct_bytes", "WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_orderkey, CAST(sum(p_size) AS BIGINT) AS bytes FROM p JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(spark, d):
    pairs = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return pairs.join(A.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.sum("p_size").alias("bytes"))


@query("g20_job_gate", A.sql("jobs", """j AS (SELECT job_id, count(*) AS n, count(*) FILTER (status = 'failed') AS bad, max(progress) AS top FROM jobs GROUP BY 1) SELECT job_id, concat_ws(',', CASE WHEN n < 60 THEN 'few' END, CASE WHEN bad * 5 > n THEN 'failures' END, CASE WHEN top < 99 THEN 'progress' END) AS codes FROM j"""))
def _(spark, d):
    j = A.jobs(spark, d).groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("bad"), F.max("progress").alias("top"))
    return j.select("job_id", F.array_join(F.array_compact(F.array(F.when(F.col("n") < 60, "few"), F.when(F.col("bad") * 5 > F.col("n"), "failures"), F.when(F.col("top") < 99, "progress"))), ",").alias("codes"))


@query("g21_deltas", "WITH m AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT coalesce(a.c_nationkey, b.c_nationkey) AS c_nationkey, b.n - a.n AS delta FROM (SELECT * FROM m WHERE c_mktsegment = 'BUILDING') a FULL JOIN (SELECT * FROM m WHERE c_mktsegment = 'HOUSEHOLD') b USING (c_nationkey)")
def _(spark, d):
    m = A.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    a = m.where("c_mktsegment = 'BUILDING'").select("c_nationkey", F.col("n").alias("a"))
    b = m.where("c_mktsegment = 'HOUSEHOLD'").select("c_nationkey", F.col("n").alias("b"))
    return a.join(b, "c_nationkey", "full").select("c_nationkey", (F.col("b") - F.col("a")).alias("delta"))


@query("h01_latest", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE n = 1")
def _(spark, d):
    return C.latest(orders(spark, d), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("h02_recent", f"WITH {STATUS} SELECT o_orderkey, status FROM st WHERE status IN ('new', 'approved') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(spark, d):
    return stated(spark, d).where(F.col("status").isin("new", "approved")).orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50).select("o_orderkey", "status")


@query("h04_rank", f"SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {CENTS} DESC, o_orderdate, o_orderkey) AS INTEGER) AS rank FROM orders")
def _(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders(spark, d).select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(cents.desc(), "o_orderdate", "o_orderkey")).alias("rank"))


@query("h06_spread", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR k IN (SELECT round_even(i * (n - 1) / 3, 0) FROM range(4) t(i))")
def _(spark, d):
    return C.spread(orders(spark, d), ["o_custkey"], ["o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("h08_quietest", f"WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {CENTS}, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 5")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.round(F.col("o_totalprice") * 100), "o_orderkey"))
    return orders(spark, d).withColumn("n", n).where("n <= 5").select("o_custkey", "o_orderkey")


@query("h11_active_jobs", A.sql("jobs", "l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_us DESC, event_id DESC) AS n FROM jobs) SELECT job_id, status, row_number() OVER (ORDER BY status = 'running' DESC, at_us DESC, job_id) AS place FROM l WHERE n = 1 AND status IN ('running', 'queued')"))
def _(spark, d):
    last = C.latest(A.jobs(spark, d), ["job_id"], [F.col("at_us").desc(), F.col("event_id").desc()]).where(F.col("status").isin("running", "queued"))
    order = [(F.col("status") == "running").desc(), F.col("at_us").desc(), F.col("job_id").asc()]
    return C.ranked(last.select("job_id", "status", "at_us"), order, 32, kept).select("job_id", "status", "place")


@query("i01_union_in_order", "WITH u AS (SELECT l_partkey AS ref, 1 AS src FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, 2 FROM lineitem WHERE l_returnflag = 'R') SELECT ref, min(src) AS src FROM u WHERE ref NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) GROUP BY 1")
def _(spark, d):
    li = A.table(spark, d, "lineitem")
    src = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2)
    by = li.groupBy(F.col("l_partkey").alias("ref")).agg(F.min(src).alias("src"), F.bool_or(F.col("l_quantity") == 50).alias("_chosen"))
    return by.where("src IS NOT NULL AND NOT (coalesce(_chosen, false) AND ref IS NOT NULL)").select("ref", "src")


@query("i02_sets", "SELECT l_partkey AS ref, 'both' AS what FROM (SELECT l_partkey FROM lineitem WHERE l_tax = 0 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount = 0) UNION ALL SELECT l_partkey, 'first' FROM (SELECT l_partkey FROM lineitem WHERE l_tax = 0 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount = 0)")
def _(spark, d):
    li = A.table(spark, d, "lineitem")
    a, b = li.where("l_tax = 0").select(F.col("l_partkey").alias("ref")), li.where("l_discount = 0").select(F.col("l_partkey").alias("ref"))
    return a.intersect(b).withColumn("what", F.lit("both")).unionByName(a.subtract(b).withColumn("what", F.lit("first")))


@query("i03_superset", "WITH h AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS have FROM lineitem GROUP BY 1) SELECT l_orderkey, list_has_all(have, ['A', 'R']) AS ok FROM h")
def _(spark, d):
    h = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    return h.select("l_orderkey", (F.size(F.array_except(F.array(F.lit("A"), F.lit("R")), "have")) == 0).alias("ok"))


@query("k02_board", f"""WITH {STATUS}, li AS (SELECT l_orderkey, count(*) AS exports, max(l_shipdate) AS newest FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT o_custkey, o_orderkey, status, coalesce(exports, 0) AS exports, newest, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM st LEFT JOIN li ON l_orderkey = o_orderkey""")
def _(spark, d):
    li = A.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("exports"), F.max("l_shipdate").alias("newest"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return stated(spark, d).join(li, "o_orderkey", "left").select("o_custkey", "o_orderkey", "status", F.coalesce("exports", F.lit(0)).alias("exports"), "newest", place.alias("place"))


# A customer is a run, two orders a clip key, a line an item: of them some failed, are drafts or have no artifact.
BOARD = """cl AS (SELECT o_custkey AS run_id, o_orderkey % 8 AS clip_key, o_orderkey AS pos, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 11 END AS rank FROM orders), st AS (SELECT o_custkey AS run_id, o_orderkey % 8 AS clip_key, bool_or(o_totalprice > 400000) AS posted, bool_or(o_orderpriority = '5-LOW') AS discarded, bool_or(o_orderkey % 7 = 0) AS saved, bool_or(o_orderstatus = 'O') AS approved FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2),
  it AS (SELECT o_custkey AS run_id, o_orderkey % 8 AS clip_key, CASE WHEN l_linenumber <> 6 THEN l_orderkey * 10 + l_linenumber END AS artifact_id, CASE l_returnflag WHEN 'N' THEN 'failed' ELSE 'succeeded' END AS status, l_shipdate AS exported_at, CASE WHEN l_linenumber <> 7 THEN l_linenumber = 5 END AS draft FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  ex AS (SELECT run_id, clip_key, count(*) AS exports, max(exported_at) AS newest FROM it WHERE status = 'succeeded' AND artifact_id IS NOT NULL AND NOT coalesce(draft, false) GROUP BY 1, 2),
  bd AS (SELECT c.run_id, c.clip_key, rank, CAST(row_number() OVER (PARTITION BY c.run_id ORDER BY rank NULLS LAST, pos) AS INTEGER) AS place, coalesce(exports, 0) AS exports, newest, CASE WHEN posted THEN 'posted' WHEN discarded THEN 'discarded' WHEN saved THEN 'saved' WHEN exports > 0 THEN 'exported' WHEN approved THEN 'approved' ELSE 'new' END AS status
    FROM (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY run_id, clip_key ORDER BY pos) = 1) c LEFT JOIN st ON st.run_id = c.run_id AND st.clip_key = c.clip_key LEFT JOIN ex ON ex.run_id = c.run_id AND ex.clip_key = c.clip_key)"""


def exported(spark, d):
    o = orders(spark, d).select(F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 8).alias("clip_key"), F.col("o_orderkey").alias("l_orderkey"))
    n = F.col("l_linenumber")
    rows = A.table(spark, d, "lineitem").join(o, "l_orderkey")
    return rows.select("run_id", "clip_key", F.when(n != 6, F.col("l_orderkey") * 10 + n).alias("artifact_id"), F.when(F.col("l_returnflag") == "N", "failed").otherwise("succeeded").alias("status"), F.col("l_shipdate").alias("exported_at"), F.when(n != 7, n == 5).alias("draft"))


def boarded(spark, d):
    o = orders(spark, d).withColumn("clip_key", (F.col("o_orderkey") % 8)).withColumnRenamed("o_custkey", "run_id")
    clips = o.select("run_id", "clip_key", F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 11).alias("rank"))
    flags = [("posted", F.col("o_totalprice") > 400000), ("discarded", F.col("o_orderpriority") == "5-LOW"), ("saved", F.col("o_orderkey") % 7 == 0), ("approved", F.col("o_orderstatus") == "O")]
    states = o.where("o_orderkey % 3 <> 0").groupBy("run_id", "clip_key").agg(*(F.bool_or(f).alias(n) for n, f in flags))
    return C.board(clips, states, exported(spark, d))


@query("k02_clip_board", f"WITH {BOARD} SELECT * FROM bd")
def _(spark, d):
    return boarded(spark, d)


@query("k02_counts", f"WITH {BOARD} SELECT run_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in C.STATUSES) + ", count(*) AS total FROM bd GROUP BY 1")
def _(spark, d):
    return C.status_counts(boarded(spark, d), ["run_id"], "status")


@query("k02_other_exports", f"WITH {BOARD}, rn AS (SELECT l_suppkey AS project_id, l_orderkey * 10 + l_linenumber AS artifact_id, l_shipdate AS created_at, l_linenumber = 3 AS draft FROM lineitem WHERE l_linenumber <> 2 UNION ALL SELECT l_suppkey, l_orderkey * 10 + 8, l_shipdate, l_linenumber = 1 AND l_orderkey % 5 = 0 FROM lineitem WHERE l_linenumber = 1) "
  "SELECT project_id, artifact_id, created_at, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, artifact_id) AS INTEGER) AS place FROM rn WHERE NOT draft AND artifact_id NOT IN (SELECT artifact_id FROM it WHERE artifact_id IS NOT NULL)")
def _(spark, d):
    n, lines = F.col("l_linenumber"), A.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "project_id")
    renders = lines.where(n != 2).select("project_id", (F.col("l_orderkey") * 10 + n).alias("artifact_id"), F.col("l_shipdate").alias("created_at"), (n == 3).alias("draft"))
    more = lines.where(n == 1).select("project_id", (F.col("l_orderkey") * 10 + 8).alias("artifact_id"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") % 5 == 0).alias("draft"))
    return C.other_exports(renders.unionByName(more), exported(spark, d))


# A page is a source: five of them a project; addresses of several forms, without a video, or none.
SOURCES = r"""sr AS (SELECT page_id, page_id // 5 AS project_id, CASE WHEN page_id // 5 % 4 = 0 THEN NULL ELSE CASE page_id % 6 WHEN 0 THEN 'https://www.youtube.com/watch?list=x&v=' WHEN 1 THEN 'http://youtu.be/' WHEN 2 THEN 'https://m.youtube.com/live/' WHEN 3 THEN 'https://youtube.com/shorts/' WHEN 4 THEN 'https://example.com/watch?v=' END || lpad(CAST(page_id // 5 * 7 % 40 AS VARCHAR), CASE WHEN page_id % 11 = 0 THEN 10 ELSE 11 END, 'x_') END AS url FROM pages),
  vi AS (SELECT page_id, project_id, url, CASE WHEN page_id // 5 % 4 <> 0 AND page_id % 6 < 4 AND page_id % 11 <> 0 THEN lpad(CAST(page_id // 5 * 7 % 40 AS VARCHAR), 11, 'x_') END AS video FROM sr)"""


def video_sources(spark, d):
    page, project = F.col("page_id"), F.floor(F.col("page_id") / 5)
    starts = ["https://www.youtube.com/watch?list=x&v=", "http://youtu.be/", "https://m.youtube.com/live/", "https://youtube.com/shorts/", "https://example.com/watch?v="]
    start = F.try_element_at(F.array(*map(F.lit, starts)), (page % 6 + 1).cast("int"))
    name = (project * 7 % 40).cast("string")
    name = F.when(page % 11 == 0, F.lpad(name, 10, "x_")).otherwise(F.lpad(name, 11, "x_"))
    return A.table(spark, d, "pages").select(page.alias("source_id"), project.alias("project_id"), F.when(project % 4 != 0, F.concat(start, name)).alias("url"))


@query("a17_canonical_id", f"WITH {SOURCES} SELECT page_id AS source_id, video FROM vi")
def _(spark, d):
    return video_sources(spark, d).select("source_id", T.video_id(F.col("url")).alias("video"))


@query("k08_episodes", f"""WITH {SOURCES}, nm AS (SELECT DISTINCT video AS episode_id, project_id FROM vi WHERE video IS NOT NULL), be AS (SELECT project_id FROM sr GROUP BY 1 HAVING count(url) = 0),
  ow AS (SELECT 'old-' || project_id % 90 AS episode_id, project_id FROM sr WHERE project_id % 3 = 0 UNION SELECT 'local-' || project_id, project_id FROM be WHERE project_id NOT IN (SELECT project_id FROM nm)),
  al AS (SELECT episode_id, true AS url, project_id, false AS held FROM nm UNION ALL SELECT episode_id, false, project_id, project_id IN (SELECT project_id FROM nm) FROM ow)
  SELECT episode_id, url, array_to_string(list(DISTINCT project_id ORDER BY project_id), ',') AS projects, bool_and(held) OR ends_with(episode_id, '7') AS hidden FROM al GROUP BY 1, 2""")
def _(spark, d):
    sources = video_sources(spark, d)
    projects = sources.select("project_id").distinct()
    local = projects.where("project_id % 3 = 0").select(F.concat(F.lit("old-"), (F.col("project_id") % 90).cast("string")).alias("episode_id"), "project_id")
    named = sources.select(T.video_id(F.col("url")).alias("episode_id")).unionByName(local.select("episode_id")).unionByName(projects.select(F.concat(F.lit("local-"), F.col("project_id").cast("string")).alias("episode_id")))
    out = C.episodes(projects, sources, named.where("episode_id LIKE '%7'"), local)
    return out.select("episode_id", "url", F.array_join(F.col("projects").cast("array<string>"), ",").alias("projects"), "hidden")


@query("f02_grouped", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1")
def _(spark, d):
    return orders(spark, d).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("items"))


@query("f03_unlinked", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders(spark, d).join(li, "o_orderkey", "left_anti").select("o_orderkey")


@query("k04_upsert", f"""WITH base AS (SELECT c_custkey AS k, 0 AS seen, c_mktsegment AS v FROM customer), ch AS (SELECT o_custkey AS k, o_orderkey AS seen, o_orderstatus AS v FROM orders), l AS (SELECT k, max(seen) AS seen, arg_max(v, seen) AS v FROM ch GROUP BY 1)
  SELECT k, seen, v, v AS made FROM l WHERE k NOT IN (SELECT k FROM base) UNION ALL SELECT base.k, coalesce(l.seen, base.seen) AS seen, coalesce(l.v, base.v), base.v FROM base LEFT JOIN l USING (k)""")
def _(spark, d):
    base = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("seen"), F.col("c_mktsegment").alias("v"), F.col("c_mktsegment").alias("made"))
    change = orders(spark, d).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seen"), F.col("o_orderstatus").alias("v"), F.col("o_orderstatus").alias("made"))
    return C.upsert(base, change, ["k"], "seen", keep=["made"])


@query("k05_insert_new", "SELECT l_partkey AS k, min(l_orderkey) AS seen FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1")
def _(spark, d):
    stored = A.table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    return C.insert_new(stored, A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("seen")), ["k"], "seen").select("k", "seen")


@query("k06_unique_content", "WITH h AS (SELECT doc_id, source, md5(text) AS h FROM documents) SELECT source, h, max(doc_id) AS doc_id, count(*) AS n FROM h GROUP BY 1, 2")
def _(spark, d):
    h = A.table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    return h.groupBy("source", "h").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("k08_hosts", r"WITH u AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://([^/]+)', 1), ''), 'local') AS host FROM pages) SELECT host, count(*) AS pages, min(page_id) AS first FROM u GROUP BY 1")
def _(spark, d):
    host = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")), F.lit("local"))
    return A.table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


@query("k10_since", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-06-01' AND o_orderstatus = 'F'")
def _(spark, d):
    return orders(spark, d).where("to_date(o_orderdate) >= date'1998-06-01' AND o_orderstatus = 'F'").select("o_orderkey")


@query("k19_progress", "SELECT o_orderpriority, 100 * count(*) FILTER (o_orderstatus = 'F') // greatest(1, count(*)) AS percent FROM orders GROUP BY 1")
def _(spark, d):
    return orders(spark, d).groupBy("o_orderpriority").agg(F.expr("100 * count_if(o_orderstatus = 'F') div greatest(1, count(*))").alias("percent"))


SETTINGS = "SELECT c_custkey AS k, 'segment' AS path, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer"
OVERRIDE = "SELECT c_custkey AS k, 'segment' AS path, CASE WHEN c_custkey % 6 = 0 THEN 'X' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'extra', 'y' FROM customer WHERE c_custkey % 5 = 0"


def settings(spark, d):
    c = A.table(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("k"), F.lit("segment").alias("path"), F.col("c_mktsegment").alias("value")).unionByName(c.select(F.col("c_custkey").alias("k"), F.lit("nation").alias("path"), F.col("c_nationkey").cast("string").alias("value")))
    changed = F.when(F.col("c_custkey") % 6 == 0, "X").otherwise(F.col("c_mktsegment"))
    over = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("segment").alias("path"), changed.alias("value")).unionByName(c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.lit("extra").alias("path"), F.lit("y").alias("value")))
    return base, over


@query("c19_deep_merge", f"WITH b AS ({SETTINGS}), o AS ({OVERRIDE}) SELECT coalesce(b.k, o.k) AS k, coalesce(b.path, o.path) AS path, coalesce(o.value, b.value) AS value FROM b FULL JOIN o ON b.k = o.k AND b.path = o.path")
def _(spark, d):
    return C.merged_settings(*settings(spark, d), ["k"])


@query("c20_diff", f"SELECT * FROM ({OVERRIDE}) EXCEPT ALL SELECT * FROM ({SETTINGS})")
def _(spark, d):
    return C.changed_settings(*settings(spark, d))


@query("f11_dimension", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    rows = A.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = C.with_dimension(rows, A.table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")), "c_custkey", most_rows=1_000)
    return C.with_dimension(rows, A.table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("o_orderkey", "c_mktsegment", "n_name")


def nested(spark, d):
    """Two documents a customer: sections that come, go, change, and turn into leaves."""
    k = F.col("k")
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", "c_nationkey")
    old = F.format_string('{"a": {"x": %d, "y": "%s"}, "b": %d, "c": {"d": {"e": [1, %d]}}}', k % 3, F.col("c_mktsegment"), F.col("c_nationkey") % 4, k % 2)
    new = F.format_string('{"a": %s, "b": %s, "c": {"d": {"e": [1, %d], "f": null}}}', F.when(k % 5 == 0, F.lit("7")).otherwise(F.format_string('{"x": %d, "z": "%s"}', k % 4, F.col("c_mktsegment"))), F.when(k % 7 == 0, F.lit('{"q": true}')).otherwise((F.col("c_nationkey") % 3).cast("string")), k % 3)
    return C.leaves(c.select("k", old.alias("settings"))), C.leaves(c.select("k", new.alias("settings")))


#: The leaves of both documents as SQL spells them out.
NESTED = """WITH o AS (SELECT c_custkey AS k, 'a.x' AS path, CAST(c_custkey % 3 AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, 'a.y', '"' || c_mktsegment || '"' FROM customer UNION ALL SELECT c_custkey, 'b', CAST(c_nationkey % 4 AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'c.d.e', '[1,' || c_custkey % 2 || ']' FROM customer),
  n AS (SELECT c_custkey AS k, 'a' AS path, '7' AS value FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'a.x', CAST(c_custkey % 4 AS VARCHAR) FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'a.z', '"' || c_mktsegment || '"' FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT c_custkey, 'b.q', 'true' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'b', CAST(c_nationkey % 3 AS VARCHAR) FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'c.d.e', '[1,' || c_custkey % 3 || ']' FROM customer UNION ALL SELECT c_custkey, 'c.d.f', 'null' FROM customer)"""


@query("c20_settings_diff", f"{NESTED} SELECT k, path, CASE WHEN n.value IS NULL THEN 'unset' ELSE 'set' END AS op, n.value FROM o FULL JOIN n USING (k, path) WHERE o.value IS DISTINCT FROM n.value")
def _(spark, d):
    return C.settings_diff(*nested(spark, d)).select("k", F.array_join("path", ".").alias("path"), "op", "value")


@query("c20_merged_again", f"{NESTED} SELECT k, path, value FROM n")
def _(spark, d):
    old, new = nested(spark, d)
    return C.apply_diff(old, C.settings_diff(old, new)).select("k", F.array_join("path", ".").alias("path"), "value")


@query("c20_without_paths", f"{NESTED} SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND (n.path = o.path OR starts_with(n.path, o.path || '.') OR starts_with(o.path, n.path || '.')))")
def _(spark, d):
    old, new = nested(spark, d)
    return C.without_paths(old, new).select("k", F.array_join("path", ".").alias("path"), "value")


@query("l02_transitions", A.sql("jobs", """r AS (SELECT *, coalesce(max(CASE WHEN status IN ('succeeded', 'failed') THEN 1 ELSE 0 END) OVER w, 0) AS ended, max(progress) OVER w AS best FROM jobs WINDOW w AS (PARTITION BY job_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT job_id, event_id, CASE WHEN ended = 1 THEN 'ended' ELSE 'progress' END AS reason FROM r WHERE ended = 1 OR progress < best"""))
def _(spark, d):
    return C.invalid_transitions(A.jobs(spark, d), "job_id", ["at_us", "event_id"]).select("job_id", "event_id", "reason")


@query("l03_stalled", A.sql("jobs", "l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_us DESC, event_id DESC) AS n FROM jobs) SELECT job_id, at_us FROM l WHERE n = 1 AND status = 'running' AND (SELECT max(at_us) FROM jobs) - at_us > 7200000000"))
def _(spark, d):
    return C.stalled(A.jobs(spark, d), "job_id", "at_us", 7_200_000_000)


@query("l05_elapsed", A.sql("jobs", "SELECT job_id, max(at_us) - min(at_us) AS elapsed_us, arg_max(status, (at_us, event_id)) AS status FROM jobs GROUP BY 1"))
def _(spark, d):
    return A.jobs(spark, d).groupBy("job_id").agg((F.max("at_us") - F.min("at_us")).alias("elapsed_us"), F.max_by("status", F.struct("at_us", "event_id")).alias("status"))


#: The job log up to where the stream's watermark ends, numbered by job.
LOG = """wm AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS passed FROM events),
  lg AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_us, event_id) AS k FROM jobs, wm WHERE (at_us + 999) // 1000 < passed)"""


@query("l01_changes", A.sql("jobs", f"""{LOG}, g AS (SELECT DISTINCT job_id, 0::BIGINT AS k, NULL::VARCHAR AS status, NULL::BIGINT AS at_us, NULL::BIGINT AS event_id, false AS said FROM lg
    UNION ALL SELECT l.job_id, l.k, CASE WHEN y THEN l.status ELSE g.status END, CASE WHEN y THEN l.at_us ELSE g.at_us END, l.event_id, y
    FROM (SELECT l.*, g.status AS gs, g.status IS NULL OR l.at_us > g.at_us + 86400000000 OR (g.status NOT IN ('succeeded', 'failed') AND g.status <> l.status) AS y FROM g JOIN lg l ON l.job_id = g.job_id AND l.k = g.k + 1) l JOIN g ON g.job_id = l.job_id AND l.k = g.k + 1)
  SELECT job_id, event_id, status FROM g WHERE said"""))
def _(spark, d):
    return J.drained(J.changes(J.job_log(J.events(spark, d)).drop("progress")), "append", folder(spark))


#: Each job's log as a recursion that carries its status, progress, time and whether it has ended.
LIVES = f"""{LOG}, g AS (SELECT DISTINCT job_id, 0::BIGINT AS k, '' AS status, NULL::INTEGER AS progress, NULL::BIGINT AS at_us, false AS ended, NULL::BIGINT AS event_id, NULL::BIGINT AS event_us, NULL::VARCHAR AS event_status, NULL::VARCHAR AS reason, NULL::BIGINT AS stalled_us FROM lg
    UNION ALL SELECT job_id, k, CASE WHEN reason IS NULL THEN e_status ELSE status1 END, CASE WHEN reason IS NOT NULL THEN progress1 WHEN e_status = 'succeeded' THEN 100 ELSE coalesce(e_progress, progress1) END, CASE WHEN reason IS NULL THEN e_at ELSE at1 END,
      CASE WHEN reason IS NULL THEN e_status IN ('succeeded', 'failed') ELSE ended1 END, event_id, e_at, e_status, reason, stalled_us
    FROM (SELECT *, CASE WHEN ended1 THEN 'ended' WHEN NOT CASE status1 WHEN '' THEN e_status IN ('queued', 'running') WHEN 'queued' THEN e_status IN ('queued', 'running', 'failed') WHEN 'running' THEN e_status IN ('running', 'succeeded', 'failed') ELSE false END THEN 'move' WHEN e_progress < progress1 THEN 'progress' END AS reason
      FROM (SELECT *, CASE WHEN gone THEN '' WHEN stalled_us IS NOT NULL THEN 'failed' ELSE status END AS status1, CASE WHEN gone THEN NULL ELSE progress END AS progress1, CASE WHEN gone THEN NULL ELSE coalesce(stalled_us, at_us) END AS at1, CASE WHEN gone THEN false ELSE ended OR stalled_us IS NOT NULL END AS ended1
        FROM (SELECT *, coalesce(e_at > coalesce(stalled_us, at_us) + 86400000000, false) AS gone
          FROM (SELECT l.job_id, l.k, l.event_id, l.at_us AS e_at, l.status AS e_status, l.progress AS e_progress, g.status, g.progress, g.at_us, g.ended, CASE WHEN g.status = 'running' AND NOT g.ended AND l.at_us > g.at_us + 7200000000 THEN g.at_us + 7200000000 END AS stalled_us
            FROM g JOIN lg l ON l.job_id = g.job_id AND l.k = g.k + 1)))))"""


def lives(spark, d):
    return J.drained(J.lifecycle(J.job_log(J.events(spark, d))), "append", folder(spark))


@query("l02_lifecycle", A.sql("jobs", f"{LIVES} SELECT job_id, event_id, event_us AS at_us, event_status AS status, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict, reason FROM g WHERE k > 0"))
def _(spark, d):
    return lives(spark, d).where("verdict <> 'failed'")


@query("l03_failed", A.sql("jobs", f"""{LIVES} SELECT job_id, stalled_us AS at_us FROM g WHERE stalled_us IS NOT NULL
  UNION ALL SELECT job_id, at_us + 7200000000 FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k DESC) = 1), wm WHERE status = 'running' AND NOT ended AND (at_us + 7200000999) // 1000 < passed"""))
def _(spark, d):
    return lives(spark, d).where("verdict = 'failed'").select("job_id", "at_us")


@query("l04_throttle", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, max(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events),
  g AS (SELECT user_id, k, event_id, best, us AS last, true AS said FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id, e.best, CASE WHEN e.us - last >= 3600000000 THEN e.us ELSE last END, e.us - last >= 3600000000 FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
  SELECT user_id AS job_id, event_id, best FROM g WHERE said""")
def _(spark, d):
    return J.drained(J.throttled(J.events(spark, d)), "append", folder(spark))


@query("l06_unique", "SELECT event_id, user_id AS job_id, event_type FROM events")
def _(spark, d):
    # Every seventh event comes twice.
    stream = J.events(spark, d).union(J.events(spark, d).where("event_id % 7 = 0"))
    return J.drained(J.unique(stream).select("event_id", "job_id", "event_type"), "append", folder(spark))


@query("l07_density", A.sql("timed", "b AS (SELECT start_us, end_us, unnest(range(start_us // 3600000000, (end_us - 1) // 3600000000 + 1)) AS w FROM timed WHERE end_us > start_us), s AS (SELECT w, CAST(sum(least(end_us, (w + 1) * 3600000000) - greatest(start_us, w * 3600000000)) AS BIGINT) AS us, count(*) AS n FROM b GROUP BY 1) SELECT w AS window_id, us AS speech_us, n, round(least(1.0::DOUBLE, us / 3600000000), 6) AS ratio FROM s"))
def _(spark, d):
    start = F.unix_micros("at")
    spans = J.events(spark, d).select("at", start.alias("start_us"), (start + F.round(F.col("value") * 100).cast("long") * A.MINUTE).alias("end_us"))
    return J.drained(J.density(spans), "complete", folder(spark))


@query("l08_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id AS job_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, g")
def _(spark, d):
    out = J.drained(J.utterances(J.events(spark, d)), "complete", folder(spark))
    return out.select("job_id", F.unix_micros("start").alias("start_us"), "n")
