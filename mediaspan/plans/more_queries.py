"""Queries on clip text, lesson sounds, slots and shares, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.functions import text as T
from mediaspan.operators import spans as S
from mediaspan.operators.catalog import is_draft, rescaled
from mediaspan.operators.selection import POINTERS, dangling
from mediaspan.operators import vectors as V
from mediaspan.operators import words as W
from mediaspan.plans.span_queries import HOURS, SEGMENTS, TIMELINE, segments
from mediaspan.plans.word_queries import BY, fold_sql
from mediaspan.sources import adapters as A
from mediaspan.sources.scratch import dealt_once

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put




@query("c05_without_hesitations", r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(text, '(?i)(^|[^\p{L}])(eh|ah|ãh|ã|hum|hã|uhm|uh|hmm|hmmm|ahn)($|[^\p{L}])', '\1\3', 'g'), ' +', ' ', 'g'))) AS h FROM conversations")
def _(spark, d):
    # No hesitation stands next to another in this table, so one pass of either engine suffices.
    return A.table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.without_hesitations(F.col("text"))).alias("h"))


@query("c08_headline", r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, nullif(left(array_to_string(ls, chr(10)), 120), '') AS headline FROM l")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.headline(F.col("text")).alias("headline"))


# Every third turn gets a pointer to open with, in one of several forms.
OPENED = "CASE WHEN (media_id + pos) % 3 = 0 THEN CASE pos % 4 WHEN 0 THEN 'Isso, ' WHEN 1 THEN 'ela ' WHEN 2 THEN '\"Aquele\" ' ELSE 'issox ' END || text ELSE text END"


@query("c13_dangling", A.sql("turns", f"o AS (SELECT media_id, pos, lower(trim(string_split(trim({OPENED}), ' ')[1], '.,;:!?…\"''()[]{{}}<>*#%$&|-“”‘’–—')) AS opens FROM turns) SELECT media_id, pos, opens FROM o WHERE pos > 0 AND opens IN {POINTERS}"))
def _(spark, d):
    opener = F.when(F.col("pos") % 4 == 0, "Isso, ").when(F.col("pos") % 4 == 1, "ela ").when(F.col("pos") % 4 == 2, '"Aquele" ').otherwise("issox ")
    pieces = A.turns(spark, d).withColumn("text", F.when((F.col("media_id") + F.col("pos")) % 3 == 0, F.concat(opener, F.col("text"))).otherwise(F.col("text")))
    return dangling(pieces.select("media_id", "pos", "text"))


@query("c14_draft", "SELECT page_id, coalesce(page_id % 5 = 2, false) OR (page_id % 3 = 0 AND page_id % 2 = 0) AS draft FROM pages")
def _(spark, d):
    page = F.col("page_id")
    path = F.concat(F.lit("/renders/"), F.when(page % 3 == 0, F.concat(F.when(page % 2 == 0, "draft-").otherwise("final-draft-"), page.cast("string"))).otherwise(page.cast("string")), F.lit(".mp4"))
    purpose = F.when(page % 5 == 2, "draft").when(page % 5 == 3, "export")
    return A.table(spark, d, "pages").select("page_id", is_draft(path, purpose).alias("draft"))


@query("c15_complete", "SELECT doc_id, trim(coalesce(text, '')) <> '' AND trim(coalesce(source, '')) <> '' AND trim(coalesce(lang, '')) <> '' AS complete FROM documents")
def _(spark, d):
    filled = [F.btrim(F.coalesce(c, F.lit(""))) != "" for c in ("text", "source", "lang")]
    return A.table(spark, d, "documents").select("doc_id", (filled[0] & filled[1] & filled[2]).alias("complete"))


@query("c16_within_bounds", A.sql("tracks", "SELECT id, end_us - start_us BETWEEN 1500000000 AND 18000000000 AS ok FROM tracks"))
def _(spark, d):
    return A.tracks(spark, d).select("id", (F.col("end_us") - F.col("start_us")).between(1_500_000_000, 18_000_000_000).alias("ok"))


# Seven legacy parts of a score; one customer in three lacks the last.
LEGACY = ("hook", "clarity", "story", "emotion", "value", "pace", "ending")


@query("c17_old_scores", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN round(CAST(round(c_acctbal) AS BIGINT) / 3.5::DOUBLE, 1) ELSE CAST(round(c_acctbal) AS BIGINT) END AS score FROM customer")
def _(spark, d):
    parts = [x for k in LEGACY[:-1] for x in (F.lit(k), F.lit(1))]
    scores = F.map_concat(F.create_map(*parts), F.when(F.col("c_custkey") % 3 != 0, F.create_map(F.lit(LEGACY[-1]), F.lit(1))).otherwise(F.create_map().cast("map<string, int>")))
    c = A.table(spark, d, "customer").select("c_custkey", scores.alias("scores"), F.round("c_acctbal").cast("double").alias("score"))
    return c.select("c_custkey", rescaled(F.col("score"), F.col("scores"), LEGACY).alias("score"))


@query("c18_public", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal < 0 AS owes FROM customer")
def _(spark, d):
    row = F.struct("c_name", "c_mktsegment", "c_acctbal").alias("r")
    return A.table(spark, d, "customer").select("c_custkey", row, (F.col("c_acctbal") < 0).alias("owes")).withColumn("r", F.col("r").dropFields("c_acctbal")).select("c_custkey", "r.*", "owes")


@query("c27_export_rows", "SELECT o_orderkey, c_custkey, c_name, CASE WHEN o_orderpriority = '1-URGENT' THEN c_mktsegment END AS teaser FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def _(spark, d):
    met = A.table(spark, d, "orders").where("o_orderstatus = 'F'").join(A.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return met.select("o_orderkey", "c_custkey", "c_name", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("c_mktsegment")).alias("teaser"))


# Two of three runs of 90 words are pieces, whose edges cut words; every sixth reaches into the next run.
@query("d04_piece_phrases", A.sql("words", """r AS (SELECT media_id, idx // 90 AS piece, min(start_us) + 100000 AS start_us, max(end_us) + CASE WHEN idx // 90 % 6 = 0 THEN 1500000 ELSE -120000 END AS end_us FROM words GROUP BY media_id, idx // 90), q AS (SELECT *, piece // 4 AS clip_id FROM r WHERE piece % 3 < 2 AND end_us > start_us),
  i AS (SELECT q.media_id, clip_id, piece, idx, word, greatest(w.start_us, q.start_us) AS start_us, least(w.end_us, q.end_us) AS end_us FROM q JOIN words w ON w.media_id = q.media_id AND w.start_us < q.end_us AND q.start_us < w.end_us),
  m AS (SELECT *, coalesce(regexp_matches(lag(word) OVER w, '[.!?…,]$') OR start_us - lag(end_us) OVER w >= 250000, true) AS new FROM i WINDOW w AS (PARTITION BY media_id, clip_id, piece ORDER BY idx)),
  g AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY media_id, clip_id, piece ORDER BY idx) AS run FROM m), k AS (SELECT *, (row_number() OVER (PARTITION BY media_id, clip_id, piece, run ORDER BY idx) - 1) // 14 AS part FROM g),
  p AS (SELECT media_id, clip_id, piece, min(idx) AS first_idx, max(idx) AS last_idx, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_words FROM k GROUP BY media_id, clip_id, piece, run, part)
  SELECT row_number() OVER (PARTITION BY media_id, clip_id ORDER BY piece, first_idx) - 1 AS phrase, * FROM p"""))
def _(spark, d):
    words = A.words(spark, d)
    r = words.groupBy("media_id", F.floor(F.col("idx") / 90).alias("piece")).agg((F.min("start_us") + 100_000).alias("start_us"), F.max("end_us").alias("end_us"))
    r = r.withColumn("end_us", F.col("end_us") + F.when(F.col("piece") % 6 == 0, 1_500_000).otherwise(-120_000)).withColumn("clip_id", F.floor(F.col("piece") / 4))
    with dealt_once(spark):
        return W.piece_phrases(A.words(spark, d, True), r.where("piece % 3 < 2"), 60_000_000, True)


@query("d07_teaser", "WITH g AS (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN len(ids) > 4 THEN 'long' WHEN list_max(ids) - list_min(ids) + 1 <> len(ids) THEN 'gap' ELSE 'ok' END AS reason FROM g")
def _(spark, d):
    g = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ids"))
    gap = F.array_max("ids") - F.array_min("ids") + 1 != F.size("ids")
    return g.select("l_orderkey", F.when(F.size("ids") > 4, "long").when(gap, "gap").otherwise("ok").alias("reason"))


@query("d15_page_flags", A.sql("words", "SELECT media_id, idx // 10 AS page, bool_or((idx * 37 + media_id * 11) % 100 < 6) AS doubtful, min(start_us) <= 30000000 AND max(end_us) > 30000000 AS now FROM words GROUP BY 1, 2"))
def _(spark, d):
    w = A.words(spark, d).groupBy("media_id", F.floor(F.col("idx") / 10).alias("page"))
    return w.agg(F.bool_or((F.col("idx") * 37 + F.col("media_id") * 11) % 100 < 6).alias("doubtful"), ((F.min("start_us") <= 30_000_000) & (F.max("end_us") > 30_000_000)).alias("now"))


@query("e15_slots", A.sql("words", f"n AS (SELECT *, lead(start_us) OVER ({BY}) AS after FROM words) SELECT media_id, idx, end_us AS slot_us, CASE WHEN regexp_matches(word, '[.!?…]$') THEN 100 ELSE 85 END AS weight FROM n WHERE regexp_matches(word, '[.!?…,;:]$') AND after - end_us >= 300000"))
def _(spark, d):
    w = A.words(spark, d).withColumn("after", F.lead("start_us").over(Window.partitionBy("media_id").orderBy("idx")))
    ends = T.sentence_end(F.col("word")) | T.clause_end(F.col("word"))
    return w.where(ends & (F.col("after") - F.col("end_us") >= 300_000)).select("media_id", "idx", F.col("end_us").alias("slot_us"), F.when(T.sentence_end(F.col("word")), 100).otherwise(85).alias("weight"))


@query("e17_live_wide", A.sql("points clips", """a AS (SELECT p.media_id, p.point_id, (SELECT CASE WHEN c.end_us > p.t_us THEN c.clip_id END FROM clips c WHERE c.media_id = p.media_id AND c.start_us <= p.t_us ORDER BY c.start_us DESC, c.clip_id DESC LIMIT 1) AS x,
  (SELECT CASE WHEN c.end_us > p.t_us + 600000000 THEN c.clip_id END FROM clips c WHERE c.media_id = p.media_id AND c.start_us <= p.t_us + 600000000 ORDER BY c.start_us DESC, c.clip_id DESC LIMIT 1) AS y FROM points p) SELECT media_id, point_id, x AS clip_id FROM a WHERE x = y"""))
def _(spark, d):
    p, c = A.points(spark, d), A.clips(spark, d)
    both = S.asof(S.asof(p, c, "clip_id").withColumnRenamed("clip_id", "x").withColumn("t_us", F.col("t_us") + 600_000_000), c, "clip_id")
    return both.where("x = clip_id").select("media_id", "point_id", "clip_id")


@query("e20_verified_top", A.sql("clips", "r AS (SELECT media_id, clip_id, row_number() OVER (PARTITION BY media_id, clip_id % 5 ORDER BY end_us - start_us DESC, clip_id) AS n FROM clips) SELECT media_id, clip_id FROM r WHERE n <= 3 AND clip_id IN (SELECT l_orderkey FROM lineitem)"))
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("media_id", F.col("clip_id") % 5).orderBy((F.col("end_us") - F.col("start_us")).desc(), "clip_id"))
    used = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip_id")).distinct()
    return A.clips(spark, d).withColumn("n", n).where("n <= 3").join(used, "clip_id", "left_semi").select("media_id", "clip_id")


@query("e27_anchors", A.sql("words turns", """c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 't' WHEN 1 THEN 'end' ELSE 'word' END AS kind FROM conversations), w AS (SELECT media_id, min(start_us) AS heard FROM words WHERE lower(word) = 'the' GROUP BY 1), e AS (SELECT media_id, max(end_us) AS last FROM words GROUP BY 1)
  SELECT conv_id, turn, CASE kind WHEN 't' THEN turn * 1000000 WHEN 'end' THEN last ELSE heard END AS at_us FROM c LEFT JOIN w ON w.media_id = conv_id LEFT JOIN e ON e.media_id = conv_id"""))
def _(spark, d):
    words = A.words(spark, d)
    known = words.groupBy(F.col("media_id").alias("conv_id")).agg(F.min(F.when(F.lower("word") == "the", F.col("start_us"))).alias("heard"), F.max("end_us").alias("last"))
    kind = F.col("turn") % 3
    at = F.when(kind == 0, F.col("turn") * 1_000_000).when(kind == 1, F.col("last")).otherwise(F.col("heard"))
    return A.table(spark, d, "conversations").join(known, "conv_id", "left").select("conv_id", "turn", at.alias("at_us"))


@query("e29_default_cues", A.sql("clips", f"{SEGMENTS}, m AS (SELECT plan_id, max(pos) AS last FROM seg GROUP BY 1) SELECT plan_id, pos, CASE WHEN pos = 0 THEN 'open' WHEN pos = last THEN 'close' ELSE 'join' END AS role FROM seg JOIN m USING (plan_id) WHERE pos = 0 OR pos = last OR piece = 1"))
def _(spark, d):
    rows = segments(spark, d).withColumn("last", F.max("pos").over(Window.partitionBy("plan_id")))
    role = F.when(F.col("pos") == 0, "open").when(F.col("pos") == F.col("last"), "close").otherwise("join")
    return rows.where("pos = 0 OR pos = last OR piece = 1").select("plan_id", "pos", role.alias("role"))


@query("e34_below_minimum", A.sql("clips", "SELECT clip_id, coalesce(end_us - start_us < CASE WHEN clip_id % 4 <> 0 THEN 3000000000 END - 500000, false) AS below FROM clips"))
def _(spark, d):
    least = F.when(F.col("clip_id") % 4 != 0, 3_000_000_000)
    return A.clips(spark, d).select("clip_id", F.coalesce(F.col("end_us") - F.col("start_us") < least - 500_000, F.lit(False)).alias("below"))


@query("f12_membership", "WITH s AS (SELECT l_suppkey, list_distinct(list(l_partkey)) AS ps FROM lineitem GROUP BY 1), u AS (SELECT l_suppkey, unnest(ps) AS p FROM s) SELECT l_suppkey, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM u JOIN part ON p_partkey = p GROUP BY 1")
def _(spark, d):
    s = A.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("ps"))
    return s.select("l_suppkey", F.explode("ps").alias("p_partkey")).join(A.table(spark, d, "part"), "p_partkey").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("g04_approval", A.sql("decisions", "SELECT media_id, count(*) AS n, round(count(*) FILTER (verdict = 'approved') / nullif(count(*), 0), 6) AS rate FROM decisions GROUP BY 1"))
def _(spark, d):
    return A.decisions(spark, d).groupBy("media_id").agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if(F.col("verdict") == "approved"), F.count("*")), 6).alias("rate"))


@query("g09_quiet_five", A.sql("tracks", "q AS (SELECT t.media_id, t.id, (t.end_us - t.start_us) // 600000 AS level FROM tracks t WHERE t.label = 'error' AND NOT EXISTS (SELECT 1 FROM tracks c WHERE c.label = 'click' AND c.media_id = t.media_id AND c.end_us > c.start_us AND t.start_us >= c.start_us AND t.start_us < c.end_us)), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY level, id) AS n FROM q) SELECT media_id, id, level FROM r WHERE n <= 5"))
def _(spark, d):
    t = A.tracks(spark, d)
    dot = t.where("label = 'error'").select("media_id", "id", F.col("start_us").alias("right_start_us"), (F.col("start_us") + 1).alias("right_end_us"))
    busy = S.overlap_join(t.where("label = 'click'").select("media_id", "start_us", "end_us"), dot, HOURS).select("media_id", "id").distinct()
    quiet = t.where("label = 'error'").select("media_id", "id", F.floor((F.col("end_us") - F.col("start_us")) / 600_000).alias("level")).join(busy, ["media_id", "id"], "left_anti")
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("level", "id"))
    return quiet.withColumn("n", n).where("n <= 5").select("media_id", "id", "level")


@query("g14_summary", A.sql("tracks", "SELECT media_id, label, count(*) AS n, CAST(sum((end_us - start_us) // 600000) AS BIGINT) AS total, max((end_us - start_us) // 600000) AS longest FROM tracks GROUP BY 1, 2"))
def _(spark, d):
    n = F.floor((F.col("end_us") - F.col("start_us")) / 600_000)
    return A.tracks(spark, d).groupBy("media_id", "label").agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.max(n).alias("longest"))


@query("h03_nulls_last", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders")
def _(spark, d):
    rank = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return A.table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank.asc_nulls_last(), "o_orderkey")).alias("place"))


@query("j01_unit", A.sql("keyframes", "n AS (SELECT idx, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS n, v FROM keyframes), e AS (SELECT idx, n, unnest(v) AS x, unnest(range(len(v))) AS place FROM n) SELECT idx, place, round(x / n, 6) AS x FROM e"))
def _(spark, d):
    u = A.keyframes(spark, d).select("idx", F.posexplode(V.unit("v")).alias("place", "x"))
    return u.select("idx", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("j03_span_mean", A.sql("keyframes", "e AS (SELECT media_id, idx // 40 AS span, unnest(v) AS x, unnest(range(len(v))) AS place FROM keyframes), s AS (SELECT media_id, span, place, CAST(sum(x) AS BIGINT) AS x FROM e GROUP BY 1, 2, 3), n AS (SELECT media_id, span, count(*) AS frames FROM (SELECT media_id, idx // 40 AS span FROM keyframes) GROUP BY 1, 2) SELECT media_id, span, frames, array_to_string(list(x ORDER BY place), ',') AS v FROM s JOIN n USING (media_id, span) WHERE frames >= 3 GROUP BY 1, 2, 3"))
def _(spark, d):
    rows = A.keyframes(spark, d).withColumn("span", F.floor(F.col("idx") / 40))
    return V.sums(rows, ["media_id", "span"]).where("n >= 3").select("media_id", "span", F.col("n").alias("frames"), F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


@query("j08_calibration_units", A.sql("turns", "u AS (SELECT media_id, pos, speaker, start_us, end_us FROM turns WHERE end_us - start_us >= 2000000), f AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM turns o WHERE o.media_id = u.media_id AND o.speaker <> u.speaker AND o.start_us < u.end_us AND u.start_us < o.end_us)), r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY media_id, pos) - 1 AS k, count(*) OVER (PARTITION BY speaker) AS n FROM f) SELECT media_id, pos, speaker FROM r WHERE n <= 400 OR k IN (SELECT round_even(i * (n - 1) / 399, 0) FROM range(400) t(i))"))
def _(spark, d):
    from mediaspan.operators.catalog import spread

    t = A.turns(spark, d)
    u = t.where("end_us - start_us >= 2000000").select("media_id", "pos", "speaker", "start_us", "end_us")
    met = S.overlap_join(u, S.right_side(t.select("media_id", "start_us", "end_us", F.col("speaker").alias("other"))), 10_000_000).where("speaker <> other").select("media_id", "pos").distinct()
    return spread(u.join(met, ["media_id", "pos"], "left_anti"), ["speaker"], ["media_id", "pos"], 400).select("media_id", "pos", "speaker")


@query("k14_voice_accepted", A.sql("turns", """e AS (SELECT media_id, speaker, sum(end_us - start_us) AS us FROM turns GROUP BY 1, 2), s AS (SELECT media_id, CAST(sum(us) FILTER (speaker = 'user') AS BIGINT) AS own, CAST(sum(us) AS BIGINT) AS total FROM e GROUP BY 1) SELECT media_id, coalesce(2 * own >= total, false) AS accepted FROM s"""))
def _(spark, d):
    size = F.col("end_us") - F.col("start_us")
    s = A.turns(spark, d).groupBy("media_id").agg(F.sum(F.when(F.col("speaker") == "user", size)).alias("own"), F.sum(size).alias("total"))
    return s.select("media_id", F.coalesce(2 * F.col("own") >= F.col("total"), F.lit(False)).alias("accepted"))


@query("k18_shot_report", A.sql("clips", f"{TIMELINE} SELECT plan_id, pos, out_us, end_us - start_us AS needed_us, CASE WHEN end_us - start_us <= 4000000000 THEN 4 WHEN end_us - start_us <= 8000000000 THEN 8 END AS offered FROM t"))
def _(spark, d):
    need = F.col("end_us") - F.col("start_us")
    offered = F.array_min(F.filter(F.array(F.lit(4), F.lit(8)), lambda x: x * F.lit(1_000_000_000).cast("long") >= need))
    return S.timeline(segments(spark, d)).select("plan_id", "pos", "out_us", need.alias("needed_us"), offered.alias("offered"))
