"""Queries on words, text and captions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspan.functions import text as T
from mediaspan.operators import words as W
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


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOKEN = f"lower(trim(word, {lit(T.MARKS)}))"
BY = "PARTITION BY media_id ORDER BY idx"
HES = ", ".join(lit(x) for x in T.HESITATIONS)


@query("a01_words", A.sql("words", "SELECT media_id, idx, start_us, end_us, word FROM words"))
def _(spark, d):
    return A.words(spark, d)


@query("c01_token", A.sql("words", f"SELECT {TOKEN} AS token, count(*) AS n FROM words GROUP BY 1"))
def _(spark, d):
    return A.words(spark, d).groupBy(T.token(F.col("word")).alias("token")).agg(F.count("*").alias("n"))


@query("c02_word_key", A.sql("words", r"SELECT regexp_replace(lower(word), '[^\p{L}\p{N}_]', '', 'g') AS k, count(*) AS n FROM words GROUP BY 1"))
def _(spark, d):
    return A.words(spark, d).groupBy(T.word_key(F.col("word")).alias("k")).agg(F.count("*").alias("n"))


@query("c03_phrase", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_ ]', ' ', 'g'), ' +', ' ', 'g'))) AS h FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.md5(T.phrase(F.col("text"))).alias("h"))


@query("c04_plain", A.sql("words", f"SELECT regexp_replace(lower(translate(word, {lit(T.ACCENTED)}, {lit(T.PLAIN)})), '[^a-z0-9]', '', 'g') AS k, count(*) AS n FROM words GROUP BY 1"))
def _(spark, d):
    return A.words(spark, d).groupBy(T.plain(F.col("word")).alias("k")).agg(F.count("*").alias("n"))


@query("c06_pauses_by_mark", A.sql("words", "SELECT media_id, count(*) FILTER (regexp_matches(word, '[.!?…]$')) AS sentences, count(*) FILTER (regexp_matches(word, '[,;:]$')) AS clauses FROM words GROUP BY 1"))
def _(spark, d):
    return A.words(spark, d).groupBy("media_id").agg(F.count_if(T.sentence_end(F.col("word"))).alias("sentences"), F.count_if(T.clause_end(F.col("word"))).alias("clauses"))


@query("c07_split_dashes", A.sql("words", """p AS (SELECT media_id, idx, start_us, end_us, list_filter(string_split(word, '-'), lambda x: x <> '') AS parts FROM words WHERE contains(word, '-')),
  u AS (SELECT media_id, idx, start_us, end_us, list_sum(list_transform(parts, lambda x: length(x))) AS total, unnest(parts) AS part, CAST(unnest(range(len(parts))) AS BIGINT) AS k FROM p),
  s AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY media_id, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
  SELECT media_id, idx, k, part, CAST(start_us + (end_us - start_us) * before // total AS BIGINT) AS start_us FROM s"""))
def _(spark, d):
    w = A.words(spark, d).where(F.contains("word", F.lit("-"))).withColumn("parts", F.filter(F.split("word", "-"), lambda x: x != ""))
    u = w.withColumn("total", F.aggregate("parts", F.lit(0), lambda a, x: a + F.length(x))).select("media_id", "idx", "start_us", "end_us", "total", F.posexplode("parts").alias("k", "part"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy("media_id", "idx").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return u.select("media_id", "idx", F.col("k").cast("long").alias("k"), "part", (F.col("start_us") + F.floor((F.col("end_us") - F.col("start_us")) * before / F.col("total"))).cast("long").alias("start_us"))


@query("c09_headline_options", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
  c AS (SELECT doc_id, trim(line) AS line, min(pos) AS pos FROM u WHERE trim(line) <> '' GROUP BY ALL), k AS (SELECT doc_id, lower(line) AS low, arg_min(line, pos) AS line, min(pos) AS pos FROM c GROUP BY 1, 2),
  r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM k) SELECT doc_id, CAST(place AS INTEGER) AS place, md5(line) AS h FROM r WHERE place <= 3""")
def _(spark, d):
    u = A.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line")).where("line <> ''")
    k = u.groupBy("doc_id", F.lower("line").alias("low")).agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return k.withColumn("place", place).where("place <= 3").select("doc_id", "place", F.md5("line").alias("h"))


# Three of four runs of 50 words are pieces, the second of them reaching into the third.
@query("c12_find_replace", A.sql("words", r"""p AS (SELECT media_id, min(start_us) AS start_us, max(end_us) + CASE WHEN idx // 50 % 4 = 1 THEN 2000000 ELSE 0 END AS end_us FROM words WHERE idx // 50 % 4 <> 3 GROUP BY media_id, idx // 50),
  h AS (SELECT *, regexp_extract(word, '[[:alpha:]]+') AS core FROM words w WHERE lower(trim(word, '.,;:!?…"''()[]{}<>*#%$&|-“”‘’–—')) = 'the' AND EXISTS (SELECT 1 FROM p WHERE p.media_id = w.media_id AND p.start_us < w.end_us AND w.start_us < p.end_us))
  SELECT media_id, idx, word, replace(word, core, 'a') AS corrected, count(*) OVER (PARTITION BY media_id) AS n FROM h"""))
def _(spark, d):
    words = A.words(spark, d)
    run = F.floor(F.col("idx") / 50)
    pieces = words.withColumn("run", run).where("run % 4 <> 3").groupBy("media_id", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return W.find_replace(words, pieces.withColumn("end_us", F.col("end_us") + F.when(F.col("run") % 4 == 1, 2_000_000).otherwise(0)), "the", "a")


# Every third line is blank, of white space only.
@query("c25_paragraphs", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), t AS (SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: ls[i] || CASE WHEN i % 3 = 0 THEN chr(10) || ' ' || chr(9) ELSE '' END), chr(10)) AS text FROM l),
  p AS (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r\f\v]*\n') AS ps FROM t), u AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS pos FROM p), c AS (SELECT doc_id, pos, trim(regexp_replace(p, '[ \t\r\n\f\v]+', ' ', 'g')) AS p FROM u)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, md5(p) AS h FROM c WHERE p <> ''""")
def _(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(x, F.when((i + 1) % 3 == 0, F.lit("\n \t")).otherwise("")))
    texts = A.table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    u = texts.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "p"))
    return u.select("doc_id", "pos", F.md5("p").alias("h"))


@query("c28_hotwords", r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[,;' || chr(10) || ']') AS ps FROM documents), u AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS pos FROM s),
  t AS (SELECT doc_id, left(trim(regexp_replace(p, '[ \t]+', ' ', 'g')), 40) AS w, pos FROM u), k AS (SELECT doc_id, lower(w) AS low, arg_min(w, pos) AS w, min(pos) AS pos FROM t WHERE w <> '' GROUP BY 1, 2),
  r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM k) SELECT doc_id, CAST(place AS INTEGER) AS place, w FROM r WHERE place <= 20""")
def _(spark, d):
    u = A.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "[,;\n]")).alias("pos", "p"))
    u = u.withColumn("w", F.substring(F.btrim(F.regexp_replace("p", r"[ \t]+", " ")), 1, 40)).where("w <> ''")
    k = u.groupBy("doc_id", F.lower("w").alias("low")).agg(F.min_by("w", "pos").alias("w"), F.min("pos").alias("pos"))
    return k.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("place <= 20").select("doc_id", "place", "w")


@query("a17_video_id", r"SELECT page_id, nullif(regexp_extract(url, '^https?://(?:www\.|m\.)?[a-z]+\.example\.(?:com|net|org)/([a-z]+)/', 1), '') AS section, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages")
def _(spark, d):
    url = F.col("url")
    return A.table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract(url, r"^https?://(?:www\.|m\.)?[a-z]+\.example\.(?:com|net|org)/([a-z]+)/", 1), F.lit("")).alias("section"), F.regexp_extract(url, "/([0-9]+)", 1).alias("number"))


@query("a21_srt", A.sql("turns", """r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us, pos) AS n FROM turns),
  f AS (SELECT media_id, n, printf('%d\\n%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d\\n%s\\n', n, start_us // 3600000000, start_us // 60000000 % 60, start_us // 1000000 % 60, start_us // 1000 % 1000, end_us // 3600000000, end_us // 60000000 % 60, end_us // 1000000 % 60, end_us // 1000 % 1000, speaker) AS t FROM r)
  SELECT media_id, md5(string_agg(t, '|' ORDER BY n)) AS h FROM f GROUP BY 1""").replace("\\\\n", "/").replace("\\n", "/"))
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("start_us", "pos"))
    rows = A.turns(spark, d).withColumn("n", n)
    block = F.concat(F.col("n").cast("string"), F.lit("/"), T.timestamp(F.col("start_us")), F.lit(" --> "), T.timestamp(F.col("end_us")), F.lit("/"), F.col("speaker"), F.lit("/"))
    return rows.groupBy("media_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("t")))), lambda x: x["t"]), "|")).alias("h"))


@query("a22_transcript_lines", A.sql("turns", "SELECT media_id, pos, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY media_id ORDER BY pos) THEN '' ELSE speaker || ': ' END || text AS line FROM turns"))
def _(spark, d):
    order = Window.partitionBy("media_id").orderBy("pos")
    label = F.when(F.col("speaker") == F.lag("speaker").over(order), "").otherwise(F.concat("speaker", F.lit(": ")))
    return A.turns(spark, d).select("media_id", "pos", F.concat(label, F.col("text")).alias("line"))


FILLERS = f"""t AS (SELECT *, {TOKEN} AS token FROM words), n AS (SELECT *, lag(token) OVER ({BY}) AS prior, coalesce(start_us - lag(end_us) OVER ({BY}), 1152921504606846976) AS before, coalesce(lead(start_us) OVER ({BY}) - end_us, 1152921504606846976) AS after FROM t),
  k AS (SELECT *, CASE WHEN token IN ({HES}) THEN 'hesitation' WHEN token IN ('é', 'né', 'the', 'de') AND before >= 350000 AND after >= 350000 THEN 'isolated' WHEN token NOT IN ('é', 'né', 'the', 'de') AND token <> '' AND token = prior THEN 'repeat' END AS kind FROM n)"""


@query("d01_fillers", A.sql("words", f"{FILLERS} SELECT media_id, idx, start_us, end_us, token, kind, CASE kind WHEN 'hesitation' THEN 90 WHEN 'isolated' THEN 70 ELSE 85 END AS confidence FROM k WHERE kind IS NOT NULL"))
def _(spark, d):
    return W.fillers(A.words(spark, d), isolated=("é", "né", "the", "de"))


def fold_sql(name: str, state: str, first: str, step: str) -> str:
    """A fold over each recording's words in order: one recursion step for each word."""
    return f"""n AS (SELECT *, row_number() OVER ({BY}) AS k, lag(end_us) OVER ({BY}) AS prior_end, lead(start_us) OVER ({BY}) AS next_start FROM words),
      f AS (SELECT media_id, k, {first} FROM n WHERE k = 1 UNION ALL SELECT n.media_id, n.k, {step} FROM f JOIN n ON n.media_id = f.media_id AND n.k = f.k + 1)
      SELECT f.part AS {name}, f.media_id, min(n.idx) AS first_idx, max(n.idx) AS last_idx, min(n.start_us) AS start_us, max(n.end_us) AS end_us, count(*) AS n_words FROM f JOIN n USING (media_id, k) GROUP BY f.media_id, f.part"""


@query("d02_units", A.sql("words", fold_sql("unit", "", "CAST(0 AS BIGINT) AS part, start_us AS begun, end_us - start_us >= 8000000 OR regexp_matches(word, '[.!?…,;:]$') AND end_us - start_us >= 1200000 AS done",
  """CASE WHEN done OR n.start_us - n.prior_end >= 600000 THEN part + 1 ELSE part END, CASE WHEN done OR n.start_us - n.prior_end >= 600000 THEN n.start_us ELSE begun END,
  n.end_us - CASE WHEN done OR n.start_us - n.prior_end >= 600000 THEN n.start_us ELSE begun END >= 8000000 OR regexp_matches(n.word, '[.!?…,;:]$') AND n.end_us - CASE WHEN done OR n.start_us - n.prior_end >= 600000 THEN n.start_us ELSE begun END >= 1200000""")))
def _(spark, d):
    return W.selection_units(A.words(spark, d))


@query("d03_phrases", A.sql("words", fold_sql("phrase", "", "CAST(0 AS BIGINT) AS part, 1 AS c, regexp_matches(word, '[.!?…,]$') OR coalesce(next_start - end_us >= 250000, false) AS done",
  "CASE WHEN done THEN part + 1 ELSE part END, CASE WHEN done THEN 1 ELSE c + 1 END, regexp_matches(n.word, '[.!?…,]$') OR coalesce(n.next_start - n.end_us >= 250000, false) OR CASE WHEN done THEN 1 ELSE c + 1 END >= 14")))
def _(spark, d):
    return W.phrases(A.words(spark, d))


# Segments of 25 words; every ninth has no words but a text, the one before it hesitations only.
@query("d02_segment_units", A.sql("words", f"""sw AS (SELECT media_id, idx, start_us, end_us, CASE WHEN idx // 25 % 9 = 7 THEN 'Hum' ELSE word END AS word, idx // 25 AS seg FROM words), lw AS (SELECT * FROM sw WHERE seg % 9 <> 8),
  n AS (SELECT *, row_number() OVER w AS k, coalesce(start_us - lag(end_us) OVER w >= 600000 OR seg - lag(seg) OVER w > 1, false) AS cut, regexp_matches(word, '[.!?…,;:]$') AS mark FROM lw WINDOW w AS (PARTITION BY media_id ORDER BY idx)),
  f AS (SELECT media_id, k, 0::BIGINT AS part, start_us AS begun, end_us - start_us >= 8000000 OR mark AND end_us - start_us >= 1200000 AS done FROM n WHERE k = 1
    UNION ALL SELECT n.media_id, n.k, CASE WHEN done OR cut THEN part + 1 ELSE part END, CASE WHEN done OR cut THEN n.start_us ELSE begun END, n.end_us - CASE WHEN done OR cut THEN n.start_us ELSE begun END >= 8000000 OR n.mark AND n.end_us - CASE WHEN done OR cut THEN n.start_us ELSE begun END >= 1200000 FROM f JOIN n ON n.media_id = f.media_id AND n.k = f.k + 1),
  u AS (SELECT f.media_id, min(idx) AS first_idx, max(idx) AS last_idx, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_words, arg_min(seg, idx) AS seg, bool_or(lower(trim(word)) NOT IN {T.HESITATIONS}) AS says FROM f JOIN n USING (media_id, k) GROUP BY f.media_id, part),
  a AS (SELECT * FROM u WHERE says UNION ALL SELECT media_id, NULL, NULL, min(start_us), max(end_us), 0, seg, true FROM sw WHERE seg % 9 = 8 AND seg % 2 = 1 GROUP BY media_id, seg)
  SELECT row_number() OVER (PARTITION BY media_id ORDER BY seg, first_idx NULLS FIRST) - 1 AS unit, media_id, first_idx, last_idx, start_us, end_us, n_words FROM a"""))
def _(spark, d):
    seg = F.floor(F.col("idx") / 25)
    words = A.words(spark, d).withColumn("seg", seg).withColumn("word", F.when(F.col("seg") % 9 == 7, "Hum").otherwise(F.col("word")))
    segments = words.groupBy("media_id", "seg").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max(F.when(F.col("seg") % 2 == 1, "noise").otherwise(" ah eh")).alias("text"))
    return W.selection_units(words.where("seg % 9 <> 8"), segments)


@query("d05_kept_ranges", A.sql("words", "k AS (SELECT *, idx - row_number() OVER (PARTITION BY media_id ORDER BY idx) AS g FROM words WHERE (idx * 7 + media_id) % 5 <> 0) SELECT media_id, min(idx) AS first, max(idx) AS last, min(start_us) AS start_us, max(end_us) AS end_us FROM k GROUP BY media_id, g"))
def _(spark, d):
    return W.kept_ranges(A.words(spark, d).where("(idx * 7 + media_id) % 5 <> 0"), ["media_id"], "idx")


@query("d08_leading_fillers", A.sql("words", f"""n AS (SELECT *, row_number() OVER ({BY}) AS place, min(CASE WHEN length({TOKEN}) <= 3 THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS led, min(start_us) OVER (PARTITION BY media_id) AS first FROM words),
  o AS (SELECT *, led = 1 AND place <= 4 AND end_us - first <= 1500000 AS ok FROM n) SELECT media_id, count(*) FILTER (ok) AS trimmed, min(start_us) FILTER (NOT ok) AS start_us FROM o GROUP BY 1"""))
def _(spark, d):
    return W.leading_fillers(A.words(spark, d), F.length(T.token(F.col("word"))) <= 3)


PHRASES = [(1, ["the"]), (2, ["of", "the"]), (3, ["is", "the"]), (4, ["de", "la"]), (5, ["and", "the", "of"])]


@query("d09_emphasis", A.sql("words", f"t AS (SELECT media_id, idx, {TOKEN} AS a, lead({TOKEN}) OVER ({BY}) AS b, lead({TOKEN}, 2) OVER ({BY}) AS c FROM words) "
  + " UNION ALL ".join(f"SELECT media_id, CAST({k} AS BIGINT) AS phrase_id, min(idx) AS idx FROM t WHERE " + " AND ".join(f"{x} = '{w}'" for x, w in zip("abc", ws, strict=False)) + " GROUP BY 1" for k, ws in PHRASES)))
def _(spark, d):
    return W.ngram_first(A.words(spark, d), spark.createDataFrame(PHRASES, "phrase_id long, tokens array<string>"))


@query("d10_caption_cues", A.sql("words", fold_sql("cue", "", "CAST(0 AS BIGINT) AS part, 1 AS c, start_us AS begun",
  "CASE WHEN c >= 5 OR n.start_us - n.prior_end > 650000 OR n.end_us - begun > 3000000 THEN part + 1 ELSE part END, CASE WHEN c >= 5 OR n.start_us - n.prior_end > 650000 OR n.end_us - begun > 3000000 THEN 1 ELSE c + 1 END, CASE WHEN c >= 5 OR n.start_us - n.prior_end > 650000 OR n.end_us - begun > 3000000 THEN n.start_us ELSE begun END")
  .replace("SELECT f.part AS cue", "SELECT cue, media_id, first_idx, last_idx, start_us, greatest(start_us + 50000, least(end_us, coalesce(lead(start_us) OVER (PARTITION BY media_id ORDER BY cue), end_us))) AS end_us, n_words FROM (SELECT f.part AS cue") + ")"))
def _(spark, d):
    return W.caption_cues(A.words(spark, d))


@query("c10_doubtful_words", A.sql("words", "SELECT media_id, idx FROM words WHERE (idx * 37 + media_id * 11) % 100 < 60 AND (idx * 3 + media_id) % 7 <> 0"))
def _(spark, d):
    w = A.words(spark, d)
    corrected = A.words(spark, d).where("(idx * 3 + media_id) % 7 = 0").select("media_id", "idx")
    return w.where("(idx * 37 + media_id * 11) % 100 < 60").join(corrected, ["media_id", "idx"], "left_anti").select("media_id", "idx")


@query("c11_corrections", A.sql("words", "SELECT media_id, idx, CASE WHEN idx % 11 = 0 AND idx % 22 = 0 THEN word || '+' ELSE word END AS word, NOT (idx % 11 = 0 AND idx % 22 <> 0) AS ok FROM words"))
def _(spark, d):
    w = A.words(spark, d)
    fix = w.where("idx % 11 = 0").select("media_id", "idx", F.when(F.col("idx") % 22 == 0, F.col("word")).otherwise(F.concat("word", F.lit("?"))).alias("original"), F.concat("word", F.lit("+")).alias("corrected"))
    return W.apply_corrections(w, fix).select("media_id", "idx", "word", "ok")


# The plan's segment changes every 33 words.
@query("d10_segment_cues", A.sql("words", """n AS (SELECT *, row_number() OVER w AS k, coalesce(start_us - lag(end_us) OVER w > 650000 OR idx // 33 <> lag(idx // 33) OVER w, false) AS cut FROM words WINDOW w AS (PARTITION BY media_id ORDER BY idx)),
  f AS (SELECT media_id, k, 0::BIGINT AS part, 1 AS c, start_us AS begun FROM n WHERE k = 1
    UNION ALL SELECT media_id, k, CASE WHEN y THEN part + 1 ELSE part END, CASE WHEN y THEN 1 ELSE c + 1 END, CASE WHEN y THEN start_us ELSE begun END FROM (SELECT n.media_id, n.k, n.start_us, part, c, begun, c >= 5 OR cut OR n.end_us - begun > 3000000 AS y FROM f JOIN n ON n.media_id = f.media_id AND n.k = f.k + 1)),
  g AS (SELECT f.part AS cue, f.media_id, min(idx) AS first_idx, max(idx) AS last_idx, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_words FROM f JOIN n USING (media_id, k) GROUP BY f.media_id, f.part)
  SELECT cue, media_id, first_idx, last_idx, start_us, greatest(start_us + 50000, least(end_us, coalesce(lead(start_us) OVER (PARTITION BY media_id ORDER BY cue), end_us))) AS end_us, n_words FROM g"""))
def _(spark, d):
    return W.caption_cues(A.words(spark, d).withColumn("segment", F.floor(F.col("idx") / 33)))


@query("d11_beat_spans")
def _(spark, d):
    return W.beat_spans(A.words(spark, d), A.lines(spark, d, 40, 13).withColumnRenamed("line", "beat"))


@query("l08_utterances", A.sql("words", f"o AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER ({BY}) < 600000 THEN 0 ELSE 1 END AS n FROM words), g AS (SELECT *, sum(n) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT media_id, CAST(run AS BIGINT) AS run, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_words FROM g GROUP BY 1, 2"))
def _(spark, d):
    return W.breaks(A.words(spark, d), 600_000).groupBy("media_id", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_words"))
