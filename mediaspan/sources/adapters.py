"""The driver's tables as this engine's inputs, by integer arithmetic that any engine repeats.

VIEWS holds the same rules in SQL: common table expressions for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = 600_000  # microseconds for a hundredth of an event's value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """documents as timed words: media_id, idx, start_us, end_us, word. With `dealt`, texts are dealt out by medium before
    they grow to words, so that what meets those within `dealt_once` needs no shuffle of them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = (documents.repartition("doc_id") if dealt else documents).select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "[ \\n\\t\\r]+")).alias("idx", "word"))
    idx = F.col("idx").cast("long")
    start = idx * 600_000 + ((idx * 7919 + F.col("media_id") * 31) % 5) * 60_000 + F.floor(idx / 17) * 900_000
    out = split.where("word <> ''").select("media_id", idx.alias("idx"), start.alias("start_us"), "word")
    return out.withColumn("end_us", F.col("start_us") + 250_000 + ((F.col("idx") * 13) % 4) * 20_000)


def lines(spark: SparkSession, sf_dir: str, size: int, without: int) -> DataFrame:
    """documents' words but every `without`-th, `size` places a line: media_id, line, text. They are those of words(), but found
    in a document's text, which passes a shuffle as one row, and not word by word."""
    texts = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("media_id")).agg(F.collect_list("text").alias("texts"))
    texts = texts.select("media_id", F.transform("texts", lambda t: F.split(t, "[ \\n\\t\\r]+")).alias("parts"))

    def line(n: Column) -> Column:
        def said(part: Column) -> Column:
            placed = F.transform(F.slice(part, n * size + 1, F.lit(size)), lambda w, i: F.struct((n * size + i).alias("idx"), w.alias("word")))
            return F.filter(placed, lambda w: (w["idx"] % without != 0) & (w["word"] != ""))

        # Of documents with one id words stand side by side.
        rows = F.when(F.size("parts") == 1, said(F.col("parts")[0])).otherwise(F.sort_array(F.flatten(F.transform("parts", said))))
        return F.transform(rows, lambda w: w["word"])

    last = F.array_max(F.transform("parts", F.size)) - 1
    every = F.transform(F.sequence(F.lit(0), F.floor(last / size).cast("int")), lambda n: F.struct(n.cast("long").alias("line"), line(n).alias("words")))
    found = texts.where(F.size("parts") > 0).select("media_id", F.explode(every).alias("l")).where(F.size("l.words") > 0)
    return found.select("media_id", "l.line", F.array_join("l.words", " ").alias("text"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", start.alias("start_us"), (start + F.round(F.col("value") * 100).cast("long") * MINUTE).alias("end_us"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as spans, a medium a user: media_id, id, start_us, end_us."""
    return _timed(spark, sf_dir).select(F.col("user_id").alias("media_id"), F.col("event_id").alias("id"), "start_us", "end_us")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled spans, a medium a user: media_id, id, label, start_us, end_us."""
    return _timed(spark, sf_dir).select(F.col("user_id").alias("media_id"), F.col("event_id").alias("id"), F.col("event_type").alias("label"), "start_us", "end_us")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).where("label = 'click'").select("media_id", F.col("id").alias("clip_id"), "start_us", "end_us")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("label") == "signup", "approved").otherwise("rejected").alias("verdict")
    return tracks(spark, sf_dir).where("label in ('signup', 'error')").select("media_id", F.col("id").alias("decision_id"), "start_us", "end_us", verdict)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).where("label = 'view'").select("media_id", F.col("id").alias("point_id"), F.col("start_us").alias("t_us"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as speaker turns: media_id, pos, speaker, start_us, end_us, text."""
    from pyspark.sql import Window

    length = (F.lit(1_000_000) * (1 + F.length("text") % 9)).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", length.alias("n"))
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.when(F.col("role") == "assistant", 500_000).otherwise(0)
    rows = rows.withColumn("start_us", F.greatest(start, F.lit(0)).cast("long"))
    return rows.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "start_us", (F.col("start_us") + F.col("n")).alias("end_us"), "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: job_id, at_us, status, progress."""
    status = F.element_at(F.create_map(*[F.lit(x) for pair in (("view", "queued"), ("click", "running"), ("purchase", "succeeded"), ("error", "failed"), ("signup", "running")) for x in pair]), F.col("event_type"))
    return _timed(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id"), F.col("start_us").alias("at_us"), status.alias("status"), F.get_json_object("props", "$.k").cast("int").alias("progress"))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames, 64 a medium: media_id, idx, label, embedding as integers (thousandths)."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("media_id"), F.col("vec_id").alias("idx"), F.col("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long")).alias("v"))


VIEWS = {
    "timed": "timed AS (SELECT event_id, user_id, event_type, props, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS end_us FROM events)",
    "spans": "spans AS (SELECT user_id AS media_id, event_id AS id, start_us, end_us FROM timed)",
    "tracks": "tracks AS (SELECT user_id AS media_id, event_id AS id, event_type AS label, start_us, end_us FROM timed)",
    "clips": "clips AS (SELECT media_id, id AS clip_id, start_us, end_us FROM tracks WHERE label = 'click')",
    "decisions": "decisions AS (SELECT media_id, id AS decision_id, start_us, end_us, CASE WHEN label = 'signup' THEN 'approved' ELSE 'rejected' END AS verdict FROM tracks WHERE label IN ('signup', 'error'))",
    "points": "points AS (SELECT media_id, id AS point_id, start_us AS t_us FROM tracks WHERE label = 'view')",
    "words": """pieces AS (SELECT doc_id AS media_id, string_split_regex(text, '[ \\n\\t\\r]+') AS w FROM documents),
      listed AS (SELECT media_id, unnest(w) AS word, CAST(unnest(range(len(w))) AS BIGINT) AS idx FROM pieces),
      words AS (SELECT media_id, idx, word, idx * 600000 + ((idx * 7919 + media_id * 31) % 5) * 60000 + (idx // 17) * 900000 AS start_us,
        idx * 600000 + ((idx * 7919 + media_id * 31) % 5) * 60000 + (idx // 17) * 900000 + 250000 + ((idx * 13) % 4) * 20000 AS end_us FROM listed WHERE word <> '')""",
    "turns": """laid AS (SELECT conv_id, turn, role, text, CAST(1000000 * (1 + length(text) % 9) AS BIGINT) AS n FROM conversations),
      begun AS (SELECT *, greatest(0, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) - CASE WHEN role = 'assistant' THEN 500000 ELSE 0 END) AS start_us FROM laid),
      turns AS (SELECT conv_id AS media_id, turn AS pos, role AS speaker, start_us, start_us + n AS end_us, text FROM begun)""",
    "jobs": "jobs AS (SELECT user_id AS job_id, event_id, start_us AS at_us, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status, CAST(json_extract_string(props, '$.k') AS INTEGER) AS progress FROM timed)",
    "keyframes": "keyframes AS (SELECT vec_id // 64 AS media_id, vec_id AS idx, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS v FROM embeddings)",
}
_NEEDS = {"spans": ["timed"], "tracks": ["timed"], "clips": ["timed", "tracks"], "decisions": ["timed", "tracks"], "points": ["timed", "tracks"], "jobs": ["timed"]}


def sql(views: str, body: str) -> str:
    """`body` (further expressions, or a SELECT) behind the views it names."""
    names: list[str] = []
    for name in views.split():
        names += [x for x in [*_NEEDS.get(name, []), name] if x not in names]
    ctes = ",\n".join(VIEWS[n] for n in names)
    body = body.strip()
    return f"WITH RECURSIVE {ctes}{',' if not body.upper().startswith('SELECT') else ''}\n{body}"
