"""Readers with explicit schemas, quarantine of unreadable rows, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.operators.catalog import content_key

TRANSCRIPT = "media_id bigint, segments array<struct<id: int, start: double, end: double, text: string, words: array<struct<word: string, start: double, end: double, probability: double>>>>, _corrupt_record string"
SELECTION = "media_id bigint, clips array<struct<rank: int, score: double, start: double, end: double, title: string, pieces: array<struct<start: double, end: double>>>>, _corrupt_record string"
PLAN = "plan_id bigint, segments array<struct<start: double, end: double, audio_start: double, audio_end: double, video_start: double, video_end: double, piece: int>>, _corrupt_record string"
ANALYSIS = "media_id bigint, duration double, vad array<struct<start: double, end: double>>, waveforms array<struct<points: int, frames_per_point: int, sample_rate: int, rms: array<double>>>, _corrupt_record string"

# The fields of an evaluation entry, the longest texts among them, and the verdicts.
DECISION = "clip_ref: struct<start_second: double, end_second: double>, verdict: string, theme: string, duration_seconds: double, hook_summary: string, payoff_summary: string, speakers: array<string>, reason: string, decided_by: string, decided_at: string"
EVALUATION = f"dataset_schema_version double, episode struct<title: string, source_sha256: string, duration_seconds: double, transcript_artifact_hash: string>, decisions array<struct<{DECISION}>>"
LONGEST = {"theme": 300, "hook_summary": 500, "payoff_summary": 500, "reason": 1000, "decided_by": 200}
VERDICTS = ("approved", "rejected")


def micros(seconds) -> F.Column:
    return F.round(seconds * 1_000_000).cast("long")


def documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON documents, one a line: those that read, and the text of those that don't."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = F.col("_corrupt_record").isNotNull()
    return rows.where(~bad).drop("_corrupt_record"), spark.read.text(path).where(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()).withColumnRenamed("value", "text")


def words(transcripts: DataFrame) -> DataFrame:
    """media_id, seg_id, idx from 0 over all segments in order, start_us, end_us, word, probability."""
    from pyspark.sql import Window

    seg = transcripts.select("media_id", F.posexplode("segments").alias("seg_pos", "s"))
    w = seg.select("media_id", "seg_pos", F.col("s.id").alias("seg_id"), F.posexplode("s.words").alias("word_pos", "w"))
    idx = F.row_number().over(Window.partitionBy("media_id").orderBy("seg_pos", "word_pos")) - 1
    return w.select("media_id", "seg_id", idx.cast("long").alias("idx"), micros(F.col("w.start")).alias("start_us"), micros(F.col("w.end")).alias("end_us"), F.col("w.word").alias("word"), F.col("w.probability").alias("probability"))


def pieces(selections: DataFrame) -> DataFrame:
    """media_id, rank, pos, start_us, end_us; a clip without pieces is one piece."""
    clip = selections.select("media_id", F.explode("clips").alias("c"))
    whole = F.array(F.struct(F.col("c.start").alias("start"), F.col("c.end").alias("end")))
    each = F.when(F.size("c.pieces") > 0, F.col("c.pieces")).otherwise(whole)
    rows = clip.select("media_id", F.col("c.rank").alias("rank"), F.posexplode(each).alias("pos", "p"))
    return rows.select("media_id", "rank", "pos", micros(F.col("p.start")).alias("start_us"), micros(F.col("p.end")).alias("end_us"))


def segments(plans: DataFrame) -> DataFrame:
    """plan_id, pos, the span, and the audio and video clocks, which default to it."""
    rows = plans.select("plan_id", F.posexplode("segments").alias("pos", "s"))
    clock = [micros(F.coalesce(f"s.{kind}_{side}", f"s.{side}")).alias(f"{kind}_{side}_us") for kind in ("audio", "video") for side in ("start", "end")]
    return rows.select("plan_id", "pos", micros(F.col("s.start")).alias("start_us"), micros(F.col("s.end")).alias("end_us"), *clock, F.col("s.piece").alias("piece"))


def energy(analyses: DataFrame) -> DataFrame:
    """media_id, idx, t_us, rms of the densest waveform of each recording."""
    best = F.array_max(F.transform("waveforms", lambda w: F.struct(w["points"].alias("points"), w.alias("w"))))["w"]
    rows = analyses.select("media_id", best.alias("w")).select("media_id", F.col("w.frames_per_point").alias("f"), F.col("w.sample_rate").alias("r"), F.posexplode("w.rms").alias("idx", "rms"))
    return rows.select("media_id", "idx", micros(F.col("idx") * F.col("f") / F.col("r")).alias("t_us"), "rms")


TRACKS = (
    "media_id bigint, vad array<struct<start: double, end: double>>, pauses array<struct<start: double, end: double>>, speech_density array<struct<start: double, end: double, speech_ratio: double>>, "
    "fillers array<struct<start: double, end: double, kind: string, confidence: double>>, _corrupt_record string"
)
#: The tracks of an analysis document: its field, and what else than times a row of it holds.
_FIELDS = (("vad", "vad", None, None), ("pauses", "pauses", None, None), ("density", "speech_density", "speech_ratio", None), ("fillers", "fillers", "confidence", "kind"))


def analysis_tracks(analyses: DataFrame, unread: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents read with TRACKS, and the texts of those that don't read -> (tracks, violations).

    tracks: media_id, track (vad, pauses, density, fillers), pos, start_us, end_us, value (a speech
    ratio or a confidence), kind. One explode of all tracks at once. violations: media_id, track,
    pos, message; a track that is missing (`missing`), a row without times, with a negative or
    turned time (`interval`), or with a value outside 0 to 1 (`value`) is one, and a document that
    doesn't read (`unreadable`, with its text as track). Rows in violation are no tracks.
    """

    def listed(track: str, field: str, value: str | None, kind: str | None):
        row = lambda x: F.struct(F.lit(track).alias("track"), x["start"].alias("a"), x["end"].alias("b"), (x[value] if value else F.lit(None).cast("double")).alias("value"), (x[kind] if kind else F.lit(None).cast("string")).alias("kind"), F.lit(value is not None).alias("valued"))
        return F.transform(F.coalesce(F.col(field), F.array()), lambda x, i: F.struct(i.cast("long").alias("pos"), row(x).alias("r")))

    gone = F.array_compact(F.array(*(F.when(F.col(field).isNull(), track) for track, field, _, _ in _FIELDS)))
    rows = analyses.select("media_id", F.explode(F.concat(*(listed(*f) for f in _FIELDS))).alias("x")).select("media_id", "x.pos", "x.r.*")
    turned = F.coalesce((F.col("a") < 0) | (F.col("b") <= F.col("a")), F.lit(True))
    wrong = F.col("valued") & ~F.coalesce(F.col("value").between(0, 1), F.lit(False))
    rows = rows.withColumn("message", F.when(turned, "interval").when(wrong, "value"))
    bad = rows.where("message IS NOT NULL").select("media_id", "track", "pos", "message")
    none = F.lit(None).cast("long").alias("pos")
    bad = bad.unionByName(analyses.select("media_id", F.explode(gone).alias("track")).select("media_id", "track", none, F.lit("missing").alias("message")))
    bad = bad.unionByName(unread.select(F.lit(None).cast("long").alias("media_id"), F.col("text").alias("track"), none, F.lit("unreadable").alias("message")))
    return rows.where("message IS NULL").select("media_id", "track", "pos", micros(F.col("a")).alias("start_us"), micros(F.col("b")).alias("end_us"), "value", "kind"), bad


def _names(schema) -> F.Column:
    return F.array(*(F.lit(f.name) for f in schema.fields))


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A folder of evaluation entries, one JSON document a file (schema.json is none of them):
    entries(path, and the fields of EVALUATION) without a violation, and violations(path, location,
    message), each with the place in its document, as decisions.0.verdict, or root.

    A field that is missing, null or of another type is `missing`, one outside its bounds `invalid`,
    one that no entry has `unknown`; a file that is no JSON object is `unreadable` at the root.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").where(~F.endswith("path", F.lit("/schema.json")))
    rows = raw.withColumn("e", F.from_json("value", EVALUATION)).withColumn("keys", F.json_object_keys("value"))
    rows = rows.withColumn("episode_keys", F.json_object_keys(F.get_json_object("value", "$.episode")))
    rows = rows.withColumn("decision_keys", F.transform(F.from_json(F.get_json_object("value", "$.decisions"), "array<map<string, string>>"), F.map_keys))
    top = spark.createDataFrame([], EVALUATION).schema
    decision, episode = top["decisions"].dataType.elementType, top["episode"].dataType

    def found(bad, where, message):
        return F.when(bad, F.struct(F.concat(*[F.lit(w) if isinstance(w, str) else w for w in where]).alias("location"), F.lit(message).alias("message")))

    def text(c, most, *where):
        n = F.length(c)
        return [found(c.isNull(), where, "missing"), found((n < 1) | (n > most), where, "invalid")]

    def number(c, low, *where):
        return [found(c.isNull(), where, "missing"), found(~low(c), where, "invalid")]

    def unknown(keys, schema, *where):
        return F.transform(F.array_except(keys, _names(schema)), lambda k: F.struct(F.concat(*[F.lit(w) if isinstance(w, str) else w for w in where], k).alias("location"), F.lit("unknown").alias("message")))

    above = lambda c: c > 0
    e = F.col("e")
    p = e["episode"]
    whole = [
        found(F.col("keys").isNull(), ("root",), "unreadable"), *number(e["dataset_schema_version"], lambda c: c == 1, "dataset_schema_version"),
        *text(p["title"], 300, "episode.title"), found(p["source_sha256"].isNull(), ("episode.source_sha256",), "missing"), found(~p["source_sha256"].rlike("^[a-f0-9]{64,128}$"), ("episode.source_sha256",), "invalid"),
        *number(p["duration_seconds"], above, "episode.duration_seconds"), *text(p["transcript_artifact_hash"], 200, "episode.transcript_artifact_hash"),
        found(e["decisions"].isNull(), ("decisions",), "missing"), found(F.size(e["decisions"]) == 0, ("decisions",), "invalid"),
    ]

    def each(d, i):
        at = lambda name: ("decisions.", i.cast("string"), f".{name}")
        rules = [*number(d["clip_ref"]["start_second"], lambda c: c >= 0, *at("clip_ref.start_second")), *number(d["clip_ref"]["end_second"], above, *at("clip_ref.end_second")), *number(d["duration_seconds"], above, *at("duration_seconds"))]
        rules += [found(d["verdict"].isNull(), at("verdict"), "missing"), found(~d["verdict"].isin(*VERDICTS), at("verdict"), "invalid")]
        for name, most in LONGEST.items():
            rules += text(d[name], most, *at(name))
        rules += [found(d["speakers"].isNull(), at("speakers"), "missing"), found(F.exists(d["speakers"], lambda s: s.isNull() | ~F.length(s).between(1, 100)), at("speakers"), "invalid")]
        rules += [found(d["decided_at"].isNull(), at("decided_at"), "missing"), found(F.try_to_timestamp(d["decided_at"]).isNull() & d["decided_at"].isNotNull(), at("decided_at"), "invalid")]
        return F.concat(F.array(*rules), unknown(F.coalesce(F.get("decision_keys", i), F.array().cast("array<string>")), decision, "decisions.", i.cast("string"), "."))

    none = F.array().cast("array<struct<location: string, message: string>>")
    listed = F.concat(F.array(*whole), F.coalesce(F.flatten(F.transform(e["decisions"], each)), none), F.coalesce(unknown(F.col("keys"), top), none), F.coalesce(unknown(F.col("episode_keys"), episode, "episode."), none))
    rows = rows.withColumn("found", F.filter(F.when(F.col("keys").isNull(), F.array(whole[0])).otherwise(listed), lambda x: x.isNotNull()))
    return rows.where(F.size("found") == 0).select("path", "e.*"), rows.select("path", F.explode("found").alias("f")).select("path", "f.*")


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document a recording (its row's columns), in place of what is there."""
    reports.write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, *columns: str) -> None:
    """Appends the rows whose content key is not stored yet; running it again adds nothing."""
    keyed = rows.withColumn("content_key", content_key(*columns)).dropDuplicates(["content_key"])
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        keyed = keyed.join(spark.read.parquet(path).select("content_key"), "content_key", "left_anti")
    keyed.write.mode("append").parquet(path)
