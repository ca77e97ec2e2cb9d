"""Readers, sinks and checks on hand-made rows."""

import json

from pyspark.sql import functions as F

from mediaspan.operators import quality as Q
from mediaspan.sources import io


def write(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    return str(path)


def test_transcript_words_and_quarantine(spark, tmp_path):
    doc = {"media_id": 1, "segments": [{"id": 7, "words": [{"word": "a", "start": 0, "end": 0.5}]}, {"id": 8, "words": []}, {"id": 9, "words": [{"word": "b", "start": 1.25, "end": 2}]}]}
    good, bad = io.documents(spark, write(tmp_path / "t.json", [doc, "{broken"]), io.TRANSCRIPT)
    assert [(r["seg_id"], r["idx"], r["start_us"], r["word"]) for r in io.words(good).orderBy("idx").collect()] == [(7, 0, 0, "a"), (9, 1, 1_250_000, "b")]
    assert [r["text"] for r in bad.collect()] == ["{broken"]


def test_pieces_fall_back_to_the_clip(spark, tmp_path):
    doc = {"media_id": 1, "clips": [{"rank": 1, "start": 0, "end": 9, "pieces": [{"start": 1, "end": 2}, {"start": 3, "end": 4}]}, {"rank": 2, "start": 5, "end": 6}]}
    good, _ = io.documents(spark, write(tmp_path / "s.json", [doc]), io.SELECTION)
    assert [(r["rank"], r["pos"], r["start_us"]) for r in io.pieces(good).orderBy("rank", "pos").collect()] == [(1, 0, 1_000_000), (1, 1, 3_000_000), (2, 0, 5_000_000)]


def test_plan_clocks_and_energy(spark, tmp_path):
    good, _ = io.documents(spark, write(tmp_path / "p.json", [{"plan_id": 1, "segments": [{"start": 1, "end": 2, "audio_start": 1.5}]}]), io.PLAN)
    r = io.segments(good).first()
    assert (r["audio_start_us"], r["audio_end_us"], r["video_start_us"]) == (1_500_000, 2_000_000, 1_000_000)
    doc = {"media_id": 1, "waveforms": [{"points": 1, "frames_per_point": 8, "sample_rate": 4, "rms": [0.5]}, {"points": 2, "frames_per_point": 4, "sample_rate": 4, "rms": [0.1, 0.2]}]}
    good, _ = io.documents(spark, write(tmp_path / "a.json", [doc]), io.ANALYSIS)
    assert [(r["t_us"], r["rms"]) for r in io.energy(good).orderBy("idx").collect()] == [(0, 0.1), (1_000_000, 0.2)]


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    for _ in range(2):
        io.append_new(rows, str(tmp_path / "out"), "k", "v")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_logs(spark):
    lines = spark.createDataFrame([(1, 0, "x pts_time:1.5 score=0.2"), (1, 1, "x pts_time:1.5 score=0.4"), (1, 2, "noise")], "media_id long, line_no long, line string")
    assert [tuple(r) for r in Q.scene_cuts(lines).collect()] == [(1, 1_500_000, 0.4)]
    logs = spark.createDataFrame([(1, "black_duration:1.5 black_duration: 0.25"), (2, "none")], "media_id long, log string")
    assert [tuple(r) for r in Q.log_summary(logs, "black_duration").orderBy("media_id").collect()] == [(1, 2, 1750, 1500), (2, 0, 0, 0)]
    assert spark.range(1).select(Q.last_json(F.lit('a {"x": 1} b {"y": 2}'))).first()[0] == '{"y": 2}'
    media = spark.createDataFrame([(1, [("audio", "3.5"), ("video", "N/A"), ("data", "1")]), (2, [])], "id long, s array<struct<kind: string, duration: string>>")
    assert [r[0] for r in media.orderBy("id").select(Q.usable_duration(F.col("s"), F.lit(9.0))).collect()] == [3.5, 9.0]


def test_layout_and_roles(spark):
    boxes = spark.createDataFrame([(1, "v", 0, 0, 10, 10), (2, "v", 50, 50, 60, 60)], "id long, canvas string, x0 int, y0 int, x1 int, y1 int")
    covers = spark.createDataFrame([("v", "p", "bar", 5, 5, 20, 20), ("v", "p", "edge", 10, 0, 12, 9)], "canvas string, platform string, name string, cx0 int, cy0 int, cx1 int, cy1 int")
    assert [tuple(r) for r in Q.occlusions(boxes, covers).collect()] == [(1, "p:bar")]
    assert [tuple(r) for r in Q.right_limit(boxes, covers).collect()] == [(1, 5)]
    codes = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, None, None)], "id long, first array<string>, second array<string>")
    assert sorted(tuple(r) for r in Q.checks(codes, ["a"]).collect() if r["code"]) == [(1, "a", "warning"), (1, "b", "fail")]
    roles = spark.createDataFrame([(1, 0.9, 0.5), (0, 0.9, 0.5), (2, 0.9, 0.5), (2, 0.3, 0.5), (2, 0.2, 0.5), (2, 0.1, 0.5), (3, 0.1, 0.5), (3, None, 0.5), (1, 0.35, 0.5), (1, 0.5, 0.5), (1, None, 0.5), (1, 0.9, 0.001)], "f int, s double, a double")
    got = [r[0] for r in roles.select(Q.camera_role(F.col("f"), F.col("s"), F.col("a"))).collect()]
    assert got == ["subject", "ignore", "subject", "subject", None, "wide", "wide", "wide", "interviewers", None, None, "ignore"]


def test_faces_and_zones(spark):
    faces = spark.createDataFrame([(1, 0.14, 2.0), (1, 0.0, 1.0), (1, 0.07, 3.0), (2, 0.5, 1.0)], "scene long, center double, area double")
    assert sorted((r["scene"], r["face"], round(r["mean"], 3), r["n"], r["area"]) for r in Q.face_groups(faces).collect()) == [(1, 0, 0.035, 2, 2.0), (1, 1, 0.14, 1, 2.0), (2, 0, 0.5, 1, 1.0)]
    samples = spark.createDataFrame([(1, 0, 0.9, 0.1), (1, 0, 0.9, 0.1), (1, 1, 0.9, 0.1), (1, 1, 0.5, 0.1), (1, 2, 0.9, 0.01)], "media_id long, sample long, score double, area double")
    assert [tuple(r) for r in Q.median_faces(samples).collect()] == [(1, 1)]
    boxes = spark.createDataFrame([(1, "v", 8, 10, 50, 50), (2, "v", 7, 10, 50, 50), (3, "v", 10, 10, 53, 50), (4, "w", 0, 0, 9, 9)], "id long, canvas string, x0 int, y0 int, x1 int, y1 int")
    zones = spark.createDataFrame([("v", 10, 10, 50, 50)], "canvas string, zx0 int, zy0 int, zx1 int, zy1 int")
    assert {r["id"] for r in Q.outside_safe_zone(boxes, zones).collect() if r["outside"]} == {2, 3}


def test_media_logs(spark):
    logs = spark.createDataFrame([(1, "t: 1 M: -23.5 S:-30\nt: 2 M:-120.7\n M: -18.25 x"), (2, "M:-120.0"), (3, None)], "media_id long, log string")
    assert sorted((r[0], r[1]) for r in Q.most_momentary(logs).collect()) == [(1, -18.25), (2, None), (3, None)]
    lines = spark.createDataFrame([(1, 0, "pts_time:2.5"), (1, 1, "n: 3 pts_time:0.04 x"), (1, 2, "none")], "media_id long, line_no long, line string")
    assert sorted(tuple(r) for r in Q.keyframes(lines).collect()) == [(1, 0, 40_000), (1, 1, 2_500_000)]
    media = spark.createDataFrame([("3.5", [("audio", "1")]), (None, [("audio", "N/A"), ("video", "2.5")]), ("N/A", [])], "w string, s array<struct<kind: string, duration: string>>")
    assert [r[0] for r in media.select(Q.media_duration(F.col("w"), F.col("s"))).collect()] == [3.5, 2.5, 0.0]


def test_evaluation_set(spark, tmp_path):
    decision = {"clip_ref": {"start_second": 0, "end_second": 9.5}, "verdict": "approved", "theme": "t", "duration_seconds": 9.5, "hook_summary": "h", "payoff_summary": "p", "speakers": ["a"], "reason": "r", "decided_by": "d", "decided_at": "2026-01-02T03:04:05Z"}
    good = {"dataset_schema_version": 1, "episode": {"title": "x", "source_sha256": "a" * 64, "duration_seconds": 60, "transcript_artifact_hash": "h"}, "decisions": [decision]}
    bad = {**good, "extra": 1, "episode": {**good["episode"], "source_sha256": "Z", "path": "/x"}, "decisions": [decision, {**decision, "verdict": "maybe", "theme": "", "speakers": ["a", ""], "decided_at": "soon", "more": 1}, {k: v for k, v in decision.items() if k != "reason"}]}
    for name, entry in (("good", good), ("bad", bad), ("empty", {**good, "dataset_schema_version": 2, "decisions": []}), ("schema", {"type": "object"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(entry, indent=1))
    (tmp_path / "broken.json").write_text("{broken")
    entries, violations = io.evaluation_set(spark, str(tmp_path))
    assert [(r["path"].rsplit("/", 1)[1], len(r["decisions"]), r["episode"]["title"]) for r in entries.collect()] == [("good.json", 1, "x")]
    assert sorted((r["path"].rsplit("/", 1)[1], r["location"], r["message"]) for r in violations.collect()) == [
        ("bad.json", "decisions.1.decided_at", "invalid"), ("bad.json", "decisions.1.more", "unknown"), ("bad.json", "decisions.1.speakers", "invalid"), ("bad.json", "decisions.1.theme", "invalid"), ("bad.json", "decisions.1.verdict", "invalid"),
        ("bad.json", "decisions.2.reason", "missing"), ("bad.json", "episode.path", "unknown"), ("bad.json", "episode.source_sha256", "invalid"), ("bad.json", "extra", "unknown"), ("broken.json", "root", "unreadable"),
        ("empty.json", "dataset_schema_version", "invalid"), ("empty.json", "decisions", "invalid"),
    ]


def test_reports(spark, tmp_path):
    for n in (1, 2):
        io.write_reports(spark.createDataFrame([(n, 0.5)], "media_id long, recall double"), str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "r")).select("media_id", "recall").collect()] == [(2, 0.5)]


def test_faults_and_loudness(spark):
    logs = spark.createDataFrame([(1, "freeze_start: 2\nfreeze_duration: 1.5\nblack_duration:0.25\nfreeze_start: 7", 10_000_000), (2, "freeze_start: 12", 10_000_000), (3, None, None)], "media_id long, log string, duration_us long")
    assert sorted(tuple(r) for r in Q.picture_faults(logs).collect()) == [(1, 1, 250_000, 250_000, 2, 4_500_000, 3_000_000), (2, 0, 0, 0, 1, 0, 0), (3, 0, 0, 0, 0, 0, 0)]
    logs = spark.createDataFrame([(1, 'x {"input_i" : "-9"} {"input_i" : "-23.5",\n"input_lra" : "4", "input_tp" : "-inf"} {"other": 1}'), (2, "none"), (3, None)], "media_id long, log string")
    assert sorted((tuple(r) for r in Q.loudness(logs).collect()), key=lambda r: r[0]) == [(1, -23.5, 4.0, None, None), (2, None, None, None, None), (3, None, None, None, None)]
