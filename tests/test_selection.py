"""Proposed clips, samples, analysis documents, settings, vectors and joins on small tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mediaspan.operators import catalog as K
from mediaspan.operators import selection as C
from mediaspan.operators import spans as S
from mediaspan.operators import vectors as V
from mediaspan.operators import words as W
from mediaspan.sources import io
from mediaspan.sources.scratch import folder

SEC = 1_000_000


def test_teasers(spark):
    units = spark.createDataFrame([(1, i, i * SEC, (i + 1) * SEC) for i in range(10)], "media_id long, unit long, start_us long, end_us long")
    pieces = spark.createDataFrame([(1, c, 0, 3, 300_000, 4 * SEC) for c in range(9)] + [(1, c, 5, 9, 5 * SEC, 10 * SEC) for c in range(9)], "media_id long, clip_id long, from_id long, to_id long, start_us long, end_us long")
    ids = [None, [], [1, 2], [1, 3], [1, 12], [3, 4], [0, 1], [1], [5, 6, 7, 8, 9]]
    clips = spark.createDataFrame([(1, c, x) for c, x in enumerate(ids)], "media_id long, clip_id long, ids array<long>")
    got = {r.clip_id: (r.start_us, r.reason) for r in C.teasers(clips, pieces, units).collect()}
    assert got == {0: (None, None), 1: (None, None), 2: (SEC, None), 3: (None, "not_consecutive"), 4: (None, "unknown"), 5: (None, "not_in_one_piece"), 6: (None, "trimmed_away"), 7: (None, "too_short"), 8: (None, "too_long")}


def test_judged_and_dropped(spark):
    clips = spark.createDataFrame([(1, 0, 5, "h"), (1, 1, 11, "h"), (1, 2, 5, "h"), (1, 3, 5, " "), (1, 4, 5, "h"), (1, 5, None, "h")], "media_id long, clip_id long, score int, headline string")
    pieces = spark.createDataFrame([(1, c, 0, 20 * SEC) for c in (0, 1, 3, 5)] + [(1, 4, i * SEC, i * SEC + 1) for i in range(16)], "media_id long, clip_id long, start_us long, end_us long")
    durations = spark.createDataFrame([(1, 30 * SEC)], "media_id long, duration_us long")
    verdicts = C.judged(clips, pieces, durations, (SEC, None), 25 * SEC)
    assert {r.clip_id: r.reason for r in verdicts.collect()} == {0: None, 1: "score", 2: "no_pieces", 3: "headline", 4: "many_pieces", 5: "score"}
    assert C.dropped(verdicts).first().asDict() == {"media_id": 1, "accepted": 1, "dropped": 5, "reasons": {"score": 2, "no_pieces": 1, "headline": 1, "many_pieces": 1}}
    assert C.judged(clips, pieces, durations.withColumn("duration_us", F.lit(SEC)), (SEC, None)).where("clip_id = 0").first().reason == "beyond_end"


def test_voice_shares(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 4 * SEC), (1, 0, 8 * SEC, 10 * SEC), (1, 1, 0, 10 * SEC), (1, 2, 20 * SEC, 30 * SEC)], "media_id long, clip_id long, start_us long, end_us long")
    turns = spark.createDataFrame([(1, "a", 0, 4 * SEC), (1, "b", 3 * SEC, 8 * SEC), (1, "a", 9 * SEC, 11 * SEC)], "media_id long, speaker string, start_us long, end_us long")
    got = {r.clip_id: (r.pieces, r.editorial, r.envelope, r.accepted) for r in C.voice_accepted(pieces, turns, "a", SEC).collect()}
    assert got == {0: (2, 0.8, 0.444444, True), 1: (1, 0.444444, 0.444444, False), 2: (1, 0.0, 0.0, False)}


def test_sound(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.5, -1.0, 0.0, 0.5, 0.5])], "media_id long, pos long, x double")
    got = [(r.block, r.peak, r.rms) for r in C.blocks(rows, 4).orderBy("block").collect()]
    assert got == [(0, 1.0, pytest.approx(math.sqrt(1.25 / 2))), (1, 0.5, pytest.approx(math.sqrt(0.25 / 2))), (2, 0.5, pytest.approx(math.sqrt(0.25 / 2))), (3, 0.0, 0.0)]
    quiet = spark.createDataFrame([(1, i, 0.0 if i < 100 else 0.1) for i in range(200)], "media_id long, pos long, x double")
    pauses = spark.createDataFrame([(1, 0, 500_000), (1, SEC, 1_500_000), (1, 500_000, 600_000)], "media_id long, start_us long, end_us long")
    assert [(r.rank, r.start_us, r.n, r.dbfs) for r in C.room_tone(quiet, pauses, 100, SEC).orderBy("rank").collect()] == [(1, 0, 40, -180.0), (2, SEC, 40, -20.0)]
    two = spark.createDataFrame([(1, i, x, -x) for i, x in enumerate([0.0, 1.0, -0.2])] + [(2, i, x, 0.3) for i, x in enumerate([0.1, 0.2])], "media_id long, pos long, left double, right double")
    got = {r.media_id: (r.peak, r.clipped, r.jumps, r.correlation) for r in C.signal_stats(two).collect()}
    assert got[1] == (1.0, 2, 4, pytest.approx(-1.0)) and got[2] == (0.3, 0, 0, None)


def test_analysis_tracks(spark):
    path = folder(spark)
    good = {"media_id": 1, "vad": [{"start": 0, "end": 1.5}, {"start": 3, "end": 2}], "pauses": [], "speech_density": [{"start": 0, "end": 10, "speech_ratio": 1.5}, {"start": 10, "end": 20, "speech_ratio": 0.5}], "fillers": [{"start": 1, "end": 2, "kind": "repeat", "confidence": 0.85}, {"start": None, "end": 2, "kind": "x", "confidence": 1}]}
    spark.createDataFrame([(json.dumps(good),), (json.dumps({"media_id": 2, "vad": []}),), ("{not json",)], "value string").coalesce(1).write.text(path)
    tracks, bad = io.analysis_tracks(*io.documents(spark, path, io.TRACKS))
    assert sorted((r.track, r.pos, r.start_us, r.end_us, r.value, r.kind) for r in tracks.collect()) == [("density", 1, 10 * SEC, 20 * SEC, 0.5, None), ("fillers", 0, SEC, 2 * SEC, 0.85, "repeat"), ("vad", 0, 0, 1_500_000, None, None)]
    found = {(r.media_id, r.track, r.pos, r.message) for r in bad.collect()}
    assert found == {(1, "vad", 1, "interval"), (1, "density", 0, "value"), (1, "fillers", 1, "interval"), (2, "pauses", None, "missing"), (2, "density", None, "missing"), (2, "fillers", None, "missing"), (None, "{not json", None, "unreadable")}


def tree(rng, depth=0):
    return {k: tree(rng, depth + 1) if depth < 3 and rng.random() < 0.5 else rng.choice([1, "a", True, None, [1, 2], {}]) for k in rng.sample("abcd", rng.randint(0 if depth else 1, 4))}


def flat(x, path=()):
    return {p: v for k, y in x.items() for p, v in (flat(y, (*path, k)).items() if isinstance(y, dict) and y else [((*path, k), y)])}


def test_settings_merge_of_diff_is_the_other(spark):
    rng = random.Random(5)
    pairs = [(k, tree(rng), tree(rng)) for k in range(60)]
    read = lambda i: K.leaves(spark.createDataFrame([(p[0], json.dumps(p[i])) for p in pairs], "k long, settings string"))
    named = lambda df: {(r.k, tuple(r.path)): json.loads(r.value) for r in df.collect()}
    whole = lambda i: {(p[0], path): v for p in pairs for path, v in flat(p[i]).items()}
    assert named(read(1)) == whole(1) and named(read(2)) == whole(2)
    assert named(K.apply_diff(read(1), K.settings_diff(read(1), read(2)))) == whole(2)
    left = {(k, p) for k, p in whole(1) if not any(k == j and q[: len(p)] == p[: len(q)] for j, q in whole(2))}
    assert set(named(K.without_paths(read(1), read(2)))) == left and left


def test_overlap_semi_and_replace(spark):
    rng = random.Random(8)
    span = lambda: (lambda a: (a, a + rng.randrange(0, 30)))(rng.randrange(200))
    left, right = [(rng.randrange(3), i, *span()) for i in range(80)], [(rng.randrange(3), *span()) for _ in range(12)]
    got = S.overlap_semi(spark.createDataFrame(left, "media_id long, id long, start_us long, end_us long"), spark.createDataFrame(right, "media_id long, start_us long, end_us long"))
    assert sorted(r.id for r in got.collect()) == [i for m, i, a, b in left if b > a and any(m == k and d > c and a < d and c < b for k, c, d in right)]
    words = spark.createDataFrame([(1, i, i * 10, i * 10 + 9, w) for i, w in enumerate(["The", "the,", "(the)", "there", "the"])], "media_id long, idx long, start_us long, end_us long, word string")
    pieces = spark.createDataFrame([(1, 5, 25), (1, 0, 12)], "media_id long, start_us long, end_us long")
    assert sorted((r.idx, r.corrected, r.n) for r in W.find_replace(words, pieces, "the", "a").collect()) == [(0, "a", 3), (1, "a,", 3), (2, "(a)", 3)]


def test_dimension_is_broadcast_only_if_counted_small(spark):
    rows, names = spark.range(10).withColumn("k", F.col("id") % 3), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, name string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(K.with_dimension(rows, names, "k")) and "broadcast" not in plan(K.with_dimension(rows, names, "k", most_rows=2))


def test_directions_and_distances(spark):
    rows = spark.createDataFrame([(1, 0, [3.0, 4.0]), (1, 1, [0.0, 2.0]), (1, 2, [0.0, 0.0]), (2, 3, [1.0, 0.0])], "media_id long, idx long, v array<double>")
    assert {r.media_id: r.v for r in V.mean_unit(rows, ["media_id"]).collect()} == {1: pytest.approx([3 / math.hypot(3, 6), 6 / math.hypot(3, 6)]), 2: [1.0, 0.0]}
    windows = rows.withColumn("start_us", F.col("idx") * 100_000).withColumn("end_us", (F.col("idx") + 1) * 100_000)
    got = {r.media_id: r.v for r in V.span_embeddings(windows, ["media_id"]).collect()}
    assert got[1] == pytest.approx([0.6 / math.hypot(0.6, 1.8), 1.8 / math.hypot(0.6, 1.8)]) and got[2] is None
    scores = {r.idx: r.score for r in V.cosines(rows, rows.where("idx = 1"), ["media_id"]).collect()}
    assert scores == {0: pytest.approx(0.8), 1: 1.0, 2: 0.0, 3: None}
    alone = {r.idx: r.score for r in V.without_own(rows, ["media_id"]).collect()}
    assert alone == {0: pytest.approx(0.8), 1: pytest.approx(0.8), 2: 0.0, 3: None}
    centres = spark.createDataFrame([(1, 7, [3.0, 3.0]), (1, 5, [0.0, 1.0])], "media_id long, centre long, v array<double>")
    assert sorted((r.idx, r.centre, r.distance) for r in V.nearest_centre(rows, centres, ["media_id"]).collect()) == [(0, 7, 1.0), (1, 5, 1.0), (2, 5, 1.0)]
    assert {r.media_id: r.idx for r in V.medoids(rows, ["media_id"]).collect()} == {1: 1, 2: 3}


def test_both_ends_of_a_teaser_are_found_in_one_join(spark, tmp_path):
    units = [(m, u, u * 1_000_000, u * 1_000_000 + 900_000) for m in range(3) for u in range(10)]
    spark.createDataFrame(units, "media_id long, unit long, start_us long, end_us long").write.parquet(f"{tmp_path}/the_units")
    units = spark.read.parquet(f"{tmp_path}/the_units")
    pieces = spark.createDataFrame([(m, 0, 0, 9, 0, 9_900_000) for m in range(3)], "media_id long, clip_id long, from_id long, to_id long, start_us long, end_us long")
    clips = spark.createDataFrame([(0, 0, [2, 3]), (1, 0, [4, 5, 6]), (2, 0, [None, 3]), (2, 1, [])], "media_id long, clip_id long, ids array<bigint>")
    out = C.teasers(clips, pieces, units)
    assert sorted((tuple(r) for r in out.collect()), key=str) == [(0, 0, 2_000_000, 3_900_000, None), (1, 0, 4_000_000, 6_900_000, None), (2, 0, None, None, "unknown"), (2, 1, None, None, None)]
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("_b#" in x for x in joins)
