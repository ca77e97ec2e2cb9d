"""Rules of the interval algebra on hand-made rows, and random spans against a set of points."""

import random

import pandas as pd
from pyspark.sql import functions as F

from mediaspan.functions import text as T
from mediaspan.operators import plan as P
from mediaspan.operators import spans as S
from mediaspan.operators import vectors as V
from mediaspan.operators import words as W


def frame(spark, rows, columns="media_id long, start_us long, end_us long"):
    return spark.createDataFrame(rows, columns)


def pairs(df):
    return sorted((r["media_id"], r["start_us"], r["end_us"]) for r in df.collect())


def covered(rows):
    return {(m, t) for m, a, b in rows for t in range(a, b)}


def test_touching_spans_merge_and_bad_ones_go(spark):
    rows = [(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, None, 3), (1, -4, 2), (1, 8, 12), (2, 1, 2)]
    assert pairs(S.union(frame(spark, rows))) == [(1, 0, 7), (1, 8, 12), (2, 1, 2)]


def test_random_spans_against_points(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.randrange(2), a := rng.randrange(60), a + rng.randrange(1, 9)) for _ in range(n)]
    for _ in range(3):
        a, b = rows(12), rows(10)
        x, y = frame(spark, a), frame(spark, b)
        assert covered(pairs(S.subtract(x, y))) == covered(a) - covered(b)
        assert covered(pairs(S.intersect(x, y, 7))) == covered(a) & covered(b)
        met = S.overlap_join(x.withColumn("i", F.monotonically_increasing_id()), S.right_side(y.withColumn("j", F.monotonically_increasing_id())), 5)
        assert met.count() == sum(m == n and p < s and r < q for m, p, q in a for n, r, s in b)


def test_gaps_have_head_and_tail(spark):
    media = frame(spark, [(1, 1_000_000), (2, 1_000_000)], "media_id long, duration_us long")
    assert pairs(S.gaps(frame(spark, [(1, 250_000, 750_000)]), media)) == [(1, 0, 250_000), (1, 750_000, 1_000_000), (2, 0, 1_000_000)]


def test_bridge_takes_the_next_end(spark):
    assert pairs(S.bridge(frame(spark, [(1, 0, 100_000), (1, 20_000, 60_000), (1, 200_000, 210_000)]))) == [(1, 0, 60_000), (1, 200_000, 210_000)]


def test_output_starts_take_half_a_neighbour_at_most(spark):
    plan = frame(spark, [(1, 0, 0, 4_000_000, 0), (1, 1, 10_000_000, 14_000_000, 200_000), (1, 2, 20_000_000, 20_100_000, 200_000)], "plan_id long, pos long, start_us long, end_us long, fade_us long")
    assert [r["out_us"] for r in S.timeline(plan).orderBy("pos").collect()] == [0, 3_800_000, 7_750_000]


def test_subject_only(spark):
    own = frame(spark, [(1, 0, 16_000_000), (1, 20_000_000, 119_300_000)])
    other = frame(spark, [(1, 16_000_000, 19_800_000)])
    assert pairs(S.subtract(S.padded(own, 300_000), S.padded(other, 400_000))) == [(1, 0, 15_600_000), (1, 20_200_000, 119_600_000)]


def test_asof_and_nearest(spark):
    rows = frame(spark, [(1, 7, 5), (1, 8, 12), (2, 9, 1)], "media_id long, id long, t_us long")
    shots = frame(spark, [(1, 0, 10, 3), (1, 4, 6, 2)], "media_id long, start_us long, end_us long, shot long")
    assert {r["id"]: r["shot"] for r in S.asof(rows, shots, "shot").collect()} == {7: 2, 8: None, 9: None}
    points = frame(spark, [(1, 3), (1, 7), (1, 20)], "media_id long, t_us long")
    assert {r["id"]: r["near_us"] for r in S.nearest(rows, points, 4).collect()} == {7: 3, 8: None, 9: None}


def test_crops(spark):
    got = S.crops(frame(spark, [(1, 0, 10_000_000), (2, 0, 5_000_000)])).collect()
    assert sorted((r["media_id"], r["crop_start_us"], r["crop_end_us"]) for r in got) == [(1, 0, 3_000_000), (1, 3_000_000, 6_000_000), (1, 6_000_000, 9_000_000), (1, 7_000_000, 10_000_000), (2, 0, 5_000_000)]


def words(spark, items):
    return spark.createDataFrame([(1, i, a, b, w) for i, (a, b, w) in enumerate(items)], "media_id long, idx long, start_us long, end_us long, word string")


def test_fillers(spark):
    got = W.fillers(words(spark, [(0, 1, "Uhm,"), (2, 3, "we"), (4, 5, "We"), (500_000, 500_001, "né"), (900_000, 900_001, "go"), (900_002, 900_003, "né")])).collect()
    assert [(r["idx"], r["kind"]) for r in got] == [(0, "hesitation"), (2, "repeat"), (3, "isolated")]


def parts(df, number):
    return [(r["first_idx"], r["last_idx"]) for r in df.orderBy(number).collect()]


def test_units_phrases_and_cues(spark):
    second = 1_000_000
    items = [(0, second // 2, "a"), (second, 1_500_000, "b."), (2 * second, 2_500_000, "c"), (20 * second, 20_500_000, "d")]
    assert parts(W.selection_units(words(spark, items), gap_us=600_000), "unit") == [(0, 1), (2, 2), (3, 3)]
    assert parts(W.selection_units(words(spark, [(0, 500_000, "a"), (600_000, 1_150_000, "b"), (1_200_000, 1_700_000, "c.")])), "unit") == [(0, 2)]
    assert parts(W.phrases(words(spark, [(i, i + 1, "w") for i in range(16)])), "phrase") == [(0, 13), (14, 15)]
    assert parts(W.caption_cues(words(spark, [(i, i + 1, "w") for i in range(7)])), "cue") == [(0, 4), (5, 6)]


def plain_units(items, gap=600_000, long_=8_000_000, short=1_200_000):
    out, current = [], []
    for i, (a, b, w) in enumerate(items):
        if current and a - items[i - 1][1] >= gap:
            out.append(current)
            current = []
        current.append(i)
        size = b - items[current[0]][0]
        if size >= long_ or w[-1] in ".!?…,;:" and size >= short:
            out.append(current)
            current = []
    return [(c[0], c[-1]) for c in out + ([current] if current else [])]


def test_folds_do_not_depend_on_chunks(spark):
    import random

    rng, t, items = random.Random(3), 0, []
    for _ in range(700):
        t += rng.choice([0, 30_000, 200_000, 590_000, 600_000, 900_000])
        items.append((t, t + rng.randrange(50_000, 900_000), rng.choice(["a", "b", "c,", "d.", "e"])))
        t = items[-1][1]
    rows = words(spark, items)
    assert parts(W.selection_units(rows), "unit") == plain_units(items)
    begins = [r.run for r in W.linked_runs(rows, F.col("start_us") - F.col("prev.end_us") >= 600_000).orderBy("idx").collect()]
    for chunk in (7, 64):
        assert [r.run for r in W.linked_runs(rows, F.col("start_us") - F.col("prev.end_us") >= 600_000, chunk=chunk).orderBy("idx").collect()] == begins
    assert begins == [max(j for j in range(i + 1) if j == 0 or items[j][0] - items[j - 1][1] >= 600_000) for i in range(700)]


def test_units_of_segments(spark):
    rows = words(spark, [(0, 100_000, "one"), (150_000, 300_000, "two"), (350_000, 500_000, "Hum"), (2_000_000, 2_100_000, "ah"), (2_150_000, 2_300_000, "three")]).withColumn("seg", F.when(F.col("idx") < 2, 0).when(F.col("idx") < 4, 2).otherwise(4))
    segments = spark.createDataFrame([(1, 0, 0, 1, "x"), (1, 1, 310_000, 340_000, "applause"), (1, 2, 0, 1, "x"), (1, 3, 2_100_000, 2_150_000, " uhm "), (1, 4, 0, 1, "x"), (1, 5, 3_000_000, 3_100_000, None)], "media_id long, seg long, start_us long, end_us long, text string")
    got = [(r.unit, r.first_idx, r.last_idx, r.start_us, r.n_words) for r in W.selection_units(rows, segments).orderBy("unit").collect()]
    # The words before and after a segment without words are no unit together; hesitations alone are none.
    assert got == [(0, 0, 1, 0, 2), (1, None, None, 310_000, 0), (2, 4, 4, 2_150_000, 1)]


def test_phrases_stay_inside_pieces(spark):
    rows = words(spark, [(i * 100_000, i * 100_000 + 90_000, "w") for i in range(10)])
    pieces = spark.createDataFrame([(1, 5, 0, 50_000, 420_000), (1, 5, 1, 400_000, 700_000), (1, 6, 0, 0, 95_000)], "media_id long, clip_id long, piece long, start_us long, end_us long")
    got = [(r.clip_id, r.phrase, r.piece, r.first_idx, r.last_idx, r.start_us, r.end_us) for r in W.piece_phrases(rows, pieces, 1_000_000).orderBy("clip_id", "phrase").collect()]
    assert got == [(5, 0, 0, 0, 4, 50_000, 420_000), (5, 1, 1, 4, 6, 400_000, 690_000), (6, 0, 0, 0, 0, 0, 90_000)]


def test_beats(spark):
    beats = spark.createDataFrame([(1, 0, "hello big"), (1, 1, "missing"), (1, 2, "end now")], "media_id long, beat long, text string")
    got = W.beat_spans(words(spark, [(0, 1, "Hello"), (1, 2, "big"), (2, 3, "noise"), (3, 4, "end"), (4, 5, "now.")]), beats)
    assert [(r["beat"], r["first_idx"], r["last_idx"]) for r in got.orderBy("beat").collect()] == [(0, 0, 1), (1, None, None), (2, 3, 4)]


def test_texts(spark):
    row = spark.range(1).select(
        T.js_number(F.lit(4948.8)).alias("a"), T.js_number(F.lit(1e-7)).alias("b"), T.js_number(F.lit(1e21)).alias("c"), T.js_number(F.lit(3.0)).alias("d"), T.token(F.lit("(Hello!)")).alias("e"),
        T.plain(F.lit("Ção-1")).alias("f"), T.video_id(F.lit("https://youtu.be/abcdefghijk?t=1")).alias("g"), T.video_id(F.lit("https://example.com/x")).alias("h"), T.timestamp(F.lit(3_723_004_000)).alias("i"),
        T.without_hesitations(F.lit("uhm well, uh yes")).alias("j"), T.headline(F.lit("  a  b \n\n c")).alias("k"), T.clip_key(F.lit(2), F.lit(4948.8), F.lit(5010.2), F.lit("fast")).alias("l")).first()
    assert tuple(row) == ("4948.8", "1e-7", "1e+21", "3", "hello", "cao1", "abcdefghijk", None, "01:02:03,004", "well, yes", "a b\nc", "2:4948.8:5010.2:fast")


def test_calibration(spark):
    rows = [(1, s, True) for s in (80, 70, 90)] + [(1, s, False) for s in (10, 20, 30)]
    got = V.calibrate(spark.createDataFrame(rows, "media_id long, score long, positive boolean"), ["media_id"]).collect()
    assert [(r["twice"], r["good"]) for r in got] == [(100, 18)]


def test_greedy_choices(spark):
    rows = spark.createDataFrame([(1, 1, 0, 10, 5), (1, 2, 5, 15, 9), (1, 3, 15, 20, 1)], "media_id long, id long, start_us long, end_us long, score long")
    assert sorted(r["id"] for r in P.without_overlaps(rows).collect()) == [2, 3]
    points = rows.select("media_id", "id", F.col("start_us").alias("t_us"), "score")
    assert sorted(r["id"] for r in P.spaced(points, 8).collect()) == [2, 3]


def test_short_segments(spark):
    rows = frame(spark, [(1, 0, 10), (1, 11, 12), (1, 30, 31), (2, 5, 6)])
    assert pairs(P.absorb_short(rows, 5, 3)) == [(1, 0, 12), (2, 5, 6)]


def test_clusters():
    import numpy as np

    label = V.leaders(np.array([[0.0, 0], [0.1, 0], [5, 5], [5.1, 5], [0, 0.1]]), 0.75)
    assert label.tolist() == [0, 0, 1, 1, 0]
    assert isinstance(pd.Series(label), pd.Series)


def test_a_span_without_length_inside_another_is_met(spark):
    clips = spark.createDataFrame([(1, 1, 100, 200), (1, 2, 300, 300), (1, 3, 400, 500)], "media_id long, id long, start_us long, end_us long")
    tracks = spark.createDataFrame([(1, "a", 150, 150), (1, "b", 290, 310), (1, "c", 400, 400), (1, "c", 500, 500)], "media_id long, label string, start_us long, end_us long")
    for bucket in (7, 50, 1000):
        assert sorted((r.id, r.label, r.us) for r in S.dominant(clips, tracks, "label", bucket).collect()) == [(1, "a", 0), (2, "b", 0)]


def test_short_segments_of_many_keys_are_one_stream(spark):
    import random

    rng = random.Random(11)
    given = [(rng.choice([None, *"abcdefg"]), s, s + rng.choice([1, 2, 9])) for s in rng.sample(range(600), 150)]
    frame = spark.createDataFrame(given, "key string, start_us long, end_us long").repartition(3)

    def plain(rows):
        rows, i = [list(r) for r in sorted(rows)], 0
        while len(rows) > 1 and i < len(rows):
            (a, b), gaps = rows[i], []
            if b - a >= 5:
                i += 1
                continue
            gaps += [(a - rows[i - 1][1], i - 1)] if i else []
            gaps += [(rows[i + 1][0] - b, i + 1)] if i + 1 < len(rows) else []
            gap, to = min(gaps)
            if gap <= 3:
                rows[to] = [rows[to][0], max(rows[to][1], b)] if to < i else [min(rows[to][0], a), rows[to][1]]
            del rows[i]
            i = max(0, i - 1)
        return rows

    found = P.absorb_short(frame, 5, 3, ("key",))
    expected = [(k, *r) for k in {g[0] for g in given} for r in plain([g[1:] for g in given if g[0] == k])]
    order = lambda r: (r[0] or "", *r[1:])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
