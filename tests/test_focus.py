"""Samples of scenes and the point of a crop, on hand-made rows."""

from mediaspan.operators import focus, plan


def test_sample_times(spark):
    s = 1_000_000
    rows = [
        (1, 0, 10 * s, True, True, 0, 0, 10 * s),  # middle and both quarters
        (2, 0, s // 4, True, True, 0, 0, s // 4),  # no room between the cuts
        *[(3, 0, 6 * s, False, False, k, k * s, (k + 1) * s) for k in range(6)],  # first, middle (2.5 to even), last
        (4, 0, 9 * s, True, False, 0, 0, s // 10), (4, 0, 9 * s, True, False, 1, 5 * s, 9 * s),  # clamped to the cut; one quarter is left
        (5, 0, s, False, False, 0, 0, s), (5, 0, s, False, False, 0, 0, s),  # repeated and short
    ]
    df = spark.createDataFrame(rows, "scene long, scene_start_us long, scene_end_us long, start_is_cut boolean, end_is_cut boolean, pos long, start_us long, end_us long")
    got = {}
    for scene, t in focus.sample_times(df).collect():
        got.setdefault(scene, []).append(t)
    assert got == {1: [2_500_000, 5_000_000, 7_500_000], 2: [125_000], 3: [500_000, 2_500_000, 5_500_000], 4: [200_000, 6_000_000, 7_000_000], 5: [500_000]}
    assert focus.sample_times(df.limit(0)).count() == 0


def test_focus(spark):
    scenes = spark.createDataFrame([(1, 0.5, 0.1, None), (2, 0.5, 0.9, "left"), (3, 0.3, 0.5, "left"), (4, 0.3, 0.5, "right"), (5, 0.3, 0.5, None), (6, 1.5, 0.2, None)], "scene long, crop_width double, manual_x double, side string")
    two = [(0.9, 0.1, 0.1, 0.3), (0.9, 0.7, 0.2, 0.3), (0.9, 0.72, 0.2, 0.3)]
    faces = spark.createDataFrame([(1, 0.5, 0.1, 0.1, 0.3), (1, 0.9, 0.1, 0.1, 0.05), (2, 0.9, 0.4, 0.1, 0.2), (2, 0.9, 0.6, 0.1, 0.2), *[(k, *f) for k in (3, 4, 5) for f in two]], "scene long, score double, x double, width double, height double")
    got = {r["scene"]: (r["focus_x"], r["reason"]) for r in focus.focus(scenes, faces).collect()}
    assert got == {1: (0.25, "no_faces"), 2: (0.55, "all_faces"), 3: (0.15, "primary_side"), 4: (0.81, "primary_side"), 5: (0.81, "largest_face"), 6: (0.5, "no_faces")}


def test_kind_plan(spark):
    slots = [(1, k, 100_000_000 * k, 2_000_000, k) for k in range(3)] + [(2, 7, 0, 2_000_000, 0), (3, 8, 0, 2_000_000, 0), (4, 0, 0, 2_000_000, 0), (4, 1, 9_000_000, 2_000_000, 1)]
    s = spark.createDataFrame(slots, "clip_id long, slot long, anchor_us long, duration_us long, output_us long")
    offers = [
        *[(1, k, "wide", 50_000_000, 0.9) for k in range(3)], (1, 1, "wide", 70_000_000, 0.5),  # shown once, then too near
        (1, 2, "reaction", 10_000_000, 0.3), (1, 2, "reaction", 9_000_000, 0.3),  # a tie: the earlier source
        (2, 7, "wide", 5, 0.9), (2, 7, "reaction", 9, 0.1),  # a single insert is a reaction
        (4, 0, "wide", 0, 0.5), (4, 1, "wide", 1_000_000, 0.5),  # the clip's own moment does not count as shown
    ]
    c = spark.createDataFrame(offers, "clip_id long, slot long, kind string, source_us long, score double")
    assert sorted(tuple(r) for r in plan.kind_plan(s, c).collect()) == [
        (1, 0, 0, "wide", 50_000_000, 0.9), (1, 1, 0, "wide", 70_000_000, 0.5), (1, 2, 0, "reaction", 9_000_000, 0.3), (1, 2, 1, "reaction", 10_000_000, 0.3),
        (2, 7, 0, "reaction", 9, 0.1), (2, 7, 1, "wide", 5, 0.9), (4, 0, 0, "wide", 0, 0.5), (4, 1, 0, "wide", 1_000_000, 0.5),
    ]
    assert plan.kind_plan(s.limit(0), c.limit(0)).count() == 0


def test_people_of_many_scenes_come_in_one_stream(spark):
    from mediaspan.operators.quality import face_groups

    faces = spark.range(3000).selectExpr("id div 3 scene", "(id % 3) * 0.06 center", "0.1 + 0.0 * id area")
    got = face_groups(faces)
    assert {(r.face, r.n) for r in got.collect()} == {(0, 2), (1, 1)} and got.count() == 2000
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
