"""Boards, episodes, rankings and small rules on hand-made rows."""

import random

from pyspark.sql import functions as F

from mediaspan.functions import text as T
from mediaspan.operators import catalog as C
from mediaspan.operators import review as R
from mediaspan.operators import selection as S
from mediaspan.sources.scratch import kept


def test_board(spark):
    clips = spark.createDataFrame([(1, "a", 0, 2), (1, "a", 1, 1), (1, "b", 2, None), (1, "c", 3, 1), (2, "a", 0, 5)], "run_id long, clip_key string, pos long, rank int")
    states = spark.createDataFrame([(1, "a", False, False, False, True), (1, "b", None, True, False, False)], "run_id long, clip_key string, posted boolean, discarded boolean, saved boolean, approved boolean")
    items = spark.createDataFrame([(1, "a", 7, "succeeded", 3, False), (1, "a", 8, "succeeded", 9, True), (1, "c", None, "succeeded", 1, False), (1, "c", 9, "failed", 1, False), (1, "b", 10, "succeeded", 4, None)], "run_id long, clip_key string, artifact_id long, status string, exported_at long, draft boolean")
    got = {(r.run_id, r.clip_key): (r.rank, r.place, r.exports, r.newest, r.status) for r in C.board(clips, states, items).collect()}
    assert got == {(1, "a"): (2, 2, 1, 3, "exported"), (1, "b"): (None, 3, 1, 4, "discarded"), (1, "c"): (1, 1, 0, None, "new"), (2, "a"): (5, 1, 0, None, "new")}
    renders = spark.createDataFrame([(5, 9, 1, False), (5, 20, 1, False), (5, 21, 2, None), (5, 22, 3, True)], "project_id long, artifact_id long, created_at long, draft boolean")
    assert sorted((r.artifact_id, r.place) for r in C.other_exports(renders, items).collect()) == [(20, 2), (21, 1)]


def test_episodes(spark):
    projects = spark.createDataFrame([(p,) for p in range(1, 7)], "project_id long")
    video = "https://youtu.be/abcdefghijk"
    sources = spark.createDataFrame([(1, 1, video), (2, 2, "https://www.youtube.com/watch?v=abcdefghijk"), (3, 3, None), (4, 4, "https://example.com/x"), (5, 1, None), (6, 5, None)], "source_id long, project_id long, url string")
    local = spark.createDataFrame([("local-2", 2), ("old", 5), ("old", 1)], "episode_id string, project_id long")
    archived = spark.createDataFrame([("local-3",)], "episode_id string")
    got = {r.episode_id: (r.url, list(r.projects), r.hidden) for r in C.episodes(projects, sources, archived, local).collect()}
    # 4 has an address that names no video, 6 no source: neither is an episode. 2's earlier one is covered.
    assert got == {"abcdefghijk": (True, [1, 2], False), "local-3": (False, [3], True), "local-5": (False, [5], False), "local-2": (False, [2], True), "old": (False, [1, 5], False)}


def test_ranked(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(9)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, x long")
    got = {r.id: r.place for r in C.ranked(frame, [F.col("x").desc(), F.col("id").asc()], 7, kept).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert C.ranked(frame.limit(0), [F.col("x").asc()], 7, kept).count() == 0


def test_small_rules(spark):
    pieces = spark.createDataFrame([(1, 0, "Isso foi"), (1, 1, " Isso, foi"), (1, 2, "issox foi"), (1, 3, '"Ela" foi'), (1, 4, None), (1, 5, "")], "media_id long, pos long, text string")
    assert [(r.pos, r.opens) for r in S.dangling(pieces).orderBy("pos").collect()] == [(1, "isso"), (3, "ela")]
    renders = spark.createDataFrame([("/a/draft-1.mp4", None), ("/draft/x.mp4", None), ("x.mp4", "draft"), (None, None)], "path string, purpose string")
    assert [r.d for r in renders.select(C.is_draft(F.col("path"), F.col("purpose")).alias("d")).collect()] == [True, False, True, False]
    scores = spark.createDataFrame([(7.0, {"a": 1, "b": 1}), (7.0, {"a": 1}), (7.0, None)], "score double, parts map<string, int>")
    assert [r.s for r in scores.select(C.rescaled(F.col("score"), F.col("parts"), ("a", "b")).alias("s")).collect()] == [2.0, 7.0, 7.0]
    text = spark.createDataFrame([("one\ntwo  three\n \t\n\nfour\n\n",)], "t string")
    assert text.select(T.paragraphs(F.col("t")).alias("p")).first().p == ["one two three", "four"]


def test_candidates_and_retention(spark):
    a = spark.createDataFrame([(1, None, "n" * 400, 1500)], "id long, name string, text string, ms long")
    b = spark.createDataFrame([("k", "t", None, None)], "key string, title string, note string, seconds double")
    got = R.candidates({"a": (a, {"ref": "id", "title": "name", "note": "text", "ms": "ms"}), "b": (b, {"ref": "key", "title": "title", "note": "note", "seconds": "seconds"})})
    assert sorted((r.provider, r.ref, r.title, len(r.note), r.seconds) for r in got.collect()) == [("a", "1", "untitled", 300, 1.5), ("b", "k", "t", 0, None)]
    files = spark.createDataFrame([("s", i, 10, i) for i in range(50)], "store string, path long, bytes long, age long")
    row = R.retention(files, 20, 3).first()
    assert (row.files, row.bytes, list(row.first)) == (29, 290, [49, 48, 47])


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_meet_without_their_prefixes(spark):
    rows = lambda x: spark.createDataFrame(x, "k long, path array<string>, value string")
    old, new = rows([(1, ["a"], "1"), (1, ["b", "c"], "2"), (1, ["d"], "3"), (1, ["ab"], "4"), (2, ["a"], "5")]), rows([(1, ["a", "x"], "6"), (1, ["b"], "7"), (1, ["b"], "8")])
    got = C.without_paths(old, new)
    assert sorted((r.k, r.value) for r in got.collect()) == [(1, "3"), (1, "4"), (2, "5")]
    assert "Generate" not in planned(got)


def test_items_are_not_made_distinct(spark):
    renders = spark.createDataFrame([(1, 1, 5, False), (1, 2, 6, None), (1, 3, 7, True), (1, 4, 8, False)], "project_id long, artifact_id long, created_at long, draft boolean")
    items = spark.createDataFrame([(4,), (4,), (None,)], "artifact_id long")
    got = C.other_exports(renders, items)
    assert sorted((r.artifact_id, r.place) for r in got.collect()) == [(1, 2), (2, 1)]
    assert "Aggregate" not in planned(got)


def test_a_union_in_order_is_one_aggregate(spark):
    from mediaspan.plans import registry

    assert "Join" not in planned(registry.QUERIES["i01_union_in_order"](spark, "/root/testdata/sf0.001"))
