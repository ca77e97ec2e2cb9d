"""Groups of consecutive words: the same for any deal of the words, and few words in a shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mediaspan.operators import runs as R

def rules():
    """begins, before, after; made here so that they reach the workers by value."""
    return lambda now, prev: now["start_us"] - prev["end_us"] >= 50, lambda n, begun, start, end: n >= 4, lambda n, begun, end, mark: bool(mark)


def plain(rows):
    out, last = [], None
    for m, i, a, b, mark in sorted(rows):
        if last is None or last[0] != m or a - last[2] >= 50 or last[3] or out[-1][5] >= 4:
            out.append([m, i, i, a, b, 0])
        out[-1][2], out[-1][4], out[-1][5] = i, b, out[-1][5] + 1
        last = (m, i, b, mark)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("deal", ["in order", "mixed", "holes", "no breaks"])
def test_groups_do_not_depend_on_the_deal(spark, monkeypatch, deal):
    monkeypatch.setattr(R, "LONG_RUN", 7)
    draw, rows = random.Random(len(deal)), []
    for media in range(6):
        t = 0
        for i in range(draw.choice([1, 3, 90])):
            t += 10 + (0 if deal == "no breaks" else draw.choice([0, 0, 0, 60]))
            if deal != "holes" or draw.random() < 0.7:
                rows.append((media, i, t, t + 8, int(draw.random() < 0.1)))
    if deal == "mixed":
        draw.shuffle(rows)
    words = spark.createDataFrame(rows, "media_id long, idx long, start_us long, end_us long, m long")
    for chunk in (5, 4096):
        got = R.grouped(words, *rules(), mark=F.col("m"), chunk=chunk).drop("said").collect()
        assert sorted(map(tuple, got)) == plain(rows), chunk


def test_words_in_order_are_grouped_where_they_are_read(spark):
    words = spark.range(2000, numPartitions=1).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("idx"), (F.col("id") * 10 + F.floor(F.col("id") / 5) * 60).alias("start_us"))
    zero = F.lit(0).cast("long")
    words = words.select("media_id", F.col("idx").alias("first_idx"), F.col("idx").alias("last_idx"), "start_us", (F.col("start_us") + 8).alias("end_us"), *[zero.alias(c) for c in R.STATE[4:]])
    out = words.mapInArrow(R._local(("media_id",), *rules(), None), words.schema)
    assert out.where("n_words = 0").count() == 10  # the first and the last run may go on in other tasks
    assert out.agg(F.sum("n_words")).first()[0] == 1990


def test_a_clip_that_goes_on_in_the_next_batch_is_one(spark):
    import pyarrow as pa

    from mediaspan.operators import edits as E

    names = ["media_id", "clip_id", "from_id", "to_id"]
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names) for rows in ([(1, 1, 0, 2)], [(1, 1, 2, 9), (1, 1, 3, 4), (1, 1, 6, 6)], [(1, 2, 7, 7)])]
    assert [tuple(r.values()) for b in E.fold_ranges(batches) for r in b.to_pylist()] == [(1, 1, 0, 0, 4), (1, 1, 1, 6, 6), (1, 2, 0, 7, 7)]


def test_phrases_are_sent_to_the_words(spark):
    from mediaspan.operators import words as W

    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("Not the end, of The End of".split())] + [(2, 0, "end")], "media_id long, idx long, word string")
    phrases = spark.createDataFrame([(1, ["the", "end"]), (2, ["end", "of"]), (3, ["end"]), (4, ["of", "not"])], "phrase_id long, tokens array<string>")
    got = W.ngram_first(words, phrases)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 3, 0)]
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_those_of_difflib(monkeypatch):
    import difflib

    from mediaspan.operators import words as W

    def joined(blocks):
        out = []
        for i, j, n in blocks:
            if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
                i, j, m = out.pop()
                n += m
            out.append((i, j, n))
        return out

    rng = random.Random(5)
    monkeypatch.setattr(W, "PLAIN_PAIRS", 4)
    for n in range(400):
        monkeypatch.setattr(W, "MOST_RUNS", 20 if n % 5 == 0 else 1 << 22)
        b = [rng.randrange(rng.choice([2, 3, 10, 50])) for _ in range(rng.randrange(60))]
        a = [w for w in b if rng.random() < 0.8] if n % 2 else [rng.randrange(10) for _ in range(rng.randrange(60))]
        assert joined(W.matching_blocks(a, b)) == [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m[2]]


def test_a_long_recording_is_aligned_soon(monkeypatch):
    import difflib
    import time

    from mediaspan.operators import words as W

    # Only short stretches go to difflib, whose time grows with the square of a recording.
    seen, plain = [], difflib.SequenceMatcher
    monkeypatch.setattr(W.difflib, "SequenceMatcher", lambda junk, a, b, autojunk: seen.append(len(a) * len(b)) or plain(junk, a, b, autojunk))
    rng = random.Random(6)
    heard = [int(rng.paretovariate(0.8)) for _ in range(10_000)]
    began = time.time()
    blocks = W.matching_blocks([w for i, w in enumerate(heard) if i % 13], heard)
    assert max(seen) <= W.PLAIN_PAIRS and sum(n for *_, n in blocks) > 9000 and time.time() - began < 20


def test_blocks_of_many_recordings_are_found_at_once(monkeypatch):
    import difflib

    import numpy as np

    from mediaspan.operators import align as L
    from mediaspan.operators import words as W

    rng = random.Random(7)
    heard = [[rng.randrange(rng.choice([2, 400])) for _ in range(rng.randrange(300))] for _ in range(30)]
    for h in heard[::3]:  # a passage that comes again, so that runs cross each other
        h[40:40] = h[:30] * 2
    script = [[t for i, t in enumerate(h) if i % 13] for h in heard]
    script[4] = script[4][50:] + script[4][:50]
    flat = lambda lists: (np.array([t for x in lists for t in x], np.int64), np.cumsum([0, *map(len, lists)]))
    rest = []
    got = L.blocks(*flat(script), *flat(heard), lambda x, y, below: rest.append(len(x)) or W._falling(x, y, below))
    met = {(int(i) + k, int(j) + k) for i, j, n in zip(*got, strict=True) for k in range(n)}
    a, b, expected = 0, 0, set()
    for x, y in zip(script, heard, strict=True):
        expected |= {(a + i + k, b + j + k) for i, j, n in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for k in range(n)}
        a, b = a + len(x), b + len(y)
    assert met == expected
    assert sum(rest) < sum(map(len, script)) / 2


def test_words_of_a_recording_pass_as_one_row():
    import pyarrow as pa

    from mediaspan.operators import align as L

    batch = pa.record_batch({"media_id": [1, 1, 1, 1, 2, None], "n": pa.array([0, 1, 3, 4, 5, None], pa.int64()), "text": ["a", "béc", "", None, "d", "e"]})
    (rows,) = L.packed([batch.slice(0, 0), batch])
    assert rows.column("n").to_pylist() == [0, 3, 5, None]
    row, n, text = L.unpacked(*(rows.column(c).slice(0, 3) for c in ("n", "sizes", "bytes")))
    assert (row.tolist(), n.to_pylist(), text.to_pylist()) == ([0, 0, 1, 1, 2], [0, 1, 3, 4, 5], ["a", "béc", "", "", "d"])


def test_lines_of_documents_with_one_id(spark, tmp_path):
    from pyspark.sql import functions as F

    from mediaspan.sources import adapters as A

    texts = [(1, " ".join(f"w{i}" for i in range(100))), (1, "x  y\nz"), (2, ""), (3, None), (4, "only")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = A.words(spark, str(tmp_path)).withColumn("line", F.floor(F.col("idx") / 40)).where("idx % 13 <> 0")
    words = words.groupBy("media_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ").alias("text"))
    assert sorted(A.lines(spark, str(tmp_path), 40, 13).collect()) == sorted(words.collect()) != []


@pytest.mark.parametrize("sizes", [[1], [400], [3, 1, 5] * 40, [30] * 9 + [900]])
def test_runs_of_a_batch_are_grouped_at_once(sizes):
    import numpy as np

    calls, rng = [0], random.Random(len(sizes))
    n = sum(sizes)
    start = np.cumsum([rng.choice([10, 30]) for _ in range(n)])
    opens = np.zeros(n, bool)
    opens[np.cumsum([0, *sizes[:-1]])] = True
    x = {"media_id": np.repeat(np.arange(len(sizes)), sizes), "first_idx": np.arange(n), "start_us": start, "end_us": start + 8, "mark": np.array([rng.random() < 0.1 for _ in range(n)], np.int64), "said": np.ones(n, np.int64)}

    def before(n, begun, start, end):
        calls[0] += 1
        return (n >= 5) | (end - begun > 70)

    after = lambda n, begun, end, mark: (mark > 0) & (end - begun >= 20)
    found = R._Groups(("media_id",), before, after, True).whole(x, np.arange(n), opens)
    steps = calls[0]
    one = R._Groups(("media_id",), before, after)
    assert list(zip(*(c.tolist() for c in found), strict=True)) == [tuple(g) for g in one.add(x, np.arange(n), opens) + one.rest()]
    assert len(sizes) < 8 or steps < 32 + max(sizes)


def test_words_meet_pieces_where_their_texts_were_dealt(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from mediaspan.operators import words as W
    from mediaspan.plans import more_queries as Q
    from mediaspan.sources import adapters as A

    texts = [(k, " ".join(f"w{(i * 7 + k) % 11}{',' if i % 23 == 5 else ''}" for i in range(300 + 70 * k))) for k in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, kept = [], R.kept
    monkeypatch.setattr(R, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    found = Q.QUERIES["d04_piece_phrases"](spark, str(tmp_path))
    assert "ShuffledHashJoin" in plans[0] and not any("_bucket" in line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line)
    # Clips are numbered by one shuffle, not by another one for each piece before.
    assert sum("Window [row_number" in line for line in found._jdf.queryExecution().executedPlan().toString().splitlines()) == 1
    words = A.words(spark, str(tmp_path))
    r = words.groupBy("media_id", F.floor(F.col("idx") / 90).alias("piece")).agg((F.min("start_us") + 100_000).alias("start_us"), F.max("end_us").alias("end_us"))
    r = r.withColumn("end_us", F.col("end_us") + F.when(F.col("piece") % 6 == 0, 1_500_000).otherwise(-120_000)).withColumn("clip_id", F.floor(F.col("piece") / 4))
    plain = W.piece_phrases(words, r.where("piece % 3 < 2"), 60_000_000)
    assert sorted(found.collect()) == sorted(plain.collect()) != []
