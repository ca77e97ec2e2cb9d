"""The operators on vectors against plain versions, on odd rows too."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from mediaspan.llm import forest, lloyd, queries, rtree

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", "y") for r in rows], SCHEMA)


def some(n, dims, seed, copies=0):
    """Vectors of small multiples of 1/8, so that scores tie, with copies of the first among them."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-12, 12) / 8 for _ in range(dims)], rng.randrange(4)) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 5) for i in range(copies)]


ODD = [(400, None, 1), (420, [0.0] * 8, 1), (440, [float("nan")] * 8, 1), (460, [None] + [1.0] * 7, 1), (480, [float("inf")] * 8, 2), (None, [1.0] * 8, 1), (500, [1.0] * 8, None), (520, [0.5] * 3, 1), (540, [], 1), (560, [3e38] + [0.0] * 7, 2), (20, [0.25] * 8, 1), (20, [0.25] * 8, 1)]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, every=100, dims=8):
    kept = [(i, lab, [max(-(2**26), min(2**26, math.floor(256 * x))) for x in v] + [0] * (dims - len(v))) for i, v, lab in rows if i is not None and lab is not None and fine(v)]
    anchors = {}
    for i, lab, v in sorted((x for x in kept if x[0] % every == 0), key=lambda x: (x[0], x[1])):
        anchors.setdefault(i, (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in kept if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            bad = [x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(bad)]
    return sorted(out)


def test_hard_negatives(spark):
    for rows in (some(300, 8, 1, 40) + ODD, some(60, 8, 2), ODD, []):
        got = rtree.hard_negatives(frame(spark, rows), every=20, block=7)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 20)


def test_relabelled(spark):
    got = rtree.relabelled(frame(spark, [(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None), (None, [1.0], 3)]))
    assert [r.label for r in got.collect()] == [0, 9, None, 3]


def test_boxes_hold_their_rows_and_prune():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-50, 50, (500, 6)) + c for c in rng.integers(-2000, 2000, (12, 6))]).astype(np.int64)
    ids, labels = rng.permutation(len(x)), np.repeat(np.arange(12), 500)
    tree = rtree.Tree(ids, labels, x, page=64, fan=4)
    assert sorted(tree.ids) == list(range(len(x))) and (np.diff(tree.starts) <= 64).all() and (np.diff(tree.starts) > 0).all()
    q = rng.integers(-2000, 2000, (5, 6))
    for boxes, starts in ((tree.boxes, tree.starts), (tree.upper_boxes, [*tree.starts[tree.nodes], len(x)])):
        low, high = tree.intervals(boxes, q)
        for b in range(len(starts) - 1):
            s = tree.x[starts[b] : starts[b + 1]] @ q.T
            assert (s.min(0) >= low[b]).all() and (s.max(0) <= high[b]).all()

    class Counted(np.ndarray):
        pages = 0

        def __matmul__(self, other):
            Counted.pages += 1
            return np.asarray(self) @ np.asarray(other)

    spans = [tree.intervals(b, q) for b in (tree.upper_boxes, tree.boxes)]
    tree.x = tree.x.view(Counted)
    for i in range(5):
        Counted.pages = 0
        everything = np.asarray(tree.x) @ q[i]
        ends = (int(np.quantile(everything, 0.4)), int(np.quantile(everything, 0.5)))
        (scores, found), (top, first) = tree.search(-1, 3, q[i], [ends, (rtree.LEAST, rtree.MOST)], 10, False, *([s[:, i] for s in pair] for pair in spans))
        for lo, hi, s, f in ((*ends, scores, found), (rtree.LEAST, rtree.MOST, top, first)):
            fits = (tree.labels != 3) & (everything >= lo) & (everything <= hi)
            best = sorted(zip(-everything[fits], tree.ids[fits], strict=True))[:10]
            assert [(-a, b) for a, b in best] == list(zip(s, f, strict=True))
        assert Counted.pages < (len(tree.starts) - 1) / 2


def plain_codes(rows, parts, entries, rounds, scale, dims):
    kept = [(i, lab, [max(-lloyd.HELD, min(lloyd.HELD, math.floor(scale * x))) for x in v] + [0] * (dims - len(v))) for i, v, lab in rows if fine(v)]
    width = dims // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, [rows_v for rows_v in kept[r][2]]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def nearest(p, w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for row in cut:
            for p in range(parts):
                groups[p, nearest(p, row[p])[1]].append(row[p])
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    said = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = [], collections.Counter()
    for (i, lab, _), row in zip(kept, cut, strict=True):
        best = [nearest(p, row[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by[lab] += error
        out.append((i, "".join(f"{e:02x}" for _, e in best), error, lab))
    return collections.Counter((i, c, e, min(by[lab], 2**63 - 1), said) for i, c, e, lab in out)


def test_vector_codes(spark):
    for rows in (some(150, 8, 4, 30) + ODD, some(5, 8, 5), ODD[:3], []):
        got = lloyd.encode(frame(spark, rows), parts=4, entries=6, rounds=5, scale=64.0)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert collections.Counter(map(tuple, got.collect())) == plain_codes(rows, 4, 6, 5, 64.0, 8)


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(8)
    x, books = rng.integers(-9, 9, (400, 3, 2)), rng.integers(-9, 9, (3, 7, 2))
    none = np.zeros((400, 3), np.int64)
    codes, far = lloyd.assign(x, books, None, none, none)
    for share in (0.0, 0.2, 0.6, 1.0):
        moved = rng.random((3, 7)) < share
        new = np.where(moved[..., None], rng.integers(-9, 9, books.shape), books)
        for a, b in zip(lloyd.assign(x, new, moved, codes, far), lloyd.assign(x, new, None, none, none), strict=True):
            assert (a == b).all()


def plain_neighbours(rows, every, k, dims):
    kept = sorted({(i, tuple(v) + (0.0,) * (dims - len(v))) for i, v, _ in rows if i is not None and fine(v) and any(v)})
    out, asked = {}, {}
    for i, v in kept:
        if i % every == 0:
            asked.setdefault(i, v)
    for q, v in asked.items():
        out[q] = sorted((-sum(a * b for a, b in zip(map(float, np.float32(v)), map(float, np.float32(w)), strict=True)), i) for i, w in kept if i != q)[:k]
    return out


@pytest.mark.parametrize("trees", [3, 24])
def test_neighbours(spark, trees):
    for rows in (some(400, 8, 6, 200) + ODD, some(10, 8, 7), ODD, []):
        got = collections.defaultdict(list)
        for r in forest.search(frame(spark, rows), k=20, trees=trees).orderBy("query_id", "rank").collect():
            assert r.rank == len(got[r.query_id]) + 1
            got[r.query_id].append((-r.score, r.vec_id))
        exact = plain_neighbours(rows, 20, 20, 8)
        assert set(got) == set(exact)
        hits = sum(len(set(got[q]) & set(exact[q])) for q in exact)
        assert hits >= 0.9 * sum(map(len, exact.values()))
        for q, best in got.items():
            assert best == sorted(best) and q not in [i for _, i in best]


def test_neighbours_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    found = collections.defaultdict(set)
    for r in queries.op13_neighbours(spark, sf).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        assert len(found[ids[i]]) == 20
        hits += len(found[ids[i]] & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_directory():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 1 << forest.BITS, (3000, 2)) >> rng.integers(0, 9, (3000, 1))
    counts = np.stack([np.bincount(keys[:, t] >> (forest.BITS - 7), minlength=128) for t in range(2)])
    directory = forest.Directory(counts, segment=50)
    totals = directory.totals(keys[:20])
    for level in range(8):
        shift = forest.BITS - level
        assert totals[level].tolist() == [int((keys >> shift == keys[q] >> shift).sum()) for q in range(20)]
    for wanted in (1, 30, 700, 10**9):
        level = directory.levels(keys[:20], wanted)
        for q, at in enumerate(level.tolist()):
            if at >= 0:
                assert totals[at, q] < 3000 and (totals[at, q] >= wanted or at == 0) and (at == 7 or totals[at + 1, q] < wanted)
    query, tree, segment = directory.visits(keys[:20], np.full(20, 3))
    trees, at = np.arange(2), keys >> (forest.BITS - 7)
    for q in range(20):
        for t in range(2):
            inside = keys[:, t] >> (forest.BITS - 3) == keys[q, t] >> (forest.BITS - 3)
            held = {int(directory.first[t, p]) + s for p in set(at[inside, t].tolist()) for s in range(int(directory.spread[t, p]))}
            assert held <= set(segment[(query == q) & (tree == t)].tolist())
