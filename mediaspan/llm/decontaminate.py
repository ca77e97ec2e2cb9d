"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.llm import shared

#: Bits of a fingerprint, its blocks, and the radius within which all fingerprints are found.
#: At a weighted similarity of 0.8 the angle of two SimHashes differs in 9.7 of 64 bits on
#: average; 23 is 4.6 standard deviations above.
BITS, BLOCKS, RADIUS = 64, 8, 23
WORDS, SIMILARITY = 5, 0.8
#: Shingles whose bits are summed at once, and windows of a stretch that are looked at at once.
SLICE, STRETCH = 1 << 16, 4096


def fingerprints(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """SimHash of each run of shingles (cuts: where each non-empty run starts); a repeat weighs again."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    return np.packbits(np.add.reduceat(bits, cuts, axis=0) > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Blocks:
    """Items of one length by the blocks of their fingerprints.

    Two fingerprints within RADIUS differ by at most RADIUS // BLOCKS bits in some block, so each
    item stands, in every block, under all values that near to its own.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near = [[v ^ mask for mask in range(256) if bin(mask).count("1") <= RADIUS // BLOCKS] for v in range(256)]
        self.lists = [[[] for _ in range(256)] for _ in range(BLOCKS)]
        for i, x in enumerate(prints.view(np.uint8).reshape(-1, BLOCKS)):
            for b in range(BLOCKS):
                for v in near[x[b]]:
                    self.lists[b][v].append(i)

    def find(self, prints: np.ndarray) -> list[np.ndarray]:
        """The items within RADIUS of each fingerprint."""
        out = []
        for x, parts in zip(prints, prints.view(np.uint8).reshape(-1, BLOCKS), strict=True):
            some = np.unique(np.concatenate([np.array(self.lists[b][parts[b]], np.int64) for b in range(BLOCKS)]))
            out.append(some[np.bitwise_count(self.prints[some] ^ x) <= RADIUS])
        return out


class Items:
    """Benchmark items as shingles, and what finds windows that can be like one of them."""

    def __init__(self, ids: list, texts: list[str]):
        data, offsets = shared.buffer(pa.array(texts, pa.string()))
        hashes, first, _, _ = shared.words(data, offsets)
        lengths = np.diff(first)
        self.ids = ids
        self.groups = {}  # length in words -> items, their index, their sorted shingles
        self.seeds = {}  # shingle size -> sorted shingles, and for each its items and offsets
        seeds: dict[int, list] = {}
        for n in sorted({int(n) for n in lengths if n}):
            items = np.flatnonzero(lengths == n)
            size = min(n, WORDS)
            sets = [shared.shingles(hashes[first[i] : first[i + 1]], np.array([0, n]), size)[0] for i in items]
            prints = fingerprints(np.concatenate(sets), np.arange(len(items)) * (n - size + 1))
            self.groups[n] = (items, Blocks(prints), [np.unique(s, return_counts=True) for s in sets])
            for i, s in zip(items, sets, strict=True):
                seeds.setdefault(size, []).extend((int(h), int(i), o) for o, h in enumerate(s))
        self.lengths = lengths
        for size, rows in seeds.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            quick = np.zeros(1 << 20, bool)
            quick[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[size] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), quick)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted multisets (values, counts): sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def matches(items: Items, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, similarity) of each row's windows like an item.

    A window like an item shares a shingle with it, so windows are laid where shared shingles
    put them: at that shingle's place in the item. Each window's fingerprint is looked up among
    all items of its length; what lies within the radius is compared exactly. An item that has no
    such window may still be there with its parts in another order: see `_anywhere`.
    """
    out = []
    for size, (keys, item, offset, quick) in items.seeds.items():
        found, at = shared.shingles(hashes, first, size)
        may = np.flatnonzero(quick[(found >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(keys, found[may], "left")
        count = np.searchsorted(keys, found[may], "right") - low
        may, low, count = may[count > 0], low[count > 0], count[count > 0]
        if not len(may):
            continue
        row = np.searchsorted(at, may, "right") - 1
        place = np.repeat(may - at[row], count)
        post = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        row, begin, n = np.repeat(row, count), place - offset[post], items.lengths[item[post]]
        met = np.unique(np.stack([row, item[post], place], 1), axis=0)
        windows = np.unique(np.stack([row, begin, n], 1), axis=0)
        row, begin, n = windows.T
        words = (first[1:] - first[:-1])[row]
        end = np.minimum(begin + n, words)
        begin = np.maximum(begin, 0)
        full = np.maximum(end - begin - size + 1, 1)  # shingles of the window
        full = np.where((begin == 0) & (end == words), at[row + 1] - at[row], full)
        for a, b in shared.slices(np.concatenate([[0], np.cumsum(full)]), SLICE):
            own = slice(a, b)
            cuts = np.cumsum(full[own]) - full[own]
            mine = found[np.repeat(at[row[own]] + begin[own] - cuts, full[own]) + np.arange(full[own].sum())]
            prints = fingerprints(mine, cuts)
            for length in np.unique(n[own]):
                group, index, sets = items.groups[int(length)]
                some = np.flatnonzero(n[own] == length)
                for k, near in zip(some, index.find(prints[some]), strict=True):
                    counted = np.unique(mine[cuts[k] : cuts[k] + full[a + k]], return_counts=True)
                    for x in near:
                        if (like := similarity(counted, sets[x])) >= SIMILARITY - 1e-12:
                            out.append((int(row[a + k]), int(group[x]), int(begin[a + k]), int(end[a + k] - begin[a + k]), like))
        out += _anywhere(items, met, {(r, i) for r, i, *_ in out}, found, at, np.diff(first), size)
    return out


def stretches(places: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """(first, last) of the runs of places b such that b to b + width - 1 holds `least` of the ascending places."""
    starts, stops = places - width + 1, places + 1
    points = np.unique(np.concatenate([starts, stops]))
    enough = np.searchsorted(starts, points, "right") - np.searchsorted(stops, points, "right") >= least
    turns = np.flatnonzero(np.diff(enough.astype(np.int8), prepend=0, append=0))
    return [(int(points[a]), int(points[b]) - 1) for a, b in turns.reshape(-1, 2)]


def rolled(found: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of found[begin:end] for ascending begins and ends that lie near each other, by running sums of bits."""
    low, high = int(begin[0]), int(end.max())
    bits = np.unpackbits(found[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((high - low + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    more = 2 * (sums[end - low] - sums[begin - low]) > (end - begin)[:, None]
    return np.packbits(more, axis=1, bitorder="little").view(np.uint64).ravel()


def _anywhere(items: Items, met: np.ndarray, done: set, found: np.ndarray, at: np.ndarray, words: np.ndarray, size: int) -> list[tuple[int, int, int, int, float]]:
    """As `matches`, of all windows at all places, for pairs of row and item that are not done.

    met: the ascending (row, item, place) of shared shingles. In a window like an item, shingles
    at 0.8 of as many places as the item has are the item's; each window of such a stretch gets
    its fingerprint, and those within the radius of the item's are compared. Stretches are gone
    through in slices, so memory does not grow with a text's repeats.
    """
    out = []
    cuts = np.flatnonzero(np.any(np.diff(met[:, :2], axis=0), axis=1)) + 1
    cuts = np.concatenate([[0], cuts, [len(met)]])
    least = np.ceil(SIMILARITY * (items.lengths - size + 1) - 1e-9)
    for k in np.flatnonzero(np.diff(cuts) >= least[met[cuts[:-1], 1]]):
        row, item = met[cuts[k], :2].tolist()
        n, places = int(items.lengths[item]), met[cuts[k] : cuts[k + 1], 2]
        if (row, item) in done or words[row] < size:
            continue
        group, index, sets = items.groups[n]
        place = int(np.searchsorted(group, item))
        for low, high in stretches(places, n - size + 1, int(least[item])):
            for b in range(max(low, -n), high + 1, STRETCH):
                begin = np.arange(b, min(b + STRETCH, high + 1))
                end = np.minimum(begin + n, words[row])
                begin = np.maximum(begin, 0)
                fits = end - begin >= size
                begin, end = begin[fits], end[fits]
                if not len(begin):
                    continue
                prints = rolled(found, at[row] + begin, at[row] + end - size + 1)
                near = np.bitwise_count(prints ^ index.prints[place]) <= RADIUS
                for x, y in sorted(set(zip(begin[near].tolist(), end[near].tolist(), strict=True))):
                    mine = np.unique(found[at[row] + x : at[row] + y - size + 1], return_counts=True)
                    if (like := similarity(mine, sets[place])) >= SIMILARITY - 1e-12:
                        out.append((row, item, x, y - x, like))
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64()), ("n_windows", pa.int64())])


def contaminated(documents: DataFrame, benchmark: DataFrame, most_words: int = 1_000_000) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, first_word, n_words,
    similarity, n_windows: for each row and item, the best window (the first of equals).

    Compared are the windows that begin where a shared shingle's place in the item puts them, and,
    where none of those is like the item, all windows at all places; n_windows counts the like ones.

    Words as elsewhere: runs without ASCII white space, A-Z lower-cased. A window has as many
    words as the item (fewer at a text's ends) and is like it at a weighted Jaccard similarity
    of 0.8 of their five-word shingles, by multiplicity; items of fewer words are one shingle.
    Items without words and null texts match nothing; null ids stay null in the result; repeated
    rows are each reported. Items are broadcast at most `most_words` words at a time: a larger
    benchmark takes several passes.
    """
    shared.small_batches(documents.sparkSession)
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    sized = asked.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"), F.count("*").alias("rows")).first()
    passes = max(1, math.ceil((sized["n"] or 0) / most_words))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double, n_windows long"
    out = None
    for k in range(passes):
        # One pass holds the items of one residue of their hash: about most_words words.
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        shipped = documents.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in part], [r["text"] for r in part]))

        def search(batches, shipped=shipped):
            items = shipped.value
            for x in batches:
                ids, (data, offsets) = x.column(0).to_pylist(), shared.buffer(x.column(1))
                for a, b in shared.slices(offsets):
                    hashes, first, _, _ = shared.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best: dict = {}
                    for row, item, begin, n, like in matches(items, hashes, first):
                        old = best.get((row, item))
                        best[row, item] = (*(min((-like, begin, n), old[:3]) if old else (-like, begin, n)), (old[3] if old else 0) + 1)
                    rows = [(ids[a + r], items.ids[i], begin, n, -like, k) for (r, i), (like, begin, n, k) in sorted(best.items())]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 6, _SCHEMA, strict=True)], schema=_SCHEMA)

        got = rows.mapInArrow(search, schema)
        out = got if out is None else out.unionByName(got)
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a window like a benchmark item; rows with a null id stay."""
    bad = shared.kept(contaminated(documents, benchmark).select("doc_id").distinct())
    return documents.join(bad, "doc_id", "left_anti").select(*documents.columns)


#: The same rule in SQL for items of five words or more.
ORACLE = r"""
WITH dw AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT id, len(w) AS n, w, unnest(range(0, greatest(1, len(w) - 4))) AS pos FROM dw WHERE len(w) > 0),
ds AS (SELECT id, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s FROM dp),
ip AS (SELECT id, len(w) AS n, w, unnest(range(0, len(w) - 4)) AS pos FROM iw WHERE len(w) >= 5),
i5 AS (SELECT id, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s FROM ip),
ic AS (SELECT id, n, s, count(*) AS c FROM i5 GROUP BY ALL),
win AS (SELECT DISTINCT ds.id AS doc_id, ds.n AS len, ds.pos - i5.pos AS begin, i5.n AS n FROM ds JOIN i5 USING (s)),
cut AS (SELECT doc_id, begin AS b0, n, greatest(begin, 0) AS b, least(begin + n, len) AS e FROM win),
wc AS (SELECT c.doc_id, c.b0, c.n, c.b, c.e, ds.s, count(*) AS c FROM cut c JOIN ds ON ds.id = c.doc_id AND ds.pos >= c.b AND (ds.pos <= c.e - 5 OR ds.pos = 0 AND c.b = 0 AND c.e = ds.n AND ds.n < 5) GROUP BY ALL),
wt AS (SELECT doc_id, b0, n, sum(c) AS total FROM wc GROUP BY ALL),
it AS (SELECT id, n, sum(c) AS total FROM ic GROUP BY ALL),
met AS (SELECT wc.doc_id, ic.id AS item_id, wc.b0, wc.n, wc.b, wc.e, sum(least(wc.c, ic.c)) AS both_n FROM wc JOIN ic ON ic.n = wc.n AND ic.s = wc.s GROUP BY ALL),
sim AS (SELECT met.doc_id, met.item_id, b, e - b AS words, both_n / (wt.total + it.total - both_n) AS similarity
  FROM met JOIN wt ON wt.doc_id = met.doc_id AND wt.b0 = met.b0 AND wt.n = met.n JOIN it ON it.id = met.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, b, words) AS k, count(*) OVER (PARTITION BY doc_id, item_id) AS n_windows FROM sim WHERE similarity >= 0.8 - 1e-12)
SELECT doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(b AS BIGINT) AS first_word, CAST(words AS BIGINT) AS n_words, CAST(similarity AS DOUBLE) AS similarity, n_windows FROM r WHERE k = 1
"""
