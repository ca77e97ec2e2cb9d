"""Hard negatives: an R-tree packed by sort-tile-recursive, asked by inner-product windows, best box first."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.llm import shared
from mediaspan.llm.lloyd import whole
from mediaspan.llm.topk import usable_rows

#: Components are held at this size, so that inner products of up to 2,048 components stay within 64 bits.
HELD = 2**26
#: Scores below and above all others, as ends of windows.
LEAST, MOST = -(2**63), 2**63 - 1


def tiles(x: np.ndarray, rows: np.ndarray, page: int) -> list[np.ndarray]:
    """Sort-tile-recursive: rows in pages of at most `page`, near ones together.

    Pages to be are spread over as many coordinates as halvings would take, half of them, widest
    spread first: sort by the coordinate, cut into equal slabs, and go on within each slab.
    """
    spread = np.argsort(-(x[rows].max(0) - x[rows].min(0)), kind="stable") if x.shape[1] else np.zeros(0, np.int64)

    def cut(rows: np.ndarray, level: int, levels: int) -> list[np.ndarray]:
        pages = -(-len(rows) // page)
        if pages <= 1:
            return [rows]
        left = max(1, levels - level)
        slabs = pages if left == 1 else min(pages, int(np.ceil(pages ** (1 / left))))
        if level < len(spread):
            rows = rows[np.argsort(x[rows, spread[level]], kind="stable")]
        size = -(-pages // slabs) * page
        return [tile for at in range(0, len(rows), size) for tile in cut(rows[at : at + size], level + 1, levels)]

    pages = max(2, -(-len(rows) // page))
    return cut(rows, 0, max(1, min(x.shape[1], int(np.ceil(np.log2(pages) / 2)))))


class Tree:
    """Pages of rows with their bounding boxes, and nodes of `fan` pages with theirs."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, page: int = 128, fan: int = 16):
        order = np.argsort(labels, kind="stable")
        starts = np.flatnonzero(np.diff(labels[order], prepend=labels[order[:1]] - 1) if len(order) else [])
        cuts, pages = [*starts.tolist(), len(order)], []
        run = 0
        while run < len(cuts) - 1:  # a label's rows by tiles; labels of few rows share a page
            end = run + 1
            while end < len(cuts) - 1 and cuts[end + 1] - cuts[run] <= page:
                end += 1
            pages += tiles(x, order[cuts[run] : cuts[end]], page)
            run = end
        rows = np.concatenate(pages) if pages else np.zeros(0, np.int64)
        self.ids, self.labels, self.x = ids[rows], labels[rows], x[rows]
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
        self.boxes = self._boxes(self.x, self.labels, self.starts[:-1])
        self.fan, self.nodes = fan, np.arange(0, len(pages), fan)
        low, high, first, last = self.boxes
        self.upper_boxes = tuple(f.reduceat(b, self.nodes, axis=0) if len(pages) else b for f, b in ((np.minimum, low), (np.maximum, high), (np.minimum, first), (np.maximum, last)))

    @staticmethod
    def _boxes(x, labels, starts):
        if not len(starts):
            return x, x, labels, labels
        return tuple(f.reduceat(v, starts, axis=0) for f, v in ((np.minimum, x), (np.maximum, x), (np.minimum, labels), (np.maximum, labels)))

    def intervals(self, boxes, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each box allows with each query, coordinate by coordinate."""
        low, high = boxes[:2]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return low @ up.T + high @ down.T, high @ up.T + low @ down.T

    def search(self, anchor: int, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int, same: bool, node_span, page_span) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best rows of each window of scores: (scores, ids), best first, ties to the smaller id.

        Rows are those of the anchor's label (`same`) or of other labels, never the anchor's own id.
        Boxes wait in a queue by their greatest product. A box is left out for a window when its
        interval is outside the window or strictly below the k-th score found; the search ends
        when no box in the queue can add to any window.
        """
        found = [(np.zeros(0, self.x.dtype), np.zeros(0, np.int64)) for _ in windows]
        need = [low for low, _ in windows]

        def wanted(low, high) -> bool:
            return any(high >= least and low <= most for least, (_, most) in zip(need, windows, strict=True))

        def may(first, last) -> bool:
            return first <= label <= last if same else not first == label == last

        low, high = node_span
        queue = [(-high[n], 0, n) for n in range(len(self.nodes)) if may(self.upper_boxes[2][n], self.upper_boxes[3][n])]
        heapq.heapify(queue)
        while queue and -queue[0][0] >= min(need):
            bound, kind, at = heapq.heappop(queue)
            if kind == 0:
                if wanted(low[at], -bound):
                    for p in range(self.nodes[at], min(self.nodes[at] + self.fan, len(self.starts) - 1)):
                        if may(self.boxes[2][p], self.boxes[3][p]):
                            heapq.heappush(queue, (-page_span[1][p], 1, p))
                continue
            if not wanted(page_span[0][at], -bound):
                continue
            rows = slice(self.starts[at], self.starts[at + 1])
            scores, ids = self.x[rows] @ q, self.ids[rows]
            fits = ((self.labels[rows] == label) == same) & (ids != anchor) & (scores >= min(need))
            if not fits.any():
                continue
            scores, ids = scores[fits], ids[fits]
            for w, (_, most) in enumerate(windows):
                good = (scores >= need[w]) & (scores <= most)
                if good.any():
                    s, i = np.concatenate([found[w][0], scores[good]]), np.concatenate([found[w][1], ids[good]])
                    order = np.lexsort((i, -s))[:k]
                    found[w] = s[order], i[order]
                    if len(order) == k:
                        need[w] = max(need[w], s[order[-1]])
        return found


def packed_trees(rows: DataFrame, scale: float, dims: int, most: int = 16384) -> tuple[DataFrame, int]:
    """rows(vec_id, label, embedding) -> rows (slab, ids, labels, components) of up to `most` vectors, and the number of slabs.

    The first cut of the tiling is Spark's: ranges of (label, first component, hash), so equal
    rows, however many, are split by their hash. A task packs what it has read whenever that
    makes a tree.
    """

    def fill(batches):
        slab = pa.array([TaskContext.get().partitionId()], pa.int32())
        ids, labels, parts, n = [], [], [], 0

        def row():
            x = np.concatenate(parts)
            return pa.record_batch({"slab": slab, "ids": pa.array([np.concatenate(ids).tobytes()]), "labels": pa.array([np.concatenate(labels).tobytes()]), "components": pa.array([x.astype("<i4").tobytes()])})

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                x = batch.slice(at, most)
                if n and n + x.num_rows > most:
                    yield row()
                    ids, labels, parts, n = [], [], [], 0
                ids.append(np.asarray(x.column("vec_id"), np.int64))
                labels.append(np.asarray(x.column("label"), np.int64))
                parts.append(whole(x.column("embedding"), scale, dims, HELD))
                n += x.num_rows
        if n:
            yield row()

    slabs = max(1, -(-rows.count() // most))
    lead = F.coalesce(F.get("embedding", F.lit(0)), F.lit(0.0))
    dealt = rows.repartitionByRange(slabs, "label", lead, F.xxhash64("vec_id", "embedding")).sortWithinPartitions("label", lead)
    return shared.kept(dealt.select("vec_id", "label", "embedding").mapInArrow(fill, "slab int, ids binary, labels binary, components binary")), slabs


def _asked(trees: DataFrame, slabs: int, queries: DataFrame, n_queries: int, k: int, same: bool, scale: float, dims: int, block: int) -> DataFrame:
    """queries(vec_id, label, embedding, windows) against all trees -> anchor_id, place of the window, score, vec_id."""
    schema = "anchor_id long, place int, score long, vec_id long"
    arrow = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def pack(key, group):
        windows = group["windows"].combine_chunks()
        ends = np.stack([np.asarray(windows.flatten().field(x), np.int64) for x in ("low", "high")], 1)
        return pa.table({"qblock": pa.array([key[0].as_py()], pa.int64()), "anchors": [np.asarray(group["vec_id"], np.int64).tobytes()], "own": [np.asarray(group["label"], np.int64).tobytes()], "vectors": [whole(group["embedding"], scale, dims, HELD).astype("<i4").tobytes()], "counts": [np.asarray(windows.value_lengths(), np.int32).tobytes()], "ends": [ends.tobytes()]})

    def answer(batches):
        for batch in batches:
            for x in (batch.slice(i, 1) for i in range(batch.num_rows)):
                get = lambda name, kind: np.frombuffer(x.column(name)[0].as_py(), kind)  # noqa: B023, E731
                values, asking = (get(name, "<i4").astype(np.int64).reshape(-1, dims) if dims else np.zeros((len(get(key, np.int64)), 0), np.int64) for name, key in (("components", "ids"), ("vectors", "anchors")))
                if dims * int(np.abs(values).max(initial=1)) * int(np.abs(asking).max(initial=1)) < 2**53:
                    values, asking = values.astype(np.float64), asking.astype(np.float64)  # exact, and faster
                tree = Tree(get("ids", np.int64), get("labels", np.int64), values)
                node_spans, page_spans = tree.intervals(tree.upper_boxes, asking), tree.intervals(tree.boxes, asking)
                ends, at = get("ends", np.int64).reshape(-1, 2).tolist(), np.concatenate([[0], np.cumsum(get("counts", np.int32))])
                out = {name: [] for name in arrow.names}
                for i, (anchor, label) in enumerate(zip(get("anchors", np.int64).tolist(), get("own", np.int64).tolist(), strict=True)):
                    windows = [tuple(w) for w in ends[at[i] : at[i + 1]]]
                    found = tree.search(anchor, label, asking[i], windows, k, same, [s[:, i] for s in node_spans], [s[:, i] for s in page_spans])
                    for w, (scores, ids) in enumerate(found):
                        for name, value in (("anchor_id", np.full(len(ids), anchor)), ("place", np.full(len(ids), w, np.int32)), ("score", scores.astype(np.int64)), ("vec_id", ids)):
                            out[name].append(value)
                yield pa.record_batch([pa.array(shared.joined(out[f.name], f.type.to_pandas_dtype()), f.type) for f in arrow], schema=arrow)

    blocks = max(1, -(-n_queries // block))
    asking = queries.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("qblock").applyInArrow(pack, "qblock long, anchors binary, own binary, vectors binary, counts binary, ends binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))
    pairs = asking.withColumn("slab", every).join(trees, "slab")
    return pairs.mapInArrow(answer, schema)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, percent: tuple[int, int] = (30, 90), scale: float = 256.0, block: int = 1024) -> DataFrame:
    """vectors(vec_id, label, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by `every`. Components are floor(scale * x), held
    at 2^26 either way; missing components of a shorter vector are 0; scores are inner products.
    An anchor's positives are its best other rows of its label, its negatives for each of them the
    k best rows of other labels whose score is within the percents of the positive's. Ties go to
    the smaller vec_id. Null ids, labels or vectors, and null or non-finite components, take no
    part. Of anchors with one id the one of least label and vector asks, and rows with its id are
    never its partners; other repeated rows are partners each time. A positive of which no row is
    in the window gives no row, and so do empty tables.
    """
    spark = vectors.sparkSession
    shared.small_batches(spark)
    rows = usable_rows(vectors).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    trees, slabs = packed_trees(rows, scale, dims)
    one = F.min(F.struct("label", "embedding")).alias("row")
    anchors = shared.kept(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(one).select("vec_id", "row.label", "row.embedding"))
    n = anchors.count()
    ends = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))).alias("windows")
    near = _asked(trees, slabs, anchors.select("*", ends), n, positives, True, scale, dims, block)
    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    near = shared.kept(near.select("anchor_id", (F.col("place") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(20,0)")
    low, high = (F.when(F.col("positive_score") < 0, F.lit(v)).otherwise(f(score * p / 100).cast("long")) for v, f, p in ((MOST, F.ceil, percent[0]), (LEAST, F.floor, percent[1])))
    window = F.struct("place", low.alias("low"), high.alias("high"))
    windows = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(window)).alias("w")).select(F.col("anchor_id").alias("vec_id"), F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    far = _asked(trees, slabs, anchors.join(windows, "vec_id"), n, k, False, scale, dims, block)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "vec_id"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= k)
    return far.join(near, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The label of each row whose vec_id is divisible by `every` goes on by one, within `labels`."""
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
