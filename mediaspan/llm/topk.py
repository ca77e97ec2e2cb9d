"""Exact top-k search: term-at-a-time accumulation of weighted postings into dense score arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.llm.shared import small_batches

_PAIRS = "query_id long, vec_id long, score long"
#: Queries whose score arrays are filled together.
TILE = 16
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable_rows(vectors: DataFrame) -> DataFrame:
    """Rows with a vector of finite components, as they are."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False)))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    return usable_rows(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull())


def packed(rows: DataFrame, block: str, scale: float) -> DataFrame:
    """rows(block, vec_id, embedding) -> one row a block: ids, lengths and scaled components as bytes.

    A component x is floor(scale * x); shorter vectors keep their own lengths.
    """
    schema = f"{block} long, ids binary, lengths binary, components binary"

    def pack(key, group):
        group = group.combine_chunks()
        lists = group["embedding"].combine_chunks() if isinstance(group["embedding"], pa.ChunkedArray) else group["embedding"]
        lists = lists if len(lists) else pa.array([], pa.list_(pa.float64()))
        values = np.floor(scale * np.asarray(lists.flatten(), np.float64)).clip(-(2.0**62), 2.0**62).astype(np.int64)
        lengths = np.asarray(lists.value_lengths(), np.int32)
        return pa.table({block: pa.array([key[0].as_py()], pa.int64()), "ids": [np.asarray(group["vec_id"], np.int64).tobytes()], "lengths": [lengths.tobytes()], "components": [values.tobytes()]})

    return rows.select(block, "vec_id", "embedding").groupBy(block).applyInArrow(pack, schema)


def _matrix(ids: bytes, lengths: bytes, components: bytes, dims: int = 0):
    ids, lengths, flat = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int32), np.frombuffer(components, np.int64)
    dims = max(dims, int(lengths.max(initial=0)))
    out = np.zeros((len(ids), dims), np.int64)
    row = np.repeat(np.arange(len(ids)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return ids, out


def block_top(k: int, queries, candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one block of candidates, its own row apart, ties to the smaller id.

    The postings of a term (a dimension) are the candidates where it is not 0, with their
    weights. Each query's sparse row scatters its weight times them into its dense score array,
    a few queries at a time, whose arrays are so short that they stay in the cache.
    """
    (qid, q), (cid, c) = queries, candidates
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    dims = min(q.shape[1], c.shape[1])
    most = sum(int(np.abs(q[:, t]).max(initial=0)) * int(np.abs(c[:, t]).max(initial=0)) for t in range(dims))
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**62 else object
    # A component beyond the kind meets only zeros, or `most` were larger: it is never multiplied.
    # Where most candidates have a posting, all of them are added, noughts too: that is ten times faster than by places.
    postings = []
    for t in range(dims):
        posting = np.flatnonzero(c[:, t])
        whole = 4 * len(posting) >= len(cid)
        postings.append((posting, np.ascontiguousarray(c[:, t] if whole else c[posting, t]).astype(kind), whole))
    own = np.isin(qid, cid)
    found = []
    for first in range(0, len(qid), TILE):
        tile = q[first : first + TILE]
        scores = np.zeros((len(tile), len(cid)), kind)
        for t, (posting, weights, whole) in enumerate(postings):
            if not len(posting):
                continue
            asking = np.flatnonzero(tile[:, t])
            for i, weight in zip(asking.tolist(), tile[asking, t].astype(kind), strict=True):
                if whole:
                    scores[i] += weight * weights
                else:
                    scores[i, posting] += weight * weights
        for i, row in enumerate(scores):
            ids, at = cid, first + i
            if own[at]:
                other = cid != qid[at]
                row, ids = row[other], cid[other]
            if not len(row):
                continue
            if len(row) > k:
                bar = np.partition(row, len(row) - k)[len(row) - k]
                above, level = np.flatnonzero(row > bar), np.flatnonzero(row == bar)
                chosen = np.concatenate([above, level[: k - len(above)]])  # ids ascend within a level
            else:
                chosen = np.arange(len(row))
            found.append((np.full(len(chosen), qid[at]), ids[chosen], row[chosen]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in s], np.int64) if s.dtype == object else s.astype(np.int64)


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank from 1, vec_id, score, exact.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows with
    another vec_id. Score: inner product of floor(scale * x) components; missing components of a
    shorter vector are 0. Null ids or vectors and null or non-finite components take no part.
    Repeated rows are candidates of their own; a query of repeated rows is answered once, by the
    components of any of them when they differ. A pair of query and candidate block is one row
    of bounded size, of which k rows a query are kept; blocks are dealt by a hash of the id. Scores
    outside 64 bits are held at its ends. Fewer candidates give fewer rows; no rows, no rows.
    """
    rows = usable(vectors)
    n = max(1, rows.count())
    blocks, query_blocks = -(-n // block), -(-n // (every * query_block))
    candidates = packed(rows.withColumn("cblock", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "cblock", scale)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asking = packed(asked.withColumn("qblock", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(query_blocks))), "qblock", scale)
    asking = asking.select("qblock", *(F.col(x).alias(f"q_{x}") for x in ("ids", "lengths", "components")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("cblock"))

    def score(batches):
        for batch in batches:
            for x in batch.to_pylist():
                queries, block_rows = _matrix(x["q_ids"], x["q_lengths"], x["q_components"]), _matrix(x["ids"], x["lengths"], x["components"])
                yield pa.record_batch([pa.array(c, pa.int64()) for c in block_top(k, queries, block_rows)], schema=_OUT)

    # A candidate block goes through the shuffle once, whatever the number of query blocks that it meets. Spark takes
    # the size of the query blocks for that of their copies, one for each candidate block, so without the hint it
    # broadcasts those, which grow with the square of the rows. Of a merge the right side is held: one row a block.
    small_batches(vectors.sparkSession)
    candidates = candidates.repartition(blocks, "cblock")  # so the tasks are many, though their bytes are few
    best = asking.join(candidates.hint("merge"), "cblock").mapInArrow(score, _PAIRS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
