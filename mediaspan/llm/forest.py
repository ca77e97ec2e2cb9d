"""Approximate nearest neighbours: a forest of sorted hash strings, asked by longest prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspan.llm import shared
from mediaspan.llm.topk import usable

#: Bits of a hash string, and at most so many of them in the directory of prefixes.
BITS, DIRECTORY = 62, 16
#: The queries by whose exact neighbours the ascent is set: those of the least hashes, this many at most.
SAMPLE = 256
#: Rows of a sorted segment, and queries that a segment is asked by at once.
SEGMENT, ASKED = 16384, 1024
_HITS = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def dense(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as a matrix; what a shorter vector lacks is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, lengths = np.asarray(column.flatten(), np.float64), np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Hash strings (n, trees): bit after bit, the side of a random hyperplane that a vector is on."""
    planes = np.random.default_rng(seed).standard_normal((trees, BITS, x.shape[1]))
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1)
    size = np.abs(x).max(1, initial=0, keepdims=True)
    x = x / np.where(size > 0, size, 1)
    return np.stack([((x @ planes[t].T) > 0) @ weights for t in range(trees)], 1) if trees else np.zeros((len(x), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in pairs, always added up in the same order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out + 0.0


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k nearest of x to each row of q: (places, scores), ties to the smaller id."""
    rough, out = q @ x.T, []
    slack = 1e-12 * max(1, x.shape[1]) * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    for i in range(len(q)):
        row = rough[i]
        places = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - slack[i]) if len(row) > k else np.arange(len(row))
        scores = products(np.broadcast_to(q[i], (len(places), q.shape[1])), x[places])
        order = np.lexsort((ids[places], -scores))[:k]
        out.append((places[order], scores[order]))
    return out


class Directory:
    """How many strings of each tree begin with each prefix of `depth` bits, and where they are kept.

    Its size is trees * 2^depth numbers, whatever the input. A segment is a run of prefixes of about
    `segment` rows; a prefix of more rows is dealt over several segments.
    """

    def __init__(self, counts: np.ndarray, segment: int = SEGMENT):
        self.depth = int(np.log2(counts.shape[1]))
        self.sums = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, 1)], 1)
        self.spread = np.maximum(1, -(-counts // segment))
        first = self.sums[:, :-1] // segment
        width = int((first + self.spread).max(initial=1))
        self.first = first + width * np.arange(len(counts))[:, None]

    def totals(self, keys: np.ndarray) -> np.ndarray:
        """keys (n, trees) -> (depth + 1, n): rows that share the first 0, 1, ... bits, over all trees."""
        at, trees = keys >> (BITS - self.depth), np.arange(keys.shape[1])
        low = [(at >> (self.depth - level)) << (self.depth - level) for level in range(self.depth + 1)]
        return np.stack([(self.sums[trees, x + (1 << (self.depth - level))] - self.sums[trees, x]).sum(1) for level, x in enumerate(low)])

    def levels(self, keys: np.ndarray, wanted: int) -> np.ndarray:
        """Each query's level: down to its longest prefixes, then up in all trees at once until
        they hold `wanted` rows; -1, all rows by one tree, where that would take as many."""
        totals = self.totals(keys)
        level = self.depth - (totals[::-1] >= wanted).argmax(0)
        level[(totals < wanted).all(0)] = 0
        rows = int(self.sums[0, -1])
        return np.where(totals[level, np.arange(len(level))] >= rows, -1, level)

    def visits(self, keys: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, tree, segment) of every segment that holds rows of a query's prefix."""
        depth, out = self.depth, []
        for t in range(keys.shape[1]):
            asking = np.flatnonzero((level >= 0) | (t == 0))
            gap = depth - np.maximum(level[asking], 0)
            low = (keys[asking, t] >> (BITS - depth)) >> gap << gap
            high = low + (np.int64(1) << gap)
            some = self.sums[t, high] > self.sums[t, low]
            asking, low, high = asking[some], low[some], high[some]
            begin = self.first[t, low]
            n = self.first[t, high - 1] + self.spread[t, high - 1] - begin
            row = np.repeat(np.arange(len(asking)), n)
            out.append((asking[row], np.full(len(row), t), begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _kind(rows: DataFrame) -> tuple[str, str]:
    """How components are kept, as numpy and as SQL name it: as they came."""
    of = rows.schema["embedding"].dataType.simpleString()
    return {"array<float>": "<f4"}.get(of, "<f8"), of


def _keyed(rows: DataFrame, dims: int, trees: int, seed: int) -> DataFrame:
    def key(batches):
        for x in batches:
            keys = strings(dense(x.column("embedding"), dims), trees, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, trees, np.int32)), pa.array(keys.ravel()))
            yield pa.record_batch([*x.columns, lists], names=[*x.schema.names, "keys"])

    return rows.mapInArrow(key, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, keys array<long>")


def _directory(rows: DataFrame, trees: int, depth: int) -> Directory:
    shift = BITS - depth
    prefix = rows.select(F.posexplode("keys").alias("tree", "key")).groupBy("tree", F.shiftright("key", shift).alias("prefix")).count()
    counts = np.zeros((trees, 1 << depth), np.int64)
    found = prefix.toArrow()
    counts[np.asarray(found["tree"], np.int64), np.asarray(found["prefix"], np.int64)] = np.asarray(found["count"], np.int64)
    return Directory(counts)


def _ascent(rows: DataFrame, queries: DataFrame, directory: Directory, dims: int, k: int, recall: float) -> int:
    """The least number of rows at which the ascent finds `recall` of the sample's exact neighbours."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding", "keys").toArrow()
    if not len(sample):
        return 1
    asked, x = np.asarray(sample["vec_id"], np.int64), dense(sample["embedding"], dims)
    keys = np.stack(sample["keys"].to_pylist()).astype(np.int64)

    def exact(batches):
        for batch in batches:
            ids, c, other = np.asarray(batch.column("vec_id"), np.int64), dense(batch.column("embedding"), dims), batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, -1)
            for q, (places, scores) in enumerate(nearest(x, c, ids, k + 1)):
                apart = (keys[q] ^ other[places]).astype(np.float64)  # the longest common prefix of any tree
                shared_bits = BITS - np.ceil(np.log2(apart.min(1) + 1)).astype(np.int64)
                yield pa.record_batch({"query": np.full(len(places), q), "vec_id": ids[places], "score": scores, "bits": shared_bits})

    near = rows.mapInArrow(exact, "query long, vec_id long, score double, bits long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    found = near.withColumn("rank", rank).where(F.col("rank") <= k + 1).toArrow()
    q, bits = np.asarray(found["query"], np.int64), np.asarray(found["bits"], np.int64)
    others = np.asarray(found["vec_id"], np.int64) != asked[q]
    q, bits = q[others], bits[others]
    totals, wanted = int(directory.sums[:, -1].sum()), float(k + 1)
    while wanted < totals:
        level = directory.levels(keys, int(wanted))
        if (np.minimum(bits, directory.depth) >= level[q]).mean() >= recall:
            return int(wanted)
        wanted *= 2**0.25
    return max(1, totals)


def _segments(rows: DataFrame, directory: Directory, dims: int) -> DataFrame:
    """The sorted arrays, cut into segments: one packed row each."""
    first, spread, shift = directory.first, directory.spread, BITS - directory.depth
    kind, of = _kind(rows)

    def route(batches):
        for x in batches:
            keys = x.column("keys").flatten().to_numpy().reshape(x.num_rows, -1)
            trees, at = np.arange(keys.shape[1]), keys >> shift
            salt = shared.mixed(np.asarray(x.column("vec_id"), np.int64).view(np.uint64))[:, None] % spread[trees, at].astype(np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], np.int32)), pa.array((first[trees, at] + salt.astype(np.int64)).ravel()))
            yield pa.record_batch([*x.columns, lists], names=[*x.schema.names, "segments"])

    def pack(key, group):
        keys = np.asarray(group["key"], np.int64)
        order = np.argsort(keys, kind="stable")
        return pa.table({"segment": [key[0].as_py()], "keys": [keys[order].tobytes()], "ids": [np.asarray(group["vec_id"], np.int64)[order].tobytes()], "vectors": [dense(group["embedding"], dims)[order].astype(kind).tobytes()]})

    routed = rows.mapInArrow(route, f"vec_id long, embedding {of}, keys array<long>, segments array<long>")
    each = routed.select("vec_id", "embedding", F.explode(F.arrays_zip("segments", "keys")).alias("at"))
    each = each.select(F.col("at.segments").alias("segment"), F.col("at.keys").alias("key"), "vec_id", "embedding")
    return each.groupBy("segment").applyInArrow(pack, "segment long, keys binary, ids binary, vectors binary")


def _visits(queries: DataFrame, directory: Directory, wanted: int, dims: int) -> DataFrame:
    """Queries at each segment they visit, packed by at most about ASKED of a segment."""
    kind, of = _kind(queries)

    def visit(batches):
        for x in batches:
            keys = x.column("keys").flatten().to_numpy().reshape(x.num_rows, -1)
            level = directory.levels(keys, wanted)
            query, tree, segment = directory.visits(keys, level)
            for at in range(0, len(query), 8192):
                q = query[at : at + 8192]
                yield pa.record_batch({"segment": pa.array(segment[at : at + 8192]), "query": x.column("vec_id").take(pa.array(q)), "key": pa.array(keys[q, tree[at : at + 8192]]), "level": pa.array(np.maximum(level[q], 0)), "embedding": x.column("embedding").take(pa.array(q))})

    def pack(key, group):
        return pa.table({"segment": [key[0].as_py()], "queries": [np.asarray(group["query"], np.int64).tobytes()], "asked": [np.asarray(group["key"], np.int64).tobytes()], "levels": [np.asarray(group["level"], np.int64).tobytes()], "points": [dense(group["embedding"], dims).astype(kind).tobytes()]})

    visits = shared.kept(queries.select("vec_id", "embedding", "keys").mapInArrow(visit, f"segment long, query long, key long, level long, embedding {of}"))
    chunks = visits.groupBy("segment").agg(F.ceil(F.count("*") / F.lit(ASKED)).alias("chunks"))
    dealt = visits.join(chunks, "segment").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")))
    return dealt.groupBy("segment", "chunk").applyInArrow(pack, "segment long, queries binary, asked binary, levels binary, points binary")


def _answers(pairs: DataFrame, kind: str, dims: int, k: int) -> DataFrame:
    def answer(batches):
        for batch in batches:
            for x in (batch.slice(i, 1) for i in range(batch.num_rows)):
                get = lambda name, kind=np.int64: np.frombuffer(x.column(name)[0].as_py(), kind)  # noqa: B023, E731
                keys, ids, queries, level = get("keys"), get("ids"), get("queries"), get("levels")
                c, points = (get(name, kind).astype(np.float64).reshape(-1, dims) for name in ("vectors", "points"))
                low = get("asked") >> (BITS - level) << (BITS - level)
                begin, end = np.searchsorted(keys, low), np.searchsorted(keys, low + (np.int64(1) << (BITS - level)))
                out = []
                ranges, which = np.unique(np.stack([begin, end]), axis=1, return_inverse=True)
                for r, (a, b) in enumerate(ranges.T.tolist()):
                    asking = np.flatnonzero(which.ravel() == r)
                    for q, (places, scores) in zip(asking, nearest(points[asking], c[a:b], ids[a:b], k) if b > a else (), strict=b > a):
                        out.append((np.full(len(places), queries[q]), ids[a:b][places], scores))
                if out:
                    yield pa.record_batch([np.concatenate(column) for column in zip(*out, strict=True)], schema=_HITS)

    return pairs.mapInArrow(answer, "query long, vec_id long, score double")


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, trees: int = 24, seed: int = 7) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank from 1, vec_id, score: the nearest found by inner product.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows with another
    vec_id. A tree is the sorted array of all rows' hash strings. A query goes down each tree to
    its longest prefixes, then up all trees by a bit at a time, until their rows come to a number
    at which a sample of queries had `recall` of its exact neighbours; all of those are compared
    on the whole vectors. Scores are sums of products in double precision, by component.

    Null ids, and vectors that are null, all 0 or hold null or non-finite components, take no part;
    missing components of a shorter vector are 0. Of equal vectors the k + 1 smallest ids are
    indexed, more than any query can return; equal queries are answered once, then each without its
    own id. Repeated rows are one candidate; a query of repeated ids is answered for the least of
    its vectors. Fewer candidates give fewer rows; no rows give none.
    """
    spark: SparkSession = vectors.sparkSession
    shared.small_batches(spark)
    rows = usable(vectors).where(F.exists("embedding", lambda x: x != 0))
    if vectors.schema["embedding"].dataType.simpleString() == "array<float>":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows = rows.dropDuplicates(["vec_id", "embedding"])
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    keyed = shared.kept(_keyed(rows.withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "embedding"), dims, trees, seed))
    directory = _directory(keyed, trees, min(DIRECTORY, max(1, int(n).bit_length() - 4)))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    one = asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))
    one = shared.kept(_keyed(one.select("vec_id", "embedding"), dims, trees, seed))
    wanted = _ascent(keyed, one, directory, dims, k, recall)
    pairs = _visits(one, directory, wanted, dims).join(_segments(keyed, directory, dims), "segment")
    found = _answers(pairs, _kind(keyed)[0], dims, k + 1)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k + 1).groupBy("query", "vec_id").agg(F.first("score").alias("score"))
    names = asked.join(one.select("embedding", F.col("vec_id").alias("query")), "embedding").select(F.col("vec_id").alias("query_id"), "query")
    own = found.join(names, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
