"""MinHash near-duplicates with tensored banding: table keys join a band of one small collection
of hashes with a band of another, so m + m bands give m * m tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.llm import shared
from mediaspan.llm.components import components

WIDTH = 3  # minhashes in a band


def bands(threshold: int, miss: float = 2e-5) -> int:
    """The least m at which a pair at the threshold shares no table with at most this chance."""
    p = (threshold / 100) ** WIDTH
    m = 1
    while 1 - (1 - (1 - p) ** m) ** 2 > miss:
        m += 1
    return m


def row_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, ascending, and the rows' offsets among them."""
    hashes, first, _, _ = shared.words(data, offsets)
    found, at = shared.shingles(hashes, first, size)
    sets = [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return shared.joined(sets, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def signatures(found: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """rows x 2m band keys: minima of WIDTH linear permutations of the shingle hashes each."""
    rng = np.random.default_rng(9)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, 2 * m), np.uint64)
    for band in range(2 * m):
        key = np.full(len(full), band + 1, np.uint64)
        for _ in range(WIDTH):
            a, b = rng.integers(0, 2**63, 2, dtype=np.uint64)
            least = np.minimum.reduceat(found * (a * np.uint64(2) + np.uint64(1)) + b, at[:-1][full]) if len(full) else key
            key = shared.mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[full, band] = key
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signed(documents: DataFrame, size: int, m: int) -> DataFrame:
    """One row for each document: its set's size, a 128-bit hash of its set, and its band keys."""

    def sign(batches):
        for x in batches:
            ids, (data, offsets) = x.column(0), shared.buffer(x.column(1))
            for a, b in shared.slices(offsets):
                found, at = row_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                keys = signatures(found, at, m).view(np.int64)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(shared.mixed(found + np.uint64(1)))])
                more = np.concatenate([[np.uint64(0)], np.cumsum(shared.mixed(found ^ np.uint64(0x5851F42D4C957F2D)))])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, 2 * m), pa.int32()), pa.array(keys.ravel()))
                yield pa.record_batch([ids.slice(a, b - a), pa.array(np.diff(at)), pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)), pa.array((more[at[1:]] - more[at[:-1]]).view(np.int64)), lists], schema=_SIGNED)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def candidates(classes: DataFrame, m: int) -> DataFrame:
    """classes(rep, bands) -> links (a, b), each from a table's smallest id to another in it.

    A band key that only one class has cannot be part of a shared table key, so those go before
    the m * m table keys are formed.
    """
    side = F.transform("bands", lambda key, i: F.struct(i.alias("band"), key.alias("key")))
    rows = classes.select("rep", F.explode(side).alias("x")).select("rep", "x.band", "x.key")
    # A band's number is part of the hash behind its key, so the key alone tells bands apart.
    common = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
    rows = rows.join(common, "key")
    sides = rows.groupBy("rep").agg(
        F.collect_list(F.when(F.col("band") < m, F.col("key"))).alias("first"), F.collect_list(F.when(F.col("band") >= m, F.col("key"))).alias("second"))
    tables = sides.select("rep", "second", F.explode("first").alias("x")).select("rep", "x", F.explode("second").alias("y")).select("rep", F.xxhash64("x", "y").alias("table"))
    tables = shared.kept(tables)
    least = tables.groupBy("table").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).select("table", "a")
    return tables.join(least, "table").where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct()


def forest(ids: np.ndarray, sets: list[np.ndarray], threshold: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what full sets join: for each new meeting of two groups one link.

    Every pair is decided, but a pair already joined needs no count. A text's counts against all
    others come from the postings of its shingles.
    """
    n = len(ids)
    group = np.unique(labels, return_inverse=True)[1] if labels is not None else np.arange(n)
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    keys, owners = flat[order], owner[order]
    links = []
    largest = np.bincount(group).argmax()
    # Any link between groups has an end outside the largest one.
    todo = np.arange(n) if labels is None else np.flatnonzero(group != largest)
    for i in todo:
        if (group == group[i]).all():
            break
        lo, hi = np.searchsorted(keys, sets[i], "left"), np.searchsorted(keys, sets[i], "right")
        size = hi - lo
        ends = np.cumsum(size)
        both = np.bincount(owners[np.repeat(lo - (ends - size), size) + np.arange(ends[-1])], minlength=n)
        near = (100 * both >= threshold * (sizes + sizes[i] - both)) & (group != group[i]) & (both > 0)
        for j in np.flatnonzero(near):
            if group[j] != group[i]:
                links.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return links


def _texts(documents: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """members(id, cluster) -> id, cluster, found: the members' full sets as bytes."""
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int64()), ("found", pa.binary())])

    def sets(batches):
        for x in batches:
            data, offsets = shared.buffer(x.column(2))
            for a, b in shared.slices(offsets):
                found, at = row_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                blobs = [found[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([x.column(0).slice(a, b - a), x.column(1).slice(a, b - a), pa.array(blobs, pa.binary())], schema=schema)

    # Members grow with the texts, so their join is a sorted one at every size.
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(members.hint("merge"), "id").select("id", "cluster", "text")
    return rows.mapInArrow(sets, "id long, cluster long, found binary")


def confirmed(documents: DataFrame, links: DataFrame, size: int, threshold: int, chunk: int = 256) -> DataFrame:
    """Of candidate links (a, b), the links (a, b) that full sets bear out within their clusters.

    Candidates fall into clusters; a cluster of more than `chunk` texts is dealt into chunks that
    all hold its smallest id. Chunks are decided whole. Where a cluster then still has several
    groups, each chunk with a text outside the largest group meets every other chunk, so every
    pair that could join two groups is decided, however large the cluster.
    """
    members = shared.kept(components(links).withColumnRenamed("component", "cluster"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / (chunk // 2)).cast("long")).drop("n")
    large = shared.kept(large)
    any_large = bool(large.take(1))
    texts = shared.kept(_texts(documents, members, size))
    if not any_large:
        dealt = texts.withColumn("chunk", F.lit(0).cast("long"))
    else:
        marked = texts.join(large, "cluster", "left")
        pivot = (F.col("id") == F.col("cluster")) & F.col("chunks").isNotNull()
        spread = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(F.coalesce(F.pmod(F.xxhash64("id"), F.col("chunks")), F.lit(0).cast("long"))))
        dealt = marked.withColumn("chunk", F.explode(spread)).drop("chunks")

    def decide(key, group):
        sets = [np.frombuffer(x, np.uint64) for x in group["found"].to_pylist()]
        ids = np.asarray(group["id"], np.int64)
        order = np.argsort(ids, kind="stable")
        found = forest(ids[order], [sets[i] for i in order], threshold)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    first = shared.kept(dealt.groupBy("cluster", "chunk").applyInArrow(decide, "a long, b long"))
    if not any_large:
        return first
    label = components(first).withColumnRenamed("component", "label")
    wide = members.join(large, "cluster").join(label, "id", "left").select("id", "cluster", "chunks", F.coalesce("label", "id").alias("label"), F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"))
    wide = shared.kept(wide)
    groups = wide.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = groups.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("groups")).where(F.col("groups") > 1)
    odd = wide.join(main, "cluster").where(F.col("label") != F.col("main")).select("cluster", "chunk", "chunks").distinct()
    meet = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    pairs = odd.withColumn("other", meet).select("cluster", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y")).distinct()
    sides = shared.kept(pairs.select("cluster", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("chunk")))
    if not sides.take(1):
        return first
    against = texts.join(wide.select("id", "label", "chunk"), "id").join(sides, ["cluster", "chunk"]).select("cluster", "x", "y", "id", "label", "found")

    def cross(key, group):
        sets = [np.frombuffer(x, np.uint64) for x in group["found"].to_pylist()]
        found = forest(np.asarray(group["id"], np.int64), sets, threshold, np.asarray(group["label"], np.int64))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return first.unionByName(against.groupBy("cluster", "x", "y").applyInArrow(cross, "a long, b long"))


def near_duplicates(documents: DataFrame, size: int = 3, threshold: int = 85) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id, kept: one row for each row.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set holds its
    distinct runs of `size` words, or its whole words as one run if it has fewer; documents with
    100 * intersection >= threshold * union are linked, checked on full sets; component_id is
    the smallest doc_id reached. Without words or text: an empty set, linked with nothing. Rows
    with a null doc_id have their n_shingles, are linked with nothing, and have null in the other
    columns; rows that share a doc_id are one node with several texts.
    Equal sets are one class before any table is built, so copies cost nothing further. A pair
    at the threshold shares no table with a chance of 2e-5; a pair above it with less.
    """
    shared.small_batches(documents.sparkSession)
    m = bands(threshold)
    rows = shared.kept(signed(documents, size, m))
    filled = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = ["n_shingles", "set_a", "set_b"]
    classes = shared.kept(filled.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    # An id with several texts stands in several classes: their links meet in it.
    several = filled.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("doc_id")
    nameless = rows.where(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    member = rows.where(F.col("doc_id").isNotNull()).select("doc_id", *same).join(classes.select(*same, "rep"), same, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    own = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = confirmed(documents, candidates(classes.select("rep", "bands"), m), size, threshold)
    label = shared.kept(components(links.unionByName(own)))
    out = member.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(nameless).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: The same rule in SQL, all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM s UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s LEFT JOIN c ON c.id = s.doc_id
"""
