"""Vector codes: product codebooks by Lloyd's rounds in whole numbers, with stored distances of active entries."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from mediaspan.llm import shared
from mediaspan.llm.topk import usable_rows

#: Components are held at this size, so that squared distances of a part of up to 64 stay below 2^62.
HELD = 2**27


def whole(column: pa.Array, scale: float, dims: int, held: int = HELD) -> np.ndarray:
    """A list column as a matrix of floor(scale * x); what a shorter vector lacks is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.floor(scale * np.asarray(column.flatten(), np.float64)).clip(-held, held).astype(np.int64)
    lengths = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """The bytes of whole numbers in the least of 2, 4 and 8 bytes each that holds them."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    size = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return size, x.astype(f"<i{size}").tobytes()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, width) to entries (k, width), exact."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        apart = x[:, d, None] - entries[None, :, d]
        out += apart * apart
    return out


def assign(x: np.ndarray, books: np.ndarray, moved: np.ndarray | None, codes: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (n, parts, width), books (parts, k, width) -> nearest entry and its distance, (n, parts) each.

    A part whose entry did not move keeps its stored distance as exact, and no entry that stayed
    can have come nearer, so it is compared with the moved ones only; on equal distances the
    lower index wins. Parts whose entry moved, and all parts when `moved` is None, see every entry.
    """
    codes, far = codes.copy(), far.copy()
    for p in range(x.shape[1]):
        again = np.ones(len(x), bool) if moved is None else moved[p][codes[:, p]]
        if again.any():
            d = distances(x[again, p], books[p])
            best = d.argmin(1)
            codes[again, p], far[again, p] = best, d[np.arange(len(best)), best]
        if moved is None or not moved[p].any() or again.all():
            continue
        rest, active = np.flatnonzero(~again), np.flatnonzero(moved[p])
        d = distances(x[rest, p], books[p][active])
        best = d.argmin(1)
        near, entry = d[np.arange(len(best)), best], active[best]
        wins = (near < far[rest, p]) | (near == far[rest, p]) & (entry < codes[rest, p])
        codes[rest[wins], p], far[rest[wins], p] = entry[wins], near[wins]
    return codes, far


def _sums(x: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Per part and entry: the components' sums, then the count; flat."""
    n, parts, width = x.shape
    out = np.zeros((parts, k, width + 1), np.int64)
    for p in range(parts):
        np.add.at(out[p, :, :width], codes[:, p], x[:, p])
        out[p, :, width] = np.bincount(codes[:, p], minlength=k)
    return out.ravel()


def _blocks(rows: DataFrame, scale: float, dims: int, block: int) -> DataFrame:
    """rows(vec_id, label, embedding) -> rows of up to `block` vectors with no codes yet."""
    label = rows.schema["label"].dataType
    schema = StructType([StructField("vec_ids", ArrayType(LongType())), StructField("labels", ArrayType(label)), StructField("size", IntegerType()), StructField("components", BinaryType()), StructField("codes", BinaryType()), StructField("far", BinaryType()), StructField("sums", ArrayType(LongType()))])

    def fill(batches):
        for x in batches:
            for at in range(0, x.num_rows, block):
                part = x.slice(at, block)
                size, data = _narrow(whole(part.column("embedding"), scale, dims))
                one = pa.array([0, part.num_rows], pa.int32())
                lists = {name: pa.ListArray.from_arrays(one, part.column(at)) for name, at in (("vec_ids", "vec_id"), ("labels", "label"))}
                yield pa.record_batch(lists | {"size": pa.array([size], pa.int32()), "components": pa.array([data]), "codes": pa.array([b""]), "far": pa.array([b""]), "sums": pa.array([[]], pa.list_(pa.int64()))})

    return rows.select("vec_id", "label", "embedding").mapInArrow(fill, schema)


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    parts, k, width = books.shape

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1)
                get = lambda name: x.column(name)[0].as_py()
                values = np.frombuffer(get("components"), f"<i{get('size')}").astype(np.int64).reshape(len(x.column("vec_ids")[0]), parts, width)
                codes, far = (np.frombuffer(get(name), np.int64).reshape(-1, parts) for name in ("codes", "far"))
                if moved is None:
                    codes = far = np.zeros((len(values), parts), np.int64)
                codes, far = assign(values, books, moved, codes, far)
                new = {"codes": pa.array([codes.tobytes()]), "far": pa.array([far.tobytes()]), "sums": pa.array([_sums(values, codes, k)], pa.list_(pa.int64()))}
                yield pa.record_batch([new.get(name, x.column(name)) for name in x.schema.names], names=x.schema.names)

    return state.mapInArrow(step, state.schema)


def codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, block: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """vectors(vec_id, label, embedding) -> (assigned blocks, codebooks (parts, entries, width)).

    The rows stay in blocks of up to `block` vectors with their codes and exact distances, written
    to the shared folder after each round; the one before is deleted. A round's sums, of parts *
    entries * (width + 1) numbers, are all that the driver gets.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    shared.small_batches(spark)
    rows = usable_rows(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    width = -(-(rows.agg(F.max(F.size("embedding"))).first()[0] or 0) // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    seeds = whole(first["embedding"], scale, parts * width) if len(first) else np.zeros((0, parts * width), np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    before = len(shared.made())
    state, moved = shared.kept(_blocks(rows, scale, parts * width, block)), None
    for step in range(rounds + 1):
        path = shared.scratch(spark)
        _round(state, books, moved).write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        shared.discard(spark, [x for x in shared.made()[before:] if x != path])
        if step == rounds:
            break
        sums = np.zeros(books.shape[0] * books.shape[1] * (width + 1), np.int64)
        for at, value in state.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value")).toLocalIterator():
            sums[at] = value
        sums = sums.reshape(parts, books.shape[1], width + 1)
        counts = sums[..., width:]
        new = np.where(counts > 0, sums[..., :width] // np.maximum(counts, 1), books)
        moved, books = (new != books).any(2), new
    return state, books


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """vectors(vec_id, label, embedding) -> vec_id, code, error, label_error, codebooks_sha256; a row a kept row.

    Null vectors and vectors with null or non-finite components are dropped. A component becomes
    floor(scale * x), held at 2^27 either way; vectors are cut into equal parts, a shorter one
    filled up with 0 to the greatest length, rounded up to a multiple of parts. Codebooks start as
    the parts of the least vec_ids (null last; of repeated ids by their vectors; with fewer rows
    there are fewer entries), and get `rounds` rounds. Repeated rows count each time and are
    returned each time. Errors of equal labels are summed, of null labels together; a sum beyond 64
    bits is held at the greatest long. No rows give no rows.
    """
    state, books = codebooks(vectors, parts, entries, rounds, scale)
    said = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    label = state.schema["labels"].dataType.elementType
    schema = StructType([StructField("vec_id", LongType()), StructField("label", label), *(StructField(x, t) for x, t in (("code", BinaryType()), ("error", LongType())))])

    def open_(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1)
                codes, far = (np.frombuffer(x.column(name)[0].as_py(), np.int64).reshape(-1, parts) for name in ("codes", "far"))
                data = pa.py_buffer(codes.astype(np.uint8).tobytes())
                code = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, codes.size + 1, parts, np.int32).tobytes()), data])
                yield pa.record_batch({"vec_id": x.column("vec_ids")[0].values, "label": x.column("labels")[0].values, "code": code, "error": pa.array(far.sum(1))})

    rows = state.mapInArrow(open_, schema).withColumn("code", F.lower(F.hex("code")))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same as SQL: each round a step of common tables over rows of (vector, part)."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e,
        row_number() OVER (ORDER BY vec_id) AS place FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, place, p, list_slice(e, p * (len(e) // {parts}) + 1, (p + 1) * (len(e) // {parts})) AS w FROM v, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, place - 1 AS entry, w FROM x WHERE place <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT x.place, x.p, b.entry, CAST(list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far FROM x JOIN b{r} b ON b.p = x.p),
a{r} AS MATERIALIZED (SELECT place, p, min(struct_pack(far := far, entry := entry)) AS best FROM d{r} GROUP BY place, p)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT p, entry, list(m ORDER BY i) AS w FROM (
    SELECT a.p, a.best.entry AS entry, i, CAST(floor(CAST(sum(x.w[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM a{r} a JOIN x ON x.place = a.place AND x.p = a.p CROSS JOIN range(1, len(x.w) + 1) t(i) GROUP BY ALL) GROUP BY p, entry),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.w, b.w) AS w FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.entry = b.entry)""")
    steps.append(f"""c AS (SELECT place, string_agg(printf('%02x', best.entry), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY place),
s AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM b{rounds})""")
    return "WITH " + ",\n".join(steps) + "\nSELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, s.codebooks_sha256 FROM v JOIN c ON c.place = v.place, s"


ORACLE = _oracle()
