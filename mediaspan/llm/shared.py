"""What the operators of this subpackage share: the scratch folder, text as bytes, hashes of words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The one machine-local folder, made only where no spark.checkpoint.dir is set (tests).
_LOCAL: list[str] = []
#: The paths that scratch() has given out, in order.
_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that all executors share.

    Without spark.checkpoint.dir that is a local folder if Spark runs in this process, else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
        base = f"file://{_LOCAL[0]}"
    _MADE.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> list[str]:
    return list(_MADE)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more; those that are gone already don't matter."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: no lineage behind them."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From here on Spark hands Python batches of about so many bytes, unless the session says
    otherwise: by default a batch is a number of rows, however long their texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of rows of at most so many bytes; a longer row is a run of its own."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        out.append((first, last))
        first = last
    return out


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_LETTERS[65:91] = _LETTERS[97:123]
#: Letters of hashes that tell upper from lower case.
EXACT = np.random.default_rng(77).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _LETTERS, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of bytes: a 64-bit hash of each word (A-Z lower-cased by the usual letters), the row's first word
    as offsets, and where each word starts and ends. A word is a run without ASCII white space; `split` marks
    bytes at which a run is cut in two."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), none, none
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    if split is not None:
        first |= split
    starts = np.flatnonzero(first)
    gone = ~inside
    last = inside.copy()
    last[:-1] &= gone[1:]
    last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
    if split is not None:
        last[:-1] |= split[1:]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of size words, and the rows' offsets among them. A row with
    fewer words has one run of all its words; a row without words has none."""
    rows, n = len(offsets) - 1, len(hashes)
    counts = np.diff(offsets)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(rows), runs)
    begin = offsets[:-1][row] + np.arange(out[-1]) - out[:-1][row]
    end = np.minimum(begin + size, offsets[1:][row])
    return mixed((sums[end] - sums[begin]) * down[begin] + np.uint64(size)), out


def joined(parts: list, dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
