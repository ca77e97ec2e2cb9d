"""Packs: rows of a few MB of whole texts, and the exchange of requests and replies about them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.llm import shared

SCHEMA = "pack long, size long, ids binary, offsets binary, text binary"


def packs(documents: DataFrame, most: int = 2 << 20) -> DataFrame:
    """documents(doc_id, text) -> a table of packs in the shared folder.

    The table freezes which texts are in which pack, so later jobs, and tasks that run again,
    see the same. A text above `most` bytes is a pack of its own.
    """

    def fill(batches):
        at, number = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=5)
        ids, texts, size = [], [], 0

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            null = np.array([x is None for x in ids], np.uint8)
            keys = np.array([0 if x is None else x for x in ids], np.int64)
            return pa.record_batch({"pack": pa.array([(at << 33) + number], pa.int64()), "size": pa.array([size], pa.int64()), "ids": pa.array([keys.tobytes() + null.tobytes()], pa.binary()), "offsets": pa.array([offsets.tobytes()], pa.binary()), "text": pa.array([press.compress(b"".join(texts))], pa.binary())})

        for x in batches:
            data, offsets = shared.buffer(x.column(1))
            keys = x.column(0).to_pylist()
            for i, key in enumerate(keys):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                if texts and size + len(text) > most:
                    yield row()
                    number += 1
                    ids, texts, size = [], [], 0
                ids.append(key)
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    shared.small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return shared.kept(rows.mapInArrow(fill, SCHEMA))


def opened(ids: bytes, offsets: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pack's doc_ids, which are null, its bytes and its rows' offsets."""
    n = len(ids) // 9
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
    return np.frombuffer(ids, np.int64, n), np.frombuffer(ids, np.uint8, n, 8 * n).astype(bool), data, np.frombuffer(offsets, np.int64)


def each(batches):
    """The packs of a task, opened, one after another."""
    for x in batches:
        for row in range(x.num_rows):
            got = {name: x.column(i)[row].as_py() for i, name in enumerate(x.schema.names) if name in ("pack", "ids", "offsets", "text")}
            yield got["pack"], opened(got["ids"], got["offsets"], got["text"])


def dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, by its high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def by_part(hashes: np.ndarray, parts: int):
    """(part, places of its hashes) for each part that has some, in order within each."""
    part = dealt(hashes, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p + 1] > cuts[p]:
            yield p, order[cuts[p] : cuts[p + 1]]
