"""Token-ID files of directly addressable codes.

A file is a run of blocks, each followed by one line end. A block holds whole documents:
  4 bytes "DAC1"; then little-endian uint64: documents, tokens, levels, bytes of the block
  per document: int64 id, uint8 1 if the id is null, uint64 tokens
  per level: uint64 chunks; a byte per chunk (8 bits of the id, lowest level first); a bitmap
  with a 1 where the id goes on in the next level; uint32 ones before each 512 bits.
Token i is chunk i of level 0; while its bit is set, it goes on at chunk rank(i) of the next level.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspan.llm import shared

MAGIC, STEP = b"DAC1", 512
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint32)
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: A piece may begin at these after an ASCII letter, as no token spans the two.
_MARK = np.array([chr(b) in '!"#$%&()*+,-./:;=?@[]^_`{}~' for b in range(256)])


def encode_level(chunks: np.ndarray, more: np.ndarray) -> bytes:
    bits = np.packbits(more, bitorder="little")
    padded = np.zeros(-(-len(bits) // (STEP // 8)) * (STEP // 8), np.uint8)
    padded[: len(bits)] = bits
    ranks = np.concatenate([[0], np.cumsum(_ONES[padded].reshape(-1, STEP // 8).sum(1))[:-1]]) if len(padded) else []
    return np.uint64(len(chunks)).tobytes() + chunks.astype(np.uint8).tobytes() + bits.tobytes() + np.asarray(ranks, np.uint32).tobytes()


def encode_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    levels, left = [], ids.astype(np.uint64)
    while len(left) or not levels:
        more = left > 255
        levels.append(encode_level(left & np.uint64(255), more))
        left = left[more] >> np.uint64(8)
        if not len(left):
            break
    body = b"".join([
        np.array([0 if x is None else x for x in doc_ids], np.int64).tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.asarray(counts, np.uint64).tobytes(), *levels])
    head = np.array([len(doc_ids), len(ids), len(levels), len(body) + 36], np.uint64)
    return MAGIC + head.tobytes() + body


class Block:
    """One block, read in place: access to any token, without decoding the others."""

    def __init__(self, data, at: int = 0):
        if bytes(data[at : at + 4]) != MAGIC:
            raise ValueError("not a block of token ids")
        self.documents, self.tokens, levels, self.size = (int(x) for x in np.frombuffer(data, np.uint64, 4, at + 4))
        at += 36
        self.ids = np.frombuffer(data, np.int64, self.documents, at)
        self.null = np.frombuffer(data, np.uint8, self.documents, at + 8 * self.documents)
        self.counts = np.frombuffer(data, np.uint64, self.documents, at + 9 * self.documents).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        at += 17 * self.documents
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(data, np.uint64, 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            ranks = np.frombuffer(data, np.uint32, -(-n // STEP), at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 4 * len(ranks)

    def token(self, i: int) -> int:
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            byte = int(bits[i >> 3])
            if not byte >> (i & 7) & 1:
                break
            first = (i // STEP) * (STEP // 8)
            i = int(ranks[i // STEP]) + int(_ONES[bits[first : i >> 3]].sum()) + bin(byte & ((1 << (i & 7)) - 1)).count("1")
        return out

    def all(self) -> np.ndarray:
        """Every token; a level's goers-on lie in the next level in the same order."""
        out = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if out is not None:
                value[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = value
        return out if out is not None else np.zeros(0, np.uint32)


class Encoder:
    """Token ids of texts. The vocabulary drops white space and splits at it, and between letters
    and marks, so a text's ids are those of its pieces one after another: each distinct piece is
    encoded once by the library. Pieces met earlier are kept, up to `most`."""

    _made: dict = {}

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The one encoder of a Python worker, which serves its tasks in turn."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        one = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return np.array(one.ids, np.uint32), np.bincount(np.array(one.word_ids, np.int64), minlength=len(texts))

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids, size = self._encoded(texts)
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, ids])
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, spot, keys), np.insert(self.begin, spot, begin), np.insert(self.size, spot, size)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return where, self.keys[where] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each has."""
        raw = data.tobytes()
        split = np.zeros(len(data), bool)
        split[1:] = _MARK[data[1:]] & _LETTER[data[:-1]]
        hashes, first, starts, ends = shared.words(data, offsets, shared.EXACT if b"<|" in raw else shared._LETTERS, split)
        keys, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        where, known = self._find(keys)
        if len(self.keys) + (~known).sum() > self.most:
            self.forget()
            known[:] = False
        if not known.all():
            new = at[~known]
            self._learn(keys[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            where, _ = self._find(keys)
        begin, size = self.begin[where][back], self.size[where][back]
        last = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (last - size), size) + np.arange(last[-1] if len(last) else 0)]
        return ids, np.diff(np.concatenate([[0], last])[first])


def _with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end).astype(np.uint32), counts + 1


def write(documents: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Writes documents(doc_id, text) as files of token ids, in ascending doc_id order.

    A null text is empty and has the end id alone; null ids come first; repeated ids keep all
    their rows, ordered by text. Each task writes one file by Spark's own commit protocol, so a
    lost or repeated task leaves no half file.
    """

    def blocks(batches):
        encoder = Encoder.of(vocabulary)
        for x in batches:
            data, offsets = shared.buffer(x.column(1))
            doc_ids = x.column(0).to_pylist()
            for a, b in shared.slices(offsets):
                ids, counts = encoder(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, counts = _with_end(ids, counts, end_id)
                yield pa.record_batch({"block": pa.array([encode_block(doc_ids[a:b], counts, ids)], pa.binary())})

    shared.small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # Spark's text writer puts out the bytes of a string column unchanged.
    rows.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files at path -> doc_id, start (tokens before the document), n_tokens, ids_crc32."""
    out = pa.schema([("file", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches):
        for x in batches:
            for name, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                data, at, before, place = content.as_buffer(), 0, 0, 0
                while at < len(data):
                    block = Block(data, at)
                    ids = block.all().astype("<u4")
                    crcs = [zlib.crc32(ids[s : s + n]) for s, n in zip(block.starts, block.counts, strict=True)]
                    keys = pa.array(block.ids, pa.int64(), mask=block.null.astype(bool))
                    yield pa.record_batch([pa.array([name] * len(keys)), pa.array(np.arange(len(keys)) + place), keys, pa.array(block.starts + before), pa.array(block.counts), pa.array(crcs, pa.int64())], schema=out)
                    at, before, place = at + block.size + 1, before + block.tokens, place + block.documents

    shared.small_batches(spark)
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    rows = shared.kept(files.mapInArrow(documents, "file string, place long, doc_id long, before long, n_tokens long, ids_crc32 long"))
    # One row a file: its place follows from the ids it holds, as ranges of ids do not overlap.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    order = Window.orderBy(F.col("nulls").desc(), F.col("least").asc_nulls_first(), "file")
    base = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(totals.select("file", base.alias("base")), "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
