"""Language-model scores: word counts of the whole corpus, and a gated recurrent network trained
on it in parallel with averaged parameters."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.llm import gru, packs, shared

#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x243F6A8885A308D3)
#: Shares of all packs after which the tasks' parameters are averaged.
ROUNDS = (0.02, 0.1, 0.4, 1.0)
LEARNT = "task long, n long, flat binary"


def held_out(ids: np.ndarray, null: np.ndarray, held: int, base: int) -> np.ndarray:
    """crc32 of the id as text leaves `held` modulo `base`; false for a null id."""
    return np.array([not n and zlib.crc32(b"%d" % i) % base == held for i, n in zip(ids.tolist(), null.tolist(), strict=True)], bool)


def _tokens(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end; offsets of the rows among them."""
    hashes, first, _, _ = shared.words(data, offsets)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, in the order of their first places, and which of them each hash is."""
    coded = pa.array(hashes.view(np.int64)).dictionary_encode()
    return np.asarray(coded.dictionary).view(np.uint64), np.asarray(coded.indices)


CODED = "pack long, ids binary, first binary, keys binary, back binary"


def coded(packed: DataFrame) -> DataFrame:
    """The packs' words as numbers, hashed this once: a pack's distinct hashes, which of them each of its
    tokens is, and where its rows begin among the tokens; a table in the shared folder."""

    def code(batches):
        press = zstandard.ZstdCompressor(level=1)
        for x in batches:
            for i in range(x.num_rows):
                one = x.slice(i, 1)
                for pack, (_, _, data, offsets) in packs.each([one]):
                    hashes, first = _tokens(data, offsets)
                    keys, back = _distinct(hashes)
                    kind = np.uint16 if len(keys) <= 1 << 16 else np.uint32
                    yield pa.record_batch({"pack": pa.array([pack], pa.int64()), "ids": one.column("ids"), "first": pa.array([first.astype(np.int64).tobytes()]), "keys": pa.array([keys.tobytes()]), "back": pa.array([press.compress(back.astype(kind).tobytes())])})

    return shared.kept(packed.select("pack", "ids", "offsets", "text").mapInArrow(code, CODED))


def _each(batches):
    """The coded packs of a task, one after another: pack, (ids, null), keys, back, first."""
    open_ = zstandard.ZstdDecompressor()
    for x in batches:
        for row in range(x.num_rows):
            got = {name: x.column(name)[row].as_py() for name in ("pack", "ids", "first", "keys", "back")}
            n, keys = len(got["ids"]) // 9, np.frombuffer(got["keys"], np.uint64)
            back = np.frombuffer(open_.decompress(got["back"]), np.uint16 if len(keys) <= 1 << 16 else np.uint32).astype(np.int64)
            yield got["pack"], (np.frombuffer(got["ids"], np.int64, n), np.frombuffer(got["ids"], np.uint8, n, 8 * n).astype(bool)), keys, back, np.frombuffer(got["first"], np.int64)


def counted(packed: DataFrame, parts: int, held: int, base: int) -> DataFrame:
    """Counts of every word in training texts, as replies to the packs that hold the word.

    Rows with a pack: the counts of its distinct words of one part, in the order of their first places.
    Rows with pack -1: a part's training tokens, distinct words, and its most frequent words.
    """

    def ask(batches):
        for pack, (ids, null), keys, back, first in _each(batches):
            train = np.repeat(~held_out(ids, null, held, base), np.diff(first))
            counts = np.bincount(back[train], minlength=len(keys)).astype(np.uint32)
            rows = [(part, keys[at].tobytes(), counts[at].tobytes()) for part, at in packs.by_part(keys, parts)]
            yield pa.record_batch({"pack": pa.array([pack] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def reply(key, group):
        asked = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        given = [np.frombuffer(x, np.uint32) for x in group["counts"].to_pylist()]
        keys, back = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate(given), minlength=len(keys)).astype(np.int64)
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        replies = [x.astype(np.int64).tobytes() for x in np.split(sums[back], cuts)]
        best = np.argsort(-sums, kind="stable")[: gru.WORDS]
        best = best[(sums[best] > 0) & (keys[best] != END)]
        n = len(replies)
        return pa.table({
            "pack": pa.array([*group["pack"].to_pylist(), -1], pa.int64()), "part": pa.array([key[0].as_py()] * (n + 1), pa.int32()), "counts": pa.array([*replies, sums[best].tobytes()], pa.binary()),
            "words": pa.array([*[None] * n, keys[best].tobytes()], pa.binary()), "tokens": pa.array([*[None] * n, int(sums.sum())], pa.int64()), "kinds": pa.array([*[None] * n, int((sums > 0).sum())], pa.int64()),
            "ends": pa.array([*[None] * n, int(sums[keys == END].sum())], pa.int64())})

    asked = packed.mapInArrow(ask, "pack long, part int, hashes binary, counts binary")
    return shared.kept(asked.groupBy("part").applyInArrow(reply, "pack long, part int, counts binary, words binary, tokens long, kinds long, ends long"))


class Lexicon:
    """The words that have ids of their own, and the totals."""

    def __init__(self, replies: DataFrame):
        sums = replies.where(F.col("pack") == -1)
        row = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "kinds", "ends"))).first()
        self.tokens, self.kinds, self.ends = row["tokens"], row["kinds"], row["ends"]

        def rows(batches):
            for x in batches:
                for words, counts in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                    yield pa.record_batch({"word": pa.array(np.frombuffer(words, np.int64)), "n": pa.array(np.frombuffer(counts, np.int64))})

        best = sums.select("words", "counts").mapInArrow(rows, "word long, n long").orderBy(F.col("n").desc(), "word").limit(gru.WORDS - 2).toArrow()
        word, n = np.asarray(best["word"]).astype(np.int64).view(np.uint64), np.asarray(best["n"]).astype(np.int64)
        order = np.argsort(word)
        self.word, self.id = word[order], (order + 1).astype(np.int64)
        self.rare_tokens = self.tokens - self.ends - int(n.sum())
        self.rare_kinds = self.kinds - len(word) - (self.ends > 0)
        self.counts = np.zeros(gru.WORDS)
        self.counts[gru.END], self.counts[1 : len(n) + 1], self.counts[gru.RARE] = self.ends, n, self.rare_tokens + 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), gru.RARE, np.int64)
        if len(self.word):
            where = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
            hit = self.word[where] == hashes
            out[hit] = self.id[where[hit]]
        out[hashes == END] = gru.END
        return out


def _mean(key, group):
    n = np.asarray(group["n"]).astype(np.float64)
    total = sum(w * np.frombuffer(x, np.float32) for w, x in zip(n, group["flat"].to_pylist(), strict=True))
    return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "flat": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def averaged(rows: DataFrame, tasks: int, fan: int = 16) -> DataFrame:
    """rows(task, n, flat) -> their mean by n, in one row: a tree in which each task adds up `fan` of them."""
    while tasks > 1:
        rows = rows.withColumn("task", F.floor(F.col("task") / fan)).groupBy("task").applyInArrow(_mean, LEARNT)
        tasks = -(-tasks // fan)
    return rows


def trained(packed: DataFrame, lexicon: Lexicon, held: int, base: int) -> np.ndarray:
    """Parameters after one pass over all training texts.

    Every task learns from its packs, from the parameters of the round before, and its step sizes
    start anew; a round's result is their mean by tokens, added up in a tree. So the parameters
    depend on which packs a task has, not on the order of tasks. Texts are learnt whole.
    """
    spark = packed.sparkSession
    flat = gru.packed(gru.start(lexicon.counts))
    # A hash of the pack says in which round it is learnt.
    spot = F.pmod(F.xxhash64("pack"), F.lit(10_000)) / 10_000.0
    low = 0.0
    for high in ROUNDS:
        given = spark.sparkContext.broadcast((flat, lexicon))

        def learn(batches, given=given):
            flat, lexicon = given.value
            learner, n = gru.Learner(gru.unpacked(flat)), 0
            for _, (ids, null), keys, back, first in _each(batches):
                train = ~held_out(ids, null, held, base)
                tokens = lexicon.ids(keys)[back[np.repeat(train, np.diff(first))]]
                cuts = np.concatenate([[0], np.cumsum(np.diff(first)[train])])
                if len(tokens):
                    n += learner.learn(tokens, cuts)
            if n:
                yield pa.record_batch({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()), "flat": pa.array([gru.packed(learner.p).tobytes()], pa.binary())})

        mine = packed.where((spot >= low) & (spot < high))
        got = averaged(mine.mapInArrow(learn, LEARNT), mine.rdd.getNumPartitions()).collect()  # one row
        if got:
            flat = np.frombuffer(got[0]["flat"], np.float32)
        given.destroy()
        low = high
    return flat


def scores(documents: DataFrame, held: int = 2, base: int = 7, part_bytes: int = 40 << 20) -> DataFrame:
    """documents(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    One row for each row; a null text is empty and has its end alone. Texts whose crc32 of the
    doc_id leaves `held` modulo `base` are not learnt from (a null doc_id is learnt from).
    base_score: log10 of add-one unigram chances by counts of all training texts. score: log10 of
    the network's chance of the whole text, its state carried from the first token to the last;
    words without an id of their own are the network's rare word times their add-one share of
    rare words, so chances over all words and one unseen word sum to 1. Without training texts
    every base_score is 0 and the network scores as it was made.
    """
    before = len(shared.made())
    texts = packs.packs(documents, 8 << 20)
    total = texts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    gone = shared.made()[before:]
    packed = coded(texts)
    shared.discard(documents.sparkSession, gone)
    parts = max(1, -(-total // part_bytes))
    replies = counted(packed, parts, held, base)
    lexicon = Lexicon(replies)
    given = documents.sparkSession.sparkContext.broadcast((trained(packed, lexicon, held, base), lexicon))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def score(key, left, right):
        flat, lexicon = given.value
        p = gru.unpacked(flat)
        answer = dict(zip(right["part"].to_pylist(), right["counts"].to_pylist(), strict=True))
        out = []
        for _, (ids, null), keys, back, first in _each(left.to_batches()):
            count = np.zeros(len(keys), np.int64)
            for part, at in packs.by_part(keys, parts):
                count[at] = np.frombuffer(answer[part], np.int64)
            plain = np.log10((count + 1) / (lexicon.tokens + lexicon.kinds + 1))[back]
            share = np.log10((count + 1) / (lexicon.rare_tokens + lexicon.rare_kinds + 1))[back]
            tokens = lexicon.ids(keys)[back]
            model = gru.score(p, tokens, first) / np.log(10) + np.where(tokens == gru.RARE, share, 0.0)
            rows = np.repeat(np.arange(len(ids)), np.diff(first))
            add = lambda x: np.bincount(rows, weights=x, minlength=len(ids))
            columns = [pa.array(ids, pa.int64(), mask=null), held_out(ids, null, held, base), np.diff(first), add(count[back] > 0).astype(np.int64), np.full(len(ids), lexicon.tokens), add(plain), add(model)]
            out.append(pa.table(columns, names=names))
        return pa.concat_tables(out)

    left = packed.groupBy("pack")
    right = replies.where(F.col("pack") >= 0).select("pack", "part", "counts").groupBy("pack")
    return left.cogroup(right).applyInArrow(score, schema)
