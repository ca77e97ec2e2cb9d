"""Toxicity by class-conditional Kneser-Ney models of the bytes of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.llm import packs, shared

#: Longest expression in bytes, with a word's border as one (at most 7: an expression is a number);
#: Kneser-Ney discount; counts that each class's estimate takes from the shared one; log ratio
#: above which a word weighs by itself.
ORDER, DISCOUNT, PRIOR, MARGIN = 7, 0.75, 20.0, 2.0
#: Words of toxicity are runs of letters and digits; other ASCII separates them.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BORDER = 1
_COUNTS = [f"n{fold}{toxic}" for fold in (0, 1) for toxic in (0, 1)]
#: The models: for fold 0, for fold 1, and for all; and what each has of an expression.
VERSIONS, _KINDS = (0, 1, 2), ("both", "plain", "toxic")
#: Rows of counts that a task holds before it hands them on; bytes of words that are decided at a time.
_HELD, _AT_ONCE = 1_000_000, 1 << 20
_ASKED = pa.schema([("part", pa.int64()), ("pack", pa.int64()), ("words", pa.binary())])
_MODEL = pa.schema([("version", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])


def _press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _open(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def _plain(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[APART[out]] = 32
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out


def _bordered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words one after another, each between border bytes."""
    sizes = ends - starts + 2
    begin = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), BORDER, np.uint8)
    place = np.arange(len(out)) - np.repeat(begin, sizes)
    body = (place > 0) & (place < np.repeat(sizes, sizes) - 1)
    out[body] = data[(np.repeat(starts, sizes) + place - 1)[body]]
    return out


def _places(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bordered words: where each begins, and each byte's place in its word."""
    edges = np.flatnonzero(run == BORDER)
    begin = edges[::2]
    return begin, np.arange(len(run)) - np.repeat(begin, edges[1::2] - begin + 1)


def _expressions(run: np.ndarray):
    """For each size, the number of the expression of that size that ends at each byte: its bytes
    in order below, its size above. Numbers across a word's beginning mean nothing."""
    value = np.zeros(len(run), np.int64)
    for size in range(1, ORDER + 1):
        value[size - 1 :] += run[: len(run) - size + 1].astype(np.int64) << (8 * (size - 1))
        yield size, value + (size << 56)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, in order, with the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[cut], np.add.reduceat(counts[order], cut, axis=0) if len(cut) else counts


def _packed(rows: DataFrame, columns=(), most: int = 8 << 20) -> DataFrame:
    """Rows whose last column is the text -> a table of packs in the shared folder: a few MB of texts each.

    rows: the named columns as an Arrow message. words: the pack's distinct words, bordered, in
    order of their hashes. counts: how many words each text has. places: where its words stand
    among the distinct ones, ascending (no measure heeds their order), as steps. Later jobs, and
    tasks that run again, see the same packs.
    """
    columns = list(columns)

    def pack(batches):
        at, number = TaskContext.get().partitionId(), 0
        waiting, size = [], 0

        def row():
            found, base = [], 0
            for _, text, offsets in waiting:
                hashes, first, starts, ends = shared.words(text, offsets)
                found.append((hashes, np.diff(first), starts + base, ends + base))
                base += len(text)
            hashes, counts, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
            _, some, place = np.unique(hashes, return_index=True, return_inverse=True)
            owner = np.repeat(np.arange(len(counts)), counts)
            place = np.sort((owner << 32) + place) & 0xFFFFFFFF
            steps = np.where(owner == np.concatenate([[-1], owner[:-1]]), np.diff(place, prepend=0), place).astype(np.uint32)
            words = _bordered(np.concatenate([text for _, text, _ in waiting]), starts[some], ends[some])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x, _, _ in waiting:
                    out.write_batch(x)
            return pa.record_batch({"pack": pa.array([(at << 33) + number], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "words": pa.array([_press(words)], pa.binary()),
                                    "counts": pa.array([_press(counts.astype(np.int64))], pa.binary()), "places": pa.array([_press(steps.view(np.uint8).reshape(-1, 4).T)], pa.binary())})

        for x in batches:
            data, offsets = shared.buffer(x.column(x.num_columns - 1))
            own = x.select(columns)
            for a, b in shared.slices(offsets):
                if waiting and size + offsets[b] - offsets[a] > most:
                    yield row()
                    number, waiting, size = number + 1, [], 0
                waiting.append((own.slice(a, b - a), _plain(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]))
                size += int(offsets[b] - offsets[a])
        if waiting:
            yield row()

    shared.small_batches(rows.sparkSession)
    return shared.kept(rows.mapInArrow(pack, "pack long, rows binary, words binary, counts binary, places binary"))


def _unpacked(rows: bytes, counts: bytes, places: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A pack's rows, where each one's words begin, and the words' places among the distinct ones."""
    first = np.concatenate([[0], np.cumsum(_open(counts, np.int64))])
    steps = np.ascontiguousarray(_open(places, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    ends = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate([[0], ends])[first[:-1]]
    return pa.ipc.open_stream(rows).read_all(), first, ends - np.repeat(before, np.diff(first))


def gram_counts(packed: DataFrame) -> DataFrame:
    """Packs of rows (toxic, fold) -> gram, and its counts by fold and class, over all words of all texts."""

    def count(batches):
        held, n = [], 0

        def sums():
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.record_batch([pa.array(keys), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], names=["gram", *_COUNTS])

        for x in batches:
            for rows, words, counts, places in zip(*(x.column(i).to_pylist() for i in range(4)), strict=True):
                table, first, place = _unpacked(rows, counts, places)
                run = _open(words, np.uint8)
                begin, at = _places(run)
                cell = np.repeat(np.asarray(table["fold"]).astype(np.int64) * 2 + np.asarray(table["toxic"]).astype(np.int64), np.diff(first))
                weights = np.bincount(place * 4 + cell, minlength=4 * len(begin)).reshape(-1, 4)
                owner = np.cumsum(at == 0) - 1
                for size, keys in _expressions(run):
                    use = np.flatnonzero((at >= size - 1) & (at > 0))
                    held.append(_summed(keys[use], weights[owner[use]]))
                    n += len(held[-1][0])
                if n > _HELD:
                    yield sums()
                    held, n = [], 0
        if held:
            yield sums()

    rows = packed.select("rows", "words", "counts", "places").mapInArrow(count, ", ".join(["gram long", *(f"{c} long" for c in _COUNTS)]))
    return rows.groupBy("gram").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def estimates(counts: DataFrame) -> DataFrame:
    """All expressions with their counts -> the models, as a table of arrays in the shared folder.

    Of each version, for each run of bytes (key): its counts as an expression, and as a context
    the sum of its followers' counts (total) and how many (after); what a run is not has 0.

    Counts of both classes together make an interpolated Kneser-Ney model: long expressions by
    their counts, shorter ones by in how many longer ones they end. Each class discounts its own
    counts of the longest expression at a place and gives the rest, and PRIOR counts more, to
    that shared model. An expression rare in a class so has nearly the same chance in both.
    Versions 0 and 1 know only the other fold's counts, version 2 all.
    """
    kinds = [f"{kind}{v}" for v in VERSIONS for kind in _KINDS]
    halves = {0: ("n10", "n11"), 1: ("n00", "n01"), 2: ("n00 + n10", "n01 + n11")}
    raw = [F.expr(x).alias(f"{kind}{v}") for v, pair in halves.items() for kind, x in zip(_KINDS[1:], pair, strict=True)]
    rows = shared.kept(counts).select("gram", *raw)
    seen = {v: F.col(f"plain{v}") + F.col(f"toxic{v}") for v in VERSIONS}
    # Without its first byte, and without its last one, an expression is a number of one size less.
    tail = F.expr("(gram & (shiftleft(1L, cast(8 * (shiftright(gram, 56) - 1) AS INT)) - 1)) + shiftleft(shiftright(gram, 56) - 1, 56)")
    context = F.expr("shiftright(gram & (shiftleft(1L, 56) - 1), 8) + shiftleft(shiftright(gram, 56) - 1, 56)")
    ends = rows.where(F.expr("shiftright(gram, 56) > 1")).groupBy(tail.alias("gram")).agg(*(F.count_if(seen[v] > 0).alias(f"ends{v}") for v in VERSIONS))
    # Counts come dealt by expression, so neither join moves them again.
    rows = rows.join(ends.hint("merge"), "gram", "left")
    rows = rows.withColumns({f"both{v}": F.when(F.col(f"ends{v}") > 0, F.col(f"ends{v}")).otherwise(seen[v]) for v in VERSIONS})
    followers = [x for k in kinds for x in (F.sum(k).alias(f"total_{k}"), F.count_if(F.col(k) > 0).alias(f"after_{k}"))]
    contexts = rows.groupBy(context.alias("key")).agg(*followers)
    both = rows.select(F.col("gram").alias("key"), *kinds).join(contexts.hint("merge"), "key", "full")
    both = both.select("key", *(F.coalesce(c, F.lit(0)).alias(c) for v in VERSIONS for c in _values(v)))

    def arrays(batches):
        for x in batches:
            keys, out = np.asarray(x["key"]), []
            for v in VERSIONS:
                values = np.stack([np.asarray(x[c]) for c in _values(v)])
                some = values.any(0)
                out.append((v, _press(np.diff(keys[some], prepend=0)), _press(values[:, some])))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MODEL, strict=True)], schema=_MODEL)

    return shared.kept(both.mapInArrow(arrays, "version int, keys binary, values binary"))


def _values(v: int) -> list[str]:
    return [f"{part}{kind}{v}" for part in ("", "total_", "after_") for kind in _KINDS]


def _model(rows: pa.Table, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of a version and their `_values`, with one more row of zeros."""
    mine = []
    for version, k, x in zip(*(rows[c].to_pylist() for c in ("version", "keys", "values")), strict=True):
        if version == v:
            values = _open(x, np.int64).reshape(9, -1)
            mine.append((np.cumsum(_open(k, np.int64)), values.astype(np.int32 if values.max(initial=0) < 1 << 31 else np.int64)))
    keys = shared.joined([k for k, _ in mine], np.int64)
    order = np.argsort(keys)
    # The last row is what an unknown run has.
    values = np.zeros((len(keys) + 1, 9), np.result_type(*(x.dtype for _, x in mine)) if mine else np.int32)
    for c in range(9):
        values[:-1, c] = shared.joined([x[c] for _, x in mine], values.dtype)[order]
    return keys[order], values


def _grams(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Of ascending expressions: log P(last byte | those before, toxic) - the same for ordinary.

    An expression's chance takes in that of the one without its first byte, so the distinct
    expressions of each size are decided once, from the shortest up. All look-ups are in order.
    """
    def look(wanted):
        where = np.searchsorted(keys, wanted)
        known = where < len(keys)
        known[known] = keys[where[known]] == wanted[known]
        return np.where(known, where, len(keys))

    cuts = np.searchsorted(asked, np.arange(ORDER + 2) << 56)
    levels, longer = {}, np.zeros(0, np.int64)
    for size in range(ORDER, 0, -1):
        tails = (longer & ((1 << 8 * size) - 1)) + (size << 56)
        levels[size] = longer = np.union1d(asked[cuts[size] : cuts[size + 1]], tails)
    out, chance, shorter = np.zeros(len(asked)), np.full(1, 1 / 256), np.zeros(1, np.int64)
    for size in range(1, ORDER + 1):
        own = levels[size]
        low = own & ((1 << 56) - 1)
        chance = chance[np.searchsorted(shorter, (low & ((1 << 8 * (size - 1)) - 1)) + (size - 1 << 56))]
        counts, context = values[look(own), :3], values[look((low >> 8) + (size - 1 << 56)), 3:]
        total, loose = context[:, :3] + [0.0, PRIOR, PRIOR], DISCOUNT * context[:, 3:] + [0.0, PRIOR, PRIOR]
        some = total > 0
        safe = np.where(some, total, 1.0)
        alpha, rest = np.where(some, np.maximum(counts - DISCOUNT, 0), 0.0) / safe, np.where(some, loose / safe, 1.0)
        chance, shorter = chance * rest[:, 0] + alpha[:, 0], own
        mine = np.searchsorted(own, asked[cuts[size] : cuts[size + 1]])
        plain, toxic = (chance[mine] * rest[mine, c] + alpha[mine, c] for c in (1, 2))
        out[cuts[size] : cuts[size + 1]] = np.log(toxic) - np.log(plain)
    return out


def ratios(models: list[tuple[np.ndarray, np.ndarray]], run: np.ndarray) -> np.ndarray:
    """Of bordered words: log P(word | toxic) - log P(word | ordinary) by each model, a pair of
    ascending keys and their `_values`. A byte counts by the longest expression that ends at it."""
    begin, place = _places(run)
    at = np.flatnonzero(place > 0)
    longest = np.minimum(place[at] + 1, ORDER)
    ends = np.zeros(len(at), np.int64)
    for size, wanted in _expressions(run):
        some = longest == size
        ends[some] = wanted[at[some]]
    asked, back = np.unique(ends, return_inverse=True)
    word = np.cumsum(place == 0)[at] - 1
    return np.stack([np.bincount(word, weights=_grams(*x, asked)[back], minlength=len(begin)) for x in models])


def _hashed(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of bordered words, and where each starts and ends."""
    text = np.where(run == BORDER, np.uint8(32), run)
    hashes, _, starts, ends = shared.words(text, np.array([0, len(run)]))
    return hashes, starts, ends


def word_ratios(packed: DataFrame, model: DataFrame, versions: list[int], together: int = 16) -> DataFrame:
    """Packs -> pack, part, ratios: of each pack's distinct words of that part, in order of their
    hashes, the ratios by each version in turn.

    Words are dealt into parts by hash, so a word is decided once however many packs have it.
    A part gets the whole model, which the sample of `fit` bounds; there is one part for
    `together` packs, so the copies of the model are a small share of the texts.
    """
    parts = max(1, -(-packed.count() // together))

    def ask(batches):
        for x in batches:
            for pack, blob in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                run = _open(blob, np.uint8)
                hashes, starts, ends = _hashed(run)
                rows = [(p, pack, _press(run[starts[at[0]] - 1 : ends[at[-1]] + 1])) for p, at in packs.by_part(hashes, parts)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 3, _ASKED, strict=True)], schema=_ASKED)

    def decide(key, asked, known):
        tables, own, fresh = [_model(known, v) for v in versions], [], []
        keys = np.zeros(0, np.uint64)
        for blob in asked["words"].to_pylist():
            run = _open(blob, np.uint8)
            hashes, starts, ends = _hashed(run)
            own.append(hashes)
            new = ~np.isin(hashes, keys, assume_unique=True)
            fresh.append((hashes[new], _bordered(run, starts[new], ends[new])))
            keys = np.union1d(keys, hashes[new])
        hashes, run = (np.concatenate(x) for x in zip(*fresh, strict=True))
        found, cuts = np.zeros((len(versions), len(keys))), np.append(_places(run)[0], len(run))
        for a, b in shared.slices(cuts, _AT_ONCE):
            found[:, np.searchsorted(keys, hashes[a:b])] = ratios(tables, run[cuts[a] : cuts[b]])
        blobs = [_press(found[:, np.searchsorted(keys, x)]) for x in own]
        return pa.table({"pack": asked["pack"], "part": asked["part"], "ratios": pa.array(blobs, pa.binary())})

    asked = packed.select("pack", "words").mapInArrow(ask, "part long, pack long, words binary")
    given = model.where(F.col("version").isin(*versions)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return asked.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(decide, "pack long, part long, ratios binary")


def _measures(row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length-normalised ratios of each row of words.

    The median word's ratio is what a row's language is worth, and is taken from every word's.
    Of each row: the mean over words; the mean of what is above MARGIN; the number of words.
    """
    n = np.diff(first)
    middle = np.array([np.median(row[a:b]) if b > a else 0.0 for a, b in zip(first[:-1], first[1:], strict=True)])
    row = row - np.repeat(middle, n)
    sums = np.concatenate([[0.0], np.cumsum(row)])
    above = np.concatenate([[0.0], np.cumsum(np.maximum(row - MARGIN, 0))])
    return tuple((x[first[1:]] - x[first[:-1]]) / np.maximum(n, 1) for x in (sums, above)) + (n,)


def _measured(packed: DataFrame, model: DataFrame, versions: list[int], finish, schema) -> DataFrame:
    """finish(rows, the measures by each version) of every pack."""

    def apply(key, blobs, replies):
        order = np.argsort(np.asarray(replies["part"], np.int64))
        answers = replies["ratios"].to_pylist()
        values = [_open(answers[i], float).reshape(len(versions), -1) for i in order]
        values = np.concatenate(values, 1) if values else np.zeros((len(versions), 0))
        rows, first, place = _unpacked(*(blobs[c][0].as_py() for c in ("rows", "counts", "places")))
        return finish(rows, [_measures(v[place], first) for v in values])

    replies = word_ratios(packed, model, versions)
    return packed.drop("words").groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(apply, schema)


def _features(mean: np.ndarray, above: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(mean)), mean, above, above * np.sqrt(np.minimum(n, 400))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    ridge = 1e-3 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def remainder(doc_id: Column, base: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(base)), F.lit(-1))


class Classifier:
    """What scoring needs: the model's table and the weights of the final comparison."""

    def __init__(self, model: DataFrame, beta: np.ndarray):
        self.model, self.beta = model, beta


def fit(documents: DataFrame, labels: DataFrame, held: int = 1, base: int = 3, rows: int = 4000) -> Classifier:
    """Learns from documents(doc_id, text) with labels(doc_id, toxic) outside the held-out part.

    The only bound: at most `rows` labelled documents of each class (those of the least hash of
    doc_id). Every expression of theirs counts. The comparison is weighed by documents that the
    other half's counts have scored, at the classes' shares of all labels.
    """
    shared.small_batches(documents.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(remainder(F.col("doc_id"), base) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = shared.kept(known.withColumn("h", F.xxhash64(F.lit(5), "doc_id")))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = [known.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(rows) for c in (0, 1)]
    sample = few[0].unionByName(few[1]).select("doc_id", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("fold"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(shared.kept(sample), "doc_id")
    packed = _packed(texts.select("toxic", "fold", "text"), ["toxic", "fold"])
    model = estimates(gram_counts(packed))

    def cross(rows, both):
        fold = np.asarray(rows["fold"])
        return pa.table([rows["toxic"], *(pa.array(np.where(fold == 0, a, b)) for a, b in zip(*both, strict=True))], names=["toxic", "mean", "above", "n"])

    scored = _measured(packed, model, [0, 1], cross, "toxic int, mean double, above double, n long").toArrow()
    y, *parts = (np.asarray(scored[c]).astype(float) for c in ("toxic", "mean", "above", "n"))
    beta = np.zeros(4)
    if len(y):
        have = np.array([max(1, (y == c).sum()) for c in (0, 1)])
        weight = np.array([share.get(c, 0) for c in (0, 1)]) / have
        beta = _logistic(_features(*parts), y, weight[y.astype(int)])
    return Classifier(model, beta)


def score(documents: DataFrame, classifier: Classifier, columns=("doc_id",), threshold: float = 0.7) -> DataFrame:
    """documents(columns..., text) -> columns..., score, predicted; every row, whole texts.

    A null text is empty; a text without words has the score of no evidence.
    """
    beta = classifier.beta
    rows = documents.select(*(c for c in columns if c != "text"), "text")
    schema = rows.select(*columns, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def apply(rows, measures):
        p = 1 / (1 + np.exp(-np.clip(_features(*measures[0]) @ beta, -50, 50)))
        return pa.table([*(rows[c] for c in columns), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    return _measured(_packed(rows, columns), classifier.model, [2], apply, schema)


def toxicity(documents: DataFrame, labels: DataFrame, held: int = 1, base: int = 3) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted: one row for each document.

    held_out: crc32 of doc_id as text leaves `held` modulo `base` (false for a null doc_id).
    Only texts enter a score. Labels of unknown documents, null labels and other values than 0
    and 1 have no part; without labels every score is 0.5. Repeated rows are scored each.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(rows, fit(rows, labels, held, base))
    return out.select("doc_id", (remainder(F.col("doc_id"), base) == held).alias("held_out"), "score", "predicted")
