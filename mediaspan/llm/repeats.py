"""Long repeats across documents by a family of suffix arrays, and the texts without them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.llm import packs, shared

#: Bytes of the seeds by which repeats find each other; a repeat of LENGTH bytes holds one.
LENGTH, SEED = 50, 24
SIDE = LENGTH - SEED  # bytes on either side of a seed that a repeat can reach
WIDE = SEED + 2 * SIDE
_OFFSETS = np.arange(SIDE + 1)


def _slide(x: np.ndarray, n: int, f, back: bool) -> np.ndarray:
    """f over each run of n entries that starts (or, with back, ends) at a place; the ends are kept short."""
    have, out = 1, x.copy()
    while have < n:
        step = min(have, n - have)
        if back:
            out[step:] = f(out[step:], out[:-step].copy())
        else:
            out[:-step] = f(out[:-step], out[step:].copy())
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds that are the least, by hash, of some run of LENGTH bytes within a row.

    Two equal runs have the same least seed at the same place, so comparing anchors of equal
    hash compares all equal runs. Returns places, 64-bit hashes, bytes to the left and right
    within the row (at most SIDE), and as bits the offsets o at which the run that starts o
    bytes before the anchor has it as its first least seed.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint32)
    up, down = shared._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(shared.EXACT[data] * up[:n], out=sums[1:])
    hashes = shared.mixed((sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1])
    rank = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), 1)
    least = _slide(rank, SIDE + 1, np.minimum, False)
    ok = np.zeros(n + 1, np.int32)  # runs that lie within a row
    lengths = np.diff(offsets)
    use = (lengths >= LENGTH) & ~skip
    np.add.at(ok, offsets[:-1][use], 1)
    np.add.at(ok, offsets[1:][use] - LENGTH + 1, -1)
    least[np.cumsum(ok)[: len(least)] <= 0] = 0
    at = np.flatnonzero(_slide(least, SIDE + 1, np.maximum, True) == rank)
    row = np.searchsorted(offsets, at, "right") - 1
    left, right = np.minimum(at - offsets[row], SIDE), np.minimum(offsets[row + 1] - at - SEED, SIDE)
    low, high = SIDE - right, left.copy()
    value = rank[at]
    for j in range(1, SIDE + 1):
        gap = at[j:] - at[:-j]
        if not len(gap) or gap.min() > SIDE:
            break
        near = gap <= SIDE
        before = near & (value[:-j] <= value[j:])
        high[j:] = np.where(before, np.minimum(high[j:], gap - 1), high[j:])
        after = near & (value[j:] < value[:-j])
        low[:-j] = np.where(after, np.maximum(low[:-j], SIDE + 1 - gap), low[:-j])
    bits = np.where(high >= low, (np.uint64(2) << high.astype(np.uint64)) - (np.uint64(1) << np.minimum(low, SIDE).astype(np.uint64)), np.uint64(0)).astype(np.uint32)
    return at, hashes[at], left, right, bits


class Family:
    """Suffix arrays of geometrically growing sizes: the LENGTH-byte beginnings of the suffixes
    met so far, in order, each with the least document that has it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes a batch of suffixes' beginnings; returns the least document of each."""
        order = np.argsort(text, kind="stable")
        ranked, held = text[order], docs[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(fresh) - 1
        cut = np.flatnonzero(fresh)
        keys, least = ranked[cut], np.minimum.reduceat(held, cut) if len(cut) else held
        new = np.ones(len(keys), bool)
        for known, owner in self.levels:  # both sides are in order: a merge scan
            where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[where] == keys
            least[hit] = np.minimum(least[hit], owner[where[hit]])
            new &= ~hit
        if new.any():
            self.levels.append((keys[new], least[new]))
            while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
                b, a = self.levels.pop(), self.levels.pop()
                text, owner = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
                merged = np.argsort(text, kind="stable")
                self.levels.append((text[merged], owner[merged]))
        out = np.empty(len(order), docs.dtype)
        out[order] = least[group]
        return out


def _classes(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows: the first row of each class, and each row's class."""
    text = np.ascontiguousarray(context).view(f"V{context.shape[1]}").ravel()
    rng = np.random.default_rng(3)
    pad = -(-context.shape[1] // 8) * 8
    wide = np.zeros((len(context), pad), np.uint8)
    wide[:, : context.shape[1]] = context
    key = np.zeros(len(context), np.uint64)
    for column in wide.view(np.uint64).T:
        key = shared.mixed((key ^ column) * np.uint64(int(rng.integers(1, 2**63)) * 2 + 1))
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    odd = np.flatnonzero(text[first[back]] != text)  # unlike rows of equal hash stand alone
    if len(odd):
        back[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return first, back


def least_owners(context: np.ndarray, bits: np.ndarray, docs: np.ndarray, batch: int = 20_000) -> np.ndarray:
    """Of seeds in their contexts: as bits, at which offsets a smaller document has the same run.

    context: rows of WIDE bytes about the seed and two of how many are real on either side.
    Equal contexts are one class, owned by its least document. Classes whose seed stands in
    other classes too go through the family in batches of ascending documents.
    """
    first, back = _classes(context)
    owner = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(owner, back, docs)
    seed_first, seed = _classes(context[first][:, SIDE : SIDE + SEED])
    shared_seed = np.flatnonzero(np.bincount(seed, minlength=len(seed_first))[seed] > 1)
    found = np.zeros(len(first), np.uint32)
    family = Family()
    order = shared_seed[np.argsort(owner[shared_seed], kind="stable")]
    for a in range(0, len(order), batch):
        some = order[a : a + batch]
        own = bits[first[some]]
        row, offset = np.nonzero(own[:, None] >> _OFFSETS.astype(np.uint32) & np.uint32(1))
        runs = np.lib.stride_tricks.sliding_window_view(context[first[some], :WIDE], LENGTH, axis=1)
        text = np.ascontiguousarray(runs[row, SIDE - offset]).view(f"S{LENGTH}").ravel()
        least = family.add(text, owner[some][row])
        earlier = least < owner[some][row]
        mask = np.bincount(row, weights=np.where(earlier, 2.0**offset, 0.0), minlength=len(some))
        found[some] = mask.astype(np.uint32)
    return np.where(docs > owner[back], bits, found[back])


def _press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(np.ascontiguousarray(x).tobytes())


def _open(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def repeats(documents: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_bytes, spans (start, end), kept: one row for each row.

    Texts are UTF-8 bytes, a null text is empty. spans: the maximal runs of bytes that lie in a
    LENGTH-byte string which also starts in a row with a smaller doc_id; matches never cross
    rows. kept: the other bytes. Rows that share a doc_id do not count for one another; rows
    with a null doc_id count for none and keep all.

    First all anchors' short fingerprints are exchanged, and only those that occur twice go on
    (a chance match costs work, never a result). Their contexts are dealt by the seed; equal
    contexts are one request a pack, so a passage in a third of all texts is one row a pack.
    """
    packed = packs.packs(documents)
    total = packed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // part_bytes))
    finer = parts * 2

    def fingerprints(hashes):
        """Spread again: the least hashes of many are small."""
        return shared.mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))

    def announce(batches):
        for pack, (_, null, data, offsets) in packs.each(batches):
            marks = fingerprints(anchors(data, offsets, null)[1])
            rows = [(part, marks[at].astype(np.uint32).tobytes()) for part, at in packs.by_part(marks, parts)]
            yield pa.record_batch({"pack": pa.array([pack] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int32()), "marks": pa.array([r[1] for r in rows], pa.binary())})

    def twice(key, group):
        marks = [np.frombuffer(x, np.uint32) for x in group["marks"].to_pylist()]
        every = np.concatenate(marks)
        ranked = np.sort(every)
        same = ranked[1:][ranked[1:] == ranked[:-1]]
        same = same[np.concatenate([[True], same[1:] != same[:-1]])] if len(same) else same
        where = np.minimum(np.searchsorted(same, every), max(0, len(same) - 1))
        hit = same[where] == every if len(same) else np.zeros(len(every), bool)
        bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum([len(x) for x in marks])[:-1])]
        return pa.table({"pack": group["pack"], "part": group["part"], "bits": pa.array(bits, pa.binary())})

    announced = packed.select("pack", "ids", "offsets", "text").mapInArrow(announce, "pack long, part int, marks binary")
    flags = announced.groupBy("part").applyInArrow(twice, "pack long, part int, bits binary")

    def flagged(left, right):
        """Of each pack: its anchors that go on, their contexts' classes, and the classes' owners."""
        answer = dict(zip(right["part"].to_pylist(), right["bits"].to_pylist(), strict=True))
        for pack, (ids, null, data, offsets) in packs.each(left.to_batches()):
            at, hashes, lefts, rights, bits = anchors(data, offsets, null)
            marks = fingerprints(hashes)
            go = np.zeros(len(at), bool)
            for part, places in packs.by_part(marks, parts):
                go[places] = np.unpackbits(np.frombuffer(answer[part], np.uint8), count=len(places)).astype(bool)
            go &= bits > 0
            at, marks, lefts, rights, bits = (x[go] for x in (at, marks, lefts, rights, bits))
            doc = ids[np.searchsorted(offsets, at, "right") - 1]
            around = np.zeros(len(data) + 2 * WIDE, np.uint8)
            around[SIDE : SIDE + len(data)] = data
            context = np.lib.stride_tricks.sliding_window_view(around, WIDE)[at]
            context[(np.arange(WIDE) < (SIDE - lefts)[:, None]) | (np.arange(WIDE) >= (SIDE + SEED + rights)[:, None])] = 0
            context = np.concatenate([context, lefts[:, None].astype(np.uint8), rights[:, None].astype(np.uint8)], 1)
            first, back = _classes(context) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            owner = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(owner, back, doc)
            yield pack, at, marks, bits, doc, context, first, back, owner

    def ask(key, left, right):
        out = []
        for pack, _, marks, bits, _, context, first, _, owner in flagged(left, right):
            for part, places in packs.by_part(marks[first], finer):
                rows = first[places]
                out.append((pack, part, _press(context[rows]), _press(bits[rows]), _press(owner[places])))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table({"pack": pa.array(columns[0], pa.int64()), "part": pa.array(columns[1], pa.int32()), "context": pa.array(columns[2], pa.binary()), "bits": pa.array(columns[3], pa.binary()), "owner": pa.array(columns[4], pa.binary())})

    def keep(key, left, right):
        """What a pack does with the replies: places, classes, and what its own texts already tell."""
        out = []
        for pack, at, marks, bits, doc, _, first, back, owner in flagged(left, right):
            out.append((pack, _press(at.astype(np.int64)), _press(np.where(doc > owner[back], bits, 0).astype(np.uint32)), _press(np.stack([back, marks[first][back].view(np.int64)]))))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table({"pack": pa.array(columns[0], pa.int64()), "part": pa.array([-1] * len(out), pa.int32()), "bits": pa.array(columns[2], pa.binary()), "context": pa.array(columns[1], pa.binary()), "owner": pa.array(columns[3], pa.binary())})

    # One plan uses the packs' exchange three times and finds the anchors anew where it needs
    # them, which is cheaper on disk than to keep what is found.
    texts = packed.select("pack", "ids", "offsets", "text")
    asked = texts.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(ask, "pack long, part int, context binary, bits binary, owner binary")
    own = texts.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(keep, "pack long, part int, bits binary, context binary, owner binary")

    def reply(key, group):
        context = [_open(x, np.uint8).reshape(-1, WIDE + 2) for x in group["context"].to_pylist()]
        bits = [_open(x, np.uint32) for x in group["bits"].to_pylist()]
        owner = [_open(x, np.int64) for x in group["owner"].to_pylist()]
        masks = least_owners(np.concatenate(context), np.concatenate(bits), np.concatenate(owner))
        parts_ = [_press(x) for x in np.split(masks, np.cumsum([len(x) for x in bits])[:-1])]
        return pa.table({"pack": group["pack"], "part": group["part"], "bits": pa.array(parts_, pa.binary())})

    replies = asked.groupBy("part").applyInArrow(reply, "pack long, part int, bits binary")
    replies = replies.select("pack", "part", "bits", F.lit(None).cast("binary").alias("context"), F.lit(None).cast("binary").alias("owner")).unionByName(own)
    schema = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"

    def cut(key, left, right):
        rows = right.to_pylist()
        mine = next(x for x in rows if x["part"] < 0)
        at, masks = _open(mine["context"], np.int64), _open(mine["bits"], np.uint32).copy()
        back, marks = _open(mine["owner"], np.int64).reshape(2, -1)
        if len(at):
            count = int(back.max()) + 1
            mark = np.zeros(count, np.int64)
            mark[back] = marks
            found = np.zeros(count, np.uint32)
            answer = {x["part"]: x["bits"] for x in rows if x["part"] >= 0}
            for part, places in packs.by_part(mark.view(np.uint64), finer):
                found[places] = _open(answer[part], np.uint32)
            masks |= found[back]
        out = []
        for _, (ids, null, data, offsets) in packs.each(left.to_batches()):
            edge = np.zeros(len(data) + 1, np.int32)
            for o in _OFFSETS:
                begin = at[(masks >> np.uint32(o) & np.uint32(1)) > 0] - o
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            change = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
            inner = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(data) else inner
            starts = np.sort(np.concatenate([np.flatnonzero(change == 1), inner]))
            ends = np.sort(np.concatenate([np.flatnonzero(change == -1), inner]))
            cuts = np.searchsorted(starts, offsets)
            texts = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            base = np.repeat(offsets[:-1], np.diff(cuts))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x - base, pa.int64())) for x in (starts, ends)]
            out.append(pa.table([pa.array(ids, pa.int64(), mask=null), pa.array(np.diff(offsets)), *lists, pa.array(texts, pa.binary())], names=["doc_id", "n_bytes", "starts", "ends", "kept"]))
        return pa.concat_tables(out)

    done = texts.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(cut, schema)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return done.select("doc_id", "n_bytes", spans.alias("spans"), "kept")


def digests(removed: DataFrame) -> DataFrame:
    """What repeats() returns -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same rule in SQL: every 50-byte string of every text, in hexadecimal digits.
ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM h),
w AS (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
m AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE f.first < w.doc_id),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS n FROM m),
g AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM o),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT r.doc_id, a, b, substring(x, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS piece FROM r JOIN h USING (doc_id)),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS kept FROM k GROUP BY doc_id)
SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id)
"""
