"""Matching blocks of many pairs of token lists at once, as difflib finds them.

Lists are numbers of tokens, concatenated, with offsets: one pair a recording.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The length of the equal runs by which blocks are found at once; a power of two.
SEED = 8
#: Seeds that meet, for each token of a recording, above which it is left to the search by falling length.
MEETINGS = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _chosen(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Of longest equal runs (i, j, n) those that difflib's blocks of `least` tokens or more are, in order of i: the longest run, of
    equals the first in a and then in b, and so on in what is left of the others before it and behind it."""
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    out: list[tuple[int, int, int]] = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n, fits, pieces = -n, True, []
        # Blocks that are chosen go up in a and in b; the run is cut where one of them is beside it, above or below.
        at = bisect_right(out, (i, -1, 0))
        k = at - 1 if at and out[at - 1][0] + out[at - 1][2] > i else at
        while k and out[k - 1][1] + out[k - 1][2] > j:
            k -= 1
        begin = 0
        while k < len(out) and begin < n:
            p, q, m = out[k]
            if p >= i + n and q >= j + n:
                break
            fits = False
            if (end := min(p - i, q - j, n)) - begin >= least:
                pieces.append((begin, end))
            begin = max(begin, p + m - i, q + m - j)
            k += 1
        if fits:
            insort(out, (i, j, n))
            continue
        if n - begin >= least:
            pieces.append((begin, n))
        for begin, end in pieces:
            heapq.heappush(heap, (begin - end, i + begin, j + begin))
    return out


def _seeds(x: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all runs of SEED tokens within a recording, and hashes of those and the recording."""
    h, step = (x.astype(np.uint64) + np.uint64(1)) * _MIX, 1
    h ^= h >> np.uint64(29)
    while step < SEED:
        h = h[:-step] * (_MIX ^ np.uint64(2 * step)) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        step *= 2
    at = np.flatnonzero(np.arange(len(h)) + SEED <= ends[: len(h)])
    h = (h[at] ^ of[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) * _MIX
    return at, h ^ (h >> np.uint64(32))


def blocks(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray, rest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matching blocks (i in x, j in y, n), in order, of each recording r's x[xo[r]:xo[r+1]] and y[yo[r]:yo[r+1]],
    as difflib has them (nothing is junk; neighbours stay apart): the longest block, of equals the first in x and then
    in y, and so on to its left and right.

    Blocks of SEED tokens or more are found for all recordings at once. Where they follow each other in x and in y
    alike, all of them stay, whatever their order; else they are chosen one by one. What is between them, and
    recordings whose seeds meet too often, are left to rest(x, y, below), which knows no equal run of `below` tokens.
    """
    n = len(xo) - 1
    xr, yr = np.repeat(np.arange(n), np.diff(xo)), np.repeat(np.arange(n), np.diff(yo))
    none = np.zeros(0, np.int64)
    i = j = size = none
    many = np.zeros(n, bool)
    if len(x) >= SEED and len(y) >= SEED:
        (xa, xh), (ya, yh) = _seeds(x, xo[1:][xr], xr), _seeds(y, yo[1:][yr], yr)
        order = np.argsort(yh, kind="stable")
        ya, yh = ya[order], yh[order]
        low = np.searchsorted(yh, xh, "left")
        counts = np.searchsorted(yh, xh, "right") - low
        met = np.bincount(xr[xa], counts, n)
        many = met > MEETINGS * (np.diff(xo) + np.diff(yo))
        counts[many[xr[xa]]] = 0
        i = np.repeat(xa, counts)
        j = ya[np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
        same = xr[i] == yr[j]
        for k in range(SEED):
            same &= x[i + k] == y[j + k]
        i, j = i[same], j[same]
        r = xr[i]
        head = (i == xo[r]) | (j == yo[r]) | (x[i - 1] != y[j - 1])
        tail = (i + SEED == xo[r + 1]) | (j + SEED == yo[r + 1])
        tail[~tail] = x[i[~tail] + SEED] != y[j[~tail] + SEED]
        # On a diagonal heads and tails take turns.
        head, tail = (np.flatnonzero(f)[np.lexsort((i[f], j[f] - i[f]))] for f in (head, tail))
        hi, hj, size = i[head], j[head], i[tail] - i[head] + SEED
        order = np.lexsort((hj, hi))
        i, j, size = hi[order], hj[order], size[order]
    r = xr[i]
    crossed = np.zeros(n, bool)
    crossed[r[1:][(r[1:] == r[:-1]) & ((i[:-1] + size[:-1] > i[1:]) | (j[:-1] + size[:-1] > j[1:]))]] = True
    fine = ~crossed[r]
    found = [np.stack([i[fine], j[fine], size[fine]])]
    first = np.searchsorted(r, np.arange(n + 1))
    for k in np.flatnonzero(crossed):
        part = slice(first[k], first[k + 1])
        found.append(np.array(_chosen(list(zip(i[part].tolist(), j[part].tolist(), size[part].tolist(), strict=True)), SEED), np.int64).T)
    for k in np.flatnonzero(many):
        if got := rest(x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]], 1 << 31):
            found.append(np.array(got, np.int64).T + np.array([[xo[k]], [yo[k]], [0]]))
    v = np.concatenate(found, 1)
    i, j, size = v[:, np.argsort(v[0], kind="stable")]
    # What lies between blocks, and before the first and behind the last one of a recording.
    rec = np.concatenate([np.arange(n), xr[i]])
    begin = np.concatenate([xo[:-1], i + size]), np.concatenate([yo[:-1], j + size])
    by = np.lexsort((begin[0], np.append(np.full(n, -1), np.zeros(len(i), np.int64)), rec))
    rec, a0, b0 = rec[by], begin[0][by], begin[1][by]
    last = np.append(rec[1:] != rec[:-1], True)[: len(rec)]
    a1, b1 = xo[rec + 1].copy(), yo[rec + 1].copy()
    inner = np.flatnonzero(~last)
    # The block behind the k-th gap, of all gaps but the recordings' last ones, is the next in order.
    a1[inner], b1[inner] = i, j
    more = []
    for k in np.flatnonzero((a1 > a0) & (b1 > b0) & ~many[rec]):
        more += [(p + a0[k], q + b0[k], m) for p, q, m in rest(x[a0[k] : a1[k]], y[b0[k] : b1[k]], SEED)]
    if more:
        v = np.concatenate([np.stack([i, j, size]), np.array(more, np.int64).T], 1)
        i, j, size = v[:, np.argsort(v[0], kind="stable")]
    return i, j, size


def packed(batches):
    """Rows (media_id, n, text) that follow each other with one medium and n one by one become one row: media_id, n of the first,
    their sizes and their bytes. Nulls are empty texts."""
    for batch in (b for b in batches if b.num_rows):
        n, text = batch.column("n"), batch.column("text").fill_null("").cast(pa.large_string())
        value, gone = np.asarray(n.fill_null(0)), np.asarray(n.is_null())
        opens = np.append(True, changes(batch.column("media_id")) | (value[1:] != value[:-1] + 1) | gone[1:] | gone[:-1])
        at = np.append(np.flatnonzero(opens), len(opens)).astype(np.int64)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        sizes = np.diff(offsets).astype(np.int32)
        cut = lambda places, data: pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), data]).cast(pa.binary())
        heads = pa.array(at[:-1])
        columns = [batch.column("media_id").take(heads), n.take(heads), cut(4 * at, pa.py_buffer(sizes)), cut(offsets[at], text.buffers()[2])]
        yield pa.record_batch(columns, names=["media_id", "n", "sizes", "bytes"])


def unpacked(n: pa.Array, sizes: pa.Array, data: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of packed rows, one after another: each text's row, its n, and the text."""

    def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        held = column.buffers()[2]
        return np.diff(offsets), np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]

    if not len(n):
        return np.zeros(0, np.int64), n, pa.array([], pa.large_string())
    (counts, each), (_, data) = whole(sizes), whole(data)
    counts, each = counts // 4, np.frombuffer(each.tobytes(), np.int32)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    offsets = np.append(0, np.cumsum(each, dtype=np.int64))
    text = pa.Array.from_buffers(pa.large_string(), len(each), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return row, pc.add(n.take(pa.array(row)), pa.array(place, pa.int64())), text


def changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before."""
    values, gone = np.asarray(column.fill_null(0)), np.asarray(column.is_null())
    return (values[1:] != values[:-1]) | (gone[1:] != gone[:-1])
