"""Groups of consecutive rows whose rules are reset by breaks, with few rows in a shuffle.

Rows are words: keys, idx (once in a recording), start_us, end_us. A run is what lies between two
breaks, and a break is seen from a word and the one before it. Where a task's rows hold a word's
neighbour (idx one less, in the row before), the break is certain, so a run between two such breaks
is grouped where it is read. Only words of other runs go on: to tasks by stretches of idx, and
what these leave, to one task a recording, row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.sources.scratch import kept

#: Words of an open run that a task holds before it hands them on.
LONG_RUN = 1 << 16
#: Runs below which a step of all of them takes longer than their rows one by one.
FEW_RUNS = 8
#: A group, or (n_words 0) a word that is to go on; `known` says that the word begins a run.
STATE = ("first_idx", "last_idx", "start_us", "end_us", "n_words", "said", "mark", "part", "known")


def _columns(batch: pa.RecordBatch) -> dict:
    def values(c):
        return c.to_numpy() if pa.types.is_integer(c.type) and not c.null_count else np.array([*c.to_pylist(), None], object)[:-1]

    return {n: values(c) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _table(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _flags(values, n: int) -> np.ndarray:
    return np.broadcast_to(np.asarray(values, bool), n)


class _Groups:
    """The groups of rows that come in order: one begins where `opens` says so, where before(n, begun,
    start, end) of the group so far and the row holds, and behind a row for which after(n, begun, end, mark)
    holds; with `arrays` both take arrays too."""

    def __init__(self, keys, before, after, arrays: bool = False):
        self.keys, self.before, self.after, self.group, self.closed = keys, before, after, None, True
        self.few = FEW_RUNS if arrays else float("inf")

    def add(self, x: dict, rows: np.ndarray, opens: np.ndarray) -> list:
        idx, start, end, mark, said = (x[c][rows].tolist() for c in ("first_idx", "start_us", "end_us", "mark", "said"))
        key, out, k, group, closed = [x[c][rows].tolist() for c in self.keys], [], len(self.keys), self.group, self.closed
        for i, new in enumerate(opens[rows].tolist()):
            if closed or new or self.before(group[k + 4], group[k + 2], start[i], end[i]):
                if group is not None:
                    out.append(group)
                group = [*(c[i] for c in key), idx[i], 0, start[i], 0, 0, 0, 0, 0, 0]
            group[k + 1], group[k + 3] = idx[i], end[i]
            group[k + 4] += 1
            group[k + 5] += said[i]
            closed = self.after(group[k + 4], group[k + 2], end[i], mark[i])
        self.group, self.closed = group, closed
        return out

    def whole(self, x: dict, rows: np.ndarray, opens: np.ndarray) -> list:
        """The columns of the groups of whole runs, of which each begins where `opens` says so. With `arrays` all runs
        go on by one row at once, the longest first, and the last few of them row by row."""
        start, end, mark, said, idx = (x[c][rows] for c in ("start_us", "end_us", "mark", "said", "first_idx"))
        new, heads = opens[rows].copy(), np.flatnonzero(opens[rows])
        sizes = np.diff(heads, append=len(rows))
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = heads[order], sizes[order]
        n, begun, closed, step = np.ones(len(heads), np.int64), start[heads], None, 0
        while (k := int(np.searchsorted(-sizes, -step))) >= self.few:
            at = heads[:k] + step
            n, begun = n[:k], begun[:k]
            if step:
                cut = _flags(closed[:k] | _flags(self.before(n, begun, start[at], end[at]), k), k)
                new[at] = cut
                n, begun = np.where(cut, 1, n + 1), np.where(cut, start[at], begun)
            closed = _flags(self.after(n, begun, end[at], mark[at]), k)
            step += 1
        for head, size, n, begun, shut in zip(*(v[:k].tolist() for v in (heads, sizes, n, begun, np.ones(k, bool) if closed is None else closed)), strict=True):
            a, b, m = (v[head : head + size].tolist() for v in (start, end, mark))
            for i in range(step, size):
                if shut or self.before(n, begun, a[i], b[i]):
                    new[head + i], n, begun = True, 0, a[i]
                n += 1
                shut = self.after(n, begun, b[i], m[i])
        first = np.flatnonzero(new)
        last, none = np.append(first[1:], len(rows)) - 1, np.zeros(len(first), np.int64)
        return [*(x[c][rows][first] for c in self.keys), idx[first], idx[last], start[first], end[last], last - first + 1, np.add.reduceat(said, first), none, none, none]

    def rest(self) -> list:
        out, self.group, self.closed = [] if self.group is None else [self.group], None, True
        return out


def _parts(batches):
    """Of each batch: its finished groups, its schema, and the columns of its words."""
    for batch in batches:
        x = _columns(batch)
        done = x["n_words"] > 0
        yield batch.filter(pa.array(done)) if done.any() else None, batch.schema, {n: v[~done] for n, v in x.items()}


def _same(x: dict, keys) -> np.ndarray:
    """Whether each row but the first has the keys of the one before."""
    return np.logical_and.reduce([np.ones(len(x["known"]) - 1, bool), *(np.asarray(x[k][1:] == x[k][:-1], bool) for k in keys)])


def _sides(x: dict) -> tuple[dict, dict]:
    return {c: v[1:] for c, v in x.items()}, {c: v[:-1] for c, v in x.items()}


def _local(keys, begins, before, after, chunk: int | None, arrays: bool = False):
    """Groups the runs that are whole in a task's rows. Neighbours are rows with idx one apart, or, if
    the rows are sorted by key and stretches of `chunk`, the rows of a stretch."""

    def fold(batches):
        held, skip, schema, groups = None, 0, None, _Groups(keys, before, after, arrays)
        for done, schema, x in _parts(batches):  # noqa: B007
            if done is not None:
                yield done
            carried = held is not None
            if carried:
                x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
            n = len(x["known"])
            if not n:
                continue
            now, prev = _sides(x)
            near = now["first_idx"] == prev["first_idx"] + 1 if chunk is None else now["first_idx"] // chunk == prev["first_idx"] // chunk
            same = _same(x, keys) & near
            known, cut = x["known"] > 0, np.concatenate([[not carried], ~same])
            known[1:] |= same & begins(now, prev)
            starts = np.flatnonzero(np.concatenate([[True], (known | cut)[1:]]))
            sizes = np.diff(starts, append=n)
            # Whole: the first word is known to begin the run, and the next run's to be its neighbour. The last run is still open.
            whole = known[starts] & np.append(~cut[starts[1:]], False)
            first = np.zeros(n, bool)
            first[starts] = known[starts]
            x["known"] = first.astype(np.int64)
            open_at, rows, on = starts[-1], np.flatnonzero(np.repeat(whole, sizes)), np.repeat(~whole, sizes)
            on[open_at:] = on[:skip] = False
            if len(rows):
                yield _table(schema, groups.whole(x, rows, first))
            if on.any():
                yield _table(schema, [x[c][on] for c in schema.names])
            skip = skip if open_at == 0 else 0
            held = {c: v[open_at:] for c, v in x.items()}
            if n - open_at > LONG_RUN:
                yield _table(schema, [held[c][skip:] for c in schema.names])
                held, skip = {c: v[-1:] for c, v in held.items()} | {"known": np.zeros(1, np.int64)}, 1
        if held is not None and len(held["known"]) > skip:
            yield _table(schema, [held[c][skip:] for c in schema.names])

    return fold


def _final(keys, begins, before, after):
    """Groups rows that are sorted by key and idx: each key's words are all there, or in finished groups."""

    def fold(batches):
        held, schema, groups = None, None, _Groups(keys, before, after)
        for done, schema, x in _parts(batches):  # noqa: B007
            if done is not None:
                yield done
            carried = held is not None
            if carried:
                x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
            if len(x["known"]) <= carried:
                continue
            now, prev = _sides(x)
            same = _same(x, keys)
            opens = np.concatenate([[True], ~same | (now["known"] > 0) | begins(now, prev)])
            if found := groups.add(x, np.arange(int(carried), len(opens)), opens):
                yield _table(schema, zip(*found, strict=True))
            held = {c: v[-1:] for c, v in x.items()}
        if found := groups.rest():
            yield _table(schema, zip(*found, strict=True))

    return fold


def grouped(rows: DataFrame, begins, before, after, keys=("media_id",), mark: Column | None = None, said: Column | None = None, part: Column | None = None, chunk: int = 4096, arrays: bool = False) -> DataFrame:
    """rows(keys, idx, start_us, end_us) -> keys, first_idx, last_idx, start_us, end_us, n_words, said (its sum).

    begins(now, prev), on arrays of rows and of the rows before with start_us, end_us, mark and part,
    says where a run begins; before and after cut it into groups (see _Groups), all runs of a batch at once where
    they take `arrays`. What the first pass
    finds is written to the shared folder.
    """
    flag = lambda c: F.coalesce(F.lit(0) if c is None else c.cast("long"), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    values = {"first_idx": F.col("idx").cast("long"), "last_idx": F.col("idx").cast("long"), "start_us": F.col("start_us").cast("long"), "end_us": F.col("end_us").cast("long"), "n_words": zero, "said": flag(said), "mark": flag(mark), "part": flag(part), "known": zero}
    given = rows.select(*keys, *[v.alias(n) for n, v in values.items()])
    columns = given.columns
    first = kept(given.mapInArrow(_local(keys, begins, before, after, None, arrays), given.schema))
    left = first.where("n_words = 0").repartition(*keys, F.floor(F.col("first_idx") / chunk)).sortWithinPartitions(*keys, "first_idx")
    left = left.mapInArrow(_local(keys, begins, before, after, chunk, arrays), given.schema)
    left = left.repartition(*keys).sortWithinPartitions(*keys, "first_idx").mapInArrow(_final(keys, begins, before, after), given.schema)
    return first.where("n_words > 0").unionByName(left).select(*columns[: len(keys)], *STATE[:6])
