"""Personal data: four patterns, and a skip-chain conditional random field that labels what is
like a found item elsewhere in its document."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.llm import shared

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: none, then the kinds.
LABELS = 1 + len(KINDS)
SHAPES = 256  # shapes of candidates that are told apart, for each pattern that finds them
MAIL_SHAPES = 176  # the first of those of mail names; numbers have the ones before
SURE = 0.9  # least marginal at which the field adds a span
ALIKE = 200  # pairs of likes with one label that are taken as seen before any are counted

# The contract's patterns, written so that each is linear in the text. A digit run
# that fails as an address's first part fails at each of its later digits too.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser: mail names before a host without a dot, or before "at" and "dot" in words or brackets.
_NAME = re.compile(r"[A-Za-z0-9._%+-]++")
_MAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++"
    r"|\x20?[(\[]\x20?(?i:at)\x20?[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20(?i:dot)\x20|\x20?[(\[]\x20?(?i:dot)\x20?[)\]]\x20?)[A-Za-z0-9-]++)*"
    r"|\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)+)"
)
#: Looser: any run of digits with at most two marks between them.
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int("0246813579"[int(x)]) for x in even)) % 10 == 0


def _emails(text: str):
    """Matches of local part, @ and dotted domain, leftmost first: an @ with a domain behind it
    takes all local characters before it, back to the match before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the patterns' matches: those that hold, and those that fail their test."""
    good, failed = [], []
    good += [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        (good if all(map(_small, m.group().split("."))) else failed).append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19:
            (good if luhn(digits) else failed).append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        n = len(_DIGITS.sub("", m.group()))
        (good if 9 <= n <= 15 else failed).append((m.start(), 3, m.end()))
    return sorted(good), failed


class Nodes:
    """The candidates of a document in order: places, base label (0: none), shape and key."""

    def __init__(self, text: str):
        self.base, failed = base(text)
        taken = sorted((s, e) for s, _, e in self.base)
        starts = np.array([s for s, _ in taken], np.int64)
        reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
        rows = [(s, e, 1 + kind, kind) for s, kind, e in self.base]
        loose = [(s, e, 4 if kind == 2 else kind) for s, kind, e in failed]
        loose += [(m.start(), m.end(), 4) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7]
        if any(kind == 0 for _, kind, _ in self.base):  # without a found name none can be alike
            loose += [(m.start(), m.end(), 0) for m in _MAIL.finditer(text)]
        for s, e, kind in set(loose):
            i = int(np.searchsorted(starts, e)) - 1
            if i < 0 or reach[i] <= s:
                rows.append((s, e, 0, kind))
        rows.sort()
        self.start, self.end = [r[0] for r in rows], [r[1] for r in rows]
        self.label = np.array([r[2] for r in rows], np.int64)
        self.shape = np.array([self._shape(text[s:e], kind) for s, e, _, kind in rows], np.int64)
        # Alike are numbers that end in the same seven digits, and addresses of the same name.
        self.key = [(True, _NAME.match(text, s).group().lower()) if kind == 0 else (False, _DIGITS.sub("", text[s:e])[-7:]) for s, e, _, kind in rows]

    @staticmethod
    def _shape(piece: str, kind: int) -> int:
        if kind == 0:  # of the name alone, so that mail found and mail written otherwise have one shape
            name = _NAME.match(piece).group()
            return MAIL_SHAPES + 4 * min(len(name) // 4, 7) + 2 * any(map(str.isdigit, name)) + any(c in name for c in "._%+-")
        digits = _DIGITS.sub("", piece)
        marks = sum(c in piece for c in "+(.-") + 4 * (" " in piece)
        return min(len(digits), 20) * 8 + min(marks, 7) + 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of neighbours, and pairs of each candidate with the last and the first one alike."""
        n = len(self.label)
        chain = np.stack([np.arange(n - 1), np.arange(1, n)], 1) if n > 1 else np.zeros((0, 2), np.int64)
        first, last, skip = {}, {}, []
        for i, key in enumerate(self.key):
            if key in last:
                skip += [(j, i) for j in {first[key], last[key]}]
            first.setdefault(key, i)
            last[key] = i
        return chain, np.array(skip, np.int64).reshape(-1, 2)


def _rows(column: pa.Array):
    """(row, text) of the rows with a digit or an @: others hold no candidate."""
    data, offsets = shared.buffer(column)
    hint = ((data >= 48) & (data <= 57)) | (data == 64)
    before = np.concatenate([[0], np.cumsum(hint)])
    for i in np.flatnonzero(before[offsets[1:]] > before[offsets[:-1]]):
        yield int(i), data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")


def learn(documents: DataFrame) -> dict[str, np.ndarray]:
    """Potentials from counts over all documents: labels by shape, and pairs of labels that meet
    as neighbours and as likes. Of likes, a found item and one that no pattern finds count for
    nothing: they are what the field is asked about. At most SHAPES * LABELS + 2 * LABELS^2
    numbers reach the driver."""

    def count(batches):
        for x in batches:
            seen: Counter = Counter()
            for _, text in _rows(x.column(0)):
                nodes = Nodes(text)
                seen.update(("shape", int(s), int(y)) for s, y in zip(nodes.shape, nodes.label, strict=True))
                for name, pairs in zip(("chain", "skip"), nodes.links(), strict=True):
                    labels = ((int(nodes.label[a]), int(nodes.label[b])) for a, b in pairs)
                    seen.update((name, a, b) for a, b in labels if name == "chain" or (a > 0) == (b > 0))
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))], names=["what", "a", "b", "n"])

    found = documents.select("text").mapInArrow(count, "what string, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    shape = np.full((SHAPES, LABELS), 0.5)
    pairs = {"chain": np.full((LABELS, LABELS), 1.0), "skip": np.full((LABELS, LABELS), 1.0) + ALIKE * np.eye(LABELS)}
    for r in found:
        if r["what"] == "shape":
            shape[r["a"], r["b"]] += r["n"]
        else:
            pairs[r["what"]][r["a"], r["b"]] += r["n"]
            pairs[r["what"]][r["b"], r["a"]] += r["n"]
    out = {"shape": np.log(shape / shape.sum(1, keepdims=True))}
    for name, n in pairs.items():
        one = n.sum(1) / n.sum()
        out[name] = np.log(n / n.sum()) - np.log(one)[:, None] - np.log(one)[None]
    return out


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Loopy sum-product over a document's candidates; edges (i, j) with a symmetric table each."""
    n = len(unary)
    both = np.concatenate([edges, edges[:, ::-1]])
    table = np.concatenate([potentials, potentials])
    twin = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(both), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, both[:, 1], message)
        out = belief[both[:, 0]] - message[twin]
        spread = out[:, :, None] + table
        top = spread.max(1, keepdims=True)
        fresh = np.log(np.exp(spread - top).sum(1)) + top[:, 0]
        fresh -= fresh.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * fresh
    belief = unary.copy()
    np.add.at(belief, both[:, 1], message)
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True) if n else belief


def added(nodes: Nodes, weights: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """The spans that the field adds to the base ones: each is like a found one, and none overlaps another."""
    if not (nodes.label == 0).any() or not (nodes.label > 0).any():
        return []
    chain, skip = nodes.links()
    unary = weights["shape"][nodes.shape].copy()
    held = nodes.label > 0  # what the patterns have found stays
    unary[held] = -50.0
    unary[held, nodes.label[held]] = 0.0
    edges = np.concatenate([chain, skip])
    tables = np.concatenate([np.repeat(weights["chain"][None], len(chain), 0), np.repeat(weights["skip"][None], len(skip), 0)])
    p = marginals(unary, edges, tables)
    best = p[:, 1:].argmax(1)
    known = {k for k, y in zip(nodes.key, nodes.label, strict=True) if y}
    like = np.array([k in known for k in nodes.key])
    found = []
    free = 0
    for i in np.flatnonzero((nodes.label == 0) & like & (p[:, 1:].max(1) >= SURE)):
        if nodes.start[i] >= free:
            found.append((nodes.start[i], int(best[i]), nodes.end[i]))
            free = nodes.end[i]
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by", pa.string())])


def find(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, spans (kind, start, end, by): one row for each row.

    Places are code points, ends exclusive; by is "pattern" or "field". Spans stand by start,
    then kind as in KINDS. A null or empty text has no spans; rows with a null or repeated id
    are each answered. Texts are searched whole, in time linear in their length.
    """
    shared.small_batches(documents.sparkSession)
    weights = documents.sparkSession.sparkContext.broadcast(learn(documents))

    def search(batches):
        for x in batches:
            spans: list = [[] for _ in range(x.num_rows)]
            for i, text in _rows(x.column(1)):
                nodes = Nodes(text)
                if len(nodes.label):
                    every = [(s, k, e, "pattern") for s, k, e in nodes.base] + [(*a, "field") for a in added(nodes, weights.value)]
                    spans[i] = [{"kind": KINDS[k], "start": s, "end": e, "by": by} for s, k, e, by in sorted(every)]
            yield pa.record_batch([x.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(search, "doc_id long, spans array<struct<kind: string, start: long, end: long, by: string>>")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """What find() returns -> counts by kind, a hash of the patterns' spans, and all spans as text."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["by"] == "pattern")
    counts = [F.size(F.filter(own, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(own), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
