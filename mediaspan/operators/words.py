"""Operators on timed words: fillers, units, phrases, cues and alignment.

Words are rows media_id, idx, start_us, end_us, word. Rules whose state is reset by their own
output run as a fold over one recording's words in order; the fold is a plain function.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.functions import text as T
from mediaspan.operators import align as L
from mediaspan.operators import catalog as C
from mediaspan.operators import runs as R
from mediaspan.operators import spans as S
from mediaspan.sources.scratch import small_batches


def fillers(words: DataFrame, pause_us: int = 350_000, isolated=("é", "né")) -> DataFrame:
    """Words that can go: hesitations (90), isolated tags with a pause on both sides (70), and
    immediate repeats (85); confidence in hundredths. The ends of a recording are pauses."""
    order = Window.partitionBy("media_id").orderBy("idx")
    w = words.withColumn("token", T.token(F.col("word")))
    before = F.coalesce(F.col("start_us") - F.lag("end_us").over(order), F.lit(1 << 60))
    after = F.coalesce(F.lead("start_us").over(order) - F.col("end_us"), F.lit(1 << 60))
    tag = F.col("token").isin(*isolated)
    kind = (
        F.when(F.col("token").isin(*T.HESITATIONS), "hesitation")
        .when(tag & (before >= pause_us) & (after >= pause_us), "isolated")
        .when(~tag & (F.col("token") != "") & (F.col("token") == F.lag("token").over(order)), "repeat")
    )
    confidence = F.element_at(F.create_map(F.lit("hesitation"), F.lit(90), F.lit("isolated"), F.lit(70), F.lit("repeat"), F.lit(85)), F.col("kind"))
    return w.withColumn("kind", kind).where("kind IS NOT NULL").select("media_id", "idx", "start_us", "end_us", "token", "kind", confidence.alias("confidence"))


def breaks(words: DataFrame, gap_us: int) -> DataFrame:
    """Numbers the runs of words without a gap of `gap_us`, in each recording."""
    order = Window.partitionBy("media_id").orderBy("idx")
    new = F.when(F.col("start_us") - F.lag("end_us").over(order) < gap_us, 0).otherwise(1)
    return words.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def linked_runs(words: DataFrame, breaks: Column, keys=("media_id",), chunk: int = 4096) -> DataFrame:
    """words(keys, idx, ...) with `run`: the idx of the first word of each word's run. `breaks`, on the
    word's columns and those of the word before as a struct `prev`, says where a run begins.

    A long recording is many tasks: each chunk of idx is numbered by itself, and takes what the
    chunks before hand over (their last word, their last run) from a table of a row a chunk.
    """
    at = [*keys, "_chunk"]
    own = Window.partitionBy(*at).orderBy("idx")
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    whole = F.struct(*[c for c in words.columns if c not in keys])
    rows = words.withColumn("_chunk", F.floor(F.col("idx") / chunk))
    tails = rows.groupBy(*at).agg(F.max_by(whole, "idx").alias("_tail")).select(*at, F.lag("_tail").over(chunks).alias("_before"))
    rows = rows.join(tails, at).withColumn("prev", F.coalesce(F.lag(whole).over(own), "_before"))
    begins = F.when(F.col("prev").isNull() | F.coalesce(breaks, F.lit(False)), F.col("idx"))
    rows = rows.drop("_before").withColumn("_begin", begins)
    heads = rows.groupBy(*at).agg(F.max("_begin").alias("_last")).select(*at, F.last("_last", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    run = F.coalesce(F.last("_begin", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_carried")
    return rows.join(heads, at).withColumn("run", run).drop("_chunk", "_begin", "_carried")


def selection_units(words: DataFrame, segments: DataFrame | None = None, gap_us: int = 600_000, long_us: int = 8_000_000, short_us: int = 1_200_000) -> DataFrame:
    """words(media_id, idx, start_us, end_us, word[, seg]) -> unit, media_id, first_idx, last_idx, start_us, end_us, n_words.

    A unit ends before a gap, behind a word with which it is long, and behind the end of a sentence
    or clause with which it isn't short. With segments(media_id, seg, start_us, end_us, text), numbered
    without holes, and words that name theirs, a segment without words ends a unit and is one
    itself (n_words 0), and units of hesitations only, or without text, are left out.
    """
    says, seg = F.lit(1), None
    if segments is not None:
        says, seg = T.without_hesitations(F.btrim("word")) != "", F.col("seg")
    begins = lambda now, prev: (now["start_us"] - prev["end_us"] >= gap_us) | (now["part"] - prev["part"] > 1)
    after = lambda n, begun, end, mark: (end - begun >= long_us) | (mark > 0) & (end - begun >= short_us)
    units = R.grouped(words, begins, lambda n, begun, start, end: False, after, mark=F.btrim("word").rlike(r"[.!?…,;:]$"), said=says, part=seg, arrays=True)
    units = units.where("said > 0").select("media_id", "first_idx", "last_idx", "start_us", "end_us", "n_words", F.lit(1).alias("_kind"))
    order = ["start_us", "first_idx"]
    if segments is not None:
        none = F.lit(None).cast("long")
        placed = words.groupBy("media_id", "seg").agg(F.min("idx").alias("_i"))
        silent = segments.join(placed, ["media_id", "seg"], "left_anti").where(T.without_hesitations(F.coalesce("text", F.lit(""))) != "")
        # A unit stands where its first word's segment does: the last one that begins at or before it.
        upto = Window.partitionBy("media_id").orderBy("first_idx").rangeBetween(Window.unboundedPreceding, 0)
        starts = placed.select("media_id", F.col("_i").alias("first_idx"), F.lit(None).cast("long").alias("last_idx"), F.col("seg").alias("_seg"))
        both = units.withColumn("_seg", none).unionByName(starts, allowMissingColumns=True)
        both = both.withColumn("_at", F.max("_seg").over(upto)).where("_kind IS NOT NULL").drop("_seg")
        units = both.unionByName(silent.select("media_id", none.alias("first_idx"), none.alias("last_idx"), "start_us", "end_us", F.lit(0).cast("long").alias("n_words"), F.lit(0).alias("_kind"), F.col("seg").alias("_at")))
        order = ["_at", F.col("first_idx").asc_nulls_first()]
    number = F.row_number().over(Window.partitionBy("media_id").orderBy(*order)) - 1
    return units.select(number.cast("long").alias("unit"), "media_id", "first_idx", "last_idx", "start_us", "end_us", "n_words")


def _phrases(words: DataFrame, keys, gap_us: int, most: int, mark: Column) -> DataFrame:
    begins = lambda now, prev: (prev["mark"] > 0) | (now["start_us"] - prev["end_us"] >= gap_us)
    return R.grouped(words, begins, lambda n, begun, start, end: n >= most, lambda n, begun, end, mark: False, keys, mark, arrays=True)


def phrases(words: DataFrame, keys=("media_id",), gap_us: int = 250_000, most: int = 14, mark: Column | None = None) -> DataFrame:
    """phrase, keys, first_idx, last_idx, start_us, end_us, n_words: broken behind the end of a sentence
    or a comma (or where `mark` says so), at a gap, and at `most` words."""
    out = _phrases(words, keys, gap_us, most, F.btrim("word").rlike(r"[.!?…,]$") if mark is None else mark)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first_idx")) - 1
    return out.select(number.cast("long").alias("phrase"), *keys, "first_idx", "last_idx", "start_us", "end_us", "n_words")


def piece_phrases(words: DataFrame, pieces: DataFrame, bucket_us: int, dealt: bool = False) -> DataFrame:
    """pieces(media_id, clip_id, piece, start_us, end_us) -> the phrases of each piece's words, cut to the
    piece, numbered by clip in order of piece: phrase, media_id, clip_id, piece, and as phrases().

    A phrase never crosses pieces; a word that two pieces hold is in both. Words that are `dealt` by
    medium, each one's in order, meet the pieces where they are and aren't sorted.
    """
    mark = F.btrim("word").rlike(r"[.!?…,]$").alias("mark")
    spans = words.select("media_id", "idx", mark, F.col("start_us").alias("right_start_us"), F.col("end_us").alias("right_end_us"), F.btrim("word").alias("word")).where("word <> ''").drop("word")
    pieces = pieces.select("media_id", "clip_id", "piece", "start_us", "end_us")
    met = S.overlap_join(pieces.hint("shuffle_hash") if dealt else pieces, spans, bucket_us)
    inside = met.select("media_id", "clip_id", "piece", "idx", "mark", F.greatest("start_us", "right_start_us").alias("start_us"), F.least("end_us", "right_end_us").alias("end_us"))
    inside = inside if dealt else inside.sortWithinPartitions("media_id", "clip_id", "piece", "idx")
    found = _phrases(inside, ("media_id", "clip_id", "piece"), 250_000, 14, F.col("mark"))
    number = F.row_number().over(Window.partitionBy("media_id", "clip_id").orderBy("piece", "first_idx")) - 1
    return found.select(number.cast("long").alias("phrase"), "media_id", "clip_id", "piece", "first_idx", "last_idx", "start_us", "end_us", "n_words")


def caption_cues(words: DataFrame, floor_us: int = 50_000, most: int = 5, gap_us: int = 650_000, long_us: int = 3_000_000) -> DataFrame:
    """words(media_id, idx, start_us, end_us, word[, segment]) on the output clock -> cue, media_id, first_idx,
    last_idx, start_us, end_us, n_words: broken at `most` words, at a gap, where the plan's segment
    changes, and before a word with which the cue would be too long. A cue ends where the next
    begins, but `floor_us` behind its own start at least."""
    begins = lambda now, prev: (now["start_us"] - prev["end_us"] > gap_us) | (now["part"] != prev["part"])
    before = lambda n, begun, start, end: (n >= most) | (end - begun > long_us)
    cues = R.grouped(words, begins, before, lambda n, begun, end, mark: False, part=F.col("segment") if "segment" in words.columns else None, arrays=True)
    order = Window.partitionBy("media_id").orderBy("first_idx")
    end = F.greatest(F.col("start_us") + floor_us, F.least("end_us", F.coalesce(F.lead("start_us").over(order), F.col("end_us"))))
    return cues.select((F.row_number().over(order) - 1).cast("long").alias("cue"), "media_id", "first_idx", "last_idx", "start_us", end.alias("end_us"), "n_words")


def kept_ranges(rows: DataFrame, keys, order: str) -> DataFrame:
    """Runs of consecutive `order` numbers within the keys: first, last, start_us, end_us."""
    by = Window.partitionBy(*keys).orderBy(order)
    found = rows.withColumn("_g", F.col(order) - F.row_number().over(by))
    return found.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_g")


def leading_fillers(words: DataFrame, is_filler, most: int = 4, most_us: int = 1_500_000) -> DataFrame:
    """How many fillers open each recording and can go: at most `most` words and `most_us`."""
    order = Window.partitionBy("media_id").orderBy("idx")
    flag = is_filler.cast("int")
    led = F.min(flag).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    place = F.row_number().over(order)
    rows = words.withColumn("_led", led).withColumn("_place", place).withColumn("_first", F.min("start_us").over(Window.partitionBy("media_id")))
    ok = F.col("_led") & (F.col("_place") <= most) & (F.col("end_us") - F.col("_first") <= most_us)
    return rows.groupBy("media_id").agg(F.count_if(ok).alias("trimmed"), F.min(F.when(~F.coalesce(ok, F.lit(False)), F.col("start_us"))).alias("start_us"))


def ngram_first(words: DataFrame, phrases: DataFrame, most: int = 3) -> DataFrame:
    """phrases(phrase_id, tokens: array of 1 to `most`) -> where each first occurs in each recording. The
    phrases are counted, to see whether they can be sent to every task."""
    order = Window.partitionBy("media_id").orderBy("idx")
    vocabulary = phrases.select(F.explode("tokens").alias("token")).distinct().withColumn("_in", F.lit(True))
    # Only words of some phrase pass the shuffle by name.
    w = C.with_dimension(words.select("media_id", "idx", T.token(F.col("word")).alias("token")), vocabulary, "token", "left")
    w = w.select("media_id", "idx", F.when(F.col("_in"), F.col("token")).alias("token"))
    w = w.withColumns({f"_t{i}": F.lead("token", i).over(order) for i in range(1, most)}).where("token IS NOT NULL")
    grams = [F.array("token", *[f"_t{i}" for i in range(1, n)]) for n in range(1, most + 1)]
    rows = w.select("media_id", "idx", F.explode(F.array(*grams)).alias("tokens")).where(~F.exists("tokens", lambda x: x.isNull()))
    return C.with_dimension(rows, phrases, "tokens").groupBy("media_id", "phrase_id").agg(F.min("idx").alias("idx"))


def find_replace(words: DataFrame, pieces: DataFrame, find: str, replacement: str) -> DataFrame:
    """Words inside pieces(media_id, start_us, end_us) that are `find`, whatever their case, with their
    marks kept around the replacement: media_id, idx, word, corrected, n (replaced in the recording)."""
    core = F.btrim("word", F.lit(T.MARKS))
    hit = S.overlap_semi(words.where(F.lower(core) == find.lower()), pieces)
    at = F.instr("word", core)
    new = F.concat(F.substring("word", F.lit(1), at - 1), F.lit(replacement), F.substring("word", at + F.length(core), F.length("word")))
    return hit.select("media_id", "idx", "word", new.alias("corrected"), F.count("*").over(Window.partitionBy("media_id")).alias("n"))


def apply_corrections(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections(media_id, idx, original, corrected) put in place; ok is false where the original differs."""
    met = words.join(corrections, ["media_id", "idx"], "left")
    same = F.col("original").isNull() | (F.col("original") == F.col("word"))
    return met.withColumn("ok", same).withColumn("word", F.when(same, F.coalesce("corrected", "word")).otherwise(F.col("word"))).drop("original", "corrected")


#: Token pairs below which difflib compares two lists, and pairs of equal runs held at once.
PLAIN_PAIRS, MOST_RUNS = 1 << 14, 1 << 22


def _equal_runs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All longest runs (i, j, n) with a[i:i+n] == b[j:j+n] and n >= size, a power of two; None if they are too many."""
    both, step = np.concatenate([a, [-1], b]), 1
    while step < size:
        both = np.unique(both[:-step] * (both.max() + 2) + both[step:] + 1, return_inverse=True)[1]
        step *= 2
    x, y = both[: len(a) - size + 1], both[len(a) + 1 :]
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    counts = high - low
    if (total := int(counts.sum())) > MOST_RUNS:
        return None
    i = np.repeat(np.arange(len(x)), counts)
    j = order[np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    first = np.ones(total, bool)
    first[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    at = np.flatnonzero(first)
    return i[at], j[at], np.diff(at, append=total) + size - 1


def _falling(x: np.ndarray, y: np.ndarray, below: int) -> list[tuple[int, int, int]]:
    """The blocks of two lists without equal runs of `below` tokens: long ones are found among runs of 2^k equal
    tokens, which are few, by falling k; only short stretches between them are left to difflib."""
    a, b, out = x.tolist(), y.tolist(), []
    todo = [(0, len(a), 0, len(b), below // 2, None)]
    while todo:
        alo, ahi, blo, bhi, size, runs = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        if (ahi - alo) * (bhi - blo) <= PLAIN_PAIRS or size == 0:
            out += [(alo + i, blo + j, n) for i, j, n in difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks() if n]
            continue
        if runs is None:
            size = min(size, 1 << (min(ahi - alo, bhi - blo).bit_length() - 1))
            runs = _equal_runs(x[alo:ahi], y[blo:bhi], size)
            if runs is None:
                todo.append((alo, ahi, blo, bhi, 0, None))
                continue
            runs = (runs[0] + alo, runs[1] + blo, runs[2])
        i, j, n = runs
        skip = np.maximum(0, np.maximum(alo - i, blo - j))
        i, j = i + skip, j + skip
        n = np.minimum(n - skip, np.minimum(ahi - i, bhi - j))
        if not (fits := n >= size).any():
            todo.append((alo, ahi, blo, bhi, size // 2, None))
            continue
        i, j, n = i[fits], j[fits], n[fits]
        best = np.flatnonzero(n == n.max())
        k = best[np.lexsort((j[best], i[best]))[0]]
        i0, j0, n0 = int(i[k]), int(j[k]), int(n[k])
        out.append((i0, j0, n0))
        todo += [(alo, i0, blo, j0, size, (i, j, n)), (i0 + n0, ahi, j0 + n0, bhi, size, (i, j, n))]
    return sorted(out)


def matching_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """difflib's matching blocks of two lists (nothing is junk; neighbours stay apart)."""
    ids: dict = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in side], np.int64) for side in (a, b))
    found = L.blocks(x, np.array([0, len(a)]), y, np.array([0, len(b)]), _falling)
    return list(zip(*(c.tolist() for c in found), strict=True))


def _tokens(words: pa.Array) -> np.ndarray:
    """A number for each word, the same where they are alike in lower case and without marks."""
    coded = words.dictionary_encode()
    each, plain = coded.dictionary, pc.string_is_ascii(coded.dictionary)
    low = pc.utf8_trim(pc.ascii_lower(each), characters=T.MARKS)
    if not (ascii := np.asarray(plain)).all():
        others = [t.lower().strip(T.MARKS) for t in each.filter(pc.invert(plain)).to_pylist()]
        low = pc.replace_with_mask(low, pa.array(~ascii), pa.array(others, each.type))
    known = low.dictionary_encode().indices
    return np.asarray(known).astype(np.int64)[np.asarray(coded.indices)]


def _aligned(rows: pa.Table) -> pa.RecordBatch:
    """Beats (side 0) and packed words (side 1; see align.packed) of whole recordings, in order -> media_id, beat, first_idx, last_idx."""
    media, side, n, sizes, data = (rows[c].combine_chunks() for c in ("media_id", "side", "n", "sizes", "bytes"))
    rec, side = np.cumsum(np.append(False, L.changes(media))), np.asarray(side)
    lines, packs = (pa.array(np.flatnonzero(side == k)) for k in (0, 1))
    of, beat, script = rec[lines], n.take(lines), data.take(lines).cast(pa.large_binary()).cast(pa.large_string())
    row, heard, said = L.unpacked(n.take(packs), sizes.take(packs), data.take(packs))
    heard_of, value = rec[packs][row], np.asarray(heard.fill_null(-1))
    if ((heard_of[1:] == heard_of[:-1]) & (value[1:] < value[:-1])).any():
        order = np.lexsort((value, heard_of))
        heard_of, heard, said = heard_of[order], heard.take(pa.array(order)), said.take(pa.array(order))
    # Arrow and Python have the same white space.
    split = pc.utf8_split_whitespace(script.fill_null(""))
    line, tokens = np.repeat(np.arange(len(split)), np.asarray(split.value_lengths())), split.flatten()
    full = np.asarray(pc.not_equal(tokens, ""))
    line, tokens = line[full], tokens.filter(pa.array(full))
    every = _tokens(pa.concat_arrays([tokens, said]))
    x, y, n = every[: len(line)], every[len(line) :], rec[-1] + 1
    i, j, size = L.blocks(x, np.searchsorted(of[line], np.arange(n + 1)), y, np.searchsorted(heard_of, np.arange(n + 1)), _falling)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    # Lines with the same number are one beat.
    same = np.cumsum(np.append(False, (of[1:] != of[:-1]) | L.changes(beat)))[: len(of)]
    met, place = same[line[np.repeat(i, size) + step]], np.repeat(j, size) + step
    first = np.flatnonzero(np.append(True, met[1:] != met[:-1])[: len(met)])
    last = np.append(first[1:], len(met))[: len(first)] - 1
    ends = []
    for at in (first, last):
        spot = np.full(len(of), -1)
        spot[met[at]] = place[at]
        spot = spot[same]
        ends.append(heard.take(pa.array(spot, mask=spot < 0)))
    key = media.take(pa.array(np.searchsorted(rec, of)))
    return pa.record_batch([key.cast(pa.int64()), beat, *ends], names=["media_id", "beat", "first_idx", "last_idx"])


#: Words and lines that are aligned at once.
ALIGNED = 1 << 16


def beat_spans(words: DataFrame, beats: DataFrame) -> DataFrame:
    """Aligns a script's beats(media_id, beat, text) with the words heard: each beat's first and
    last word by the longest matching blocks; null where a beat was not heard. Words that follow each
    other pass the shuffle as one row; a recording's beats and then its words come to one task in order,
    and recordings are aligned many at once."""

    def fold(batches):
        count = lambda batch: batch.num_rows + (pc.sum(pc.binary_length(batch.column("sizes"))).as_py() or 0) // 4
        held, n, most = [], 0, ALIGNED
        for batch in batches:
            held.append(batch)
            n += count(batch)
            if n < most:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            # The last recording may go on.
            at = np.flatnonzero(L.changes(rows["media_id"].chunk(0)))
            if len(at):
                yield _aligned(rows.slice(0, at[-1] + 1))
                rows = rows.slice(at[-1] + 1)
            held = rows.to_batches()
            n = sum(map(count, held))
            most = max(ALIGNED, 2 * n)
        if n:
            yield _aligned(pa.Table.from_batches(held))

    said = words.select("media_id", F.col("idx").cast("long").alias("n"), F.col("word").alias("text"))
    small_batches(words.sparkSession)
    said = said.mapInArrow(L.packed, f"media_id {said.schema['media_id'].dataType.simpleString()}, n long, sizes binary, bytes binary")
    rows = beats.select("media_id", F.lit(0).alias("side"), F.col("beat").cast("long").alias("n"), F.lit(None).cast("binary").alias("sizes"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    rows = rows.unionByName(said.withColumn("side", F.lit(1)))
    rows = rows.repartition("media_id").sortWithinPartitions("media_id", "side", "n")
    return rows.mapInArrow(fold, "media_id long, beat long, first_idx long, last_idx long")
