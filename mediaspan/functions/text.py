"""Column functions on words and phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks around tokens, hesitations, and letters with accents and without.
MARKS = ".,;:!?…\"'()[]{}<>*#%$&|-“”‘’–—"
HESITATIONS = ("eh", "ah", "ãh", "ã", "hum", "hã", "uhm", "uh", "hmm", "hmmm", "ahn")
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"


def token(word: Column) -> Column:
    """Without the marks around it, in lower case."""
    return F.lower(F.btrim(word, F.lit(MARKS)))


def word_key(text: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def phrase(text: Column) -> Column:
    """Marks as spaces, runs of space as one."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_ ]", " "), " +", " "))


def plain(word: Column) -> Column:
    """ASCII letters and digits only, accents taken off, in lower case."""
    return F.regexp_replace(F.lower(F.translate(word, ACCENTED, PLAIN)), "[^a-z0-9]", "")


def sentence_end(word: Column) -> Column:
    return word.rlike(r"[.!?…]$")


def clause_end(word: Column) -> Column:
    return word.rlike(r"[,;:]$")


def without_hesitations(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?i)(^|[^\p{L}])(" + "|".join(HESITATIONS) + r")(?![\p{L}])", "$1"), " +", " "))


def js_number(value: Column) -> Column:
    """A number as a browser prints it: no point for whole numbers, exponents outside 1e-7..1e21."""
    text = value.cast("double").cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
    exponential = F.concat(mantissa, F.lit("e"), F.when(exponent.startswith("-"), exponent).otherwise(F.concat(F.lit("+"), exponent)))
    digits = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", "")
    size = F.abs(value.cast("double"))
    return F.when(value == 0, "0").when((size >= 1e21) | (size < 1e-6), exponential).otherwise(digits)


def clip_key(rank: Column, start: Column, end: Column, pacing: Column) -> Column:
    return F.concat_ws(":", rank.cast("string"), js_number(start), js_number(end), pacing)


def video_id(url: Column) -> Column:
    """The eleven characters that name a video in its address, null if there are none."""
    found = F.regexp_extract(url, r"^https?://(?:www\.|m\.)?(?:youtu\.be/|youtube\.com/(?:watch\?(?:[^#]*&)?v=|live/|shorts/|embed/))([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.nullif(found, F.lit(""))


def paragraphs(text: Column) -> Column:
    """What stands between blank lines, its white space squeezed, without empty ones."""
    parts = F.split(text, r"\n[ \t\r\f\x0B]*\n")
    squeezed = F.transform(parts, lambda p: F.btrim(F.regexp_replace(p, r"[ \t\r\n\f\x0B]+", " ")))
    return F.filter(squeezed, lambda p: p != "")


def timestamp(us: Column, comma: str = ",") -> Column:
    """hh:mm:ss,mmm of microseconds."""
    ms = F.floor(us / 1000)
    return F.format_string(f"%02d:%02d:%02d{comma}%03d", F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000 % 60).cast("long"), F.floor(ms / 1000 % 60).cast("long"), (ms % 1000).cast("long"))


def headline(text: Column, most: int = 120) -> Column:
    """Lines squeezed, blank ones dropped, cut to `most` characters, null if empty."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    return F.nullif(F.substring(F.array_join(lines, "\n"), 1, most), F.lit(""))
