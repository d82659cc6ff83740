"""Places of matches in a text, and what stands around them. Offsets are code points, spans half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,end:int,text:string>>"
#: What counts as part of a word beside a span.
WORD_CHARACTER = r"[\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, group: int = 0, needs: Column | None = None) -> Column:
    """All leftmost matches that don't overlap, as ``array<struct<start, end, text>>``.

    A split leaves the pieces between the matches, so running sums of lengths give the places. With a
    ``group`` the span is that group's, which must end its match. ``needs`` is a cheap condition
    without which there is no match; texts that fail it, or have no match, aren't taken apart.
    """
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.arrays_zip(whole.alias("m"), values.alias("v")), gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m["m"]).alias("n"), m["v"].alias("v")))
    steps = F.filter(steps, lambda s: s["n"].isNotNull())  # the last piece has no match after it

    def add(acc: Column, s: Column) -> Column:
        end = acc["at"] + s["gap"] + s["n"]
        found = F.struct((end - F.length(s["v"])).alias("start"), end.alias("end"), s["v"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out"))
    none = F.array().cast(MATCHES)
    there = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(there, F.aggregate(steps, start, add, lambda acc: acc["out"])).otherwise(none)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a character; spans that only touch don't."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def piece(text: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end``."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def context_window(text: Column, start: Column, end: Column, radius: int = 40) -> Column:
    """The span with ``radius`` characters on either side, in lower case."""
    return F.lower(piece(text, F.greatest(start - radius, F.lit(0)), end + radius))


def preceding_word(text: Column, start: Column, lookback: int = 20) -> Column:
    """The word of ASCII letters right before a place, white space between, or an empty string."""
    return F.regexp_extract(piece(text, F.greatest(start - lookback, F.lit(0)), start), r"([A-Za-z]+)\s*$", 1)


def word_safe(text: Column, start: Column, end: Column) -> Column:
    """Whether a span is inside the text, not empty, and doesn't cut a word at either end."""
    inside = (start >= 0) & (end <= F.length(text)) & (start < end)
    before = F.when(start > 0, piece(text, start - 1, start)).otherwise(F.lit(""))
    return inside & ~before.rlike(WORD_CHARACTER) & ~piece(text, end, end + 1).rlike(WORD_CHARACTER)
