"""From all detectors' finds to one ordered set of spans that don't overlap, per document array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import fuzzy, spans

# Legal suffixes after a company's name, and the characters that don't belong to a span's ends.
SUFFIX = r"(?i)^[\s,]*(?:Pvt\.?|Private)?[\s,]*(?:Ltd\.?|Limited|Inc\.?|LLC|LLP|Corp\.?|Corporation|Co\.?|Company|GmbH|PLC|Sdn\.?\s*Bhd\.?)(?![a-zA-Z])"
TRIM = r"[ \t\n\r.,;:!?()\[\]{}\"'‘’“”]"
LOOKAHEAD, EXTENSIONS = 24, 2
SIMILAR, BOOST, CAP = 0.85, 0.05, 0.99


def extend_companies(text: Column, entities: Column) -> Column:
    """Company spans grow over up to two legal suffixes that follow them."""

    def end_of(end: Column) -> Column:
        for _ in range(EXTENSIONS):
            end = spans.let(end, lambda e: e + F.length(F.regexp_extract(spans.piece(text, e, e + LOOKAHEAD), SUFFIX, 0)))
        return end

    def grow(e: Column) -> Column:
        longer = spans.let(end_of(e["end"]), lambda end: e.withField("end", end).withField("text", spans.piece(text, e["start"], end)))
        return F.when(e["type"] == "company", longer).otherwise(e)

    return F.transform(entities, grow)


def corroborate(entities: Column) -> Column:
    """Confidence rises where another detector found the same type, overlapping, with nearly the same text."""

    def backed(e: Column, all_: Column) -> Column:
        return F.exists(all_, lambda o: (o["source"] != e["source"]) & (o["type"] == e["type"]) & spans.overlaps(e, o) & (fuzzy.text_similarity(e["text"], o["text"]) >= SIMILAR))

    def raised(all_: Column) -> Column:
        more = lambda e: e.withField("confidence", F.least(F.lit(CAP), e["confidence"] + BOOST))
        return F.transform(all_, lambda e: F.when((e["confidence"] < CAP) & backed(e, all_), more(e)).otherwise(e))

    return spans.let(entities, lambda all_: F.when(F.size(all_) < 2, all_).otherwise(raised(all_)))


def merge(entities: Column) -> Column:
    """Greedy choice of spans that don't overlap.

    The most confident first (then the earlier start, then the earlier find). A later one gives way,
    unless it comes from a detector of fixed formats and every span in its way is of another type and
    lies inside it; those give way then.
    """
    def take(kept: Column, e: Column) -> Column:
        clash = F.filter(kept, lambda k: spans.overlaps(e, k))
        inside = F.forall(clash, lambda k: (k["type"] != e["type"]) & (e["start"] <= k["start"]) & (k["end"] <= e["end"]))
        others = F.filter(kept, lambda k: ~spans.overlaps(e, k))
        accept = (F.size(clash) == 0) | (e["source"].isin(*schema.DETERMINISTIC) & inside)
        return F.when(accept, F.concat(others, F.array(e))).otherwise(kept)

    def chosen(all_: Column) -> Column:
        ranked = F.transform(all_, lambda e: F.struct((-e["confidence"]).alias("c"), e["start"].alias("s"), e["ordinal"].alias("o"), e.alias("e")))
        kept = F.aggregate(F.transform(F.array_sort(ranked), lambda r: r["e"]), F.array().cast(schema.ENTITIES), take)
        by_start = F.transform(kept, lambda e: F.struct(e["start"].alias("s"), e["ordinal"].alias("o"), e.alias("e")))
        return F.transform(F.array_sort(by_start), lambda r: r["e"])

    return spans.let(entities, lambda all_: F.when(F.size(all_) < 2, all_).otherwise(chosen(all_)))


def normalize(entities: Column) -> Column:
    """Punctuation and white space off both ends, confidence to four places; what would vanish stays."""

    def trim(e: Column) -> Column:
        lead = F.length(F.regexp_extract(e["text"], f"^{TRIM}*", 0))
        rest = F.regexp_replace(e["text"], f"^{TRIM}+", "")
        tail = F.length(F.regexp_extract(rest, f"{TRIM}*$", 0))
        kept = e.withField("start", e["start"] + lead).withField("end", e["end"] - tail).withField("text", F.regexp_replace(rest, f"{TRIM}+$", ""))
        return F.when(rest == "", e).otherwise(kept).withField("confidence", F.round(e["confidence"], 4))

    return F.transform(entities, trim)


def resolve(text: Column, entities: Column) -> Column:
    """Extend, corroborate, merge and normalize; entities come out by start and don't overlap."""
    return normalize(merge(corroborate(extend_companies(text, entities))))
