"""Replacing approved spans: strategies, planning, rewriting, and what is kept about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import spans

PLAN = "array<struct<entity_id:string,type:string,start:int,end:int,original:string,replacement:string,source:string,confidence:double>>"
# The layouts in which a birth date is read, and the texts that stand for what was there.
DATE_LAYOUTS = ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy")


def clean(value: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def mask(kind: Column) -> Column:
    return F.concat(F.lit("[REDACTED-"), F.upper(kind), F.lit("]"))


def age(birth: Column, as_of: Column) -> Column:
    """Full years, at least 0."""
    before = F.date_format(as_of, "MMdd") < F.date_format(birth, "MMdd")
    return F.greatest(F.year(as_of) - F.year(birth) - before.cast("int"), F.lit(0))


def generalize(kind: Column, value: Column, as_of: Column | None = None) -> Column:
    """Less precise instead of gone: decades of age, the address after the street, the last four digits of
    a phone, the first half of an IPv4 address; everything else is masked."""
    today = as_of if as_of is not None else F.current_date()
    birth = F.coalesce(*[F.try_to_date(F.trim(value), layout) for layout in DATE_LAYOUTS])
    decade = (F.floor(age(birth, today) / 10) * 10).cast("int")
    dob = F.when(birth.isNotNull(), F.format_string("[AGE %d-%d]", decade, decade + 9)).otherwise(F.lit("[REDACTED-DOB]"))
    parts = F.transform(F.split(value, ",", -1), lambda p: F.trim(p))
    street = F.when(F.size(parts) >= 2, F.concat(F.lit("[REDACTED STREET], "), F.array_join(F.slice(parts, 2, 1_000_000), ", "))).otherwise(F.lit("[REDACTED-ADDRESS]"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    phone = F.when(F.length(digits) >= 4, F.concat(F.lit("[PHONE ENDING "), F.right(digits, F.lit(4)), F.lit("]"))).otherwise(F.lit("[REDACTED-PHONE]"))
    octets = F.split(value, r"\.", -1)
    quad = (kind == "ip_address") & (F.size(octets) == 4)
    net = F.concat(F.get(octets, 0), F.lit("."), F.get(octets, 1), F.lit(".x.x"))
    return F.when(kind == "dob", dob).when(kind == "address", street).when(kind == "phone", phone).when(quad, net).otherwise(mask(kind))


def replacement(strategy: Column, kind: Column, value: Column, pseudonym: Column | None = None, as_of: Column | None = None) -> Column:
    """The text for a span. Unknown and missing strategies mask; so does black_box, in texts."""
    fake = pseudonym if pseudonym is not None else mask(kind)
    return F.when(strategy == "generalize", generalize(kind, value, as_of)).when(strategy == "pseudonymize", fake).otherwise(mask(kind))


def in_order(approved: Column) -> Column:
    """Spans by start, the longer first, then by id."""
    keyed = F.transform(approved, lambda e: F.struct(e["start"].alias("s"), (-(e["end"] - e["start"])).alias("l"), e["entity_id"].alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda r: r["e"])


def plan(text: Column, approved: Column, black_box_as_empty: bool = False) -> Column:
    """The replacements of one document, in order, from ``array<struct<entity_id, type, start, end, text,
    strategy, replacement, source, confidence>>``.

    Spans come by start, the longer first, then by id. One that overlaps a planned one is left out, as is
    one that cuts a word; that doesn't keep others out. The first replacement of a value of a type holds
    for all its places in the document. With ``black_box_as_empty`` black boxes leave an empty text and
    are ``[BLACK-BOX]`` in the map.
    """
    def add(planned: Column, e: Column) -> Column:
        original = clean(e["text"])
        box = (e["strategy"] == "black_box") if black_box_as_empty else F.lit(False)
        known = F.filter(planned, lambda p: (p["type"] == e["type"]) & (p["original"] == original))
        text_for = F.coalesce(F.get(known, 0)["replacement"], F.when(box, F.lit("[BLACK-BOX]")).otherwise(e["replacement"]))
        row = F.struct(e["entity_id"].alias("entity_id"), e["type"].alias("type"), e["start"].alias("start"), e["end"].alias("end"), original.alias("original"), text_for.alias("replacement"), e["source"].alias("source"), e["confidence"].alias("confidence"))
        free = ~F.exists(planned, lambda p: spans.overlaps(e, p)) & spans.word_safe(text, e["start"], e["end"])
        return F.when(free, F.concat(planned, F.array(row))).otherwise(planned)

    return F.aggregate(in_order(approved), F.array().cast(PLAN), add)


def rewrite(text: Column, planned: Column, black_box: str | None = None) -> Column:
    """The text with the planned spans replaced; pieces between them stay. ``black_box`` is what the map's
    ``[BLACK-BOX]`` becomes in the text, if not itself."""
    def part(p: Column, i: Column) -> Column:
        new = p["replacement"] if black_box is None else F.when(p["replacement"] == "[BLACK-BOX]", F.lit(black_box)).otherwise(p["replacement"])
        before = F.coalesce(F.get(planned, i - 1)["end"], F.lit(0))
        return F.concat(spans.piece(text, before, p["start"]), new)

    tail = spans.piece(text, F.element_at(planned, -1)["end"], F.length(text))
    return F.when(F.size(planned) == 0, text).otherwise(F.concat(F.array_join(F.transform(planned, part), ""), tail))


def redact(docs: DataFrame, approved: str = "approved", text: str = "text", black_box_as_empty: bool = False) -> DataFrame:
    """``docs`` with ``plan`` and ``redacted``, which replace columns of these names.

    A null text stays null. Mappings never leave a row: equal rows are documents of their own.
    """
    planned = docs.withColumn("plan", plan(F.coalesce(F.col(text), F.lit("")), F.col(approved), black_box_as_empty))
    return planned.withColumn("redacted", rewrite(F.col(text), F.col("plan"), "" if black_box_as_empty else None))


def strategy_of(kind: Column, policy: dict[str, str]) -> Column:
    """A policy's strategy for a type; what it doesn't name is masked."""
    out = F.lit("mask")
    for k, s in policy.items():
        out = F.when(kind == k, F.lit(s)).otherwise(out)
    return out


def audit_log(redacted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each replaced entity."""
    return redacted.select(F.col(doc_id).alias("doc_id"), F.inline("plan")).withColumnRenamed("type", "pii_type")


def replacement_map(redacted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Each document's different originals and what stands for them, by type, then original in any case.

    Sorted within the row; rows that share an id are documents of their own. No shuffle.
    """
    entry = lambda p: F.struct(p["type"].alias("pii_type"), F.lower(p["original"]).alias("sort"), p["original"].alias("original"), p["replacement"].alias("replacement"))
    own = F.array_sort(F.array_distinct(F.transform("plan", entry)))
    return redacted.select(F.col(doc_id).alias("doc_id"), F.inline(own)).drop("sort")


def summary(detected: DataFrame, redacted: DataFrame) -> DataFrame:
    """``pii_type, candidates, redacted``: how many spans of a type were found and how many were replaced."""
    found = detected.groupBy(F.col("type").alias("pii_type")).agg(F.count("*").alias("candidates"))
    both = found.join(counts(redacted), "pii_type", "full")
    return both.select("pii_type", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("n", F.lit(0)).alias("redacted"))


def counts(redacted: DataFrame) -> DataFrame:
    """How many spans of each type were replaced."""
    return redacted.select(F.explode("plan").alias("p")).groupBy(F.col("p.type").alias("pii_type")).agg(F.count("*").alias("n"))


def rollup(redacted: DataFrame) -> DataFrame:
    """``counts`` and, as type ``total``, their sum, in one pass."""
    types = redacted.select(F.explode("plan").alias("p")).select(F.col("p.type").alias("pii_type"))
    per = types.rollup("pii_type").agg(F.count("*").alias("n"), F.grouping("pii_type").alias("g"))
    return per.select(F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("pii_type")).alias("pii_type"), "n")


def merged_counts(*tables: DataFrame) -> DataFrame:
    """Counts by type from texts, images and whatever else, added up."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("pii_type").agg(F.sum("n").alias("n"))


def text_report(totals: DataFrame) -> DataFrame:
    """Lines of a report over ``counts``: types padded to 14 characters, then the total."""
    lines = totals.select(F.lit(0).alias("part"), "pii_type", F.concat(F.rpad("pii_type", 14, " "), F.lit(" "), F.col("n").cast("string")).alias("line"))
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(1).alias("part"), F.lit("total").alias("pii_type"), F.concat(F.rpad(F.lit("total"), 14, " "), F.lit(" "), F.col("n").cast("string")).alias("line"))
    order = Window.orderBy("part", "pii_type")  # ten lines at most
    return lines.unionByName(whole).select(F.row_number().over(order).alias("line_no"), "line")


def display_mask(value: Column) -> Column:
    """For display: first and last character with at most eight dots between; short values are dots only."""
    n = F.length(value)
    return F.when(n <= 2, F.lit("••")).otherwise(F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("•"), F.least(n - 2, F.lit(8))), F.right(value, F.lit(1))))


def box_plan(entities: DataFrame, words: DataFrame, padding: float = 0.0) -> DataFrame:
    """Boxes to cover: every word that a planned span overlaps, the replacement on the first of a span only.

    ``words``: ``doc_id, start, end, page, bbox``. Spans without a word have no box. The join is on the
    document and then on the overlap.
    """
    e, w = entities.alias("e"), words.alias("w")
    hit = e.join(w, (F.col("e.doc_id") == F.col("w.doc_id")) & (F.col("e.start") < F.col("w.end")) & (F.col("w.start") < F.col("e.end")))
    first = Window.partitionBy("e.doc_id", "e.entity_id").orderBy("w.start", "w.page")
    n = F.row_number().over(first)
    box = F.array(*[F.get("w.bbox", k) + (padding if k > 1 else -padding) for k in range(4)])
    return hit.select("e.doc_id", "e.entity_id", "w.page", F.col("w.start").alias("word_start"), box.alias("bbox"), F.when(n == 1, F.col("e.replacement")).otherwise(F.lit("")).alias("label"))
