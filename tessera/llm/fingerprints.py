"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A fingerprint is the ascending list of the ``k`` smallest distinct 64-bit hashes of a text's shingles
(five lower-cased words in a row). Two fingerprints estimate resemblance, containment and the number of
distinct shingles; the fingerprint of a union is the k smallest of both, so parts merge in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import in_ranges, stored

K, SHINGLE = 128, 5
#: Sketches that are merged at a time.
FAN_IN = 64


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text as ``array<bigint>``.

    Words are separated by ASCII white space. A text of fewer words than a shingle is one shingle; a null,
    empty or blank text has none and an empty fingerprint.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        return F.when(n >= shingle, each).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(bound(hashes, shingles))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / part)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, from 0 to 1: what the k smallest of the union have in common.

    Two empty fingerprints resemble each other fully, an empty and another not at all.
    """

    def share(u: Column) -> Column:
        return F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(bound(merged(a, b, k), share))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of ``a``'s shingles that ``b`` has too; 1 where ``a`` has none."""
    common = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct(a, k)))


def as_text(a: Column) -> Column:
    """16 lower-case hex digits for each hash, one after another."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_by(sketches: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One fingerprint for each value of ``keys`` (null is a value): that of all its rows together.

    Rounds merge at most about ``FAN_IN`` sketches of a key in one place, so a key that has a third of
    all rows is many small tasks in each round. Null sketches count as empty.
    """
    rows = sketches.select(*keys, F.coalesce(F.col(column), F.array().cast("array<bigint>")).alias(column))
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    spread = 1
    while spread * FAN_IN < most:
        spread *= FAN_IN
    empty = F.array().cast("array<bigint>")
    while True:
        salt = F.pmod(F.xxhash64(column), F.lit(spread)) if spread > 1 else F.lit(0).cast("long")
        own = rows.distinct().withColumn("_salt", salt).groupBy(*keys, "_salt").agg(F.collect_list(column).alias("_all"))
        rows = own.select(*keys, F.aggregate("_all", empty, lambda x, y: merged(x, y, k)).alias(column))
        if spread == 1:
            return rows
        spread //= FAN_IN


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside the next, by descending id; after the last comes the first.

    ``doc_id, text, head, next_sketch``: ``head`` is the start of the next text, a third of the own
    length, ``next_sketch`` its fingerprint. A single document is its own next. Rows with a null id
    come after all others. Rows that share an id are ordered by their text's hash; equal rows are one
    document and get the same result each.

    Only ids and lengths are sorted, in ranges; every text is shuffled once, and its head once more.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ids = rows.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies"))
    ranged = in_ranges(ids, ["doc_id", "h"], "fingerprint-ids")
    up = F.lead(F.struct("doc_id", "h", "n")).over(Window.partitionBy("part").orderBy("doc_id", "h"))
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "h", "n")).alias("first"))  # a row for each range
    whole = Window.orderBy("part")
    after = F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = firsts.select("part", after.alias("after"))
    links = ranged.withColumn("up", up).join(ends, "part").select("doc_id", "h", F.coalesce("up", "after").alias("to"))
    repeats = (ranged.agg(F.max("copies")).first()[0] or 0) > 1
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    sent = rows.alias("r").join(links.alias("l"), same("r", "l")).select(F.col("to.doc_id").alias("doc_id"), F.col("to.h").alias("h"), F.expr("substring(text, 1, to.n div 3)").alias("head"), sketch(F.col("text")).alias("next_sketch"))
    if repeats:
        sent = sent.dropDuplicates(["doc_id", "h"])
    return rows.alias("d").join(sent.alias("s"), same("d", "s")).select("d.doc_id", "d.text", "s.head", "s.next_sketch")


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint`` of each text.

    The edited text has its last third replaced by as many characters of the next document's start (or
    all, where that is shorter). Nulls, ties and repeated rows: see ``with_next`` and ``sketch``.
    """
    n = F.length("text")
    pairs = with_next(docs, doc_id, text).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), F.col("head")))
    return pairs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("fingerprint"),
        sketch(F.col("edited"), k).alias("edited_fingerprint"),
        F.col("next_sketch").alias("next_fingerprint"),
    )
