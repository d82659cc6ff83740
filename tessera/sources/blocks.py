"""Texts that come in pieces: flattening, places of pieces, words from page layouts and from OCR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: OCR words below this confidence are noise.
OCR_FLOOR = 40


def offsets(blocks: DataFrame, order: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``blocks`` with ``char_offset``, where each starts in its document's flattened text."""
    before = Window.partitionBy(doc_id).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("char_offset", F.coalesce(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).over(before), F.lit(0)).cast("int"))


def flatten(blocks: DataFrame, order: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the texts of its blocks one after another."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_text"))))
    return blocks.groupBy(doc_id).agg(F.array_join(F.transform(pieces, lambda p: p["_text"]), "").alias("text"))


def with_separators(words: DataFrame, order: list[str], groups: list[tuple[list[str], str]], otherwise: str = " ", doc_id: str = "doc_id") -> DataFrame:
    """Words with the separator before each: that of the first group of columns that changes, else a space.

    The first word of a document has none.
    """
    w = Window.partitionBy(doc_id).orderBy(*order)
    sep: Column = F.lit(otherwise)
    for columns, mark in reversed(groups):
        changed = F.lit(False)
        for c in columns:
            changed = changed | ~F.lag(c).over(w).eqNullSafe(F.col(c))
        sep = F.when(changed, F.lit(mark)).otherwise(sep)
    first = F.row_number().over(w) == 1
    return words.withColumn("separator", F.when(first, F.lit("")).otherwise(sep))


def _placed(words: DataFrame, order: list[str], doc_id: str) -> DataFrame:
    upto = Window.partitionBy(doc_id).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("separator") + F.length("text")).over(upto)
    return words.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("text")).cast("int"))


def pdf_words(words: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Words of pages with ``start, end`` in the flattened text.

    Order is page, block, line, word. A new page or block starts after a blank line, a new line after a
    line end.
    """
    order = ["page", "block", "line", "word"]
    return _placed(with_separators(words, order, [(["page"], "\n\n"), (["block"], "\n\n"), (["line"], "\n")], doc_id=doc_id), order, doc_id)


def ocr_words(words: DataFrame, doc_id: str = "doc_id", floor: int = OCR_FLOOR) -> DataFrame:
    """OCR words with ``start, end`` and their box (left, top, right, bottom); blanks and noise are dropped.

    A confidence that isn't a number counts as -1. Another block, paragraph or line is another line.
    """
    order = ["i"]
    sure = F.coalesce(F.expr("try_cast(conf as double)"), F.lit(-1.0)) >= floor
    kept = words.where((F.trim("text") != "") & sure).withColumn("text", F.trim("text"))
    placed = _placed(with_separators(kept, order, [(["block", "par", "line"], "\n")], doc_id=doc_id), order, doc_id)
    return placed.withColumn("bbox", F.array("left", "top", F.col("left") + F.col("width"), F.col("top") + F.col("height")))


def text_of(placed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The flattened text of placed words."""
    pieces = F.array_sort(F.collect_list(F.struct("start", "separator", "text")))
    return placed.groupBy(doc_id).agg(F.array_join(F.transform(pieces, lambda p: F.concat(p["separator"], p["text"])), "").alias("text"))


def overlapping(blocks: DataFrame, spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Every span with every block that it touches; ``blocks`` have ``char_offset`` and ``text``.

    An equality join on the document, with the overlap as a filter on its pairs.
    """
    b = blocks.withColumn("block_end", F.col("char_offset") + F.length("text")).alias("b")
    s = spans.alias("s")
    return s.join(b, (F.col(f"s.{doc_id}") == F.col(f"b.{doc_id}")) & (F.col("s.start") < F.col("b.block_end")) & (F.col("b.char_offset") < F.col("s.end"))).drop(F.col(f"b.{doc_id}"))
