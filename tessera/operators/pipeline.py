"""Detection over a table: any DataFrame with a text column in, entities out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import detect, resolve


def with_entities(docs: DataFrame, types: Iterable[str] = schema.TYPES, text: str = "text", as_of: Column | None = None, wide: bool = True, extra: str | None = None) -> DataFrame:
    """``docs`` with ``entities``, the resolved entities of each row. A null or empty text has none.

    No shuffle: everything happens within the row, in batch as in a stream. Equal rows get equal entities,
    other columns stay; a column that is called ``entities`` already is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = detect.detect_all(body, types, as_of, wide, F.col(extra) if extra else None)
    # the finds are a column of their own, so that they are computed once
    return docs.withColumn("_tessera_found", found).withColumn("entities", resolve.resolve(body, F.col("_tessera_found"))).drop("_tessera_found")


def entity_id(doc_id: Column, e: Column) -> Column:
    """A name for an entity that is the same in every run."""
    return F.concat(F.lit("det_"), F.substring(F.sha2(F.concat_ws("|", doc_id.cast("string"), e["type"], e["start"], e["end"], e["source"]), 256), 1, 32))


def detect_pii(docs: DataFrame, types: Iterable[str] = schema.TYPES, doc_id: str = "doc_id", text: str = "text", as_of: Column | None = None, wide: bool = True) -> DataFrame:
    """One row for each entity: ``doc_id, entity_id, type, text, start, end, confidence, source``."""
    found = with_entities(docs, types, text, as_of, wide).select(F.col(doc_id).alias("doc_id"), F.explode("entities").alias("e"))
    return found.select("doc_id", entity_id(F.col("doc_id"), F.col("e")).alias("entity_id"), "e.type", "e.text", "e.start", "e.end", "e.confidence", "e.source")


def detect_distinct(docs: DataFrame, types: Iterable[str] = schema.TYPES, doc_id: str = "doc_id", text: str = "text", as_of: Column | None = None) -> DataFrame:
    """``detect_pii`` that looks into each different text once and joins the finds back by the text's hash.

    Worth it where many rows are copies and detection is dear, as with models.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("checksum"))
    found = with_entities(keyed.dropDuplicates(["checksum"]), types, "text", as_of).select("checksum", F.explode("entities").alias("e"))
    joined = keyed.select("doc_id", "checksum").join(found, "checksum")
    return joined.select("doc_id", entity_id(F.col("doc_id"), F.col("e")).alias("entity_id"), "e.type", "e.text", "e.start", "e.end", "e.confidence", "e.source")
