"""Files and entity lists coming in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema

MAX_BYTES, EXTENSIONS = 25 * 1024 * 1024, (".docx", ".pdf")
ENTITY_JSON = "struct<id:string,pii_type:string,entity_type:string,type:string,label:string,start:int,end:int,span:struct<start:int,end:int>,document_id:string,doc_id:string,text:string,raw_value:string>"


def acceptable(filename: Column, size: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Whether a file's extension (in any case) and size are accepted."""
    extension = F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))
    return extension.isin(*EXTENSIONS) & (size <= max_bytes)


def deduplicated(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Rows with ``checksum`` (SHA-256 of the content), and whether an earlier row had the same.

    ``first_id`` is that row's first order column. A null content is its own kind: never a duplicate.
    """
    keyed = rows.withColumn("checksum", F.sha2(F.col(content), 256))
    firsts = keyed.where(F.col("checksum").isNotNull()).groupBy("checksum").agg(F.min(F.struct(*order)).alias("_first"))
    joined = keyed.join(firsts, "checksum", "left")
    return joined.withColumn("first_id", F.coalesce(F.col(f"_first.{order[0]}"), F.col(order[0]))).withColumn("deduplicated", F.coalesce(F.struct(*order) != F.col("_first"), F.lit(False))).drop("_first")


def load_entities(lists: DataFrame, payload: str = "payload", strict: bool = True) -> DataFrame:
    """Entities of JSON texts, each a list or an object with the list ``entities``.

    The type may be called ``pii_type``, ``entity_type``, ``type`` or ``label``; places stand in ``span`` or
    beside it; the document is ``document_id``, ``doc_id`` or ``default``; an empty string counts as absent.
    With ``strict`` an unknown or missing type fails the query, else its entity is left out.
    """
    text = F.col(payload)
    whole = F.trim(text).startswith("[")
    items = F.when(whole, F.from_json(text, f"array<{ENTITY_JSON}>")).otherwise(F.from_json(text, f"struct<entities:array<{ENTITY_JSON}>>")["entities"])
    if strict:
        items = F.when(items.isNull(), F.raise_error(F.lit("entity JSON must be a list or an object with a list 'entities'"))).otherwise(items)
    rows = lists.select(F.posexplode(items).alias("ordinal", "x"))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"x.{n}"), F.lit("")) for n in names])
    kind = first("pii_type", "entity_type", "type", "label")
    known = kind.isin(*schema.TYPES)
    if strict:
        kind = F.when(F.coalesce(known, F.lit(False)), kind).otherwise(F.raise_error(F.concat(F.lit("unsupported or missing type: "), F.coalesce(kind, F.lit("-")))))
    out = rows.select(
        "ordinal",
        kind.alias("pii_type"),
        F.coalesce("x.span.start", "x.start").alias("start"),
        F.coalesce("x.span.end", "x.end").alias("end"),
        F.coalesce(first("document_id", "doc_id"), F.lit("default")).alias("document_id"),
        first("text", "raw_value").alias("text"),
        F.col("x.id").alias("entity_id"),
    )
    return out if strict else out.where(F.col("pii_type").isin(*schema.TYPES))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
