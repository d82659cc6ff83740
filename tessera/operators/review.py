"""Review decisions and approval over rows of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema


def effective_type(kind: Column, decision: Column, new_type: Column) -> Column:
    """The reviewed type where a span was retyped, else the detected one."""
    return F.coalesce(F.when(decision == "retype", new_type), kind)


def approved(confidence: Column, decision: Column, floor: float = schema.CONFIDENCE_FLOOR) -> Column:
    """A decision counts before the confidence: accept and retype approve, reject doesn't."""
    return F.when(decision.isNotNull(), decision.isin("accept", "retype")).otherwise(confidence >= floor)


def needs_review(confidence: Column, decision: Column, floor: float = schema.CONFIDENCE_FLOOR) -> Column:
    return decision.isNull() & (confidence < floor)


def confidence_tier(confidence: Column) -> Column:
    """``high`` from 0.9, ``medium`` from 0.75, else ``low``."""
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.75, "medium").otherwise("low")


def latest(reviews: DataFrame) -> DataFrame:
    """``entity_id, decision, new_type`` of each entity's latest review (and ``doc_id`` where reviews have it).

    Decisions other than accept, reject and retype say nothing; a new type counts for a retype only. Of
    reviews at the same time the alphabetically last decision counts, then the last new type.
    """
    order = Window.partitionBy("entity_id").orderBy(F.col("reviewed_at").desc(), F.col("decision").desc(), F.col("new_pii_type").desc())
    last = reviews.where(F.col("decision").isin(*schema.DECISIONS)).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return last.select(*[c for c in ("doc_id",) if c in reviews.columns], "entity_id", "decision", F.when(F.col("decision") == "retype", F.col("new_pii_type")).alias("new_type"))


def apply_reviews(entities: DataFrame, reviews: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Entities with ``verified, decision, new_type, effective_type`` from each one's latest review.

    A new type counts for a retype only. ``states`` (``doc_id, status``) limits reviews to documents that
    are being detected or wait for a review; others' entities stay as they are. Of reviews at the same
    time the alphabetically last decision counts.
    """
    last = latest(reviews).select("entity_id", "decision", "new_type")
    joined = entities.join(last, "entity_id", "left")
    if states is not None:
        joined = joined.join(states.select("doc_id", "status"), "doc_id", "left")
        open_ = F.col("status").isin("needs_review", "detecting")
        joined = joined.withColumns({c: F.when(open_, F.col(c)) for c in ("decision", "new_type")}).drop("status")
    return joined.withColumn("verified", F.col("decision").isNotNull()).withColumn("effective_type", effective_type(F.col("type"), F.col("decision"), F.col("new_type")))


def visible(entities: DataFrame, floor: float = schema.CONFIDENCE_FLOOR) -> DataFrame:
    """What a reviewer sees: not rejected, at or over the floor, with a label of type and percentage."""
    kept = entities.where(((F.col("decision").isNull()) | (F.col("decision") != "reject")) & (F.col("confidence") >= floor))
    return kept.withColumn("label", F.concat_ws(" · ", "effective_type", F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))))


def hidden_counts(entities: DataFrame, floor: float = schema.CONFIDENCE_FLOOR) -> DataFrame:
    """Per document: how many entities the floor shows and hides."""
    return entities.groupBy("doc_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("confidence") >= floor, 1)).alias("visible"), F.count(F.when(F.col("confidence") < floor, 1)).alias("hidden"))


def by_page(entities: DataFrame) -> DataFrame:
    """Boxes of each page in order of their start; entities without a page or a box have none."""
    placed = entities.where(F.col("page").isNotNull() & F.col("bbox").isNotNull())
    return placed.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("start", "end", "effective_type", "bbox"))).alias("boxes"))
