"""A policy applied to found entities: what may be replaced, and by what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import pipeline, pseudonyms, redact, review

DECISIONS = "array<struct<entity_id:string,decision:string,new_type:string>>"


def approved(docs: DataFrame, policy: dict[str, str], floor: float = schema.CONFIDENCE_FLOOR, as_of: Column | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``approved``: those of their ``entities`` that may be replaced, as ``redact.plan`` takes them.

    ``policy`` names a strategy for each type; what it doesn't name is masked. Without a review an entity is
    approved at or over the floor. ``reviews`` (``entity_id, decision, new_pii_type, reviewed_at``, maybe
    ``doc_id``) come first: accepted and retyped entities are approved whatever their confidence, a
    retyped one by its new type's strategy, rejected ones never. Stand-ins are made document by document,
    in the order of the plan. Rows that share a ``doc_id`` share their reviews; a null id has none.
    """
    today = as_of if as_of is not None else F.current_date()
    decided = _with_decisions(docs, reviews) if reviews is not None else docs
    reviewed = F.coalesce(F.col("_tessera_reviews"), F.array().cast(DECISIONS)) if reviews is not None else F.array().cast(DECISIONS)

    def one(x: Column) -> Column:
        name = pipeline.entity_id(F.col("doc_id"), x)
        if reviews is None:
            kind, good = x["type"], x["confidence"] >= floor
        else:
            own = F.get(F.filter(reviewed, lambda r: r["entity_id"] == name), 0)
            kind, good = review.effective_type(x["type"], own["decision"], own["new_type"]), review.approved(x["confidence"], own["decision"], floor)
        return F.struct(name.alias("entity_id"), kind.alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), redact.strategy_of(kind, policy).alias("strategy"), x["source"].alias("source"), x["confidence"].alias("confidence"), good.alias("good"))

    # columns of their own, so that each is computed once
    chosen = decided.withColumn("approved", F.filter(F.transform("entities", one), lambda e: e["good"]))
    fake = None
    if "pseudonymize" in policy.values():
        wanted = F.filter(redact.in_order(F.col("approved")), lambda e: e["strategy"] == "pseudonymize")
        values = F.transform(wanted, lambda e: F.struct(e["type"].alias("type"), redact.clean(e["text"]).alias("original")))
        chosen = chosen.withColumn("_tessera_memo", pseudonyms.pseudonyms(F.col("doc_id"), values, today))
        fake = lambda e: pseudonyms.lookup(F.col("_tessera_memo"), e["type"], redact.clean(e["text"]))

    def replaced(e: Column) -> Column:
        new = redact.replacement(e["strategy"], e["type"], e["text"], fake(e) if fake else None, today)
        return F.struct(*[e[c].alias(c) for c in ("entity_id", "type", "start", "end", "text", "strategy")], new.alias("replacement"), e["source"].alias("source"), e["confidence"].alias("confidence"))

    return chosen.withColumn("approved", F.transform("approved", replaced)).drop("_tessera_memo", "_tessera_reviews")


def _with_decisions(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """``docs`` with each document's decisions; reviews without a ``doc_id`` are told by the entities' names."""
    last = review.latest(reviews)
    if "doc_id" not in last.columns:
        names = docs.select("doc_id", F.explode("entities").alias("e")).select("doc_id", pipeline.entity_id(F.col("doc_id"), F.col("e")).alias("entity_id")).distinct()
        last = names.join(last, "entity_id")
    per = last.groupBy("doc_id").agg(F.collect_list(F.struct("entity_id", "decision", "new_type")).alias("_tessera_reviews"))  # a document's own
    return docs.join(per, "doc_id", "left")
