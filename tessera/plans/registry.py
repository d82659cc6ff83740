"""Every query of the library by name, and the SQL that says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera import schema
from tessera.operators import pipeline, policy
from tessera.operators import redact as redaction
from tessera.plans import oracles, queries
from tessera.sources import tables

QUERIES = queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect all nine kinds in every document, approve by confidence, mask: ``doc_id, n_spans, redacted``."""
    docs = tables.spread(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
    done = redaction.redact(policy.approved(pipeline.with_entities(docs, schema.TYPES), {}))
    return done.selectExpr("doc_id", "size(plan) as n_spans", "redacted")
