"""Command line: ``python -m tessera detect|redact|evaluate ...``; paths are whatever Spark reads and writes."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import evaluate, jobs, pipeline, policy, redact
from tessera.sources import ingest, sinks


def _policy(pairs: list[str]) -> dict[str, str]:
    """Pseudonyms for every type; a strategy alone is for all of them, ``TYPE=STRATEGY`` for one."""
    out = jobs.default_policy()
    for p in pairs:
        kind, _, strategy = p.rpartition("=")
        out |= {kind: strategy} if kind else dict.fromkeys(schema.TYPES, strategy)
    if unknown := set(out) - set(schema.TYPES) or set(out.values()) - set(schema.STRATEGIES):
        raise SystemExit(f"unknown type or strategy: {sorted(unknown)}")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("detect", "redact"):
        p = commands.add_parser(name)
        p.add_argument("input", help="Parquet with an id and a text column")
        p.add_argument("output")
        p.add_argument("--id", default="doc_id")
        p.add_argument("--text", default="text")
        p.add_argument("--types", nargs="*", default=list(schema.TYPES))
        if name == "redact":
            p.add_argument("--strategy", nargs="*", default=[], metavar="[TYPE=]STRATEGY")
            p.add_argument("--reviews", help="Parquet of reviews: entity_id, decision, new_pii_type, reviewed_at")
            p.add_argument("--floor", type=float, default=schema.CONFIDENCE_FLOOR)
    p = commands.add_parser("evaluate")
    p.add_argument("ground_truth", help="entity JSON")
    p.add_argument("predictions", help="entity JSON")
    p.add_argument("output", help="a local folder for the reports")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "evaluate":
        both = [ingest.load_entities(spark.read.text(x, wholetext=True).withColumnRenamed("value", "payload")) for x in (a.ground_truth, a.predictions)]
        matches = evaluate.match_best_overlap(*both)
        print(sinks.write_reports(evaluate.report(matches), evaluate.confusion(matches), a.output, matches=matches)["md"])
        return
    docs = spark.read.parquet(a.input).select(F.col(a.id).alias("doc_id"), F.col(a.text).alias("text"))
    if a.command == "detect":
        pipeline.detect_pii(docs, a.types).write.mode("overwrite").parquet(a.output)
        return
    reviews = spark.read.parquet(a.reviews) if a.reviews else None
    done = redact.redact(policy.approved(pipeline.with_entities(docs, a.types), _policy(a.strategy), a.floor, reviews=reviews))
    done.select("doc_id", "redacted", "plan").write.mode("overwrite").parquet(f"{a.output}/texts")
    written = spark.read.parquet(f"{a.output}/texts")
    sinks.write_artifacts(redact.audit_log(written), f"{a.output}/artifacts")
    for line in redact.text_report(redact.counts(written)).orderBy("line_no").collect():
        print(line["line"])


if __name__ == "__main__":
    main()
