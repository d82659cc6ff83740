"""One query for each operator: its contract's columns, from the operator's own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import balanced_mix, best_fit, compression_classifier, fingerprints, kd_shards, multiprobe, parity_join, run_index, secrets, token_files
from tessera.llm.common import read
from tessera.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_edits(read(spark, sf_dir, "documents"))
    own, edited, following = (F.col(f"{x}fingerprint") for x in ("", "edited_", "next_"))
    found = found.withColumns({"near_edited": fingerprints.resemblance(own, edited), "near_next": fingerprints.resemblance(own, following), "n_shingles_estimate": fingerprints.distinct(own)})
    found = found.withColumns({"fingerprint": fingerprints.as_text(own), "edited_fingerprint": fingerprints.as_text(edited)})
    return found.drop("next_fingerprint")


def op2_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(files)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(read(spark, sf_dir, "documents"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shards(read(spark, sf_dir, "documents"), count=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity_join.groups(read(spark, sf_dir, "documents"), size=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    most = lambda c: F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(secrets.BASE)],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
        most("owners").alias("most_owners"),
        most("repositories").alias("most_repositories"),
    )


def op8_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = balanced_mix.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_index.dedup(read(spark, sf_dir, "documents"))
    covered = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        covered("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("kept_bytes"),
        F.size("passages").cast("long").alias("n_passages"),
        covered("passages").alias("passage_bytes"),
    )


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = compression_classifier.fit(docs, labels, ~held_out)
    scored = compression_classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bottom_k,
        op2_multiprobe,
        op3_token_bits,
        op4_best_fit,
        op5_kd_shards,
        op6_parity_join,
        op7_secret_owners,
        op8_cube_mix,
        op9_run_index,
        op10_compression_quality,
    )
}

