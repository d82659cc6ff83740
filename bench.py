"""Times the headline queries and prints one line of JSON.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` choose data and cores. Every query is written in full
to Spark's no-op sink after one run to warm up.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans import registry  # noqa: E402

HEADLINES = ("detect_email", "detect_phone", "detect_credit_card", "detect_pii", "redact_mask", "redaction_counts", "replacement_map", "checksum_dedup", "block_offsets", "event_changes")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = {"flagship": registry.flagship, **{n: registry.QUERIES[n] for n in HEADLINES}}
    took = {}
    for name, query in queries.items():
        times = []
        for _ in range(2):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "documents": docs, "cpus": int(cpus), "docs_per_second_flagship": round(docs / took["flagship"])}))


if __name__ == "__main__":
    main()
