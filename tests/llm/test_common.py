import os
from types import SimpleNamespace

from pyspark.sql import functions as F

from tessera.llm import common


def test_running_sums_over_ranges(spark):
    rows = [((k * 37) % 101, k % 3, k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b int, v long")
    keys = ["b", "a", "v"]
    got = common.running(common.in_ranges(df, keys), keys, {"s": F.col("v"), "n": F.lit(1)}, by=["b"]).collect()
    want = {}
    for b in range(3):
        at, n = 0, 0
        for a, _, v in sorted((r for r in rows if r[1] == b), key=lambda r: (r[0], r[2])):
            want[b, a, v] = (at, n)
            at, n = at + v, n + 1
    assert {(r["b"], r["a"], r["v"]): (r["s"], r["n"]) for r in got} == want


def test_null_groups_have_sums_of_their_own(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "k string, v long")
    got = common.running(common.in_ranges(df, ["k", "v"]), ["k", "v"], {"n": F.lit(1)}, by=["k"]).collect()
    assert sorted(r["n"] for r in got) == [0, 0, 1]


def test_stored_tables_can_be_forgotten(spark):
    kept = list(common._written)
    common._written.clear()
    df = common.stored(spark.range(10).toDF("id"), "scrap")
    path = common._written[0].removeprefix("file:")
    assert df.count() == 10 and os.path.isdir(path)
    assert common.forget(spark) == 1 and not os.path.exists(path) and common._written == []
    common._written.extend(kept)


def test_the_shared_folder_is_the_configured_one():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "file:///some/where/"))
    assert common.shared_dir(session) == "file:///some/where"


def test_numbered(spark):
    from collections import defaultdict

    from pyspark.sql import functions as F

    rows = [(k % 7 if k % 3 else 1000 + k, k) for k in range(500)]
    df = spark.createDataFrame(rows, "key long, x long").repartition(9)
    got = common.numbered(common.stored(df.withColumn("salt", F.spark_partition_id()), "t"), "key").collect()
    by = defaultdict(list)
    for r in got:
        by[r["key"]].append(r["copy"])
    assert len(got) == 500 and all(sorted(v) == list(range(len(v))) for v in by.values())
