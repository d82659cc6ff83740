import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from tests.llm.conftest import table

from tessera.llm import kd_shards as kd


def shards(df, **options):
    return kd.shards(df, **options).collect()


def check(rows, got, count):
    assert len(got) == len(rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(count))
    for own in by.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [r["doc_id"] for r in own]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_equal_bytes_and_groups_together(spark):
    rows = [(k, f"text {k % 400} " + "x" * (k % 97)) for k in range(2000)]
    got = shards(table(spark, rows), count=8)
    sizes = check(rows, got, 8)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) <= 1.06 * mean and min(sizes.values()) >= 0.94 * mean
    by = defaultdict(set)
    for r in got:
        by[r["text_crc32"]].add(r["shard"])
    assert all(len(v) == 1 for v in by.values())


def test_counts_that_are_no_powers_of_two(docs, corpus):
    sizes = check(corpus, shards(docs, count=5), 5)
    assert len(sizes) == 5


def test_target_bytes(spark):
    rows = [(k, "y" * 99) for k in range(1000)]
    df = table(spark, [(k, f"{k:099d}") for k, _ in rows])
    sizes = check([(k, f"{k:099d}") for k, _ in rows], shards(df, target_bytes=10_000), 10)
    assert len(sizes) == 10 and max(sizes.values()) <= 10_500


def test_a_large_group_moves_out_of_the_way(spark):
    rows = [(k, "the same text for very many rows") if k % 12 == 0 else (k, f"other {k} " + "x" * (k % 40)) for k in range(3000)]
    got = shards(table(spark, rows), count=8)
    sizes = check(rows, got, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) <= 1.06 * mean and min(sizes.values()) >= 0.94 * mean
    assert len({r["shard"] for r in got if r["doc_id"] % 12 == 0}) == 1


def test_one_group_larger_than_a_shard_is_cut(spark):
    rows = [(k, "same") if k % 3 else (k, f"other {k}") for k in range(900)]
    sizes = check(rows, shards(table(spark, rows), count=8), 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) <= 1.1 * mean


def plain_tree(rows, count, spans):
    """The same tree on one machine; rows: values, hash, id, size."""
    if count == 1 or not rows:
        return [rows]
    widths = [(max(r[0][i] for r in rows) - min(r[0][i] for r in rows)) / spans[i] for i in range(len(spans))]
    dim = widths.index(max(widths))
    ordered = sorted(rows, key=lambda r: (r[0][dim], r[1], r[2]))
    total, left = sum(r[3] for r in rows), count - count // 2
    need, cut = total * left // count, 0
    while sum(r[3] for r in ordered[: cut + 1]) <= need:
        cut += 1
    before = sum(r[3] for r in ordered[:cut])
    cut += (need - before) * 2 > ordered[cut][3]
    return plain_tree(ordered[:cut], left, spans) + plain_tree(ordered[cut:], count // 2, spans)


def test_against_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(kd, "GIVE", 0.0)
    monkeypatch.setattr(kd, "LARGE", 1e9)
    rows = [(k, f"unique {k * k} " + "z" * (k * 7 % 31)) for k in range(300)]
    df = table(spark, rows).withColumns({"a": (F.col("doc_id") * 37) % 101, "b": (F.col("doc_id") * 11) % 17})
    meta = {r["doc_id"]: ((r["a"], r["b"]), r["h"], r["doc_id"], len(r["text"].encode()) + 1) for r in df.withColumn("h", F.xxhash64("text")).collect()}
    whole = [max(v[0][i] for v in meta.values()) - min(v[0][i] for v in meta.values()) for i in (0, 1)]
    want = {r[2]: k for k, part in enumerate(plain_tree(list(meta.values()), 6, whole)) for r in part}
    got = {r["doc_id"]: r["shard"] for r in shards(df, count=6, dimensions=(F.col("a"), F.col("b")))}
    assert got == want


def test_ranks_are_by_whole_strings(spark):
    words = ["", "a", "ab", "b", "é", "zz", "source-with-a-long-name-1", "source-with-a-long-name-2", None, "a", None]
    got = {r["w"]: r["rank"] for r in kd.with_rank(spark.createDataFrame([(w,) for w in words], "w string"), "w", "rank").collect()}
    order = [None, *sorted({w for w in words if w is not None}, key=lambda w: w.encode())]
    assert got == {w: k for k, w in enumerate(order)}


def test_many_large_groups_stay_whole(spark):
    """A value made of 40 copy groups, each a tenth of a shard, and little else."""
    rows = [(k, f"group {k % 40} of equal texts " + "x" * 60) for k in range(4000)] + [(10_000 + k, f"other {k}") for k in range(300)]
    df = table(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = shards(df, count=4, dimensions=(F.lit(1),))
    sizes = check(rows, got, 4)
    mean = sum(sizes.values()) / 4
    assert max(sizes.values()) <= 1.06 * mean and min(sizes.values()) >= 0.94 * mean
    by = defaultdict(set)
    for r in got:
        by[r["text_crc32"]].add(r["shard"])
    assert sum(len(v) > 1 for v in by.values()) <= 3


def test_odd_rows(odd, nothing):
    check([(r["doc_id"], r["text"]) for r in odd.collect()], shards(odd, count=3), 3)
    assert shards(nothing, count=8) == []


def test_no_python_in_the_plan(docs):
    plan = kd.shards(docs, count=2)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
