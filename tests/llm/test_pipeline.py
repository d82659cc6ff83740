"""The stages, each against a plain version of what it promises, on the smallest tables."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tessera.llm import compression_classifier
from tessera.llm.common import read
from tests.llm.test_balanced_mix import n_words, plain_targets
from tests.llm.test_parity_join import brute


@pytest.fixture(scope="module")
def made(spark, sf, tmp_path_factory):
    """What goes into each stage and comes out of it."""
    base, docs, out = tmp_path_factory.mktemp("stages"), read(spark, sf, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{base}/{k}")
        after = spark.read.parquet(f"{base}/{k}")
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_order_and_columns(made):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    assert all(columns == corpus_pipeline.COLUMNS for _, _, columns in made[:-1])


def test_quality(spark, sf, made):
    before, after, _ = made[0]
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    from pyspark.sql import functions as F

    score = compression_classifier.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1).scorer()
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if score([(r["text"] or "").encode()])[0] >= 0.5}


def test_near_duplicates(made):
    before, after, _ = made[1]
    want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in sorted(before, key=lambda r: r["doc_id"])], 5, 4, 5)}
    assert sorted(r["doc_id"] for r in after) == sorted(want)


def test_secrets(made):
    before, after, _ = made[2]
    now = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for r in before:
        x = now[r["doc_id"]]
        assert x["n_chars"] == len(x["text"])
        if x["text"] != r["text"]:
            assert "[SECRET]" in x["text"] and re.search("AKIA|password|secret|token|key|[0-9a-f]{24}", r["text"], re.I)


def test_mix(made):
    before, after, _ = made[3]
    sizes, taken, copies = defaultdict(int), defaultdict(int), Counter(r["doc_id"] for r in after)
    for r in before:
        sizes[r["source"]] += n_words(r["text"])
        taken[r["source"]] += n_words(r["text"]) * copies[r["doc_id"]]
    want = plain_targets(sizes)
    assert max(copies.values()) <= 2
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 50 for s in sizes)


def test_packing(made):
    before, after, _ = made[4]
    assert sum(r["size"] for r in after) == sum(n_words(r["text"]) for r in before)
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    source = {r["doc_id"]: r["source"] for r in before}
    bins = defaultdict(list)
    for r in after:
        bins[r["bin"]].append(r)
    for own in bins.values():
        assert sum(r["size"] for r in own) <= 1024
        assert len({source[r["doc_id"]] for r in own}) == len(own)


def test_run_is_all_stages(spark, sf, made):
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, made[-1][1]))


def test_empty_table(spark, sf, nothing):
    docs = nothing.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
