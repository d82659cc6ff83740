import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import sentence, table

from tessera.llm import balanced_mix as bm


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shared by weight; what is above a limit is shared again among the others until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        if not free or not (weight := sum(w[s] for s in free)):
            return stopped
        now = {s: left * w[s] / weight for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return stopped | now
        stopped |= {s: most * sizes[s] for s in over}


def check(df, near):
    rows = df.collect()
    got = bm.mix(df).collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(((r["doc_id"], r["source"], n_words(r["text"])) for r in rows), key=repr)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near, s
    assert sorted(got, key=repr) == sorted(bm.mix(df).collect(), key=repr)  # reruns agree
    return got


def test_targets_are_met(spark):
    rng = random.Random(4)
    rows = [(k, sentence(rng, rng.choice([1, 5, 20, 80]))) for k in range(900)]
    check(table(spark, rows), 10)


def test_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(bm, "BLOCK", 20)
    rng = random.Random(5)
    check(table(spark, [(k, sentence(rng, rng.choice([2, 9, 30]))) for k in range(600)]), 30)


def test_the_corpus(docs):
    check(docs, 300)


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(3, 200)
        sizes = [rng.choice([0, 1, 5, 5, 5, 300]) for _ in range(n)]
        p = [0.3] * n
        out = bm.flight(list(p), sizes, random.Random(2))
        assert sum(out) == pytest.approx(sum(p)) and sum(x * s for x, s in zip(out, sizes, strict=True)) == pytest.approx(sum(x * s for x, s in zip(p, sizes, strict=True)), rel=1e-6)
        assert sum(0 < x < 1 for x in out) <= 2


def test_expectations_hold():
    """Over many draws every entry is taken as often as its probability says."""
    sizes, n = [1, 2, 3, 5, 8, 13, 21, 34], 4000
    total = [0.0] * 8
    for k in range(n):
        out = bm.flight([0.4] * 8, sizes, random.Random(k))
        total = [a + b for a, b in zip(total, out, strict=True)]
    assert all(abs(t / n - 0.4) < 0.03 for t in total)


def test_odd_rows(spark, odd, nothing):
    assert bm.mix(odd).count() == 7 and bm.mix(nothing).count() == 0
    blank = bm.mix(table(spark, [(1, ""), (2, None)])).collect()
    assert [r["copies"] for r in blank] == [0, 0]


def test_repeated(spark, docs):
    mixed = bm.mix(docs)
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    out = bm.repeated(docs, mixed)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.select("doc_id").collect():
        got[r["doc_id"]] += 1
    assert got == {k: v for k, v in copies.items() if v}


def test_very_many_equal_rows_are_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bm, "BLOCK", 64)
    same = [(5, "six words are in this text")] * 600 + [(None, "four words without id")] * 200
    rows = same + [(100 + k, "one two three " * (k % 5 + 1)) for k in range(300)]
    df = table(spark, rows).withColumn("source", F.lit("s")).repartition(6)
    mixed = bm.mix(df).cache()
    assert mixed.count() == len(rows)
    taken = sum(r["size"] * r["copies"] for r in mixed.collect())
    want = 1.5 * sum(len((t or "").split()) for _, t in rows)
    assert abs(taken - want) <= 15
    out = bm.repeated(df, mixed)
    assert sum(len(r["text"].split()) for r in out.select("text").collect()) == taken
    again = bm.mix(df.repartition(3))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, mixed.collect()), key=repr)
