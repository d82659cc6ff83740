import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import multiprobe as mp

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=10):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        d = np.sqrt(((v - v[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        out[q] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def search(df, rows, every=10, k=10):
    got = {}
    for r in mp.search(df, F.col("vec_id") % every == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=24) if i % 3 else rng.normal(size=24)).astype(np.float32).tolist(), 0) for i in range(3000)]
    got, want = search(spark.createDataFrame(rows, SCHEMA), rows, 20), brute(rows, range(0, 3000, 20))
    assert set(got) == set(want)
    assert np.mean([len({x[1] for x in got[q]} & {x[0] for x in want[q]}) / 10 for q in want]) >= 0.9
    for q, found in got.items():
        exact = dict(brute(rows, [q], 3000)[q])
        assert [x[0] for x in found] == list(range(1, 11)) and all(s == exact[v] for _, v, s in found)
        assert found == sorted(found, key=lambda x: (x[2], x[1]))


def test_one_vector_very_often(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).astype(np.float32).tolist(), 0) for i in range(600)]
    got, want = search(spark.createDataFrame(rows, SCHEMA), rows, 30), brute(rows, range(0, 600, 30))
    assert all([x[1] for x in got[q]] == [x[0] for x in want[q]] for q in want if q % 3 == 0)


def test_few_candidates_are_all_returned(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [50.0, 9.0], 0), (2, [-900.0, 4.0], 0)]
    got = search(spark.createDataFrame(rows, SCHEMA), rows)
    assert [(r, v) for r, v, _ in got[0]] == [(1, 1), (2, 2)]
    assert search(spark.createDataFrame(rows[:1], SCHEMA), rows) == {}


def test_what_takes_no_part(spark):
    good = [(i, [float(i + 1), 1.0], 0) for i in range(12)]
    bad = [(100, None, 0), (110, [0.0, 0.0], 0), (120, [float("nan"), 1.0], 0), (130, [float("inf"), 1.0], 0), (140, [None, 1.0], 0), (150, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (0, [9.0, 9.0], 0), (3, [4.0, 1.0], 0)]
    df = spark.createDataFrame(good + bad, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "c", "g", "score", "rank")})
    got = search(df, good)
    assert set(got) == {0, 10} and [x[1] for x in got[0]] == list(range(1, 11))
    assert mp.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_visits_come_by_estimated_success():
    place = np.array([0.1, 0.5, 0.95])
    slots = mp.sequence(place, 0.999)
    inside = place - np.floor(place)
    edges = np.stack([-1 - inside, -inside, 1 - inside, 2 - inside], 1) * mp.WIDTH
    chance = np.diff(mp._normal(edges), axis=1)
    p = [np.prod([chance[j, int(s[j] - np.floor(place[j])) + 1] for j in range(3)]) for s in slots]
    assert p == sorted(p, reverse=True) and len({tuple(s) for s in slots}) == len(slots) and sum(p) == pytest.approx(1, abs=0.05)


def test_functions_and_tables_grow_with_the_table():
    """Eight directions at random: a thousand times the vectors are cut into more buckets, a smaller part is ranked."""
    sample = np.random.default_rng(8).normal(size=(2048, 8))
    small, large = mp.fit(sample, 2048, 10, 0), mp.fit(sample, 3 * 10**6, 10, 0)
    assert large.a.shape[2] > small.a.shape[2] and large.share < 0.6 * small.share


def test_crowded_buckets_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(mp, "ENTRIES", 40)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * (0.001 if i % 2 else 1)).astype(np.float32).tolist(), 0) for i in range(800)]
    got, want = search(spark.createDataFrame(rows, SCHEMA), rows, 20), brute(rows, range(0, 800, 20))
    assert np.mean([len({x[1] for x in got[q]} & {x[0] for x in want[q]}) / 10 for q in want]) >= 0.9
