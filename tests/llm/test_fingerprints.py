import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp
from tessera.llm.queries import QUERIES


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(docs, corpus):
    got = {r["doc_id"]: r for r in fp.with_edits(docs).withColumns({"e": fp.resemblance(F.col("fingerprint"), F.col("edited_fingerprint")), "x": fp.resemblance(F.col("fingerprint"), F.col("next_fingerprint")), "d": fp.distinct(F.col("fingerprint")), "c": fp.containment(F.col("fingerprint"), F.col("edited_fingerprint"))}).collect()}
    down = sorted(corpus, reverse=True)
    assert len(got) == len(corpus)
    for k, (i, t) in enumerate(down):
        t, after = t or "", down[(k + 1) % len(down)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = grams(t), grams(edited)
        exact = len(a | b) <= fp.K
        assert r["e"] == pytest.approx(jaccard(a, b), abs=1e-9 if exact else 0.2)
        assert r["x"] == pytest.approx(jaccard(a, grams(after)), abs=1e-9 if len(a | grams(after)) <= fp.K else 0.2)
        assert r["d"] == pytest.approx(len(a), abs=0.01 if len(a) < fp.K else 0.4 * len(a))
        assert 0 <= r["c"] <= 1
        assert r["fingerprint"] == sorted(set(r["fingerprint"])) and len(r["fingerprint"]) == min(len(a), fp.K)


def test_equal_texts_have_equal_fingerprints(docs, corpus):
    got = {r["doc_id"]: r["f"] for r in docs.select("doc_id", fp.sketch(F.col("text")).alias("f")).collect()}
    by = {}
    for i, t in corpus:
        by.setdefault(t, set()).add(tuple(got[i]))
    assert all(len(v) == 1 for v in by.values())


def test_merge_is_the_sketch_of_all(spark, docs):
    sketches = docs.select("source", fp.sketch(F.col("text"), 16).alias("f"))
    got = {r["source"]: r["f"] for r in fp.merge_by(sketches, ["source"], "f", 16).collect()}
    want = {}
    for r in sketches.collect():
        want.setdefault(r["source"], set()).update(r["f"])
    assert got == {k: sorted(v)[:16] for k, v in want.items()}


def test_many_parts_merge_in_rounds(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), F.array(F.xxhash64("id")).alias("f"))
    got = fp.merge_by(rows, ["k"], "f", 8).first()["f"]
    assert got == sorted(r[0][0] for r in rows.select("f").collect())[:8]


def test_odd_rows(odd, nothing):
    assert fp.with_edits(odd).count() == 7 and fp.with_edits(nothing).count() == 0
    assert fp.merge_by(nothing.select("source", fp.sketch(F.col("text")).alias("f")), ["source"], "f").count() == 0


def test_single_document_is_its_own_next(spark):
    from tests.llm.conftest import table

    r = fp.with_edits(table(spark, [(1, "a b c d e f g h i")])).first()
    assert r["fingerprint"] == r["next_fingerprint"]


def test_no_python_in_the_plan(docs):
    plan = fp.with_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query(spark, sf):
    r = QUERIES["op1_bottom_k"](spark, sf)
    assert r.count() == 200 and re.fullmatch("([0-9a-f]{16})+", r.where("n_chars > 0").first()["fingerprint"])
