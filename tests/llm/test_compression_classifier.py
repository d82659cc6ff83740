import random

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import sentence, table

from tessera.llm import compression_classifier as cc
from tessera.llm.queries import QUERIES


def made(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        t = sentence(rng, rng.randrange(20, 200))
        bad = k % 3 == 0
        out.append((k, rng.choice([lambda s: " ".join(s.split()[:3] * 40), lambda s: s.upper().replace(" ", "!! "), lambda s: s.replace(" ", " | ")])(t) if bad else t, 0 if bad else 1))
    return out


def frames(spark, rows):
    return table(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def train_rows():
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def test_held_out_accuracy(spark):
    rows = made()
    docs, labels = frames(spark, rows)
    model = cc.fit(docs, labels, train_rows())
    got = {r["doc_id"]: r["score"] for r in cc.score(docs, model).collect()}
    held = {r["doc_id"] for r in labels.where(~train_rows()).collect()}
    assert held and sum((got[i] >= 0.5) == q for i, _, q in rows if i in held) / len(held) >= 0.95
    assert all(0 <= s <= 1 for s in got.values())
    again = cc.fit(docs, labels, train_rows())
    assert again == model


def test_held_out_labels_teach_nothing(spark):
    rows = made(120)
    docs, labels = frames(spark, rows)
    turned = labels.withColumn("quality", F.when(train_rows(), F.col("quality")).otherwise(1 - F.col("quality")))
    assert cc.fit(docs, labels, train_rows()) == cc.fit(docs, turned, train_rows())


def test_only_the_text_counts(spark):
    rows = made(120)
    docs, labels = frames(spark, rows)
    model = cc.fit(docs, labels, train_rows())
    other = docs.withColumns({"doc_id": F.col("doc_id") + 7, "lang": F.lit("q"), "source": F.lit(None).cast("string"), "score": F.lit("clash")})
    a, b = ({r["doc_id"]: r["score"] for r in cc.score(d, model).collect()} for d in (docs, other))
    assert a == {k - 7: v for k, v in b.items()}


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 0, 0)], [(0, None, 0), (None, 1, 0), (1, 7, 0)]])
def test_too_little_to_learn_from(spark, odd, labels):
    docs = table(spark, [(0, "some text"), (1, ""), (2, None)])
    model = cc.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    got = [r["score"] for r in cc.score(docs, model).collect()]
    assert len(set(got)) == 1 and 0 <= got[0] <= 1
    assert cc.score(odd, model).count() == 7


def test_the_bound_of_the_sample(spark):
    rows = made(200)
    docs, labels = frames(spark, rows)
    small = cc.fit(docs, labels, train_rows(), per_class=10)
    assert small != cc.fit(docs, labels, train_rows()) and len(small.good) <= cc.DICTIONARY_BYTES


def test_accept(spark, nothing):
    rows = made(150)
    docs, labels = frames(spark, rows)
    model = cc.fit(docs, labels, train_rows())
    kept = cc.accept(docs, model)
    want = sorted(r["doc_id"] for r in cc.score(docs, model).where("score >= 0.5").collect())
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == want
    assert cc.accept(nothing, model).count() == 0


def test_query(spark, sf):
    got = QUERIES["op10_compression_quality"](spark, sf).collect()
    assert len(got) == 200 and all(r["predicted"] == (r["score"] >= 0.5) for r in got)
