import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge", "ha", "jo", "ki", "lu", "me") for b in ("n", "rt", "s", "ll", "ng", "", "x", "st")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def texts(seed=7, n=60):
    """Texts with copies, near copies, shared passages, repeats, odd ones, an empty one and a null."""
    rng = random.Random(seed)
    out = [sentence(rng, rng.choice([1, 3, 4, 5, 12, 40, 120, 300])) for _ in range(n)]
    passage = sentence(rng, 150)
    for k in range(0, n, 6):
        out.append(out[k])
        words = out[k].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        out.append(sentence(rng, 30) + "\n" + passage + " " + sentence(rng, 20))
    out += ["", None, "   \n\t ", "é" * 500, "ab " * 400, "😀 " + passage.upper(), "x", "X", "a" * 2000, passage * 3]
    return out


def table(spark, rows, extra=False):
    """``(doc_id, text)`` pairs as documents, with sources of which one is hot, some null."""
    made = [(i, t, ("en", "fr", None)[k % 3], ("s0", "s0", "s1", "s2", None)[k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(made, COLUMNS)
    if extra:  # names that the operators use for themselves
        for c in ("h", "n", "size", "part", "hash", "node", "rid", "base", "spans", "key", "c", "g", "component", "label", "score"):
            df = df.withColumn(c, df["lang"])
    return df


@pytest.fixture(scope="session")
def corpus():
    return [(3 * k + 1, t) for k, t in enumerate(texts())]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return table(spark, corpus, extra=True).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, one id for two texts, equal rows."""
    return table(spark, [(None, "a b c d e f g"), (None, None), (5, "one two three four five six"), (5, "other words stand in here now"), (7, "same row"), (7, "same row"), (9, "")])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
