import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.conftest import sentence, table

from tessera.llm import components as module
from tessera.llm import parity_join as pj
from tessera.llm import shingles
from tessera.llm.components import components

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def grams(t, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    """Component and set size of each row by all pairs."""
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)]) if least[find(i)] and sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def got(df, k, num, den):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in pj.groups(df, k, num, den).collect()), key=repr)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_against_all_pairs(docs, corpus, k, num, den):
    assert got(docs, k, num, den) == brute(corpus, k, num, den)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Chains of links through many variants, in cells far smaller than the group."""
    monkeypatch.setattr(pj, "CELL", 16)
    rng = random.Random(1)
    base = sentence(rng, 120).split()
    rows = []
    for k in range(220):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(40)}"
        rows.append((k + 1, " ".join(w)))
    assert got(table(spark, rows), 3, 9, 10) == brute(rows, 3, 9, 10)


def test_links_joined_by_distributed_steps(docs, corpus, monkeypatch):
    monkeypatch.setattr(module, "HELD", 20)
    assert got(docs, 3, 9, 10) == brute(corpus, 3, 9, 10)


def test_hot_copies_and_common_passages(spark):
    rng = random.Random(2)
    passage = sentence(rng, 40)
    rows = [(k, "hot copy of a text that is there very often indeed") for k in range(300)] + [(1000 + k, passage + " " + sentence(rng, 30)) for k in range(200)]
    assert got(table(spark, rows), 3, 9, 10) == brute(rows, 3, 9, 10)


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd, 3, 9, 10) == brute(rows, 3, 9, 10)
    assert got(nothing, 3, 9, 10) == []


@pytest.mark.parametrize(("size", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_linked_sets_share_a_key_and_pass_the_bound(size, num, den):
    rule, rng = pj.Rule(size, num, den), random.Random(6)
    linked = 0
    for _ in range(2000):
        n = rng.choice([1, 2, 3, 5, 9, 10, 11, 19, 20, 40, 100, 300])
        a = {rng.getrandbits(63) for _ in range(n)}
        b = set(a)
        k = rng.randrange(max(2, int(n * 0.4)))
        b -= set(rng.sample(sorted(a), min(k, n)))
        b |= {rng.getrandbits(63) for _ in range(rng.randrange(max(2, k + 1)))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if a == b or not b or not rule.linked(x, y):
            continue
        linked += 1
        p, q = pj.keys([x, y], rule)
        assert set(p.tolist()) & set(q.tolist())
        assert pj._near(pj.sketch(x, rule), pj.sketch(y, rule)) <= rule.most_apart(len(a) + len(b))
    assert linked > 100


def test_blocks_in_stretches():
    import pyarrow as pa

    rng = random.Random(9)
    for hold in (2, 4, 64):
        rows = sorted((rng.choice([1, 2, 3, 3, 3, 4, 5, 6, 7]), rng.randrange(12)) for _ in range(150)) + [(9, x) for x in range(200)]
        for size in (1, 2, 7, 50, 1000):
            batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in rows[i : i + size]], "c": [r[1] for r in rows[i : i + size]]}) for i in range(0, len(rows), size)]
            blocks, told, last = defaultdict(set), [], None
            for k, _ in rows:
                blocks[k] |= {c for kk, c in rows if kk == k}
            for k, c, m, again in pj._stretches(iter(batches), hold):
                assert not again or (k[0], c[0]) == last
                pieces = list(zip(k.tolist(), c.tolist(), strict=True))
                assert all(x == min(len(blocks[key]), hold + 1) for key, x in zip(k.tolist(), m.tolist(), strict=True))
                told += pieces[1:] if again else pieces
                last = (k[-1], c[-1])
            assert told == [(k, c) for k in sorted(blocks) for c in sorted(blocks[k])]


def test_what_is_left_out_never_costs_a_link():
    """Two linked sets among many that share passages: one equal block is common to what both keep."""
    rng, rule = random.Random(11), pj.Rule(5, 4, 5)
    passage = [rng.getrandbits(63) for _ in range(30)]
    sets = []
    for _ in range(150):
        a = {rng.getrandbits(63) for _ in range(rng.choice([15, 40, 90]))} | set(rng.sample(passage, rng.randrange(31)))
        b = set(a)
        for x in rng.sample(sorted(a), int(len(a) * 0.11)):
            b.discard(x)
        b |= {rng.getrandbits(63) for _ in range(rng.randrange(3))}
        sets += [np.array(sorted(x), np.uint64) for x in (a, b)]
    found = [set(k.tolist()) for k in pj.keys(sets, rule)]
    often = defaultdict(int)
    for k in found:
        for x in k:
            often[x] += 1
    quota = rule.quotas(np.array([len(s) for s in sets]))
    kept = []
    for k, q in zip(found, quota, strict=True):
        kept.append({x for parity in (0, 1) for x in sorted((x for x in k if x % 2 == parity and often[x] > 1), key=lambda x: (-min(often[x], 65), x))[q[parity] :]})
    linked = 0
    for i in range(0, len(sets), 2):
        if rule.linked(sets[i], sets[i + 1]):
            linked += 1
            assert kept[i] & kept[i + 1]
    assert linked > 50


def test_shingles_are_those_of_the_words():
    rng = random.Random(8)
    texts = ["", " ", "a", "A b", "a b c", "x\ty\x0bz\x0cq", "é É", "A B C a b c a b c", "\n lead and trail \r\n", *(sentence(rng, n) for n in (5, 50, 900))]
    import pyarrow as pa

    for k in (1, 3, 5):
        sets = [s for part in shingles.of_column(pa.array(texts), k) for s in part]
        assert [len(s) for s in sets] == [len(grams(t, k)) for t in texts]
        named = {}
        for s, t in zip(sets, texts, strict=True):
            assert named.setdefault(tuple(s.tolist()), grams(t, k)) == grams(t, k)


@pytest.mark.parametrize("held", [500_000, 3])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(module, "HELD", held)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 200)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in df.collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(docs, corpus):
    kept = pj.one_of_each(docs, pj.groups(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in brute(corpus, 5, 4, 5)})


def test_one_of_each_of_odd_rows(odd):
    kept = [r["doc_id"] for r in pj.one_of_each(odd, pj.groups(odd)).collect()]
    assert sorted(kept, key=repr) == sorted([None, None, 5, 5, 7, 9], key=repr)


def test_a_null_id_links_like_any_other(spark):
    """The middle text, which alone has no id, joins two that don't link with each other."""
    rng = random.Random(12)
    words = sentence(rng, 200).split()
    a, b, c = words[:194], words[:200], words[6:200]
    for middle in (None, 2):
        rows = [(1, " ".join(a)), (middle, " ".join(b)), (3, " ".join(c)), (4, sentence(rng, 90))]
        assert got(table(spark, rows), 3, 19, 20) == brute(rows, 3, 19, 20)
        assert [x[2] for x in got(table(spark, rows), 3, 19, 20)].count(1) == 3


def test_rows_that_share_an_id_are_told_by_text(spark):
    rng = random.Random(13)
    first, other = sentence(rng, 40), sentence(rng, 40)
    df = table(spark, [(1, first), (2, first), (2, other), (2, other), (3, ""), (3, "")])
    kept = sorted((r["doc_id"], r["text"]) for r in pj.one_of_each(df, pj.groups(df)).collect())
    assert kept == sorted([(1, first), (2, other), (3, ""), (3, "")])
