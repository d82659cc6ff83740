import random
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import sentence, table

from tessera.llm import run_index as ri


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + length, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((d, len(t), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def both(rows, length, passage):
    """What goes, and what the shorter strings cover."""
    return [(*x, y[2]) for x, y in zip(brute(rows, length), brute(rows, passage), strict=True)]


def got(df, length, passage):
    spans = lambda r, c: [(s["start"], s["end"]) for s in r[c]]
    return sorted(((r["doc_id"], r["n_bytes"], spans(r, "spans"), bytes(r["kept"]), spans(r, "passages")) for r in ri.dedup(df, length, passage).collect()), key=lambda r: repr(r[:4]))


@pytest.mark.parametrize(("length", "passage"), [(400, 256), (60, 30), (60, 60)])
def test_against_every_string(docs, corpus, length, passage):
    assert got(docs, length, passage) == both(corpus, length, passage)


def test_small_strings_and_periods(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for k in range(60)] + [(100, "abc" * 40), (101, "a" * 50), (102, "é" * 30)]
    assert got(table(spark, rows), 12, 8) == both(rows, 12, 8)


def test_a_passage_in_very_many_texts(spark, monkeypatch):
    """The hash of a common passage is too hot for one index and is split by offsets."""
    monkeypatch.setattr(ri, "HOT_BYTES", 3000)
    monkeypatch.setattr(ri, "INDEX_BYTES", 2000)
    rng = random.Random(4)
    passage = sentence(rng, 40)
    rows = [(k, sentence(rng, rng.randrange(3, 12)) + " " + passage + " " + sentence(rng, rng.randrange(3, 12))) for k in range(120)] + [(500, passage), (501, "z" * 300)]
    assert got(table(spark, rows), 60, 40) == both(rows, 60, 40)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd, 5, 3) == both(rows, 5, 3)
    assert got(nothing, 400, 256) == []


def naive_matching(text, ends):
    n = len(text)
    out = []
    for p in range(n):
        best = 0
        for q in range(n):
            if q != p:
                k = 0
                while p + k < n and q + k < n and text[p + k] == text[q + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def test_matching_statistics_from_sampled_run_ends():
    rng = random.Random(5)
    for _ in range(40):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 15))).encode() for _ in range(rng.randrange(1, 6))]
        index = ri.RunIndex(parts)
        text, at = [], []
        for k, p in enumerate(parts):
            at.append(len(text))
            text += [x + 1000 for x in p] + [k]
        assert index.matching().tolist() == naive_matching(text, at)


def test_only_unsettled_suffixes_are_sorted_again(monkeypatch):
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 123, 3000).astype(np.uint8).tobytes(), b"ab" * 200, b"ab" * 150]
    text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int64) + len(parts), k) for k, p in enumerate(parts)])
    sizes, sort = [], np.sort
    monkeypatch.setattr(ri.np, "sort", lambda x: sizes.append(len(x)) or sort(x))
    order, ranks = ri.suffix_array(text)
    monkeypatch.undo()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert len(sizes) > 5 and max(sizes[1:]) < 1000 < len(text)
    for k, rank in ranks.items():
        assert [rank[i] == rank[j] for i, j in zip(order, order[1:])] == [(text[i : i + k] == text[j : j + k]).all() if max(i, j) + k <= len(text) else False for i, j in zip(order, order[1:])]


def test_repetitive_text_has_few_runs():
    rng = random.Random(6)
    base = sentence(rng, 300).encode()
    many = ri.RunIndex([base + b"%d" % k for k in range(50)])
    assert many.runs < many.n / 15


def test_sliding_least():
    rng = np.random.default_rng(7)
    for n, w in ((1, 1), (10, 3), (100, 100), (257, 16)):
        x = rng.integers(0, 50, n).astype(np.uint64)
        assert ri._sliding_least(x, w).tolist() == [int(x[i : i + w].min()) for i in range(n - w + 1)]


def test_segments_hold_all_windows_and_equal_windows_meet():
    rng = random.Random(8)
    made = [("ab" * 300 + sentence(rng, 200) + "c" * 700).encode(), sentence(rng, 90).encode(), b"", b"x" * 150, b"short"]
    data, offsets = np.frombuffer(b"".join(made), np.uint8), np.cumsum([0, *map(len, made)])
    text, h, a, b, twice = ri.segments(data, offsets, (200, 100))
    own = {}
    for t, x, i, j in zip(text, h, a, b, strict=True):
        own.setdefault((t, x), []).append((i, j))
    for spans in own.values():
        assert all(j <= k for (_, j), (k, _) in zip(spans, spans[1:], strict=False))
    for n in (200, 100):
        met = {}
        for t, body in enumerate(made):
            for s in range(len(body) - n + 1):
                hashes = {x for (k, x), spans in own.items() if k == t and any(i <= s and s + n <= j for i, j in spans)}
                met.setdefault(body[s : s + n], []).append(hashes)
        assert all(set.intersection(*x) for x in met.values())
    assert twice[text == 3].all() and twice[(text == 0) & (a == 0)].any() and not twice[text == 1].any()
