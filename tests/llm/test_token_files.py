import random
import zlib

import numpy as np
import pytest

from tessera.llm import token_files as tf

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = P.path("byte_bpe_50k.json")


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 8, 13, 16, 17, 24, 31, 32):
        for n in (0, 1, 63, 64, 65, 1000):
            ids = rng.integers(0, 2**bits, n).astype("<u4")
            data = tf.pack(ids, bits)
            assert len(data) == -(-n // 64) * bits * 8 and (tf.unpack(data, bits)[:n] == ids).all()
    assert [tf.bits_for(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_encoding_in_pieces_is_the_librarys():
    e, fresh = tf.Encoder(PATH, 2), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "foo", "é", "don't", "'s", ".", "...", "3", "14", "\0", "\x1c", "\xa0", "<|endoftext|>", "漢字", "😀", " x", " 's", "a,", "é,", "Ġ", "Ċ", "a.\n", "!?"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for t, got in zip(made, e(made), strict=True):
        assert got.tolist() == [*(fresh.encode(t, add_special_tokens=False).ids if t else []), 2], repr(t)


def test_added_tokens_are_the_librarys(spark):
    fresh = Tokenizer.from_file(PATH)
    made = ["one two <|endoftext|> three", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|>", "one <|endoftext| > two", "one two three"]
    want = [[*fresh.encode(t, add_special_tokens=False).ids, 2] for t in made]
    assert 50256 in want[0] and [x.tolist() for x in tf.Encoder(PATH, 2)(made)] == want
    rows, at = [], 0
    for i, ids in enumerate(want):
        rows.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert rows_of(tf.read(tf.write(df, PATH, 2))) == rows


def test_little_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 8)
    e = tf.Encoder(PATH, 2)
    made = [f"word{k} and word{k % 7} stay" for k in range(300)] * 2
    assert all(got.tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t, got in zip(made, e(made), strict=True))


def expected(rows):
    fresh, at, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*(fresh.encode(t, add_special_tokens=False).ids if t else []), 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_known_pieces_are_looked_up_once():
    class Counting(dict):
        looks = 0

        def get(self, *key):
            Counting.looks += 1
            return super().get(*key)

        def __contains__(self, key):
            Counting.looks += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counting.looks += 1
            return super().__getitem__(key)

    encode = tf.Encoder(PATH, 2)
    first = encode(["one two three two.", "four one"])
    encode.known = Counting(encode.known)
    again = encode(["one two three two.", "four one"])
    assert Counting.looks <= len({"\0one", "two", "three", "two.", "\0four", "one"})
    assert [x.tolist() for x in again] == [x.tolist() for x in first]


def test_files_round_trip(docs, corpus):
    files = tf.write(docs, PATH, 2)
    assert rows_of(tf.read(files)) == expected(corpus)


def test_random_access(spark, docs, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK", 128)
    files = tf.write(docs.coalesce(1), PATH, 2, folder=str(tmp_path)).orderBy("part").collect()
    e = tf.Encoder(PATH, 2)
    for f in files:
        file = tf.TokenFile(f["uri"])
        for k, i in enumerate(file.doc_ids):
            text = dict(corpus)[i] or ""
            assert file.document(k).tolist() == [*(e.tokenizer.encode(text, add_special_tokens=False).ids if text else []), 2]


def test_odd_rows(odd, nothing):
    got = rows_of(tf.read(tf.write(odd, PATH, 2)))
    want = expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tf.read(tf.write(nothing, PATH, 2)).count() == 0


def test_damaged_file_is_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError, match="token file"):
        tf.TokenFile(str(tmp_path / "x"))
