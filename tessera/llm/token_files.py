"""Token ids in fixed-width bit-packed files.

A file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs.
Ids lie in blocks of ``BLOCK`` ids, and every block starts at a byte offset that the file lists, so any
range of ids is read and unpacked with numpy without touching the rest.

Layout (little-endian): packed blocks; for each document its id (int64), whether the id is there
(uint8) and the number of ids up to its end (uint64); the blocks' byte offsets and the end of the last
(uint64); then a fixed footer with the counts and the places of these tables.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, shuffle_partitions, stored, tidy

BLOCK = 1 << 16
MAGIC = b"TSBITS01"
FOOTER = struct.Struct("<8sIIQQQQ")  # magic, bits, ids a block, ids, documents, place of documents, place of offsets
#: Pieces of text whose ids a worker remembers at most; beyond that it starts anew.
REMEMBERED = 1_000_000
MARKS = frozenset(".,;:!?")
#: Bytes of texts that are encoded together (one text may be longer), and new pieces that are.
TOGETHER_BYTES, JOINED = 4 << 20, 16384
# How byte-level vocabularies write a space and a line end.
SPACE, LINE = "\u0120", "\u010a"
#: No token of a byte-level pre-tokenizer lies across these places, so texts can be cut there: before a
#: single space or line end between characters that are no white space.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing; 64 ids fill exactly ``bits`` words of 64 bits."""
    n = -(-len(ids) // 64) * 64
    rows = np.zeros(n, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(-1, 64)
    out = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1).astype("<u4")


class Writer:
    """Writes one file, block by block."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.offsets, self.waiting, self.held, self.place = [0], [], 0, 0
        self.ids, self.ends, self.n = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.ids.append(doc_id)
        self.ends.append(self.n)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            rest = np.concatenate(self.waiting)
            while len(rest) >= BLOCK:
                self._block(rest[:BLOCK])
                rest = rest[BLOCK:]
            self.waiting, self.held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        self.stream.write(x := pack(ids, self.bits))
        self.place += len(x)
        self.offsets.append(self.place)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        valid = np.array([x is not None for x in self.ids], np.uint8)
        tables = [np.array([x or 0 for x in self.ids], "<i8").tobytes(), valid.tobytes(), np.array(self.ends, "<u8").tobytes()]
        docs_at, offsets_at = self.place, self.place + sum(map(len, tables))
        for x in (*tables, np.array(self.offsets, "<u8").tobytes(), FOOTER.pack(MAGIC, self.bits, BLOCK, self.n, len(self.ids), docs_at, offsets_at)):
            self.stream.write(x)
        self.stream.close()


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block, self.n, self.n_docs, docs_at, offsets_at = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        table = self.file.read_at(offsets_at - docs_at, docs_at)
        ids = np.frombuffer(table, "<i8", self.n_docs)
        valid = np.frombuffer(table, np.uint8, self.n_docs, 8 * self.n_docs)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(ids, valid, strict=True)]
        self.ends = np.frombuffer(table[9 * self.n_docs :], "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.file.read_at(size - FOOTER.size - offsets_at, offsets_at), "<u8").astype(np.int64)
        self._kept: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _block(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            data = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            self._kept = (k, unpack(data, self.bits))
        return self._kept[1]

    def ids(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` up to ``stop``, a piece for each block."""
        while start < stop:
            k, at = divmod(start, self.block)
            n = min(stop - start, self.block - at)
            yield self._block(k)[at : at + n]
            start += n

    def document(self, k: int) -> np.ndarray:
        return np.concatenate([*self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k])), np.empty(0, "<u4")])


class Encoder:
    """Encodes whole texts; remembers the ids of the pieces between places where no token can lie.

    Arrow splits some texts at a time and numbers their different pieces, so Python looks at each
    different piece once, and the ids of all texts are gathered from one array.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.end = np.array([end_id], "<u4")
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        self.added = tuple(x["content"] for x in told["added_tokens"] or ())  # found before texts are cut into tokens
        self.in_pieces = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spaced, self.line = np.zeros(self.vocabulary, bool), names.get(LINE, -1)
        self.spaced[[k for name, k in names.items() if name.startswith(SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # the row of a piece; -1 if its ids depend on what stands beside it
        self.n, self.ids = 0, np.empty(1 << 16, "<u4")
        self.rows, self.starts = 0, np.zeros(1 << 14, np.int64)  # row k lies from starts[k] to starts[k + 1]

    def _add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of the keys, whose ids stand one after another."""
        while self.n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.rows + len(keys) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.n : self.n + len(ids)] = ids
        self.starts[self.rows + 1 : self.rows + len(keys) + 1] = self.n + np.cumsum(sizes)
        self.known.update(zip(keys, range(self.rows, self.rows + len(keys)), strict=True))
        self.n, self.rows = self.n + len(ids), self.rows + len(keys)

    def _gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after another, and how many each has."""
        starts = self.starts[rows]
        sizes = self.starts[rows + 1] - starts
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, keys: list[str]) -> None:
        found = self._encode([" " + k if k[:1] not in ("\0", "\n") else k.lstrip("\0") for k in keys])
        self._add(keys, np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found], np.int64))

    def _together(self, keys: list[str], joint: str) -> None:
        """Keys are encoded in one text; after a space starts a token, a line end is one of its own."""
        for at in range(0, len(keys), JOINED):
            some = keys[at : at + JOINED]
            if joint == " ":
                ids = np.array(self._encode([" " + " ".join(some)])[0], "<u4")
                first = np.flatnonzero(self.spaced[ids])
            else:
                ids = np.array(self._encode(["\n".join(["", *(k[1:] for k in some)])])[0], "<u4")
                first = np.flatnonzero(ids == self.line)
            if len(first) != len(some):
                self._alone(some)
                continue
            sizes = np.diff(np.append(first, len(ids)))
            if joint != " ":  # the line ends go
                ids, sizes = np.delete(ids, first), sizes - 1
            self._add(some, ids, sizes)

    def _learn(self, keys: list[str]) -> None:
        """Ids of keys that aren't known.

        A key is a piece without the space before it; one without such a space starts with a line end
        or, at a text's start, with a zero. It is safe if, but for that, it neither starts nor ends with
        white space, for then texts may be cut before and after it.
        """
        spaced, bare, lines, marked, odd = [], [], [], [], []
        for k in keys:
            body = k[1:] if k[:1] in ("\0", "\n") else k
            if not body or body[0].isspace() or body[-1].isspace():
                self.known[k] = -1
            elif " " in body or "\n" in body:
                odd.append(k)
            elif body[-1] in MARKS and (c := body[-2:-1]).isalpha() and c.isascii():
                marked.append(k)  # a mark after an ASCII letter is a token of its own
            else:
                (spaced if body is k else bare if k[0] == "\0" else lines).append(k)
        if marked:
            parts = {k[:-1] for k in marked} | {"\0" + k[-1] for k in marked}
            self._learn(list(parts.difference(self.known, spaced, bare, lines, odd)))
        if lines:
            parts = {"\0" + k[1:] for k in lines}
            self._learn(list(parts.difference(self.known, bare, odd)))
        self._together(spaced, " ")
        self._together(bare, "\n")
        if odd:
            self._alone(odd)
        for first, then, of in ((lambda k: "\0\n", lambda k: "\0" + k[1:], lines), (lambda k: k[:-1], lambda k: "\0" + k[-1], marked)):
            if of:
                if of is lines and "\0\n" not in self.known:
                    self._add(["\0\n"], np.array(self._encode(["\n"])[0], "<u4"), np.array([len(self._encode(["\n"])[0])]))
                ids, sizes = self._gathered(np.array([r for k in of for r in (self.known[first(k)], self.known[then(k)])], np.int64))
                self._add(of, ids, sizes[::2] + sizes[1::2])

    def _rows(self, keys: list[str]) -> np.ndarray:
        """The rows of different keys; those that aren't known are learnt."""
        rows = np.fromiter(map(self.known.get, keys, itertools.repeat(-2)), np.int64, len(keys))
        missing = np.flatnonzero(rows == -2)
        if len(missing):
            if len(self.known) + len(missing) > REMEMBERED:
                self._forget()
                missing = np.arange(len(keys))
            new = [keys[k] for k in missing.tolist()]
            self._learn(new)
            rows[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return rows

    def _whole(self, text: str) -> np.ndarray:
        """A text with places that can't be cut: pieces between those that can, or all of it at once."""
        if not text:
            return np.empty(0, "<u4")
        if not self.in_pieces or "\0" in text or text[0] in " \n" or any(x in text for x in self.added):
            return np.array(self._encode([text])[0], "<u4")  # an added token's string may lie across pieces
        keys = [p[1:] if p[0] == " " else p if p[0] == "\n" else "\0" + p for p in CUT.split(text)]
        rows = self._rows(list(dict.fromkeys(keys)))
        at = dict(zip(dict.fromkeys(keys), rows.tolist(), strict=True))
        alone = {k: np.array(self._encode([" " + k if k[:1] not in ("\0", "\n") else k.lstrip("\0")])[0], "<u4") for k, r in at.items() if r < 0}
        return np.concatenate([alone[k] if at[k] < 0 else self.ids[self.starts[at[k]] : self.starts[at[k] + 1]] for k in keys])

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, the end id included; what is new in all of them is encoded at once."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        plain = pc.not_equal(texts, "") if self.in_pieces else pa.array([False] * len(texts))
        for x in ("\0", *self.added):
            plain = pc.and_not(plain, pc.match_substring(texts, x))
        whole = ~plain.to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.replace_substring(texts.filter(plain), "\n", " \n"), pa.scalar("", pa.large_string()))
        pieces = pc.split_pattern(marked, " ")
        coded = pieces.flatten().dictionary_encode()
        different = coded.dictionary
        # no piece holds a space, so Python splits them off one text, which is faster than to_pylist
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(different)], different), pa.scalar(" ", pa.large_string()))[0].as_py()
        rows = self._rows(joined.split(" ") if len(different) else [])[coded.indices.to_numpy()]
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))]).astype(np.int64)
        cut = np.flatnonzero(~whole)
        unsafe = np.concatenate([[0], np.cumsum(rows < 0)])
        whole[cut] = unsafe[starts[1:]] > unsafe[starts[:-1]]
        ids, sizes = self._gathered(np.maximum(rows, 0)) if len(rows) else (np.empty(0, "<u4"), rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])[starts]
        out: list = [None] * len(texts)
        for k, a, b in zip(cut.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = np.concatenate([ids[a:b], self.end])
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.concatenate([self._whole(texts[k].as_py()), self.end])
        return out


@functools.cache
def encoder(path: str, end_id: int) -> Encoder:
    """A worker's own; it outlives its tasks."""
    return Encoder(path, end_id)


def _together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First rows and numbers of rows of runs of texts that are encoded together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, before + TOGETHER_BYTES, "right")) - at)
        yield at, n
        at += n


def write(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the files; returns ``part, uri, n_docs, n_tokens, start``.

    Files hold ranges of ascending document ids, ``start`` is the number of ids in the files before.
    Each task writes a file of its own name; only the files of tasks that ended well are listed, so a
    lost executor leaves at most an unlisted file. ``folder`` defaults to the shared folder.

    A null text counts as empty and has the end id only. Rows with a null id come first. Rows of the
    same id are kept, in the order of their texts. Other columns are ignored. Of an empty table no
    file is listed. ``tokenizer_path`` must be readable by every worker.
    """
    spark = docs.sparkSession
    into = folder or f"{shared_dir(spark)}/tessera/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, uri = encoder(tokenizer_path, end_id), None, None
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at, rows in _together(batch.column(1)):
                if out is None:
                    fs, path = pyarrow.fs.FileSystem.from_uri(into)
                    fs.create_dir(path, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens"
                    uri = f"{into}/{name}"
                    out = Writer(fs.open_output_stream(f"{path}/{name}"), bits_for(encode.vocabulary))
                some = batch.slice(at, rows)
                for name, ids in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    out.add(name, ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(out.ids)], "n_tokens": [out.n]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(dealt.mapInArrow(tidy(run), "part long, uri string, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """Reads the listed files; ``doc_id, start, n_tokens, ids_crc32`` for each document.

    ``start`` counts the ids of all documents before; the crc is of the ids as little-endian unsigned
    32-bit integers. One block is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["uri"])
                starts = np.concatenate([[0], file.ends[:-1]]).astype(np.int64)
                sums = []
                for a, b in zip(starts, file.ends, strict=True):
                    crc = 0
                    for piece in file.ids(int(a), int(b)):
                        crc = zlib.crc32(np.ascontiguousarray(piece), crc)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(starts + row["start"]), pa.array(file.ends - starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = files.select("uri", "start").repartition(shuffle_partitions(files.sparkSession))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
