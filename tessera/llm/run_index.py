"""Removal of long repeated byte strings by a run-length index.

Every string of ``length`` bytes that starts at two places or more is found, exactly, whatever the size
of the corpus, and all bytes that such strings cover are marked; so are, apart, those of shorter repeated
``passage`` strings, which are reported and not removed.

Dealing out. The least hash among the ``GRAM``-byte grams of a window depends on the window's bytes
alone, so equal windows have the same one. Consecutive windows with the same least hash are a segment of
a text; a segment of long windows holds those of short ones with its hash. Segments meet by that hash.
Segments whose hash stands nowhere else are done. Equal segments are counted before they are shuffled.
A hash with too much different text is split by what the windows at one offset from the hashed gram must
have in common.

Index. The segments that meet form one text, each with an end of its own. Its Burrows-Wheeler transform
is cut into runs of equal letters, and the suffix array is kept at both ends of the runs only, with the
length of the match to the neighbouring suffix. Within a run a match only loses its first byte from one
place of the text to the next, so streaming over the text from sample to sample gives the matching
statistics of each place against all other places; where they reach ``length``, the window is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import shuffle_partitions, stored, tidy

#: Bytes of a gram; of segments in one index; of different segments of a hash beyond which it is split.
GRAM, INDEX_BYTES, HOT_BYTES = 64, 1 << 17, 6 << 20
#: Offsets that stay together as a hot hash is split again and again.
WIDTHS = (64, 16, 4, 1)
#: Of which length a segment's windows are asked for: one of the two by number, or both. How tables between steps are kept.
BOTH, ZSTD = -1, "zstd"
LEVEL = ["g", "h", "part", "off", "n", "sub", "which", "bytes"]


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    up, down = shingles._power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(shingles._BYTE[data] * up, out=sums[1:])
    return shingles.mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, from running minima within blocks of ``w``, forwards and backwards."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _stretches(data: np.ndarray, offsets: np.ndarray, grams: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """Text, hash, first byte and end of each run of windows of ``length`` bytes with the same least hash."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none
    least = _sliding_least(grams, length - gram + 1)
    begin, end = offsets[:-1], offsets[1:] - length + 1  # a text's windows start from the one up to the other
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[begin[begin < len(least)]] = True
    new[end[(begin < end) & (end < len(least))]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    of = np.searchsorted(offsets, first, "right") - 1
    inside = first < end[of]
    of, first, last = of[inside], first[inside], last[inside]
    return of, least[first], first, last + length


def segments(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Text, hash, first byte, end, and whether the hash may occur twice there, of each segment of the texts.

    Segments of one text with one hash that overlap are one, so no place stands twice for a hash.
    """
    gram = min(GRAM, *lengths)
    grams = _grams(data, gram) if len(data) >= gram else np.empty(0, np.uint64)
    text, h, a, b = (np.concatenate(x) for x in zip(*(_stretches(data, offsets, grams, gram, n) for n in lengths), strict=True))
    order = np.lexsort((a, h, text))
    text, h, a, b = text[order], h[order], a[order], b[order]
    same = np.zeros(len(h), bool)
    same[1:] = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
    reach = np.maximum.accumulate(b + np.cumsum(~same) * (len(data) + 1)) - np.cumsum(~same) * (len(data) + 1)
    new = ~same
    new[1:] |= a[1:] >= reach[:-1]
    first = np.flatnonzero(new)
    b = reach[np.append(first[1:], len(h))[: len(first)] - 1]
    text, h, a = text[first], h[first], a[first]
    # a hash that occurs twice in a text is among the least ones there both times
    most = np.zeros(len(offsets), np.uint64)
    np.maximum.at(most, text, h)
    low = np.flatnonzero(grams <= np.repeat(most[:-1], np.diff(offsets))[: len(grams)])
    salt = shingles.mix(np.arange(len(offsets), dtype=np.uint64) + np.uint64(1))
    found = np.sort(grams[low] ^ salt[np.searchsorted(offsets, low, "right") - 1])
    again = np.unique(found[1:][found[1:] == found[:-1]])
    return text, h.view(np.int64), a - offsets[text], b - offsets[text], np.isin(h ^ salt[text], again)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array by prefix doubling, and for each length reached the ranks of all places by that prefix.

    The text ends each segment with a number of its own, so all suffixes differ in the end.
    """
    n = len(text)
    bits = max(1, (n + 1).bit_length())
    base = int(text.max()) + 2
    k = next(x for x in (4, 3, 2, 1) if base**x < 1 << 62)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = key * base
        key[: n - j] += text[j:] + 1
    order = np.argsort(key)
    ordered = key[order]
    rank, at, ranks = np.empty(n, np.int32), np.arange(n), {}
    while True:
        # equal suffixes have the rank of the first of them; those that stand alone are in their place for good
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[order[at]] = at[head]
        ranks[k] = rank
        at = at[~(new & np.append(new[1:], True))]
        if not len(at):
            return order, ranks
        place = order[at]  # none of the prefixes holds an end, so something follows each
        key = rank[place].astype(np.int64) << bits | rank[place + k]
        if 3 * bits <= 63:  # with the place in the low bits a plain sort does, which is the fastest
            packed = np.sort(key << bits | place)
            order[at], ordered = packed & ((1 << bits) - 1), packed >> bits
        else:
            by = np.argsort(key)
            order[at], ordered = place[by], key[by]
        rank = rank.copy()
        k *= 2


def _common(a: np.ndarray, b: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, from ranks by longer prefixes first."""
    out, text_ranks = np.zeros(len(a), np.int64), ranks
    n = len(next(iter(ranks.values())))
    for k in sorted(text_ranks, reverse=True):
        i, j = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        out += np.where(text_ranks[k][i] == text_ranks[k][j], k, 0)
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some segments, with samples at both ends of the runs.

    Segments of different ``groups`` (numbers from 0) have different letters and match nowhere.
    """

    def __init__(self, parts: list[bytes], groups: list[int] | None = None):
        count = len(parts)
        sizes = np.array([len(p) + 1 for p in parts])
        ends = np.cumsum(sizes) - 1
        text = np.empty(int(sizes.sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + count
        text[inside] += 256 * np.repeat(groups or [0] * count, sizes - 1)
        text[ends] = np.arange(count)
        self.starts = ends - sizes + 1
        self.n = len(text)
        order, ranks = suffix_array(text)
        before = np.where(order > 0, text[order - 1], -1)
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.runs = len(heads)
        tails = np.append(heads[1:], self.n) - 1
        # at a run's first suffix the match with the one before, at its last that with the one after
        heads, tails = heads[heads > 0], tails[tails < self.n - 1]
        ranks |= {1: text, 2: _pairs(text)}
        self.samples = []
        for at, other in ((heads, heads - 1), (tails, tails + 1)):
            place = order[at]
            self.samples.append((place, _common(place, order[other], ranks)))
        self.edges = (int(order[0]), int(order[-1]))  # the first suffix has none before it, the last none after

    def matching(self) -> np.ndarray:
        """For each place the longest match that starts there and at another place too."""
        out = np.zeros(self.n, np.int64)
        for (place, length), edge in zip(self.samples, self.edges, strict=True):
            known = np.full(self.n, -1, np.int64)
            known[place] = length
            known[edge] = 0
            at = np.arange(self.n)
            last = np.maximum.accumulate(np.where(known >= 0, at, -1))
            np.maximum(out, np.where(last >= 0, known[last] - (at - last), 0), out=out)
        return out


def _pairs(text: np.ndarray) -> np.ndarray:
    out = text * (int(text.max()) + 2)
    out[:-1] += text[1:] + 1
    return out


def repeated(parts: list[bytes], groups: list[int], lengths: tuple[int, ...]) -> list[list[tuple[list[int], list[int]]]]:
    """For each length and part, the first and last of each run of windows that start at another place of its group as well."""
    index = RunIndex(parts, groups)
    matching = index.matching()
    out = []
    for n in lengths:  # no match goes beyond a part's end, so no run does
        edges = np.flatnonzero(np.diff(np.concatenate([[False], matching >= n, [False]]).view(np.int8)))
        at = np.searchsorted(edges[::2], np.append(index.starts, index.n))
        of = np.repeat(index.starts, np.diff(at))
        a, b, at = (edges[::2] - of).tolist(), (edges[1::2] - 1 - of).tolist(), at.tolist()
        out.append([(a[x:y], b[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)])
    return out


def _runs(marks: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _segment_rows(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, th = batch.column(0), batch.column(1).to_numpy()
        for at, _, data, offsets in shingles.chunks(batch.column(2)):
            text, h, a, b, twice = segments(data, offsets, lengths)
            columns = [doc_id.take(pa.array(text + at)), *map(pa.array, (th[text + at], h, 1 + twice.astype(np.int32), a.astype(np.int32), b.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "h", "times", "first", "end"])


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of candidate segments; equal ones of a task carry them once (as far as it remembers)."""
    told: set[tuple[int, int]] = set()
    names = ["doc_id", "th", "h", "part", "first", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        held = 0
        for doc_id, th, text, segs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            data = text.encode()
            for s in segs:
                body = data[s["first"] : s["end"]]
                key = (s["h"], _digest(body))
                for column, x in zip(out, (doc_id, th, s["h"], key[1], s["first"], None if key in told else body), strict=True):
                    column.append(x)
                held += 0 if key in told else len(body)
                told.add(key)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
                out, held = [[], [], [], [], [], []], 0
            if len(told) > 500_000:
                told.clear()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)


def _split(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], width: int) -> Iterator[pa.RecordBatch]:
    """Segments of a hot hash, cut for each length by their windows' offset to the hashed gram.

    Windows whose offsets lie in one range of ``width`` share the bytes that all such windows have;
    only where these are equal can the windows be. Windows without the gram are another hash's.
    """
    gram = min(GRAM, *lengths)
    for batch in batches:
        out: list[list] = [[] for _ in LEVEL]
        for g, h, part, off, n, _, which, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            grams = _grams(np.frombuffer(body, np.uint8), gram).view(np.int64)
            places = np.append(np.flatnonzero(grams == h), len(body))
            for k, length in enumerate(lengths):
                if which not in (BOTH, k) or len(body) < length:
                    continue
                windows = np.arange(len(body) - length + 1)
                own = places[np.searchsorted(places, windows)]
                bucket = np.where(own - windows <= length - gram, (own - windows) // width, -1)
                edges = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])]))
                for a, b in zip(edges.tolist(), [*(edges[1:] - 1).tolist(), len(windows) - 1], strict=True):
                    p, o = int(own[a]), int(bucket[a])
                    if o < 0:
                        continue
                    core = body[p - o * width : p - (o * width + width - 1) + length]
                    sub = body[a : b + length]
                    for column, x in zip(out, (_digest(b"%d %d %d %d " % (g, k, width, o) + core), h, part, off + a, n, _digest(sub), k, sub), strict=True):
                        column.append(x)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], LEVEL)


def _indexed(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the segments, from rows sorted by group and content; an index for some groups each."""

    copies: list[tuple[tuple, list]] = []

    def settle(own: dict, rows: dict) -> int:
        """A group goes to the index; one whose segments are all equal is repeated as a whole already."""
        if len(own) == 1 and sum(x[3] for x in next(iter(own.values()))) > 1:
            copies.append(next(iter(own.items())))
            return len(copies[-1][0][2]) // 8
        rows.update(own)
        return sum(len(k[2]) for k in own)

    def flush(rows: dict) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        number: dict[int, int] = {}
        groups = [number.setdefault(k[0], len(number)) for k in rows]
        marked = repeated([k[2] for k in rows], groups, lengths) if rows else [[]] * len(lengths)
        for k, length in enumerate(lengths):
            for runs, ((_, which, body), owners) in (*zip(marked[k], rows.items(), strict=True), *((None, c) for c in copies)):
                if which not in (BOTH, k) or len(body) < length:
                    continue
                a, b = runs if sum(x[3] for x in owners) == 1 else ([0], [len(body) - length])
                for h, part, off, _ in owners if a else ():
                    for column, x in zip(out, (h, part, k, [off + x for x in a], [off + x + length for x in b]), strict=True):
                        column.append(x)
        copies.clear()
        types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["h", "part", "which", "a", "b"])

    rows: dict[tuple[int, int, bytes], list] = {}
    own: dict[tuple[int, int, bytes], list] = {}
    group, held = None, 0
    for batch in batches:
        for g, h, part, off, n, _, which, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if g != group:
                held += settle(own, rows)
                own, group = {}, g
                if held > INDEX_BYTES:
                    yield from flush(rows)
                    rows, held = {}, 0
            own.setdefault((g, which, body), []).append((h, part, off, n))
    settle(own, rows)
    if rows or copies:
        yield from flush(rows)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered bytes of a text by length; those of the first length go."""

    def covered(marks: list, which: int, n: int) -> np.ndarray:
        cover = np.zeros(n + 1, np.int32)
        for m in marks:
            if m["which"] == which:
                np.add.at(cover, m["a"], 1)
                np.add.at(cover, m["b"], -1)
        return np.cumsum(cover[:-1]) > 0

    for batch in batches:
        found: tuple[list, list] = ([], [])
        sizes, kept = [], []
        for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = text.encode()
            sizes.append(len(data))
            if not marks:
                kept.append(data)
                for spans in found:
                    spans.append([])
                continue
            for which, spans in enumerate(found):
                gone = covered(marks, which, len(data))
                first, last = _runs(gone)
                spans.append([{"start": x, "end": y + 1} for x, y in zip(first, last, strict=True)])
                if which == 0:
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if first else data)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found[0], spans_type), pa.array(kept, pa.binary()), pa.array(found[1], spans_type)], ["doc_id", "n_bytes", "spans", "kept", "passages"])


def dedup(docs: DataFrame, length: int = 400, passage: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept, passages`` for each row: the removed byte spans, ascending, the bytes left, and repeats.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    text or another; strings never cross texts and are judged on the input. ``passages`` are the spans
    of what strings of ``passage`` bytes cover in the same way; they stay unless they go by ``length``.
    A null text counts as empty; a text shorter than ``length`` is kept whole. Equal rows repeat each
    other. A null id is kept. Other columns play no part; an empty table gives an empty result.
    """
    n, lengths = shuffle_partitions(docs.sparkSession), (length, passage)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    own = "doc_id long, th long, "
    found = rows.select("doc_id", "th", "text").mapInArrow(tidy(lambda x: _segment_rows(x, lengths)), own + "h long, times int, first int, end int")
    found = stored(found, "run-segments", ZSTD)
    again = found.groupBy("h").agg(F.sum("times").alias("times")).where("times > 1").select("h")
    again = stored(found.join(again, "h").select("doc_id", "th", F.struct("h", "first", "end").alias("s")), "run-again", ZSTD)
    wanted = again.groupBy("doc_id", "th").agg(F.collect_set("s").alias("segs"))  # a text's own segments
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    parts = rows.alias("r").join(wanted.alias("w"), same("r", "w")).select("r.doc_id", "r.th", "r.text", "w.segs")
    parts = stored(parts.mapInArrow(tidy(_part_rows), own + "h long, part long, first int, bytes binary"), "run-parts", ZSTD)

    schema = "g long, h long, part long, off int, n long, sub long, which int, bytes binary"
    per = parts.groupBy("h", "part").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    level = stored(per.select(F.col("h").alias("g"), "h", "part", F.lit(0).alias("off"), "n", F.col("part").alias("sub"), F.lit(BOTH).alias("which"), "bytes"), "run-level", ZSTD)
    results = []
    for width in (*WIDTHS, None):
        different = level.groupBy("g", "sub").agg(F.max(F.length("bytes")).cast("long").alias("size")).groupBy("g").agg(F.sum("size").alias("size"))
        hot = stored(different.where(F.col("size") > HOT_BYTES).select("g"), "run-hot") if width else None
        there = hot is not None and not hot.isEmpty()
        cold = level.join(hot, "g", "left_anti") if there else level
        dealt = cold.select(LEVEL).repartition(n, "g").sortWithinPartitions("g", "sub")
        results.append(stored(dealt.mapInArrow(tidy(lambda x: _indexed(x, lengths)), "h long, part long, which int, a array<int>, b array<int>"), "run-repeats", ZSTD))
        if not there:
            break
        cut = level.join(hot, "g", "left_semi").select(LEVEL)
        level = stored(cut.mapInArrow(tidy(lambda x, w=width: _split(x, lengths, w)), schema), "run-level", ZSTD)
    marks = results[0]
    for x in results[1:]:
        marks = marks.unionByName(x)
    first = lambda c: F.transform(c, lambda x: x + F.col("first")).alias(c)
    placed = parts.select("doc_id", "th", "h", "part", "first").join(marks, ["h", "part"]).select("doc_id", "th", F.struct("which", first("a"), first("b")).alias("m"))
    spans = placed.groupBy("doc_id", "th").agg(F.collect_list("m").alias("marks"))  # a text's own marks
    whole = rows.alias("r").join(spans.alias("s"), same("r", "s"), "left").select("r.doc_id", "r.text", "s.marks")
    return whole.mapInArrow(tidy(_kept), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, passages array<struct<start:int,end:int>>")
