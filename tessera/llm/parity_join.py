"""N-gram Jaccard join by parity sketches.

Texts are sets of word shingles. Two sets link when their Jaccard similarity is at least a fraction
``num / den``. XOR-ing shingles' hashes into a sketch gives a parity sketch, and two sketches differ in
at most as many places as the sets' symmetric difference has elements, which for linked sets of sizes a
and b is at most ``(a + b) * (den - num) / (den + num)``. So:

* sizes are cut into bands such that linked sets lie in the same band or in neighbouring ones;
* for its own band and the one below, a set's shingles are dealt to more blocks than such a pair can
  differ in, each block the XOR of its shingles' 64-bit hashes, so at least one block is equal; blocks
  are the keys of an equality join (pigeonhole);
* there are spare blocks: a set leaves out so many of those with one shingle or none, and of the rest
  so many of those that stand in most sets. Equal blocks come at the same place in both sets' orders,
  so what is left out of either is no more than the spare, and one equal block stays in both;
* candidates pass the bound on the Hamming distance of one-bit parity sketches and are then verified
  on the sets themselves.

Equal sets are one class throughout, so copies cost nothing. What is asked for is which texts hang
together; a pair of classes that is known to hang together already need not be verified. Blocks that
only a few classes share give all their pairs. In larger ones each class meets two others drawn at
random; what still doesn't hang together after that is compared in cells of bounded size, each class
outside the block's largest component with every other class of the block: first only its nearest
ones are verified, then whatever is within the bound. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import WORD, shuffle_partitions, small, stored, tidy
from tessera.llm.components import components

#: Classes of a block up to which all pairs are candidates at once; classes on a side of a cell.
FEW, CELL = 4, 1024
#: Classes up to which the size of a block is told apart.
HOLD = 64
#: Partners that a class outside a block's largest component tries first in a cell.
NEAREST = 2


@dataclass(frozen=True)
class Rule:
    """Shingle size and similarity threshold, with the bands that follow from it."""

    size: int
    num: int
    den: int
    low: list[int] = field(default_factory=list, compare=False)

    def bands(self, largest: int) -> np.ndarray:
        """Least size of each band, up to one beyond ``largest``."""
        if not self.low:
            self.low.append(1)
        while self.low[-1] <= largest or len(self.low) < 4:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return np.array(self.low)

    def most_apart(self, total):
        """The largest symmetric difference of linked sets with ``total`` elements together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def blocks(self, level: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of blocks at each level, and how many light and how many common ones may be left out.

        At a level the sets of its band meet one another and those of the band above.
        """
        high = low[level + 1] - 1
        apart = self.most_apart(high + high * self.den // self.num)
        light = 18 * (apart + 1) * (self.den - self.num) ** 2 // (self.den + self.num) ** 2 + 1
        common = 2 * (apart + 1) * (self.den - self.num) // (self.den + self.num) + 1
        return np.where(apart > 0, apart + 1 + light + common, 0), light, common

    def quotas(self, sizes: np.ndarray) -> np.ndarray:
        """How many common blocks a set may leave out at its level of even and of odd number."""
        low = self.bands(int(sizes.max(initial=0)) + 1)
        band = np.searchsorted(low, sizes, "right") - 1
        out = np.zeros((len(sizes), 2), np.int64)
        for level in (band, band - 1):
            out[np.arange(len(sizes)), level % 2] = self.blocks(np.maximum(level, 0), low)[2]
        return out

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both) and both > 0


def class_of(s: np.ndarray) -> int:
    """A 64-bit hash of the set; sets are equal where it is (as shingles are where their hashes are)."""
    h = shingles.mix(s).sum(dtype=np.uint64, keepdims=True) + shingles.mix(np.array([len(s)], np.uint64))
    return int(shingles.mix(h).view(np.int64)[0])


def sketch(s: np.ndarray, rule: Rule) -> bytes:
    """Parity sketch of a power of two bits, eight times the largest distance of interest or more.

    A larger sketch folds into a smaller one by XOR-ing its halves.
    """
    want = 8 * max(1, int(rule.most_apart(2 * len(s))))
    bits = 64 << max(0, (want - 1).bit_length() - 6)
    odd = np.bincount((shingles.mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def keys(sets: list[np.ndarray], rule: Rule) -> list[np.ndarray]:
    """For each set the keys of its blocks, at the level of its band and at the one below."""
    out = [[] for _ in sets]
    sizes = np.array([len(s) for s in sets], np.int64)
    used = np.flatnonzero(sizes > 0)
    if not len(used):
        return [np.empty(0, np.int64) for _ in sets]
    low = rule.bands(int(sizes.max()) + 1)
    everything = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), sizes[used])
    hashes = shingles.mix(everything ^ np.uint64(0x14057B7EF767814F))
    band = np.searchsorted(low, sizes[used], "right") - 1
    for level in (band, band - 1):
        count, spare, _ = rule.blocks(np.maximum(level, 0), low)
        count = np.where(level >= 0, count, 0)
        first = np.concatenate([[0], np.cumsum(count)])
        live = count[owner] > 0
        block = first[owner[live]] + (everything[live] % count[owner[live]].astype(np.uint64)).astype(np.int64)
        weight = np.bincount(block, minlength=int(first[-1]))
        order = np.argsort(block)
        value = np.zeros(int(first[-1]), np.uint64)
        there = np.flatnonzero(weight)
        if len(there):
            value[there] = np.bitwise_xor.reduceat(hashes[live][order], (np.cumsum(weight) - weight)[there])
        of = np.repeat(np.arange(len(used)), count)
        number = (np.arange(len(of)) - first[of]).astype(np.uint64) + (level[of].astype(np.uint64) << np.uint64(32))
        key = shingles.mix(value ^ shingles.mix(number)) & ~np.uint64(1) | level[of].astype(np.uint64) & np.uint64(1)
        key = key.view(np.int64)
        # equal blocks hold the same shingles: both sets of a pair leave out light ones in the same order
        kept = np.ones(len(key), bool)
        light = np.flatnonzero(weight <= 1)
        if len(light):
            light = light[np.lexsort((key[light], of[light]))]
            starts = np.searchsorted(of[light], np.arange(len(used)))
            kept[light[np.arange(len(light)) - starts[of[light]] < spare[of[light]]]] = False
        for k, part in zip(used, np.split(key[kept], np.searchsorted(of[kept], np.arange(1, len(used)))), strict=True):
            out[k].append(part)
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


def _classes(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for sets in shingles.of_column(batch.column(1), rule.size):
            n = np.array([len(s) for s in sets], np.int64)
            c = [class_of(s) if len(s) else None for s in sets]
            quota = rule.quotas(n)
            columns = [batch.column(0).slice(at, len(sets)), batch.column(2).slice(at, len(sets)), pa.array(n), pa.array(c, pa.int64()), pa.array([sketch(s, rule) for s in sets], pa.binary()), pa.array(quota[:, 0]), pa.array(quota[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "c", "sketch", "even", "odd"])
            at += len(sets)


def _keys(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows of key and class; a class is told once by a task (as far as it remembers)."""
    told: set[int] = set()
    for batch in batches:
        for sets in shingles.of_column(batch.column(0), rule.size):
            fresh, names = [], []
            for s in sets:
                if len(s) and (c := class_of(s)) not in told:
                    told.add(c)
                    fresh.append(s)
                    names.append(c)
            if len(told) > 500_000:
                told.clear()
            if fresh:
                found = keys(fresh, rule)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(np.array(names, np.int64), [len(x) for x in found]))], ["key", "c"])


def _stretches(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """From rows sorted by key: keys, classes and block sizes, each class of a block once.

    A block of at most ``hold`` classes comes in one piece. A larger one may come in several, with size
    ``hold + 1``; each piece then starts with the last row of the one before, which the last value tells.
    So no more than ``hold`` rows of a block are kept, however hot it is.
    """
    key, held, large = np.int64(0), np.empty(0, np.int64), False
    for batch in batches:
        k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        again = large
        k, c = np.concatenate([np.repeat(key, len(held)), k]), np.concatenate([held, c])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c = k[new], c[new]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        total = np.minimum(sizes, hold + 1)
        if again:
            total[0] = hold + 1
        large = bool(total[-1] > hold)
        out = len(k) if large else int(starts[-1])  # a block that is small as yet may go on
        key, held = k[-1], c[-1:] if large else c[out:]
        if out:
            yield k[:out], c[:out], np.repeat(total, sizes)[:out], again
    if len(held) and not large:
        yield np.repeat(key, len(held)), held, np.full(len(held), len(held)), False


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that two classes share or more, with the block's size as far as ``HOLD``."""
    for k, c, m, again in _stretches(batches, HOLD):
        told = m > 1
        told[0] &= not again
        yield pa.RecordBatch.from_arrays([pa.array(k[told]), pa.array(c[told]), pa.array(m[told].astype(np.int32))], ["key", "c", "m"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that meet in a block: all of a small one, neighbours of a larger one."""
    for k, c, m, _ in _stretches(batches, FEW):
        xs, ys = [], []
        for gap in range(1, FEW):
            if len(k) > gap:
                both = (k[gap:] == k[:-gap]) & ((m[gap:] <= FEW) | (gap == 1))
                xs.append(np.minimum(c[gap:], c[:-gap])[both])
                ys.append(np.maximum(c[gap:], c[:-gap])[both])
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["a", "b"])


def _near(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the larger one folded."""
    x, y = (int.from_bytes(z, "little") for z in (a, b))
    n, m = len(a) * 8, len(b) * 8
    while n > m:
        n //= 2
        x = (x & ((1 << n) - 1)) ^ (x >> n)
    while m > n:
        m //= 2
        y = (y & ((1 << m) - 1)) ^ (y >> m)
    return (x ^ y).bit_count()


def _passing(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs within the bounds on sizes and sketches."""
    for batch in batches:
        a, b, na, nb, sa, sb = (x.to_pylist() if k > 3 else x.to_numpy() for k, x in enumerate(batch.columns))
        sized = np.minimum(na, nb) * rule.den >= np.maximum(na, nb) * rule.num
        most = rule.most_apart(na + nb)
        good = np.array([k for k in np.flatnonzero(sized) if _near(sa[k], sb[k]) <= most[k]], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts are of the named classes and whose sets link; the last set of each side is kept."""
    last: list[tuple] = [(None, None, None), (None, None, None)]

    def set_of(side: int, c: int, text: str) -> np.ndarray | None:
        if last[side][0] != c or last[side][1] != text:
            s = shingles.of_bytes(text.encode(), rule.size)
            last[side] = (c, text, s if len(s) and class_of(s) == c else None)
        return last[side][2]

    for batch in batches:
        good = []
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            x = set_of(0, a[k], batch.column(2)[k].as_py())
            y = set_of(1, b[k], batch.column(3)[k].as_py())
            if x is not None and y is not None and rule.linked(x, y):
                good.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], ["a", "b"])


def _words(rows: list[bytes], bits: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to ``bits``."""
    out = np.zeros((len(rows), bits // 64), "<u8")
    for k, r in enumerate(rows):
        x = np.frombuffer(r, "<u8")
        while len(x) * 64 > bits:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def _cells(batches: Iterator[pa.RecordBatch], rule: Rule, best: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs within the bounds and of different components, from rows sorted by cell.

    With ``best`` only the so many nearest of each class outside the largest component are told.

    A cell has about ``CELL`` rows of either side at most. Columns: key, i, j, c, n, component, sketch,
    straggler (whether the row stands for the side outside the block's largest component).
    """

    def compare(cell: list[tuple]) -> Iterator[pa.RecordBatch]:
        left, right = [r for r in cell if r[4]], [r for r in cell if not r[4]]
        if not left or not right:
            return
        # the sketches are folded to the smallest: distances only shrink, so no linked pair is lost
        bits = min(len(r[3]) for r in cell) * 8
        ws, ms = _words([r[3] for r in left], bits), _words([r[3] for r in right], bits)
        n, comp, c = (np.array([r[k] for r in right]) for k in (1, 2, 0))
        xs, ys = [], []
        for row, w in zip(left, ws, strict=True):
            most = rule.most_apart(n + row[1])
            sized = (np.minimum(n, row[1]) * rule.den >= np.maximum(n, row[1]) * rule.num) & (comp != row[2])
            if not sized.any():
                continue
            apart = np.bitwise_count(ms[sized] ^ w).sum(1).astype(np.int64)
            near = np.flatnonzero(apart <= most[sized])
            if best is not None:
                near = near[np.argsort(apart[near], kind="stable")[:best]]
            for y in c[sized][near]:
                xs.append(min(row[0], int(y)))
                ys.append(max(row[0], int(y)))
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["a", "b"])

    at, cell = None, []
    for batch in batches:
        for key, i, j, *row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if (key, i, j) != at:
                yield from compare(cell)
                at, cell = (key, i, j), []
            cell.append(tuple(row))
    yield from compare(cell)


def groups(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, class, component, component_id``: one row for each row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are ``size`` words in a
    row, a shorter text is one shingle. Rows whose sets have a Jaccard similarity of ``num / den`` or
    more link; ``component_id`` is the least id that can be reached by links, the own one included.
    ``class`` and ``component`` number equal sets and what hangs together.

    A null, empty or blank text has no shingles, a null class, and is linked with nothing. A null id is
    kept, links like any other, and is no component's name unless all its rows have none. Equal rows are
    rows of their own in one component. Other columns play no part; an empty table gives an empty result.
    """
    spark, rule = docs.sparkSession, Rule(size, num, den)
    n = shuffle_partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = rows.select("doc_id", "text", "text_hash").mapInArrow(tidy(lambda x: _classes(x, rule)), "doc_id long, text_hash long, n long, c long, sketch binary, even long, odd long")
    sets = stored(sets, "parity-sets")
    same = [F.min(x).alias(x) for x in ("n", "sketch", "even", "odd")]
    # a class's text is that of its least id; of a class without ids, that of the least hash
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.col("text_hash"))).alias("nameless")
    classes = stored(sets.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("rep"), nameless, *same), "parity-classes")

    told = rows.select("text").mapInArrow(tidy(lambda x: _keys(x, rule)), "key long, c long")
    in_blocks = [F.col("key"), F.xxhash64("c", "key"), F.col("c")]
    shared = told.repartition(n, "key").sortWithinPartitions(*in_blocks).mapInArrow(tidy(_members), "key long, c long, m int")
    # of a class's blocks at one level those in most classes are left out, as many as may be
    level = F.pmod("key", F.lit(2))
    common = F.row_number().over(Window.partitionBy("c", level).orderBy(F.col("m").desc(), "key"))
    ranked = stored(shared, "parity-shared").join(classes.select("c", "even", "odd"), "c").withColumn("rank", common)
    members = stored(ranked.where(F.col("rank") > F.when(level == 0, F.col("even")).otherwise(F.col("odd"))).select("key", "c"), "parity-members")

    sketches = classes.select("c", "n", "sketch")
    met = members.repartition(n, "key").sortWithinPartitions(*in_blocks).mapInArrow(tidy(_meetings), "a long, b long")
    first = met.distinct()
    with_a = first.join(sketches.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    with_b = with_a.join(sketches.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    pairs = stored(with_b.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(lambda x: _passing(x, rule)), "a long, b long"), "parity-pairs")
    links = verify(rows, classes, pairs, rule)
    found = stored(components(links), "parity-components")

    # blocks whose classes don't all hang together yet; in those of a few classes all pairs have met
    large = members.groupBy("key").count().where(F.col("count") > FEW).select("key")
    members = stored(members.join(large, "key"), "parity-members")
    for best in (NEAREST, None):
        more = _between(members, found, sketches, rule, n, best).join(pairs, ["a", "b"], "left_anti")
        more = stored(more, "parity-more")
        if more.isEmpty():
            continue
        pairs = pairs.unionByName(more)
        joined = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verify(rows, classes, more, rule))
        found = stored(components(joined), "parity-components")

    named = found.withColumnRenamed("node", "c").join(classes.select("c", "rep"), "c").select("c", "component", "rep")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = stored(named.join(least, "component").select("c", "component", "least"), "parity-named")
    named = classes.select("c", "rep").join(named, "c", "left").select("c", F.coalesce("component", "c").alias("component"), F.coalesce("least", "rep").alias("least"))
    out = sets.select("doc_id", "text_hash", "n", "c").join(named, "c", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("c").alias("class"), "component", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _between(members: DataFrame, found: DataFrame, sketches: DataFrame, rule: Rule, n: int, best: int | None) -> DataFrame:
    """Pairs that could link two components, from the blocks whose classes don't all hang together."""
    placed = members.join(found.withColumnRenamed("node", "c"), "c", "left").select("key", "c", F.coalesce("component", "c").alias("component"))
    placed = stored(placed, "parity-members")
    per = placed.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum(F.xxhash64("c").cast("decimal(30,0)")).alias("who"))
    per = per.groupBy("key").agg(F.sum("m").alias("m"), F.count("*").alias("parts"), F.max(F.struct("m", "component")).alias("main"), F.sum("who").alias("who"))
    # blocks of the same classes ask the same question: one of them is enough
    open_ = stored(per.where("parts > 1").groupBy("m", "who").agg(F.min(F.struct("key", "main")).alias("one")).select("m", "one.key", "one.main"), "parity-open")
    open_ = open_.select("key", F.col("main.component").alias("main"), F.ceil(F.col("m") / CELL).alias("js"), F.ceil((F.col("m") - F.col("main.m")) / CELL).alias("is"))
    asked = placed.join(open_, "key").join(sketches, "c").withColumn("r", F.xxhash64("c"))
    left = asked.where("component != main").select("key", F.pmod("r", "is").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("js") - 1)).alias("j"), "c", "n", "component", "sketch", F.lit(True).alias("straggler"))
    right = asked.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("is") - 1)).alias("i"), F.pmod("r", "js").alias("j"), "c", "n", "component", "sketch", F.lit(False).alias("straggler"))
    cells = left.unionByName(right).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInArrow(tidy(lambda x: _cells(x, rule, best)), "a long, b long").distinct()


def verify(rows: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of classes whose sets link, from the texts of one document each."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    need = stored(both.join(classes.select("c", "rep", "nameless"), "c").select("c", F.col("rep").alias("doc_id"), F.col("nameless").alias("text_hash")), "parity-need")
    texts = rows.select("doc_id", "text").join(small(need.select("c", "doc_id").where("doc_id is not null")), "doc_id").select("c", "text")
    without = need.where("doc_id is null").select("c", "text_hash")
    if not without.isEmpty():
        texts = texts.unionByName(rows.where("doc_id is null").select("text", "text_hash").join(small(without), "text_hash").select("c", "text"))
    texts = stored(texts.dropDuplicates(["c", "text"]), "parity-texts")
    with_a = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
    return stored(with_b.select("a", "b", "ta", "tb").mapInArrow(tidy(lambda x: _verified(x, rule)), "a long, b long").distinct(), "parity-links")


def one_of_each(docs: DataFrame, grouped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, with all its columns, of each component in ``grouped``: that of the least id, then text hash.

    ``grouped`` comes from ``groups``. Rows are told by id and text, so rows that share an id but hang
    together with other texts are decided each for themselves; null ids come after all others. Of rows
    with the same id and text one stays. Texts without words are in no component and stay, all of them.
    """
    grouped = stored(grouped.where("class is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.col("component").alias("_component")), "parity-grouped")
    row = F.struct(F.col("_id").isNull().alias("last"), "_id", "_h")
    best = grouped.groupBy("_component").agg(F.min(row).alias("b")).select("b._id", "b._h")
    # rows of a large component meet by id and text, not by component
    one = F.col("g._id").eqNullSafe(F.col("b._id")) & (F.col("g._h") == F.col("b._h"))
    gone = stored(grouped.select("_id", "_h").distinct().alias("g").join(best.alias("b"), one, "left_anti"), "parity-gone")
    kept = docs.join(small(gone), F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_h")), "left_anti")
    if grouped.groupBy("_id", "_h").count().where("count > 1").isEmpty():
        return kept
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    return kept.where(worded).dropDuplicates([doc_id, text]).unionByName(kept.where(~worded))
