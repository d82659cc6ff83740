"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of some tables cuts space into buckets by some functions ``floor((a . v + b) / w)`` with
Gaussian ``a``. How many follows from the number of vectors: more functions make buckets finer, so that
fewer vectors are ranked, at the cost of more buckets to visit; more tables ask less of each. A query visits, in every table, its own bucket and buckets whose functions differ by
one, in the order of the estimated probability that a neighbour at the usual distance lies there, until
these add up to what the tables together need for ``TARGET``. What the visited buckets hold is ranked
by exact distance in double precision, table by table, and merged.

Equal vectors are one entry with the least of their ids, so a vector that is there very often costs no
more than another. Crowded buckets are dealt to several tasks, and queries go to all of them. Buckets have
no size limit; a query that finds too few is answered from all entries.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small, stored

TABLES, TARGET = (1, 2, 4, 8), 0.95
#: Numbers of functions to choose from (and of tables, above), what visiting a bucket costs beside ranking a vector, and the
#: vectors of the sample by which the costs are compared.
HASHES, VISIT, TRIED = range(4, 33, 2), 50, 8
#: Slot width as a multiple of the usual distance, and the bound of the sample that this distance is taken from.
WIDTH, SAMPLE = 2.0, 2048
#: Entries of a table that one task ranks, and ids of equal vectors in one group while they are counted.
ENTRIES, MEMBERS = 8192, 4096


@dataclass(frozen=True)
class Model:
    """The hash functions and the distance they are made for: ``tables * hashes * (dimensions + 1)`` numbers.

    ``share`` is the part of all vectors that a query is expected to rank, all tables together.
    """

    a: np.ndarray
    b: np.ndarray
    near: float
    share: float = 1.0

    @property
    def reach(self) -> float:
        """The probability that one table must reach so that all together reach ``TARGET``."""
        return 1 - (1 - TARGET) ** (1 / len(self.a))

    def projections(self, v: np.ndarray) -> np.ndarray:
        """Table, vector, function: places in slots."""
        return (np.einsum("tdk,nd->tnk", self.a, v) + self.b[:, None, :]) / (WIDTH * self.near)


def fit(sample: np.ndarray, total: int, k: int, seed: int) -> Model:
    """Functions for vectors of which ``sample`` (at most ``SAMPLE``) were drawn out of ``total``.

    The usual distance is that to the sample neighbour whose rank corresponds to the ``k``-th of all,
    at the 90 % quantile of the sample; on a sample it comes out rather too large, so probing too wide. The
    number of functions is the first beyond which the estimated cost of a query rises; it grows with
    ``total``.
    """
    near = 0.0
    if len(sample) > 1:
        squares = (sample**2).sum(1)
        d = np.maximum(squares[:, None] + squares - 2 * sample @ sample.T, 0)
        np.fill_diagonal(d, np.inf)
        rank = min(len(sample) - 2, max(0, round(k * len(sample) / total) - 1))
        near = float(np.quantile(np.sqrt(np.partition(d, rank, axis=1)[:, rank]), 0.9))
    near = near if near > 0 else 1.0
    rng = np.random.default_rng(seed)
    dimensions = sample.shape[1] if len(sample) else 1
    a, b = rng.normal(size=(TABLES[-1], dimensions, HASHES[-1])), rng.uniform(0, WIDTH * near, (TABLES[-1], HASHES[-1]))
    best = (math.inf, Model(a[:, :, :1], b[:, :1], near))
    for tables in TABLES:
        last = math.inf
        for hashes in HASHES:
            model = Model(a[:tables, :, :hashes], b[:tables, :hashes], near)
            visits, share = _effort(model, sample)
            cost = visits * VISIT + share * total
            best = min(best, (cost, Model(model.a, model.b, near, share)), key=lambda x: x[0])
            if cost >= last:
                break
            last = cost
    return best[1]


def _effort(model: Model, sample: np.ndarray) -> tuple[float, float]:
    """Buckets that a query visits and the part of all vectors that it ranks, in all tables, by some of the sample.

    Infinite where buckets whose functions differ by one at most can't reach what they must.
    """
    if not len(sample):
        return 0.0, 0.0
    place = model.projections(sample)[0]
    held, visits, share = codes(np.floor(place).astype(np.int64)), 0.0, 0.0
    tried = place[:: max(1, len(place) // TRIED)]
    if np.mean([_chances(p).sum(1).prod() for p in tried]) < model.reach:
        return math.inf, math.inf
    for p in tried:
        wanted = codes(sequence(p, model.reach))
        visits += len(wanted)
        share += float(np.isin(held, wanted).mean())
    return len(model.a) * visits / len(tried), len(model.a) * share / len(tried)


def codes(slots: np.ndarray) -> np.ndarray:
    """One number for each row of slot numbers."""
    out = np.zeros(slots.shape[:-1], np.uint64)
    for j in range(slots.shape[-1]):
        out = (out ^ slots[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def _chances(place: np.ndarray) -> np.ndarray:
    """For each function the probabilities of the slot below, the own one and the one above."""
    inside = place - np.floor(place)
    edges = np.stack([-1 - inside, -inside, 1 - inside, 2 - inside], 1) * WIDTH
    return np.maximum(np.diff(_normal(edges), axis=1), 1e-12)


def sequence(place: np.ndarray, target: float) -> np.ndarray:
    """Slots of the buckets to visit, most promising first, until their probabilities reach ``target``.

    ``place`` holds a query's projections in slots. A neighbour's projection differs by a Gaussian of
    the usual distance, which is ``1 / WIDTH`` of a slot; so each function has a probability for staying
    and for the slots beside. Sets of changes come off a heap by their summed loss.
    """
    chance = _chances(place)
    order = np.argsort(-chance, axis=1, kind="stable")
    loss = np.log(np.take_along_axis(chance, order, 1))
    loss = loss[:, :1] - loss
    turn = np.argsort(loss[:, 1], kind="stable")
    first, second = loss[turn, 1].tolist(), loss[turn, 2].tolist()
    whole = float(np.prod(np.take_along_axis(chance, order, 1)[:, 0]))
    heap: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    sets, reached = [], 0.0
    while heap and reached < target:
        cost, changes = heapq.heappop(heap)
        sets.append(changes)
        reached += whole * math.exp(-cost)
        at = changes[-1][0] if changes else -1
        if at + 1 < len(first):
            heapq.heappush(heap, (cost + first[at + 1], (*changes, (at + 1, 1))))
        if changes and changes[-1][1] == 1:
            heapq.heappush(heap, (cost - first[at] + second[at], (*changes[:-1], (at, 2))))
            if at + 1 < len(first):
                heapq.heappush(heap, (cost - first[at] + first[at + 1], (*changes[:-1], (at + 1, 1))))
    step = np.tile(order[:, 0] - 1, (len(sets), 1))
    for row, changes in zip(step, sets, strict=True):
        for j, choice in changes:
            row[turn[j]] = order[turn[j], choice] - 1
    return np.floor(place).astype(np.int64) + step


def _nearest(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(((vectors - query) ** 2).sum(1))
    if len(d) > k:
        limit = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= limit)
        d, ids = d[near], ids[near]
    best = np.lexsort((ids, d))[:k]
    return ids[best], d[best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _told(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    kinds = (np.int64, np.int64, np.float64)
    return pd.DataFrame({n: np.concatenate([f[k] for f in found]) if found else np.empty(0, kinds[k]) for k, n in enumerate(("q", "c", "score"))})


def clean(vectors: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    fine = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vectors.isNotNull() & fine & F.exists(vectors, lambda x: x != 0), F.lit(False))


def search(table: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of each row for which ``queries`` holds.

    Nearest first by Euclidean distance, ties by the smaller id; a query's own row is no candidate.
    ``queries`` is a condition on ``vec_id``. With ``k`` candidates or fewer all are returned.

    Rows with a null id, and vectors that are null, zero or hold a null or non-finite component, take no
    part, nor do vectors of another length than most have. Rows that share an id count as one, with the
    least vector. Other columns play no part; an empty table gives an empty result.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & clean(F.col("v")))
    # 0.0 + x makes -0.0 equal 0.0
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.transform("v", lambda x: x + 0.0).alias("v"))
    rows = stored(rows.withColumn("vh", F.xxhash64("v")), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    rows = rows.where(F.size("v") == (lengths["d"] if lengths else 0))

    most = rows.groupBy("vh").count().agg(F.max("count")).first()[0] or 0
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(-(-most // MEMBERS) or 1))
    some = rows.groupBy("vh", "v", salt.alias("salt")).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    entries = some.groupBy("vh", "v").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = stored(entries.withColumn("c", F.col("ids")[0]), "vector-entries")  # c, the least id, names the entry
    total = entries.count()
    sample = entries.orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("v").collect()
    model = fit(np.array([r["v"] for r in sample] or np.empty((0, 1)), float), max(total, 1), k, seed)
    groups = max(1, -(-total // ENTRIES))

    asking = rows.where(queries).join(entries.select("vh", "v", "c"), ["vh", "v"]).select(F.col("vec_id").alias("query_id"), "c")
    asking = stored(asking, "vector-queries")
    probing = asking.select("c").distinct().join(entries.select("c", "v"), "c")

    def index(batches):
        for pdf in batches:
            if len(pdf):
                at = codes(np.floor(model.projections(_matrix(pdf["v"]))).astype(np.int64))
                for t in range(len(model.a)):
                    yield pd.DataFrame({"t": t, "g": at[t] % groups, "code": at[t], "c": pdf["c"], "v": pdf["v"]})

    def probes(batches):
        for pdf in batches:
            if len(pdf):
                place, rows = model.projections(_matrix(pdf["v"])), []
                for t in range(len(model.a)):
                    for c, v, p in zip(pdf["c"], pdf["v"], place[t], strict=True):
                        at = codes(sequence(p, model.reach))
                        g = at % groups
                        rows += [(t, x, c, v, at[g == x]) for x in np.unique(g).tolist()]
                yield pd.DataFrame(rows, columns=["t", "g", "q", "v", "codes"])

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            code, c, v = left["code"].to_numpy(), left["c"].to_numpy(), _matrix(left["v"])
            for q, query, wanted in zip(right["q"], right["v"], right["codes"], strict=True):
                visited = np.isin(code, np.asarray(wanted))
                ids, d = _nearest(v[visited], c[visited], np.asarray(query, float), k + 1)
                found.append((np.full(len(ids), q), ids, d))
        return _told(found)

    # the vectors' part of a table is dealt by bucket, a group of crowded ones to several tasks; a query goes
    # where its buckets are
    indexed = entries.select("c", "v").mapInPandas(index, "t int, g long, code long, c long, v array<double>")
    crowd = indexed.groupBy("t", "g").agg(F.ceil(F.count("*") / (2 * ENTRIES)).cast("long").alias("parts")).where("parts > 1")
    crowd = small(stored(crowd, "vector-crowds"))
    parts = F.coalesce(F.col("parts"), F.lit(1).cast("long"))
    indexed = indexed.join(crowd, ["t", "g"], "left").withColumn("part", F.pmod(F.xxhash64("c"), parts)).drop("parts")
    asked = probing.mapInPandas(probes, "t int, g long, q long, v array<double>, codes array<long>")
    asked = asked.join(crowd, ["t", "g"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    keys = ["t", "g", "part"]
    found = indexed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(rank, "q long, c long, score double")
    found = stored(found.distinct(), "vector-found")

    # entries a query can have at most: itself and k others; with fewer found, all entries are ranked
    enough = min(k + 1, total)
    short = probing.join(found.groupBy("q").count().withColumnRenamed("q", "c"), "c", "left").where(F.coalesce("count", F.lit(0)) < enough).select("c", "v")
    short = stored(short, "vector-short")
    if not short.isEmpty():
        everywhere = short.select(F.col("c").alias("q"), "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).withColumn("g", F.col("g").cast("long"))
        all_ = entries.select(F.pmod(F.xxhash64("c"), F.lit(groups)).alias("g"), "c", "v")

        def rank_all(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return _told([])
            c, v = left["c"].to_numpy(), _matrix(left["v"])
            best = [(q, *_nearest(v, c, np.asarray(x, float), k + 1)) for q, x in zip(right["q"], right["v"], strict=True)]
            return _told([(np.full(len(ids), q), ids, d) for q, ids, d in best])

        more = all_.groupBy("g").cogroup(everywhere.groupBy("g")).applyInPandas(rank_all, "q long, c long, score double")
        found = found.unionByName(more).distinct()

    order = Window.partitionBy("q").orderBy("score", "c")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", "c", "score")
    members = best.join(entries.select("c", "ids"), "c").select(F.col("q").alias("c"), "score", F.explode("ids").alias("vec_id"))
    # the k + 1 nearest ids of an entry serve each query that has its vector
    top = Window.partitionBy("c").orderBy("score", "vec_id")
    members = members.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    lists = members.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answers = asking.join(lists, "c").select("query_id", F.expr(f"slice(filter(near, x -> x.vec_id != query_id), 1, {k})").alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
