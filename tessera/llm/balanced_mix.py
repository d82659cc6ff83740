"""Mixing sources to target weights by the cube method.

Every source gets a target; a document of a source is taken ``floor(target / source size)`` times
surely and once more with the remaining probability. The cube method turns these probabilities into
choices: it moves them along the null space of the balancing constraints (the source's number of
documents and its number of words), so both totals stay exactly what they were until at most two
documents of a source are undecided; with a few others these land on the choice that errs least.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, numbered, shuffle_partitions, small, stored

#: Documents that one task balances at a time.
BLOCK = 2048
#: Documents that are decided anew with the undecided two at the very end of a source.
LANDING = 12
#: Copies of one row that a task makes at a time.
LOT = 1000


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, n_docs, target``: one row a source.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all sizes by
    weight. A target stops at ``most`` times its source's size; the excess is shared again by weight
    until none is above. That fixed point is found at once: by ascending size over weight, a source is
    stopped while what is left for it and those after it would exceed its limit.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights)) + 1))
    per = per.withColumn("stop", most * F.col("source_size")).withColumn("all", share * F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("stopped", (F.col("all") - before) * F.col("w") / rest >= F.col("stop"))
    whole = Window.partitionBy()
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))).over(whole), F.lit(0.0))
    free = F.sum(F.when(~F.col("stopped"), F.col("w"))).over(whole)
    return per.select("source", "source_size", "n_docs", F.when(F.col("stopped"), F.col("stop")).otherwise(left * F.col("w") / free).alias("target"))


def flight(p: list[float], sizes: list[int], rng: random.Random) -> list[float]:
    """Moves ``p`` through the null space of (1, size) until at most two entries are inside (0, 1).

    Three undecided entries have a direction that changes neither the sum of ``p`` nor the sum of
    ``p * size``; a step along it, its sign drawn so that expectations stay, ends where an entry
    reaches 0 or 1. With two entries left, of equal size, the sum of both still holds along (1, -1).
    """
    eps = 1e-9
    live: list[int] = []
    for k in [*range(len(p)), -1]:
        if k >= 0:
            if not eps < p[k] < 1 - eps:
                p[k] = float(round(p[k]))
                continue
            live.append(k)
        while len(live) == 3 or k < 0 and len(live) == 2 and sizes[live[0]] == sizes[live[1]]:
            a, b = live[:2]
            u = [1.0, -1.0, 0.0]
            if len(live) == 3 and not sizes[a] == sizes[b]:
                c = live[2]
                u = [float(sizes[b] - sizes[c]), float(sizes[c] - sizes[a]), float(sizes[a] - sizes[b])]
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(live, u, strict=False) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(live, u, strict=False) if x)
            step = up if rng.random() * (up + down) < down else -down
            for i, x in zip(live, u, strict=False):
                p[i] += step * x
                if p[i] <= eps or p[i] >= 1 - eps:
                    p[i] = float(round(p[i]))
            live = [i for i in live if 0 < p[i] < 1]
    return p


def land(p: list[float], sizes: list[int], words: float, number: float) -> list[float]:
    """Decides what the flight has left, along with ``LANDING`` entries of sizes as different as can be.

    Of all ways to decide these few, the one whose total of sizes is nearest to ``words`` is taken, and
    among such the one whose number is nearest to ``number``.
    """
    live = [i for i, x in enumerate(p) if 0 < x < 1]
    if not live:
        return p
    by: dict[int, list[int]] = {}
    for i, x in enumerate(sizes):
        by.setdefault(x, []).append(i)
    kinds = sorted(by)
    kinds = [kinds[k * len(kinds) // LANDING] for k in range(LANDING)] if len(kinds) > LANDING else kinds
    turns = [by[x][n] for n in range(LANDING) for x in kinds if n < len(by[x])]
    free = sorted({*live, *turns[:LANDING]})
    ways = (np.arange(1 << len(free))[:, None] >> np.arange(len(free))) & 1
    kept = sorted(set(range(len(p))) - set(free))
    off_words = np.abs(ways @ np.array([sizes[i] for i in free]) + sum(p[i] * sizes[i] for i in kept) - words)
    off_number = np.abs(ways.sum(1) + sum(p[i] for i in kept) - number)
    best = np.lexsort((np.arange(len(ways)), off_number, off_words))[0]
    for i, x in zip(free, ways[best], strict=True):
        p[i] = float(x)
    return p


def _balance(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["hash", "doc_id", "size"], kind="stable", ignore_index=True)
    sizes = rows["size"].astype(int).tolist()
    words, number = float((rows["p"] * rows["size"]).sum()), float(rows["p"].sum())
    p = flight(rows["p"].tolist(), sizes, random.Random(int(rows["hash"].min()) ^ len(rows)))
    if rows["blocks"].iloc[0] == 1:
        p = land(p, sizes, words, number)
    return rows.assign(p=p).drop(columns="block")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, copies``: one row for each row of ``docs``.

    ``copies`` is how often the mix takes the document, 0 to ``ceil(most)``; a source's words taken come
    within about one document of its target. Choices follow from hashes of ids, so reruns agree.

    A null text is empty and has size 0; null sources are one source, the last. Repeated rows are
    documents of their own. A null id is a value like any other. Rows of a source without a word are
    taken ``floor(share)`` times nothing: 0. Other columns play no part; an empty table gives none.
    Sources are balanced in blocks of about ``BLOCK`` documents, dealt by a hash of id, text and a number
    among rows that agree in these, so a hot source or id is many tasks; what a block leaves undecided
    (two documents at most) goes to the next round, until a source's last block decides all it has.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text_hash"), F.col(source).cast("string").alias("source"), size.alias("size"))
    key = F.xxhash64(F.lit(seed), "doc_id", F.col("doc_id").isNull(), "text_hash", "source", F.col("source").isNull())
    rows = stored(rows.withColumns({"key": key, "salt": F.spark_partition_id()}), "mix-sizes")
    per = stored(targets(rows, weights, share, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = numbered(rows, "key").withColumn("hash", F.xxhash64("key", "copy")).drop("key", "salt", "copy")
    keyed = _with_source(rows, per.select("source", "source_size", "target", ratio.alias("ratio")))
    keyed = keyed.withColumn("sure", F.floor("ratio").cast("int")).withColumn("p", F.col("ratio") - F.floor("ratio"))
    columns = ["doc_id", "text_hash", "source", "size", "source_size", "target", "sure", "p", "hash"]
    decided, live = [keyed.where("p <= 1e-9 or p >= 1 - 1e-9").withColumn("p", F.round("p")).select(columns)], keyed.where("p > 1e-9 and p < 1 - 1e-9").select(columns)
    schema = "doc_id long, text_hash long, source string, size long, source_size long, target double, sure int, p double, hash long, blocks long"
    turn = 0
    while turn == 0 or not live.isEmpty():
        blocks = live.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        out = _with_source(live, blocks).withColumn("block", F.pmod(F.xxhash64("hash", F.lit(turn)), "blocks"))
        out = stored(out.groupBy("source", "block").applyInPandas(_balance, schema), "mix-round")
        decided.append(out.where("p = 0 or p = 1").select(columns))
        live = out.where("p > 0 and p < 1").select(columns)
        turn += 1
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("sure") + F.col("p").cast("int")).alias("copies"))


def _with_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with the columns of their source's only row in ``per``; null is a source too."""
    extra = [c for c in per.columns if c != "source"]
    return rows.alias("r").join(per.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", *[f"s.{c}" for c in extra])


def repeated(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, as often as ``mixed`` (from ``mix``) takes them.

    Rows are told by id (null is one) and text. Of rows that agree in both one stands for all, as often as
    they are taken together.
    """
    own = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg(F.sum("copies").alias("_taken"), F.count("*").alias("_rows"))
    own = stored(own.where("_taken > 0"), "mix-chosen")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_h"))
    taken = docs.join(small(own.where("_rows = 1")), same).withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_taken")))).select(docs.columns)
    again = own.where("_rows > 1")
    if again.isEmpty():
        return taken
    one = docs.join(small(again), same).dropDuplicates(["_id", "_h"])
    # a row that stands very often is multiplied by many tasks
    lots = one.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / LOT)))).repartition(shuffle_partitions(docs.sparkSession), "_id", "_h", "_lot")
    many = lots.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT), F.col("_taken") - F.col("_lot") * LOT))))
    return taken.unionByName(many.select(docs.columns))
