"""Sharding by a k-d tree over the documents' metadata.

All documents are one node at first. A node is split at the weighted median of its widest metadata
dimension (its range there as a part of the whole table's range), weighted by bytes, until each leaf
holds its share of the bytes. Medians are exact and distributed: bytes are summed in bins of the
dimension, the bin that holds the median is binned again, and so on; only one bin a node reaches the
driver. Equal texts share the least of their metadata, and within equal values rows are ordered by
their text's hash, then by id. Large groups of equal texts go to the start or the end of their value's
order before the cut is looked for, so equal texts stay together wherever that is possible.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import in_ranges, running, small, stored

#: Bins of a node in one pass, and of all nodes of a level together.
BINS, ALL_BINS = 4096, 1 << 20
#: A cut moves aside for a group of equal texts by this part of a leaf at most.
GIVE = 0.02
#: A group of equal texts is large from this part of a leaf on; a table of n leaves has n / LARGE such at most.
LARGE = 2 * GIVE


def with_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the place, from 0, of a column's value among all its values by code point; null comes first."""
    values = in_ranges(rows.select(F.col(column).alias("value")).distinct(), ["value"], "shard-values")
    ranks = stored(running(values, ["value"], {name: F.lit(1)}).select("value", name), "shard-ranks")
    return rows.join(small(ranks), F.col(column).eqNullSafe(F.col("value"))).drop("value")


def shards(docs: DataFrame, count: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", dimensions: tuple[Column, ...] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row of ``docs``.

    ``count`` shards of nearly equal bytes, or as many as keep a leaf within ``target_bytes``. Size is
    the text's UTF-8 bytes plus 1. Slots count from 0 within a shard, by ascending id. ``dimensions`` are
    numbers; by default the language's and the source's place by code point, and the text's length.

    A null text is empty, a null dimension lies before all others, rows with a null id come first in
    their shard. Equal rows are rows of their own. Other columns play no part. An empty table gives an
    empty result. A group of equal texts is cut only where it is larger than ``LARGE`` of a leaf and along
    no dimension its value's other texts make up the part that must lie below the cut.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    named = {} if dimensions is not None else {"d0": F.col("lang").cast("string").alias("s0"), "d1": F.col("source").cast("string").alias("s1")}
    numbers = {f"d{i + len(named)}": x for i, x in enumerate(dimensions or (F.length(body),))}
    d = len(named) + len(numbers)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
        *named.values(),
        *[F.coalesce(x.cast("long"), F.lit(-2)).alias(name) for name, x in numbers.items()],
        F.lit(0).alias("node"),
    )
    rows = stored(rows, "shard-rows")
    for name in named:
        rows = with_rank(rows, f"s{name[1:]}", name).drop(f"s{name[1:]}")
    group = stored(rows.groupBy("h").agg(*[F.min(f"d{i}").alias(f"d{i}") for i in range(d)]), "shard-groups")
    rows = stored(rows.drop(*[f"d{i}" for i in range(d)]).join(group, "h"), "shard-rows")
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    count = count or max(1, -(-total // target_bytes))
    leaves = {0: count}  # by the first shard of each node
    whole = rows.agg(*[F.max(f"d{i}").alias(f"b{i}") for i in range(d)], *[F.min(f"d{i}").alias(f"a{i}") for i in range(d)]).first()
    while total and any(n > 1 for n in leaves.values()):
        rows = stored(_split(rows, leaves, [max(1, whole[f"b{i}"] - whole[f"a{i}"]) for i in range(d)], total / count), "shard-rows")
        leaves = {k: v for first, n in leaves.items() for k, v in ((first, n - n // 2), (first + n - n // 2, n // 2)) if v}
    keyed = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), "h")
    keys = ["shard", "doc_id", "h"]
    placed = running(in_ranges(keyed, keys, "shard-ranges"), keys, {"slot": F.lit(1)}, by=["shard"])
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def _start(n: dict) -> None:
    """The search for a node's cut along the next of its dimensions."""
    n["dim"] = n["dims"].pop(0)
    n |= dict(zip(("lo", "hi"), n["ends"][n["dim"]], strict=True)) | {"stage": 0, "need": n["goal"], "at": [], "up": [], "down": [], "all_down": False, "done": False}


def _aside(n: dict, large: list[tuple[int, int]], give: float) -> None:
    """Deals a value's large groups (hash, bytes; the largest first) to both sides of a node's cut.

    What is left to find is a cut among the value's other texts, unless these all lie on one side. Where a
    group would have to be cut, the next widest dimension is tried; along the last one it is.
    """
    sizes = dict(large)
    for h, size in large:
        n["all"] -= size
        if size <= n["need"]:
            n["down"].append(h)
            n["need"] -= size
        else:
            n["up"].append(h)
    if 0 < n["need"] < n["all"]:
        return
    n["done"], n["whole"] = True, False
    if n["need"] == 0:
        n["at"].append(-(2**63))
        n["whole"] = True
        return
    n["need"] -= n["all"]
    if n["need"]:  # the last group that went up is the least of them, and larger than this
        h = n["up"][-1]
        if min(n["need"], sizes[h] - n["need"]) > give:
            if n["dims"]:
                return _start(n)  # along another dimension no group may have to be cut
            n["up"].pop()
            n["at"].append(h)
            n["done"], n["stage"], n["all_down"] = False, 2, True
            return
        if n["need"] * 2 > sizes[h]:
            n["down"].append(n["up"].pop())
    n["at"].append(2**63 - 1)


def _split(rows: DataFrame, leaves: dict[int, int], spans: list[int], leaf: float) -> DataFrame:
    """Every node of two leaves or more cut in two; the upper part gets the number of its first leaf."""
    spark = rows.sparkSession
    d = len(spans)
    stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[F.min(f"d{i}").alias(f"a{i}") for i in range(d)], *[F.max(f"d{i}").alias(f"b{i}") for i in range(d)])
    nodes = {}  # as many as there are shards at most
    for r in stats.collect():
        if leaves[r["node"]] > 1:
            widest = sorted(range(d), key=lambda i: ((r[f"a{i}"] - r[f"b{i}"]) / spans[i], i))
            lower = leaves[r["node"]] - leaves[r["node"]] // 2
            nodes[r["node"]] = {"dims": widest, "ends": [(r[f"a{i}"], r[f"b{i}"]) for i in range(d)], "goal": r["bytes"] * lower // leaves[r["node"]]}
            _start(nodes[r["node"]])

    value = F.col(f"d{d - 1}")
    for i in range(d - 1):
        value = F.when(F.col("dim") == i, F.col(f"d{i}")).otherwise(value)
    names = "node int, dim int, stage int, lo long, hi long, width decimal(20,0), need long, c0 long, c1 long, moved array<long>"
    while any(not n["done"] for n in nodes.values()):
        open_ = {k: n for k, n in nodes.items() if not n["done"]}
        bins = max(16, min(BINS, ALL_BINS // len(open_)))
        state = [(k, n["dim"], n["stage"], n["lo"], n["hi"], Decimal(-(-(n["hi"] - n["lo"] + 1) // bins)), n["need"], *[*n["at"], 0, 0][:2], n["up"] + n["down"]) for k, n in open_.items()]
        near = rows.join(F.broadcast(spark.createDataFrame(state, names)), "node")
        v = F.when(F.col("stage") == 0, value).when(F.col("stage") == 1, F.col("h")).otherwise(F.coalesce("doc_id", F.lit(-(2**63))))
        near = near.withColumn("v", v).where("stage = 0 or (case " + " ".join(f"when dim = {i} then d{i}" for i in range(d)) + " end = c0 and (stage = 1 and not array_contains(moved, h) or stage = 2 and h = c1))").where("v between lo and hi")
        near = near.withColumn("bin", F.floor((F.col("v").cast("decimal(20,0)") - F.col("lo")) / F.col("width")).cast("long"))
        per = near.groupBy("node", "need", "bin").agg(F.sum("size").alias("bytes"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))  # at most BINS rows a node
        entered: dict[int, dict] = {}
        found = per.withColumn("upto", upto).where("upto > need and upto - bytes <= need").collect()
        for r in found:
            n = nodes[r["node"]]
            n["need"] -= r["upto"] - r["bytes"]
            n["lo"], n["hi"] = r["lo"], r["hi"]
            if r["lo"] < r["hi"]:
                continue
            # the cut's value in this stage; r["bytes"] are all bytes of that value
            n["at"].append(r["lo"])
            give = GIVE * leaf if n["stage"] == 1 else 0
            if n["stage"] == 2 or min(n["need"], r["bytes"] - n["need"]) <= give:
                n["done"], n["whole"] = True, n["need"] * 2 <= r["bytes"]  # True: what equals the cut goes up
                continue
            n["all"] = r["bytes"]
            n["stage"] += 1
            n["lo"], n["hi"] = -(2**63), 2**63 - 1
            if n["stage"] == 1:
                entered[r["node"]] = n
        if entered:
            of = F.broadcast(spark.createDataFrame([(k, n["dim"], n["at"][0]) for k, n in entered.items()], "node int, dim int, c0 long"))
            large = rows.join(of, "node").where(value == F.col("c0")).groupBy("node", "h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > LARGE * leaf).collect()
            for k, n in entered.items():
                _aside(n, sorted(((r["h"], r["bytes"]) for r in large if r["node"] == k), key=lambda x: (-x[1], x[0])), GIVE * leaf)
        missing = {r["node"] for r in found} ^ set(open_)
        if missing:
            raise ValueError(f"no cut found for nodes {sorted(missing)[:5]}")
    cuts = [(k, n["dim"], len(n["at"]), *[*n["at"], 0, 0, 0][:3], n["whole"], k + leaves[k] - leaves[k] // 2, n["up"], n["down"], n["all_down"]) for k, n in nodes.items()]
    cut = F.broadcast(spark.createDataFrame(cuts, "node int, dim int, depth int, c0 long, c1 long, c2 long, equal_up boolean, upper int, up array<long>, down array<long>, all_down boolean"))
    joined = rows.join(cut, "node", "left")
    ids = F.coalesce("doc_id", F.lit(-(2**63)))
    beyond = F.when(value != F.col("c0"), value > F.col("c0"))
    beyond = beyond.when(F.col("depth") == 1, F.col("equal_up")).when(F.array_contains("up", F.col("h")), True).when(F.array_contains("down", F.col("h")), False).when(F.col("h") != F.col("c1"), ~F.col("all_down") & (F.col("h") > F.col("c1")))
    beyond = beyond.when(F.col("depth") == 2, F.col("equal_up")).when(ids != F.col("c2"), ids > F.col("c2")).otherwise(F.col("equal_up"))
    node = F.when(F.col("upper").isNotNull() & beyond, F.col("upper")).otherwise(F.col("node"))
    return joined.select(*[c for c in rows.columns if c != "node"], node.alias("node"))
