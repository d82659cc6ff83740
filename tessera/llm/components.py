"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, tidy

#: Nodes that a task's union-find holds at a time; it tells them and starts anew beyond that.
HELD = 500_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its least node.

    First each task joins the edges it has by union-find, in bounded memory, so that a node with very many
    edges stands at most once a task as the larger end. Then rounds: every node hangs on the least
    of its parents, its other parents are hung on that one, and the node moves up to the least parent's own
    least parent. Chains halve in each round; when nothing moves, all nodes hang on their component's
    least node. A round is a grouped minimum (summed before the shuffle) and two joins by a node.

    Edges with a null end and loops say nothing; repeated edges count once.
    """
    real = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    up = stored(real.mapInArrow(tidy(_joined), "u long, v long"), "components")
    while True:
        least = up.groupBy("u").agg(F.min("v").alias("p"))
        others = up.join(least, "u").where("v != p").select(F.col("v").alias("u"), F.col("p").alias("v"), F.lit(True).alias("moved"))
        jump = least.alias("x").join(least.alias("y"), F.col("x.p") == F.col("y.u"), "left")
        jump = jump.select(F.col("x.u").alias("u"), F.coalesce("y.p", "x.p").alias("v"), F.col("y.p").isNotNull().alias("moved"))
        now = stored(jump.unionByName(others), "components")
        up = now.select("u", "v")
        if now.where("moved").isEmpty():
            break
    return up.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(up.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of some edges beside the least node that these edges join it to, unless that is itself."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def told() -> pa.RecordBatch:
        found = np.array([(x, find(x)) for x in list(root)], np.int64).reshape(-1, 2)
        found = found[found[:, 0] != found[:, 1]]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
        if len(root) > HELD:
            yield told()
    yield told()
