"""Best-fit packing under conflicts.

Documents are packed into bins of a fixed capacity. A bin carries a bitmap of the sources and one of the
duplicate clusters it holds, and a document goes only where neither has its bit. Bins are ordered by
residual capacity; the search starts at the least residual that takes the document and goes on to the
next larger one until a bin is compatible, so each document gets the tightest compatible bin. Documents
come in descending size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, numbered, stored

#: Documents that are packed together.
BLOCK = 4096


class Bins:
    """Open bins by residual, and within it by source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels: list[int] = []
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}  # residual: sources: (bin, clusters)
        self.count = 0

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that takes a document with these bits, and the residual it had."""
        for residual in self.levels[bisect_left(self.levels, size) :]:
            for sources, bins in self.at[residual].items():
                if sources & source:
                    continue
                for k, (number, clusters) in enumerate(bins):
                    if not clusters & cluster:
                        del bins[k]
                        if not bins:
                            del self.at[residual][sources]
                            if not self.at[residual]:
                                del self.at[residual], self.levels[bisect_left(self.levels, residual)]
                        self._put(residual - size, sources | source, number, clusters | cluster)
                        return number, residual
        self.count += 1
        self._put(self.capacity - size, source, self.count - 1, cluster)
        return self.count - 1, self.capacity

    def _put(self, residual: int, sources: int, number: int, clusters: int) -> None:
        if residual not in self.at:
            self.at[residual] = {}
            insort(self.levels, residual)
        self.at[residual].setdefault(sources, []).append((number, clusters))


def _bits(keys: pd.Series) -> list[int]:
    """A bit for each key that occurs more than once; others, and null, can't conflict and have none."""
    often = keys[keys.notna() & keys.duplicated(keep=False)]
    bit = {x: 1 << k for k, x in enumerate(sorted(set(often)))}
    return [bit.get(x, 0) if pd.notna(x) else 0 for x in keys]


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["hash", "doc_id", "size"], kind="stable", ignore_index=True)
    pieces = []
    for k, size in enumerate(rows["size"].astype(int)):
        pieces += [(k, p, p * capacity, capacity) for p in range(size // capacity)]
        if size % capacity or not size:
            pieces.append((k, size // capacity, size // capacity * capacity, size % capacity))
    sources, clusters = _bits(rows["source"]), _bits(rows["cluster"])
    bins, out = Bins(capacity), []
    for k, piece, start, size in sorted(pieces, key=lambda x: (-x[3], x[0], x[1])):
        if size == capacity:
            bins.count += 1  # a bin of its own, full at once
            number, residual = bins.count - 1, capacity
        else:
            number, residual = bins.place(size, sources[k], clusters[k])
        out.append((k, piece, start, size, number, capacity - residual))
    found = pd.DataFrame(out, columns=["k", "piece", "start", "size", "number", "place"])
    group = rows["group"].iloc[0] if len(rows) else 0
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"].take(found["k"]).to_numpy(),
            "piece": found["piece"],
            "start": found["start"],
            "size": found["size"],
            "bin": group * (1 << 32) + found["number"],
            "place": found["place"],
        }
    )


def pack(docs: DataFrame, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """``doc_id, piece, start, size, bin, place``: where each piece of each row of ``docs`` goes.

    Sizes are words. A document longer than a bin is cut into pieces at every ``capacity`` words; full
    pieces are bins of their own. No bin holds two pieces of one source or of one duplicate cluster
    (``cluster`` names a column; by default equal words in order, whatever their case, are a cluster).
    ``place`` is the piece's first word in its bin. Null sources and clusters conflict with nothing.

    A null or empty text is a piece of no words and still gets a bin. Repeated rows are documents of
    their own that conflict. A null id is kept. Other columns play no part; an empty table gives none.
    Documents are packed in blocks of about ``BLOCK``, dealt by a hash of id, source, size and cluster and
    a number among rows that agree in these, so sources, clusters and ids of any size are many tasks.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(body, F.lit(WORD)).cast("long")
    same = F.xxhash64(F.lower(F.trim(F.regexp_replace(body, r"[\x20\x09-\x0D]+", " ")))) if cluster is None else F.col(cluster)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), same.alias("cluster"))
    # a null changes no hash, so whether it is one is hashed too
    named = F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "size", "cluster")
    rows = stored(rows.withColumns({"key": named, "salt": F.spark_partition_id()}), "pack-rows")
    groups = max(1, -(-rows.count() // BLOCK))
    rows = numbered(rows, "key").withColumn("hash", F.xxhash64("key", "copy"))
    rows = rows.withColumn("group", F.pmod(F.col("hash"), F.lit(groups))).drop("key", "salt", "copy")
    return rows.groupBy("group").applyInPandas(lambda x: _pack(x, capacity), "doc_id long, piece int, start long, size long, bin long, place long")
