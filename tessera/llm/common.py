"""What the operators of this subpackage share: tables in the shared folder, global order, reading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Only where it is unset, as in tests on one machine, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that this process has written into the shared folder.
_written: list[str] = []


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    The lineage ends there: a lost executor costs no recomputation of what came before, and values
    that depend on how rows were dealt out (such as partition numbers) stay as they were. Results are
    read lazily, so the tables stay until ``forget`` is called or the folder's own expiry takes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes the tables that ``stored`` has written so far, and tells how many.

    For the end of a job, when the results that were made of them have been written elsewhere.
    """
    jvm = spark.sparkContext._jvm
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def tidy(run: Callable) -> Callable:
    """``run``, a function over Arrow batches, that gives unused memory back when its task ends.

    Python workers outlive their tasks; without this each keeps the most that any task has needed.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, keys: list[str], name: str = "ranges") -> DataFrame:
    """Rows dealt by ranges of ``keys`` and stored, with ``part``, the number of the range.

    All keys of a part come before those of the next. Give it narrow rows (ids and sizes, no texts).
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *[F.col(k) for k in keys]).withColumn("part", F.spark_partition_id())
    return stored(dealt, name)


def running(ranged: DataFrame, keys: list[str], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Exclusive running sums over all rows in the order of ``keys``, without sorting all rows in one task.

    ``ranged`` comes from ``in_ranges``. ``sums`` maps a new column to what is summed; ``by`` names
    leading keys at which the sums start again. Each part is summed by itself; the totals, one row for
    each part (and value of ``by`` within it), give what came before it.
    """
    by = by or []
    own = Window.partitionBy("part", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part", *by).agg(*[F.sum(c).alias(f"_{n}_total") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", *by, *[F.coalesce(F.sum(f"_{n}_total").over(before), F.lit(0)).alias(f"_{n}_base") for n in sums])
    inner = ranged.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_{n}_own") for n, c in sums.items()])
    joined = inner.alias("i").join(base.alias("b"), [F.col("i.part") == F.col("b.part"), *[F.col(f"i.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]])
    return joined.select("i.*", *[(F.col(f"_{n}_own") + F.col(f"_{n}_base")).alias(n) for n in sums]).drop(*[f"_{n}_own" for n in sums])


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``copy``: 0, 1, 2 ... among the rows that agree in ``key``, which is never null.

    ``rows`` is a stored table with ``salt``, the number of the task that wrote the row. Rows of a key are
    counted for each task first, so a key that a third of all rows share is many tasks' work.
    """
    often = stored(rows.groupBy(key).count().where("count > 1").select(key), "numbered-keys")
    if often.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    some = rows.join(small(often), key)
    own = F.row_number().over(Window.partitionBy(key, "salt").orderBy(key)) - 1
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = stored(some.groupBy(key, "salt").agg(F.count("*").alias("n")).select(key, "salt", before.alias("before")), "numbered-tasks")
    told = some.withColumn("own", own).join(small(base), [key, "salt"]).withColumn("copy", F.col("own") + F.col("before"))
    single = rows.join(small(often), key, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return told.select(single.columns).unionByName(single)


#: Rows of a few numbers that are broadcast at most; beyond that a shuffle join takes over.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table of narrow rows, marked for broadcast if it has at most ``BROADCAST_ROWS``."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
