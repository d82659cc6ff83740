"""Tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input a core up to which dealing rows out anew costs less than leaving cores idle.
SMALL_SHARE = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it is read from a few small files, else as it is.

    A small file is often a single row group, which a single task reads; work on every row is then
    worth a shuffle of the little there is. Large inputs have row groups enough and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SMALL_SHARE * cores else df
