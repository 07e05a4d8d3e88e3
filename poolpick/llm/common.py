"""Reading, column shielding and shared-folder helpers of the operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolpick.session import checkpoint_dir, ship_package

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, a lost executor costs nothing.

    A query's result still reads its tables, so they go with the shared folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder among this application's tables in the shared one (``session.drop_tables`` deletes them)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that no later step reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins an aggregate of ``rows`` back to them.

    The keys' hash is a further key, so the aggregate's own partitioning does not serve the
    join: both sides are dealt anew, and a key that many rows share can be split.
    """
    mark = "__join_back"
    return rows.withColumn(mark, F.xxhash64(*keys)).join(groups.withColumn(mark, F.xxhash64(*keys)), [mark, *keys], how).drop(mark)


def has(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


def split_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


@contextmanager
def arrow_batch_bytes(spark: SparkSession, size: str):
    """Bounds the Arrow batches of the jobs inside the block, for whole texts beside other large buffers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
