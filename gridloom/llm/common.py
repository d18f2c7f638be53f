"""Helpers shared by the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import shared

#: Words are runs of anything but ASCII white space (space, \t..\r).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Row numbers that are sent to all tasks at most: 8 MB of them.
MOST_IDS = 1_000_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spool(df: DataFrame, name: str, *by: str, compression: str = "zstd") -> DataFrame:
    """df written once as Parquet to the shared folder and read again: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = shared.fresh(spark, name)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, most: int = 50_000) -> DataFrame:
    """df spooled; a join sends it to all tasks if it has at most `most` rows, else Spark joins it as any other frame."""
    df = spool(df, name)
    return F.broadcast(df) if df.count() <= most else df


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def clear_spools() -> None:
    """Delete all that spool() has written; for when the results that read it are no longer needed."""
    while _written:
        spark, path = _written.pop()
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def fold(column: str = "doc_id", by: int = 1):
    """crc32 of the id as text, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


def row_number(row: str | None):
    """The given column of unique numbers, or one made from partition and place."""
    return F.col(row).cast("long") if row else F.monotonically_increasing_id()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
