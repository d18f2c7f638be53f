"""The given tables, and tasks derived from them by arithmetic: they hold no grids themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_grid(key: Column) -> Column:
    """1 + key % 5 rows of 1 + key div 5 % 6 cells (7 key + 3 r + 5 c + r c) % 10, of negative keys too: none where that is below one."""
    key = key.cast("long")
    rows, cols = (1 + key % 5).cast("int"), (1 + F.call_function("div", key, F.lit(5)) % 6).cast("int")  # whole numbers: a double is inexact beyond 2^53
    upto = lambda n: F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))  # noqa: E731  null for null
    cell = lambda r, c: ((key * 7 + r * 3 + c * 5 + r * c) % 10).cast("int")
    return F.transform(upto(rows), lambda r: F.transform(upto(cols), lambda c: cell(r, c)))


def large_grid(key: Column) -> Column:
    """1 + key % 30 rows of 1 + 7 key % 30 cells (7 key + 3 r + 5 c + r c) % 10: up to the largest side."""
    key = key.cast("long")
    rows, cols = (1 + key % 30).cast("int"), (1 + key * 7 % 30).cast("int")
    row = lambda first, step: F.transform(F.sequence(first, first + step * (cols - 1), step), lambda v: (v % 10).cast("int"))
    return F.transform(F.sequence(F.lit(0).cast("long"), (rows - 1).cast("long")), lambda r: row(key * 7 + r * 3, r + 5))


def derived_sample(key: Column) -> Column:
    return F.struct(derived_grid(key).alias("input"), derived_grid(key * 3 + 1).alias("output"))


def derived_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, task_id, train, test): three training samples and one test sample for each part."""
    key = F.col("p_partkey")
    train = F.array(*(derived_sample(key * 4 + t) for t in range(3)))
    return table(spark, sf_dir, "part").select(key.alias("key"), F.format_string("task_%08x", key).alias("task_id"), train.alias("train"), F.array(derived_sample(key * 4 + 3)).alias("test"))
