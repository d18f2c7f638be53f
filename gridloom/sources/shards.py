"""Sharded task datasets: folders shard=S/chunk=C of JSON lines, with a table of what each holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import partition
from gridloom.sources import jsonl


def write(tasks: DataFrame, path: str, shards: int, chunk_bytes: int, idx: str = "idx", drop_remainder: bool = False) -> DataFrame:
    """tasks (idx, task_id, train, test) in contiguous shards of chunks of chunk_bytes at most; returns and writes metadata.

    A chunk is closed before the line that would take it over its size; a longer line has
    one to itself. Rows that don't divide evenly go to the last shard, or are dropped.
    """
    total = F.lit(tasks.count())
    shard = partition.contiguous(F.col(idx), total, shards, drop_remainder)
    rows = tasks.select(idx, "task_id", F.to_json(F.struct("task_id", "train", "test")).alias("value"), shard.alias("shard")).where("shard is not null")
    rows = partition.pack(rows, "shard", idx, F.octet_length("value") + 1, chunk_bytes).withColumnRenamed("pack", "chunk")
    rows.select("value", "shard", "chunk").write.partitionBy("shard", "chunk").text(f"{path}/data")
    about = rows.groupBy("shard", "chunk").agg(F.count("*").alias("tasks"), F.sum(F.octet_length("value") + 1).alias("bytes")).withColumn("status", F.lit("available"))
    about.write.parquet(f"{path}/metadata")
    return tasks.sparkSession.read.parquet(f"{path}/metadata")


def write_counted(tasks: DataFrame, path: str, per_shard: int = 1000, per_chunk: int = 100, idx: str = "idx") -> DataFrame:
    """tasks (idx, task_id, train, test) in shards of so many rows, in chunks of so many; returns and writes metadata. idx: 0, 1, 2, ..."""
    shard, chunk = partition.shard_and_chunk(F.col(idx), per_shard, per_chunk)
    rows = tasks.select(idx, F.to_json(F.struct("task_id", "train", "test")).alias("value"), shard.alias("shard"), chunk.alias("chunk"))
    rows.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", idx).select("value", "shard", "chunk").write.partitionBy("shard", "chunk").text(f"{path}/data")
    about = rows.groupBy("shard", "chunk").agg(F.count("*").alias("tasks"), F.sum(F.octet_length("value") + 1).alias("bytes")).withColumn("status", F.lit("available"))
    about.write.parquet(f"{path}/metadata")
    return tasks.sparkSession.read.parquet(f"{path}/metadata")


def read(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The tasks (line_idx, chunk, task_id, train, test) of one shard; its folder alone is read.

    A line that is no JSON ends its chunk. A task without an id is named by how many ids
    came before it; of equal ids the last task stays, at the place of the first. An empty
    or absent shard gives no rows.
    """
    at = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")
    lines = spark.read.text(f"{path}/data").where(F.col("shard") == shard).select("chunk", *at, F.col("value").alias("line"))
    lines = partition.global_index(lines, "chunk", "_file", "_start", "_at", to="line_idx").select("line_idx", "chunk", "line")
    bad = lines.where(F.try_parse_json("line").isNull()).groupBy("chunk").agg(F.min("line_idx").alias("_bad"))
    lines = lines.join(bad, "chunk", "left").where(F.coalesce(F.col("line_idx") < F.col("_bad"), F.lit(True))).drop("_bad")
    rows = jsonl.parsed_tasks(lines).drop("line")
    new = F.col("task_id").isNull() | (F.row_number().over(Window.partitionBy("task_id").orderBy("line_idx")) == 1)
    places = partition.global_index(rows.withColumn("_new", new).where("_new").select("line_idx"), "line_idx", to="_place")
    rows = rows.join(places, "line_idx", "left").withColumn("task_id", F.coalesce("task_id", partition.task_id_of(F.col("_place")))).drop("_place")
    return jsonl.last_wins(rows).drop("line_idx").withColumnRenamed("first_idx", "line_idx").select("line_idx", "chunk", "task_id", "train", "test")
