"""Sources and sinks of task and text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators.partition import global_index, stream_of, task_id_of


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_idx, file, line): lines of text files numbered over all files in the order of their names; no files or empty ones give no rows."""
    at = F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")  # a file's splits can be read in any order
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), *at)
    return global_index(read, "file", "_start", "_at", to="line_idx").select("line_idx", "file", F.col("value").alias("line"))


def parsed_tasks(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with task_id, train and test; lines that aren't a JSON object are dropped, records without train or test raise."""
    task = F.from_json(line, grid.TASK, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(line)
    rows = rows.withColumn("_task", task).where(whole.isNotNull() & F.expr(f"schema_of_variant(try_parse_json({line}))").startswith("OBJECT"))
    need = lambda c: F.when(F.col(f"_task.{c}").isNull(), F.raise_error(F.lit(f"a task lacks {c}"))).otherwise(F.col(f"_task.{c}")).alias(c)
    return rows.select("*", F.col("_task.task_id").alias("task_id"), need("train"), need("test")).drop("_task")


def unique_ids(rows: DataFrame, idx: str = "line_idx", to: str = "task_id") -> DataFrame:
    """Missing ids, and ids met before, become task_%08x of the line number."""
    given = F.coalesce(F.col("task_id"), task_id_of(F.col(idx)))
    first = F.row_number().over(Window.partitionBy(given).orderBy(idx)) == 1
    return rows.withColumn(to, F.when(first, given).otherwise(task_id_of(F.col(idx))))


def last_wins(rows: DataFrame, idx: str = "line_idx") -> DataFrame:
    """One row for each id: the content of its last line at the place of its first (first_idx)."""
    given = rows.withColumn("task_id", F.coalesce(F.col("task_id"), task_id_of(F.col(idx))))
    rest = [c for c in rows.columns if c != "task_id"]
    best = given.groupBy("task_id").agg(F.max_by(F.struct(*rest), idx).alias("_r"), F.min(idx).alias("first_idx"))
    return best.select("task_id", "first_idx", "_r.*")


def text_record(line: Column, idx: Column) -> Column:
    """(id, text) of a JSON record: text, else content, else empty; id, else the line number."""
    text = F.coalesce(F.get_json_object(line, "$.text"), F.get_json_object(line, "$.content"), F.lit(""))
    return F.struct(F.coalesce(F.get_json_object(line, "$.id"), idx.cast("string")).alias("id"), text.alias("text"))


def read_object(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(task_id, train, test) of one JSON object {task_id: task}; the first n by id."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<train:array<{grid.SAMPLE}>,test:array<{grid.SAMPLE}>>>")).alias("task_id", "t")).select("task_id", "t.*")
    return pairs.orderBy("task_id").limit(first) if first else pairs


#: How tasks are read, by kind of dataset; callers can add to it.
READERS = {
    "jsonl": lambda spark, path: unique_ids(parsed_tasks(lines(spark, path))),
    "arc": lambda spark, path: global_index(read_object(spark, path), "task_id", to="line_idx"),
}


def read_tasks(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """(line_idx, task_id, train, test, ...) of a dataset; ValueError for a kind that isn't registered."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of dataset {kind}; known: {sorted(READERS)}")
    return READERS[kind](spark, path)


def window_of(rows: DataFrame, idx: str, start: int, stop: int) -> DataFrame:
    return rows.where((F.col(idx) >= start) & (F.col(idx) < stop))


def dataset_shard(rows: DataFrame, idx: str, shards: int, index: int, most: int | None = None) -> DataFrame:
    """Every shards-th row, and the first of those."""
    mine = rows.where(F.col(idx) % shards == index)
    return mine.where(F.floor(F.col(idx) / shards) < most) if most is not None else mine


def write_tasks(tasks: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object a line; by: a folder for each value of that column, its rows together in one task's files."""
    line = F.to_json(F.struct("task_id", "train", "test")).alias("value")
    if by:
        tasks.select(line, by).repartition(by).write.partitionBy(by).text(path)
    else:
        tasks.select(line).write.text(path)


def write_streams(converted: DataFrame, path: str, streams: int, idx: str = "idx") -> DataFrame:
    """Converted rows (idx, task_id, train, test, reject) dealt to folders of streams; (stream_id, written, invalid) of each."""
    rows = converted.withColumn("stream_id", stream_of(F.col(idx), streams))
    write_tasks(rows.where("reject is null"), path, "stream_id")
    return rows.groupBy("stream_id").agg(F.count_if(F.col("reject").isNull()).alias("written"), F.count_if(F.col("reject").isNotNull()).alias("invalid"))
