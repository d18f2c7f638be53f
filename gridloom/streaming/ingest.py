"""Resumable ingestion by Structured Streaming: what a stream has done is its checkpoint, so a rerun goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType | str, out: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, pattern: str | None = None, fmt: str = "parquet", files_per_batch: int = 100, by: tuple[str, ...] = ()) -> None:
    """Everything new under source, changed and appended to out as Parquet, each batch once."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    writer = change(reader.load(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    (writer.partitionBy(*by) if by else writer).start().awaitTermination()


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Counts of events by window of time and keys; rows later than `late` after the newest are left out of closed windows."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    return rows.withWatermark("_ts", late).groupBy(F.window("_ts", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
