"""Assigning rows to streams, hosts, shards, chunks and batches.

All rules but the two packers are arithmetic on a global index, so they need no shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import written


def global_index(df: DataFrame, *order: str, to: str = "idx", buckets: int | None = None) -> DataFrame:
    """df with 0, 1, 2, ... in the given order, which must be total; nulls first.

    Rows are dealt out by ranges of the order, numbered within, and offset by the sizes
    of the ranges before; only a row for each range meets in one task. What is numbered
    within ranges is written once to the shared folder: planned twice, the ranges of the
    rows and of their counts would be drawn from two samples. An empty df stays empty.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    local = written(dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1), "global-index")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # a row for each of n ranges
    return local.join(offsets, "_part").withColumn(to, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def stream_of(idx: Column, streams: int) -> Column:
    return (idx % streams).cast("int")


def task_id_of(idx: Column) -> Column:
    return F.format_string("task_%08x", idx)


def machine_filter(idx: Column, machine: int, machines: int) -> Column:
    if not 0 <= machine < machines:
        raise ValueError("machine must be below machines")
    return idx % machines == machine


def host_filter(idx: Column, host: int, hosts: int, machines: int) -> Column:
    """The second level: of a machine's rows those of one host."""
    return F.floor(idx / machines) % hosts == host


def balanced(idx: Column, total: Column, parts: int) -> Column:
    """Contiguous parts whose sizes differ by one at most, the larger first."""
    base, more = F.floor(total / parts), total % parts
    edge = more * (base + 1)
    return F.when(idx < edge, F.floor(idx / (base + 1))).otherwise(more + F.floor((idx - edge) / F.greatest(base, F.lit(1)))).cast("int")


def contiguous(idx: Column, total: Column, parts: int, drop_remainder: bool = False) -> Column:
    """Parts of floor(total / parts) rows; the rest go to the last part, or to none (null)."""
    size = F.greatest(F.floor(total / parts), F.lit(1))
    part = F.floor(idx / size)
    return F.when(part < parts, part).otherwise(F.lit(None) if drop_remainder else F.lit(parts - 1)).cast("int")


def shard_and_chunk(idx: Column, per_shard: int = 1000, per_chunk: int = 100) -> tuple[Column, Column]:
    return F.floor(idx / per_shard).cast("int"), F.floor((idx % per_shard) / per_chunk).cast("int")


def batch_of(idx: Column, size: int) -> Column:
    return F.floor(idx / size).cast("long")


def equal_shards(rank: Column, row_bytes: int, limit: int) -> Column:
    """Shard numbers, from 1 on, of rows of equal size: a shard is closed by the row that fills it."""
    each = -(-limit // row_bytes)
    return (F.floor(rank / each) + 1).cast("int")


def _packs(sizes: np.ndarray, held: int, number: int, limit: int, close_first: bool) -> tuple[np.ndarray, int, int]:
    """Pack numbers of rows in order after a pack `number` that holds `held`, and what is open then. One step for each pack."""
    total = np.r_[0, np.cumsum(sizes)]
    out, at = np.empty(len(sizes), np.int64), 0
    while at < len(sizes):
        if close_first:
            stop = max(at, int(np.searchsorted(total, total[at] + limit - held, side="right")) - 1)  # rows up to it fit
            stop += held + total[stop] == total[at] and stop < len(sizes)  # a row over the limit goes where nothing is held
        else:
            stop = min(int(np.searchsorted(total, total[at] + limit - held)), len(sizes))
            stop = max(stop, at + 1)
        out[at:stop] = number
        held += int(total[stop] - total[at])
        at = stop
        if at < len(sizes) if close_first else held >= limit:
            number, held = number + 1, 0
    return out, held, number


def pack(df: DataFrame, by: str, order: str, size: Column, limit: int, close_first: bool = True, overhead: int = 0) -> DataFrame:
    """df with the column pack: greedy packing in order within each `by`, numbers from 0.

    close_first: a pack is closed before a row that would take it over the limit; else by
    the row that takes it there. The state is a sum that goes back to 0, which no window
    function says, so each group is folded in order, batch by batch, with a step for each
    pack. A null size counts as 0 and a null `by` as a group; rows of equal order may
    come either way. Only df's columns move; give keys and sizes, and join the rest after.
    """
    slim = df.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))).repartition(by).sortWithinPartitions(by, order)
    names = [f.name for f in df.schema]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", pack int"

    def run(frames):
        last, held, number = object(), 0, 0
        for f in frames:
            for key, part in f.groupby(by, sort=False, dropna=False):
                if key != last and not (key != key and last != last):
                    last, held, number = key, 0, 0
                packs, held, number = _packs(part["_size"].to_numpy() + overhead, held, number, limit, close_first)
                yield part[names].assign(pack=packs)

    return slim.mapInPandas(run, ddl)
