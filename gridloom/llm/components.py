"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common


#: Edges of up to this many are joined in one task: 16 bytes each.
FEW = 200_000


def _join(batches):
    """(hi, lo) for each node that isn't its component's smallest: that smallest node is lo."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = up
        return i

    for b in batches:
        for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    nodes = [i for i in root if find(i) != i]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(i) for i in nodes], pa.int64())], ["node", "root"])


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (hi, lo), where root is the component's smallest node and node isn't root.

    Needs of the order of log(n) rounds squared, a few in practice; when at most FEW edges
    are left, one task joins them. Each round is written to the shared folder. Stars'
    centres have many edges: the joins on them are plain ones that Spark splits where one
    key holds many rows. most_rounds: an error beyond it, which only a fault can cause,
    as long chains are halved by each round.
    """
    edges = common.spool(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi > lo").distinct(), "links")
    was = _mark(edges)
    for _ in range(most_rounds):
        if not was[0]:
            break
        if was[0] <= FEW:
            return common.spool(edges.coalesce(1).mapInArrow(_join, "node long, root long"), "components")
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = common.spool(large, "large-stars")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        edges = common.spool(small, "small-stars")
        now = _mark(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
