"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies, target / source
size. The fractional parts are rounded so that each document's expected copies
stay what they were and the words taken of a source stay its target: of a pair of
documents one gains copies and the other loses as many words, by a random amount
that makes at least one of the two integral. Chunks of a source do so apart, each
leaves one fractional document at most, and these go up a reduction tree of
`fan_in` to one until a source has one left, which is rounded at random. So a
source's words differ from its target by less than the size of one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import common

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
EPS = 1e-9


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources by code point, null last, weigh `weights`, repeating. With r = cap * size /
    weight, targets are min(cap * size, level * weight), where the level makes them
    share * all sizes together: the same as giving out the excess again and again. One
    row for each source comes together in one task, never the documents.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("double")
    by = by.withColumn("_i", F.row_number().over(place) - 1).withColumn("_w", w).withColumn("_cap", cap * F.col("source_size"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("_left", share * F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
    by = by.withColumn("_open", F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing))).withColumn("_level", F.col("_left") / F.col("_open"))
    # the first source, from the lowest cap on, whose cap isn't reached sets the level for all from there on
    free = F.col("_cap") / F.col("_w") >= F.col("_level")
    by = by.withColumn("_n", F.row_number().over(up)).withColumn("_set", F.min_by(F.when(free, F.col("_level")), F.when(free, F.col("_n"))).over(Window.partitionBy(F.lit(0))))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_set"), F.col("_cap") / F.col("_w")) * F.col("_w"))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers that depend on the row alone (splitmix64)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / 2**53


def pivot(share: np.ndarray, size: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Round fractional copies in order, one document at a time against the one that is still fractional.

    Expected copies and the sum of size * copies stay; at most one is left fractional.
    Sizes are positive.
    """
    out = share.copy()
    i = -1
    for j in np.flatnonzero((share > EPS) & (share < 1 - EPS)):
        if i < 0:
            i = j
            continue
        a, b, s, t = out[i], out[j], size[i], size[j]
        up = min((1 - a) * s, b * t)  # words that can go from j to i
        down = min(a * s, (1 - b) * t)
        move = up if luck[j] * (up + down) < down else -down
        out[i], out[j] = a + move / s, b - move / t
        for k in (i, j):
            out[k] = 0.0 if out[k] < EPS else 1.0 if out[k] > 1 - EPS else out[k]
        left = [k for k in (i, j) if 0 < out[k] < 1]
        i = left[0] if left else -1
    return out


def _round(last: bool, level: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "_rank", "_row"], ascending=[False, True, True], kind="stable")  # small documents last: what is left over at the end is small
        rank = rows["_rank"].to_numpy()
        out = pivot(rows["_share"].to_numpy(np.float64), rows["size"].to_numpy(np.float64), _uniform(rank, seed + 2 * level))
        if last:
            out = np.where((out > 0) & (out < 1), (_uniform(rank, seed + 2 * level + 1) < out).astype(float), out)
        return rows.assign(_share=out)[["_row", "_source", "size", "_rank", "_share"]]

    return run


def _twins_apart(sized: DataFrame, chunk_docs: int) -> DataFrame:
    """Rows whose _rank more than chunk_docs rows share get one for each chunk_docs of them, by their number among such rows.

    Numbers go by partition (the high bits of _row) and place; equal rows can swap them without effect.
    """
    hot = common.small(sized.groupBy("_rank").agg(F.count("*").alias("n")).where(F.col("n") > chunk_docs).select("_rank"), "mix-equal")
    if not hot.take(1):
        return sized
    twins = sized.join(hot, "_rank").select("_row", "_rank", F.shiftrightunsigned("_row", 33).alias("_part"))
    sizes = twins.groupBy("_rank", "_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_rank", "_part").orderBy("_row")) - 1
    number = twins.withColumn("_place", place).join(sizes.select("_rank", "_part", before.alias("_before")), ["_rank", "_part"])
    mine = number.select("_row", F.xxhash64("_rank", F.floor((F.col("_before") + F.col("_place")) / chunk_docs)).alias("_own"))
    return common.spool(sized.join(mine, "_row", "left").withColumn("_rank", F.coalesce("_own", "_rank")).drop("_own"), "mix-apart")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, chunk_docs: int = 4000, fan_in: int = 64, seed: int = 8, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """Rows (key, source, size, source_size, target, copies, taken), one for each row of docs.

    size: words of the text (null: 0). A document of no words takes nothing. Draws come
    from a hash of key and text, so reruns agree; rows equal in both are told apart by
    their number among such rows. Copies lie within 0 and ceil(cap). Other columns of
    docs are ignored; an empty table gives an empty one. row: a column of unique numbers,
    returned as _row; by default one is made.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(key), F.col(source).alias("source"), F.regexp_count(text_col, F.lit(common.WORD)).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), text_col).alias("_rank"), common.row_number(row).alias("_row"))
    sized = _twins_apart(common.spool(sized, "mix-sized"), chunk_docs)
    targets = common.spool(source_targets(sized, weights, share, cap).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = sized.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    # one row for each source; Spark sends it to all tasks where it is measured to be small
    rated = named.drop("source").join(targets, "_source").withColumn("_rate", rate).withColumn("_whole", F.floor(F.col("_rate") + EPS)).withColumn("_share", F.when(F.col("size") > 0, F.greatest(F.col("_rate") - F.col("_whole"), F.lit(0.0))).otherwise(0.0))
    chunks = F.ceil(F.col("n_docs") / chunk_docs)
    kind = "_row long, _source string, size long, _rank long, _share double"
    step = rated.withColumn("_chunk", F.pmod(F.xxhash64("_rank", F.lit(seed)), chunks)).select("_row", "_source", "size", "_rank", "_share", "_chunk").where("_share > 0")
    most = (targets.agg(F.max("n_docs")).first()[0] or 0) // chunk_docs + 1
    parts, level = [], 0
    done = common.spool(step.groupBy("_source", "_chunk").applyInPandas(_round(False, level, seed), kind), "mix-0")
    parts.append(done.where("_share = 0 or _share = 1"))
    while True:
        level += 1
        rest = done.where("_share > 0 and _share < 1")
        most = -(-most // fan_in)
        last = most <= 1
        rest = rest.withColumn("_chunk", F.lit(0).cast("long") if last else F.pmod(F.xxhash64("_rank", F.lit(seed + level)), F.lit(most)))
        done = common.spool(rest.groupBy("_source", "_chunk").applyInPandas(_round(last, level, seed), kind), f"mix-{level}")
        parts.append(done.where("_share = 0 or _share = 1"))
        if last:
            break
    rounded = parts[0]
    for x in parts[1:]:
        rounded = rounded.unionByName(x)
    out = rated.join(rounded.where("_share = 1").select("_row", F.lit(1).alias("_up")), "_row", "left")
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.coalesce("_up", F.lit(0))).otherwise(0).cast("long")
    return out.select(key, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_row")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
