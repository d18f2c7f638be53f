"""Near duplicates by exact Jaccard similarity of word shingles: a prefix-filter join.

1. A text is its set of shingles (64-bit hashes of runs of words). Equal sets become one
   node.
2. Obvious copies are linked first by SimHash (`op5_simhash.links`): wide fingerprints of
   the sets, buckets of random bits, pivot distance tables, links that span a bucket; of
   these only pairs whose whole sets reach the threshold stay. What random bits miss, step 3
   finds; without step 2 large groups would give it pairs with the square of their size.
3. Shingles have one global order: those frequent in a sample come last, then by hash. Two
   sets of similarity t or more share a shingle among the first n - ceil(t * n) + 1 of each,
   so each of these is a bucket key and no pair is lost, whatever the input's size. Pairs
   that step 2 has joined aren't compared; sizes and places in the order rule out others.
   Keys that the sample shows to be hot are dealt into cells, in which any two rows meet.
4. Each candidate's similarity is computed from the whole texts; only pairs that reach the
   threshold are links. Components of the links give each text's group.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.components import components
from gridloom.llm.op5_simhash import finer_samples, links, majority, sampled_keys, shingle_hashes

#: Rows of the sample that shows frequent shingles, or the share of all rows if that is more; of how many of its texts one must have; and how many are sent at most. They set the order, not the result.
SAMPLE, SHARE, FREQUENT, SENT = 20_000, 0.25, 3, 200_000
FLUSH = 500_000
#: Random keys have so many bits less than would tell all nodes apart: buckets hold some 2 ** SPARE nodes that have nothing in common.
SPARE = 4


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingles' hashes, ascending. A text of under size words is one shingle, of no words none."""
    return np.unique(shingle_hashes(text, size))


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _frequent(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles frequent in a sample, and of how many rows they are in about."""
    share = min(1.0, max(SHARE, SAMPLE / max(1, rows.count())))

    def run(batches):
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), size).view(np.int64))], ["h"])

    some = rows.where(F.pmod(F.xxhash64("_row"), F.lit(1_000_000)) < share * 1_000_000).select("_text").mapInArrow(run, "h long")
    found = some.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "h").limit(SENT).toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], np.ceil(c[order] / share).astype(np.int64)


def _lookup(h: np.ndarray, known: np.ndarray, value: np.ndarray, default: int) -> np.ndarray:
    if not len(known):
        return np.full(len(h), default, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, value[at], default)


def _describe(size: int, percent: int, words: int, sent):
    def run(batches):
        known, rows = sent.value
        for b in batches:
            digest, n, fp, prefix = [], [], [], []
            for t in b.column(2):
                h = shingles(t.as_py(), size)
                digest.append(xxhash.xxh128_digest(h.tobytes()))
                n.append(len(h))
                fp.append(majority(h, words))
                prefix.append(h[np.lexsort((h, _lookup(h, known, rows, 0)))[: prefix_length(len(h), percent)]].view(np.int64) if len(h) else [])
            cells = [pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], ["_row", "_id", "digest", "n", "fp", "prefix"])

    return run


def _entries(sent, cell_rows: int):
    """A row (key, node, comp, at: n and pos) for each shingle of a node's prefix; of a hot key one for each cell, with a key of its own."""

    def run(batches):
        known, rows = sent.value
        hot = rows > cell_rows
        known, parts = known[hot], -(-rows[hot] // cell_rows)
        for b in batches:
            lists = b.column(3)
            size = np.diff(lists.offsets.to_numpy())
            key = lists.flatten().to_numpy()
            at = np.repeat(np.arange(len(size)), size)
            node, comp, n = (b.column(k).to_numpy()[at] for k in range(3))
            pos = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            times = _lookup(key.view(np.uint64), known, parts, 1)
            pick = np.repeat(np.arange(len(key)), times)
            t = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
            s = (node[pick].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % times[pick]
            cell = (np.minimum(s, t) * times[pick] + np.maximum(s, t)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            cell = (key[pick].view(np.uint64) ^ cell).view(np.int64)
            for k in range(0, len(pick), FLUSH):
                p = pick[k : k + FLUSH]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell[k : k + FLUSH], node[p], comp[p], (n[p].astype(np.int64) << 32) + pos[p])], ["key", "node", "comp", "at"])

    return run


def _candidates(percent: int):
    """Rows sorted by (key, at): pairs of different components that can reach the threshold."""

    def pairs(cols):
        key, node, comp, at = cols
        n, pos = at >> 32, at & (2**32 - 1)
        active, d, his, los, held = np.arange(len(key)), 0, [], [], 0
        while len(active):
            d += 1
            active = active[active + d < len(key)]
            other = active + d
            # rows of a bucket ascend in n: beyond the first that is too large all are
            meets = (key[active] == key[other]) & (100 * n[active] >= percent * n[other])
            active, other = active[meets], other[meets]
            need = -(-percent * (n[active] + n[other]) // (100 + percent))
            rest = np.minimum(n[active] - pos[active], n[other] - pos[other])
            good = (comp[active] != comp[other]) & (rest >= need)
            x, y = node[active[good]], node[other[good]]
            his.append(np.maximum(x, y))
            los.append(np.minimum(x, y))
            held += len(x)
            if held > FLUSH:
                yield batch(his, los)
                his, los, held = [], [], 0
        if held:
            yield batch(his, los)

    def batch(his, los):
        both = np.unique(np.stack([np.concatenate(his), np.concatenate(los)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["hi", "lo"])

    def columns(parts):
        return [np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(4)]

    def run(batches):
        parts = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            cut = b.num_rows - int((key == key[-1]).sum())
            if parts and cut == 0 and parts[-1].column(0)[-1].as_py() == key[0]:
                parts.append(b)
                continue
            yield from pairs(columns([*parts, b.slice(0, cut)]))
            parts = [b.slice(cut)]
        if parts:
            yield from pairs(columns(parts))

    return run


def _verify(size: int, percent: int):
    def run(batches):
        of = lru_cache(256)(lambda t: shingles(t, size))
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = of(x.as_py()), of(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["hi", "lo"])

    return run


def verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (hi, lo) of rows (_row, _text) whose sets of shingles reach the threshold. Only texts of those rows move."""
    pairs = common.spool(pairs, "jaccard-pairs")
    ids = pairs.select(F.explode(F.array("hi", "lo")).alias("_row")).distinct()
    rows = rows.join(common.small(ids, "jaccard-verified", common.MOST_IDS), "_row", "left_semi")
    texts = lambda at: rows.select(F.col("_row").alias(at), F.col("_text").alias(f"_{at}"))
    return pairs.join(texts("hi"), "hi").join(texts("lo"), "lo").select("hi", "lo", "_hi", "_lo").mapInArrow(_verify(size, percent), "hi long, lo long")


def near_duplicates(docs: DataFrame, row: str, shingle: int = 5, percent: int = 80, cell_rows: int = 32_768, words: int = 4, radius: int = 40, tables: int = 16, pivots: int = 16, bucket_rows: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, component_id, kept, _row), one for each row of docs.

    Two rows are linked if the Jaccard similarity of their sets of shingles is percent / 100
    or more; none is missed. component_id: smallest key that links reach; kept: true for one
    row of each component, that of its smallest key (of equal keys, the smallest row). Null
    texts and texts of no words are one component. Null keys come last; others are whole
    numbers. Other columns are ignored; an empty table gives an empty one. row: a column of
    unique numbers, the same at every read of docs (of a written table). cell_rows: rows of a
    hot key that meet in one task, about. words, radius, tables, pivots, bucket_rows: of the
    fingerprints that link obvious copies; they set the cost, not the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row).cast("long").alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    sent = spark.sparkContext.broadcast(_frequent(rows, shingle))
    told = common.spool(rows.mapInArrow(_describe(shingle, percent, words, sent), "_row long, _id long, digest binary, n int, fp binary, prefix array<long>"), "jaccard")
    nodes = common.spool(told.groupBy("digest").agg(F.min("_row").alias("node"), F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("least")), "jaccard-nodes")
    again = told.select("_row", "digest").join(nodes.select("digest", "node"), "digest").where("_row <> node").select("_row")
    firsts = told.join(common.small(again, "jaccard-again", common.MOST_IDS), "_row", "left_anti").withColumnRenamed("_row", "node")
    keys = sampled_keys(64 * words, max(8, ceil(log2(nodes.count() + 1)) - SPARE), tables)
    close = links(firsts.select("node", "fp"), radius, words, keys, finer_samples(64 * words), pivots, bucket_rows).distinct()
    first = common.spool(verified(close, rows, shingle, percent), "jaccard-first")
    roots = components(first)
    entries = firsts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "n", "prefix").mapInArrow(_entries(sent, cell_rows), "key long, node long, comp long, at long")
    dealt = entries.repartition(common.partitions(spark), "key").sortWithinPartitions("key", "at")
    pairs = dealt.mapInArrow(_candidates(percent), "hi long, lo long").distinct()
    joined = components(first.unionByName(verified(pairs, rows, shingle, percent)))
    nodes = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("first"))
    named = common.spool(nodes.join(least, "root").select("digest", F.col("first.id").alias("component_id"), F.col("first.row").alias("_stays")), "jaccard-components")
    return told.select("_row", "_id", "digest").join(named, "digest").select(F.col("_id").alias(key), "component_id", (F.col("_row") == F.col("_stays")).alias("kept"), "_row")
