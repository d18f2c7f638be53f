"""SimHash near-duplicates with pivot distance tables.

1. Each text gets a fingerprint: a bit is set where it is set in over half of its
   shingles' hashes. Equal fingerprints become one node.
2. Nodes are dealt into buckets by bit groups. With `radius` r and one hash word, the
   bits are cut into r + 2 blocks: fingerprints that differ in at most r bits agree in
   two blocks at least, so each pair of blocks is a bucket key and no link is lost.
   Buckets beyond `bucket_rows` are dealt out again by pairs of r + 2 blocks of the bits
   that their key leaves open, which loses no pair either: after three turns a bucket
   of 64-bit fingerprints has 8 open bits, so 256 nodes at most.
3. In a bucket, a table holds each node's Hamming distances to `pivots` reference
   fingerprints. By the triangle inequality two nodes within r differ by at most r in
   each coordinate, so pairs of a larger maximum difference are discarded, and those
   left are verified bit by bit. A bucket gives links that span it, never all its pairs.
4. Components of the links give each text's group.

Wide fingerprints have no exact keys of use; `links` takes random ones for callers that
find what they miss in another way (`gridloom.llm.jaccard`).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.components import components

SEED = 42
#: Buckets of up to this many nodes are compared side by side.
SMALL = 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, repeats included; of fewer words one hash, of none no hash."""
    norm = b" ".join((text or "").encode().lower().split())
    if not norm:
        return np.empty(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    n = max(1, len(spaces) + 2 - shingle)
    starts = [0, *(spaces[: n - 1] + 1).tolist()]
    ends = [*spaces[shingle - 1 :].tolist(), len(norm)] if n > 1 else [len(norm)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(norm[s:e], SEED) for s, e in zip(starts, ends, strict=True)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray, words: int = 1) -> bytes:
    """The fingerprint of hashes, 8 * words bytes, highest bit first; of none: zeros. Words after the first are of mixed hashes."""
    out = b""
    for w in range(words):
        with np.errstate(over="ignore"):
            x = hashes if not w else (hashes ^ (hashes >> np.uint64(31 - w))) * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
            x = x if not w else x ^ (x >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 8192):
            ones += np.unpackbits(x[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(x)).tobytes()
    return out


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> bytes:
    """8 * words bytes, highest bit first; a text of no words: zeros."""
    return majority(shingle_hashes(text, shingle), words)


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int, words: int, row: str | None = None) -> DataFrame:
    rows = docs.select(common.row_number(row).alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t.as_py(), shingle, words) for t in b.column(2)], pa.binary())], ["_row", "_id", "fp"])

    return rows.mapInArrow(run, "_row long, _id long, fp binary")


def _pairs_of_blocks(bits: list[int], radius: int) -> list[list[int]]:
    return [np.concatenate(pair).tolist() for pair in combinations(np.array_split(np.array(bits), radius + 2), 2)]


def block_keys(radius: int) -> list[list[int]]:
    """Bit positions of each pair of the radius + 2 blocks of 64 bits."""
    return _pairs_of_blocks(list(range(64)), radius)


def finer_blocks(radius: int):
    """For a key's bit positions those of the keys that split its bucket; none where too few bits are open."""

    def finer(key: list[int]) -> list[list[int]]:
        rest = [p for p in range(64) if p not in set(key)]
        return [key + more for more in _pairs_of_blocks(rest, radius)] if len(rest) >= 2 * (radius + 2) and len(key) < 56 else []

    return finer


def sampled_keys(bits: int, width: int, tables: int, seed: int = 5) -> list[list[int]]:
    draw = np.random.default_rng(seed)
    return [sorted(draw.choice(bits, width, replace=False).tolist()) for _ in range(tables)]


def finer_samples(bits: int, more: int = 12):
    """One key with more random bits, up to 60."""

    def finer(key: list[int]) -> list[list[int]]:
        rest = [p for p in range(bits) if p not in set(key)]
        return [key + np.random.default_rng(len(key)).choice(rest, more, replace=False).tolist()] if len(key) + more <= 60 else []

    return finer


def _pivots(n: int, words: int) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, (n, words), dtype=np.uint64)


def _words(fps: pa.Array, words: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(fps.to_pylist()), ">u8").astype(np.uint64)
    return flat.reshape(len(fps), words)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def _cells(keys: dict[int, list[list[tuple[int, list[int]]]]], words: int):
    """A row (path, key, node, fp) for each node (path, node, fp) and key of its path: (path, bit positions)."""

    def run(batches):
        for b in batches:
            whole = b.column(0).to_numpy()
            for path in np.unique(whole).tolist():
                own = b.filter(pa.array(whole == path))
                fps = _words(own.column(2), words)
                bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), 8 * words), axis=1)
                for to, at in keys[path]:
                    value = np.zeros(len(fps), np.int64)
                    for p in at:
                        value = (value << 1) | bits[:, p]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), to, np.int16)), pa.array(value), own.column(1), own.column(2)], ["path", "key", "node", "fp"])

    return run


def spanning_links(fps: np.ndarray, refs: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """The shortest links (i, j, bits) that join all that is joined by pairs within radius: a node at a time, the one nearest to what is joined."""
    n = len(fps)
    table = np.stack([_apart(fps, r[None, :]) for r in refs], axis=1)
    rest, at, out = np.arange(1, n), 0, []
    best, by = np.full(n, radius + 1, np.int16), np.zeros(n, np.int64)
    while len(rest):
        near = rest[np.abs(table[rest] - table[at]).max(axis=1, initial=0) <= radius]
        d = _apart(fps[near], fps[at][None, :])
        closer = d < best[near]
        best[near[closer]], by[near[closer]] = d[closer], at
        k = int(best[rest].argmin())
        at = int(rest[k])
        rest = np.delete(rest, k)
        if best[at] <= radius:
            out.append((int(by[at]), at, int(best[at])))
    return out


def _spanning(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Of pairs of nodes those that join what the ones before haven't joined."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = up
        return i

    his, los = [], []
    for i, j in zip(a, b, strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[y] = x
            his.append(i)
            los.append(j)
    return his, los


def _link(words: int, pivots: int, radius: int):
    """Rows sorted by (path, key): links of each bucket. A bucket is held until its last row."""
    refs = _pivots(pivots, words)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            path, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = b.num_rows - int(((path == path[-1]) & (key == key[-1])).sum())
            if held and cut == 0 and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (path[0], key[0]):
                held.append(b)
                continue
            yield from group(pa.concat_batches([*held, b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield from group(pa.concat_batches(held))

    def group(b):
        if not b.num_rows:
            return
        path, key = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[new, b.num_rows])
        pick = np.flatnonzero(size > 1)
        if not len(pick):
            return
        keep = np.repeat(size > 1, size)
        node, fps = b.column(2).to_numpy()[keep], _words(b.column(3).filter(pa.array(keep)), words)
        size = size[pick]
        first = np.r_[0, np.cumsum(size)[:-1]]
        table = np.stack([_apart(fps, r[None, :]) for r in refs], axis=1)
        his, los, bits = [], [], []
        for n in range(2, SMALL + 1):  # all small buckets of a size at once
            i, j = np.triu_indices(n, 1)
            at = first[size == n][:, None]
            x, y = (at + i).ravel(), (at + j).ravel()
            near = np.abs(table[x] - table[y]).max(axis=1, initial=0) <= radius
            x, y = x[near], y[near]
            d = _apart(fps[x], fps[y])
            his.append(x[d <= radius])
            los.append(y[d <= radius])
            bits.append(d[d <= radius])
        for s, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            found = np.array(spanning_links(fps[s : s + n], refs, radius), np.int64).reshape(-1, 3)
            his.append(s + found[:, 0])
            los.append(s + found[:, 1])
            bits.append(found[:, 2])
        order = np.argsort(np.concatenate(bits), kind="stable")  # short links first
        hi, lo = _spanning(node[np.concatenate(his)[order]].tolist(), node[np.concatenate(los)[order]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

    return run


def links(nodes: DataFrame, radius: int, words: int, keys: list[list[int]], finer, pivots: int, bucket_rows: int) -> DataFrame:
    """(hi, lo): links between nodes (node, fp) within radius that span each bucket.

    finer: the keys that split a bucket of more than bucket_rows. What they can't split
    is dealt out by node, each share with the bucket's least node.
    """
    columns = "path short, key long, node long, fp binary"
    rows, paths, last, done = nodes.select(F.lit(0).cast("short").alias("path"), "node", "fp"), {0: [(k, at) for k, at in enumerate(keys)]}, len(keys), []
    while True:
        cells = rows.mapInArrow(_cells(paths, words), columns)
        counted = cells.groupBy("path", "key").agg(F.count("*").alias("n"), F.min(F.struct("node", "fp")).alias("least"))
        hot = common.small(counted.where(F.col("n") > bucket_rows), "hot-buckets")
        if not hot.take(1):
            done.append(cells)
            break
        done.append(cells.join(hot, ["path", "key"], "left_anti"))
        held, was = cells.join(hot, ["path", "key"]), [x for own in paths.values() for x in own]
        paths = {}
        for path, at in was:
            paths[path] = [(last + k, more) for k, more in enumerate(finer(at))]
            last += len(paths[path])
        if not any(paths.values()):
            shares = F.ceil(F.col("n") / bucket_rows)
            own = held.withColumn("_share", F.pmod(F.xxhash64("node"), shares)).select("path", "key", "_share", "node", "fp")
            least = hot.select("path", "key", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("_share"), "least.node", "least.fp")
            done.append(own.unionByName(least).distinct().select("path", F.xxhash64("key", "_share").alias("key"), "node", "fp"))
            break
        rows = common.spool(held.select("path", "node", "fp"), "hot-nodes")
    dealt = common.union(done).repartition(common.partitions(nodes.sparkSession), "path", "key").sortWithinPartitions("path", "key")
    return dealt.mapInArrow(_link(words, pivots, radius), "hi long, lo long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, pivots: int = 16, bucket_rows: int = 4096, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Rows (key, fingerprint, component_id, kept, _row), one for each row of docs.

    fingerprint: hex; component_id: smallest key that links reach; kept: true for one
    row of each component, that of its smallest key (of equal keys, the first read). Null
    texts and texts of no words have fingerprint zero and link like any other. Null keys
    come last. Repeated rows are one node. The key is a whole number or null. Other
    columns of docs are ignored; an empty table gives an empty one. row: a column of
    unique numbers, returned as _row; by default one is made.
    """
    if radius > 6:
        raise ValueError("block keys need a small radius")
    rows = common.spool(fingerprints(docs, key, text, shingle, 1, row), "simhash")
    nodes = common.spool(rows.groupBy("fp").agg(F.min("_row").alias("node"), F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("least")), "simhash-nodes")
    roots = components(links(nodes, radius, 1, block_keys(radius), finer_blocks(radius), pivots, bucket_rows))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("first"))
    named = common.spool(nodes.join(least, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.row").alias("_stays")), "simhash-components")
    out = rows.join(named, "fp")
    return out.select(F.col("_id").alias(key), F.lower(F.hex("fp")).alias("fingerprint"), "component_id", (F.col("_row") == F.col("_stays")).alias("kept"), "_row")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
