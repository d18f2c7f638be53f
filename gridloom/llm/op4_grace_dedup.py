"""Exact dedup by Grace hash partitioning.

1. Each task normalises its rows, and rows of equal content within a batch become
   one record with the list of their row numbers, so a content that a third of all
   rows share is moved once for each batch.
2. Records are written once to spill files in the shared folder. Buckets are the first bits
   of content hashes; of a bucket whose bytes exceed `bucket_bytes` the next bits are taken,
   and so on, until each fits or can't be split by hash. This recursion reads hashes and
   sizes alone; then one exchange partitions the records to the buckets found.
3. Buckets that don't fit hold few contents many times over: they are dealt out by hash
   and record number, and each share is reduced to one record for each content.
4. Each bucket goes into an open-addressing table that compares complete contents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common

MAX_LEVELS = 6


def normalise(text: str | None) -> bytes:
    r"""UTF-8 with each run of [\x20\x09-\x0D] as one space; null as empty. bytes.split() knows just these."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return b" " if raw else b""
    lead, trail = raw[:1] in b" \t\n\v\f\r", raw[-1:] in b" \t\n\v\f\r"
    return b" " * lead + b" ".join(words) + b" " * trail


class OpenTable:
    """Open addressing with linear probing over slots that hold record numbers; equal means equal bytes."""

    def __init__(self, n: int):
        self.mask = max(8, 1 << (2 * n - 1).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)

    def find(self, hashes: np.ndarray, contents) -> np.ndarray:
        """For each record the number of the first one of equal content."""
        first, slots, mask = np.empty(len(hashes), np.int64), self.slots, self.mask
        for i, h in enumerate(hashes.tolist()):
            at = (h ^ (h >> 32)) & mask
            while True:
                j = int(slots[at])
                if j < 0:
                    slots[at] = first[i] = i
                    break
                if hashes[j] == h and contents(j) == contents(i):
                    first[i] = j
                    break
                at = (at + 1) & mask
        return first


def _records(batches):
    """One record for each content of a batch. Contents go on compressed."""
    packer = zstandard.ZstdCompressor(level=1)
    for b in batches:
        rows, ids = b.column(0).to_numpy(), b.column(1).to_pylist()
        whole = [normalise(t.as_py()) for t in b.column(2)]
        hashes = np.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in whole], np.int64)
        groups: dict[int, list[int]] = {}
        for i, j in enumerate(OpenTable(len(whole)).find(hashes, whole.__getitem__).tolist()):
            groups.setdefault(j, []).append(i)
        best = [min((i for i in g if ids[i] is not None), key=ids.__getitem__, default=g[0]) for g in groups.values()]
        members = [[{"row": int(rows[i]), "id": ids[i]} for i in g] for g in groups.values()]
        kept = list(groups)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[kept]), pa.array(hashes[kept]), pa.array([packer.compress(whole[i]) for i in kept], pa.binary()), pa.array([hashlib.sha256(whole[i]).digest() for i in kept], pa.binary()),
                pa.array([ids[i] for i in best], pa.int64()), pa.array(rows[best]), pa.array([len(g) for g in groups.values()], pa.int64()), pa.array(members, pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64())]))),
            ],
            ["rec", "h", "content", "sha", "least", "least_row", "n", "members"],
        )


SLIM = "rec long, h long, content binary, least long, least_row long, n long"
RECORDS = "rec long, h long, content binary, sha binary, least long, least_row long, n long, members array<struct<row:long,id:long>>"


def _groups(last: bool):
    """For each record of a bucket the record that stands for its content; last: with the content's result, else with what goes on."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        contents, hashes, unpack = t.column("content").chunk(0), t.column("h").to_numpy(), zstandard.ZstdDecompressor().decompress
        least, least_row, size = t.column("least").to_pylist(), t.column("least_row").to_pylist(), t.column("n").to_pylist()
        first = OpenTable(t.num_rows).find(hashes, lambda i: unpack(contents[i].as_buffer())).tolist()
        best, n = {}, dict.fromkeys(first, 0)
        for i, j in enumerate(first):
            n[j] += size[i]
            x = (least[i] is None, least[i] or 0, least_row[i])
            best[j] = min(x, best.get(j, x))
        ids = pa.array([None if best[j][0] else best[j][1] for j in first], pa.int64())
        rows, n = pa.array([best[j][2] for j in first], pa.int64()), pa.array([n[j] for j in first], pa.int64())
        if last:
            return pa.table([t.column("rec"), ids, rows, n], ["rec", "keep_id", "keep_row", "group_size"])
        to = t.column("rec").take(pa.array(first))
        return t.select(["rec"]).append_column("to", to).append_column("h", t.column("h")).append_column("content", t.column("content")).append_column("least", ids).append_column("least_row", rows).append_column("n", n)

    return run


def grace_buckets(records: DataFrame, bucket_bytes: int, fan_bits: int, max_levels: int = MAX_LEVELS) -> tuple[DataFrame, DataFrame | None]:
    """Records (with bytes) with a column leaf that names a bucket that fits; and those that hash bits can't split, with bytes of their bucket."""
    n, rest, fits = 1 << fan_bits, records.withColumn("leaf", F.lit("")), []
    for level in range(max_levels + 1):
        if level == max_levels or fan_bits * level >= 63:
            return common.union(fits), rest
        bits = F.shiftrightunsigned("h", max(0, 63 - fan_bits * (level + 1))).bitwiseAND(n - 1)
        rest = rest.drop("total").withColumn("leaf", F.concat_ws(".", "leaf", bits.cast("string")))
        sizes = rest.groupBy("leaf").agg(F.sum("bytes").alias("total"), (F.min("h") == F.max("h")).alias("one"))
        large = common.small(sizes.where(F.col("total") > bucket_bytes), f"grace-large-{level}")  # as few as buckets that are too large
        if not large.take(1):
            return common.union([*fits, rest]), None
        fits.append(rest.join(large.select("leaf"), "leaf", "left_anti"))
        rest = rest.join(large.select("leaf", "total"), "leaf")
        if not large.where(~F.col("one")).take(1):
            return common.union(fits), rest


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 16 << 20, fan_bits: int | None = None, row: str | None = None) -> DataFrame:
    """Rows (key, keep_id, group_size, kept, text_sha256, _row), one for each row of docs.

    Texts are equal when their normalised bytes are; null counts as empty. The row of
    the smallest key stays; of several rows with that key, the first read. Null keys
    come last, others are whole numbers: keep_id is null only where all keys of a group
    are. Other columns of docs
    are ignored; an empty table gives an empty one. fan_bits: hash bits a level, by
    default enough for two buckets a shuffle partition. row: a column of unique numbers,
    returned as _row; by default one is made.
    """
    spark = docs.sparkSession
    rows = docs.select(common.row_number(row).alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    fan_bits = fan_bits or min(16, max(6, (2 * common.partitions(spark) - 1).bit_length()))
    records = common.spool(rows.mapInArrow(_records, RECORDS).withColumn("bytes", F.octet_length("content") + 96), "grace-records")
    fits, rest = grace_buckets(records, bucket_bytes, fan_bits)
    found = "rec long, keep_id long, keep_row long, group_size long"
    slim = [x.split()[0] for x in SLIM.split(", ")]
    results = fits.select("leaf", *slim).groupBy("leaf").applyInArrow(_groups(True), found)
    if rest is not None:
        shares = F.ceil(F.col("total") / bucket_bytes)
        cut = rest.withColumn("_share", F.pmod(F.xxhash64("rec"), shares)).select("_share", *slim).groupBy("h", "_share").applyInArrow(_groups(False), SLIM.replace("rec long, ", "rec long, to long, "))
        cut = common.spool(cut, "grace-shares")
        last = cut.where("rec = to").select(*slim).groupBy("h").applyInArrow(_groups(True), found)
        results = results.unionByName(cut.select("rec", "to").join(last.withColumnRenamed("rec", "to"), "to").drop("to"))
    members = records.select("rec", "sha", F.explode("members").alias("m"))
    out = members.join(common.spool(results, "grace-groups"), "rec")
    return out.select(F.col("m.id").alias(key), "keep_id", "group_size", (F.col("m.row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("m.row").alias("_row"))


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("_row")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
QUERIES = {"op4_grace_dedup": op4_grace_dedup}
ORACLES = {"op4_grace_dedup": ORACLE}
