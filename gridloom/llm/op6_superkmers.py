"""Substring dedup by super-k-mers of words.

A window is `window` consecutive words of a document; its minimiser is the least hash of
`mmer` consecutive words in it. Consecutive windows that share a minimiser form one
packed string, a super-k-mer, whose bucket is the minimiser: equal windows meet there.

1. The first and last document of each minimiser show which ones several documents share;
   windows of all others are in one document alone. A Bloom filter of those shared, of
   bounded size, is sent to all tasks and holds back the rest.
2. Super-k-mers of equal content in a batch become one record with a list of its places;
   records go to their bucket without that list, where their windows are sorted by hash
   and equal ones compared word by word, giving each window's first document.
   A bucket of more than `hot_records` is dealt out in shares by record: each share gives its
   distinct windows with their first documents in it, these are merged by window, and shares
   get back what began earlier in another one.
3. Records whose windows began elsewhere earlier are joined with their places again, and
   documents with the windows to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

WINDOW, MMER = 50, 12
HOT_RECORDS = 1024
LAST = 2**63 - 1
#: Shared minimisers that the filter has 24 bits each for, 48 MB at most.
FILTER_KEYS = 1 << 24
KEYS_A_BLOCK = 21
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * PRIME + hashes[j : j + len(out)]
    return _mix(out)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = np.minimum(x[: len(x) - step], x[step:])
        size += step
    return x


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def super_kmers(words: list[bytes], window: int = WINDOW, mmer: int = MMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser as int64, first window, number of windows) of each super-k-mer, in order."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least(_runs(_hashes(words), mmer), window - mmer + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first].view(np.int64), first, np.diff(np.r_[first, len(least)])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _minimisers(window: int, mmer: int):
    def run(batches):
        for b in batches:
            found, ids = [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                m = np.unique(super_kmers(_words(t.as_py()), window, mmer)[0])
                found.append(m)
                ids.append(np.full(len(m), doc, np.int64))
            m, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, ids))
            order = np.lexsort((d, m))
            m, d = m[order], d[order]
            first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(m)] - 1 if len(m) else first
            yield pa.RecordBatch.from_arrays([pa.array(m[first]), pa.array(d[first]), pa.array(d[last])], ["mh", "least", "most"])

    return run


def _filter(shared: DataFrame, n: int) -> np.ndarray:
    """Blocks of eight words with a bit in each for every shared minimiser; beyond FILTER_KEYS more get through that aren't shared."""
    blocks = (min(n, FILTER_KEYS) // KEYS_A_BLOCK) | 1
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("mh", 7 * i + 3).bitwiseAND(63).cast("int"))
    rows = shared.groupBy(F.pmod("mh", F.lit(blocks)).alias("block")).agg(*(F.bit_or(bit(i)).alias(f"w{i}") for i in range(8))).toArrow()
    out = np.zeros((blocks, 8), np.int64)
    if rows.num_rows:
        out[rows["block"].to_numpy()] = np.stack([rows[f"w{i}"].to_numpy() for i in range(8)], axis=1)
    return out


def _possible(blocks: np.ndarray, mh: np.ndarray) -> np.ndarray:
    own = blocks[mh % len(blocks)]
    at = (mh.view(np.uint64)[:, None] >> (7 * np.arange(8, dtype=np.uint64) + np.uint64(3))) & np.uint64(63)
    return ((own.view(np.uint64) >> at) & np.uint64(1)).all(axis=1)


PLACE = "struct<doc:long,rid:long,start:int>"
RECORD = f"mh long, ldoc long, lrid long, lidx int, content binary, least long, most long, places array<{PLACE}>"


def _records(window: int, mmer: int, sent):
    def run(batches):
        blocks = sent.value
        for b in batches:
            seen: dict[bytes, list] = {}
            for doc, rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = _words(t.as_py())
                mh, first, n = super_kmers(words, window, mmer)
                if not len(mh):
                    continue
                keep = np.flatnonzero(_possible(blocks, mh))
                for m, s, k in zip(mh[keep].tolist(), first[keep].tolist(), n[keep].tolist(), strict=True):
                    text = b" ".join(words[s : s + k + window - 1])
                    seen.setdefault(text, [m]).append((doc, rid, s))
            rows = [(v[0], v[1], t, v[1:]) for t, v in seen.items()]
            cells = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1][0] for r in rows], pa.int64()), pa.array([r[1][1] for r in rows], pa.int64()), pa.array([r[1][2] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.binary()), pa.array([min(p[0] for p in r[3]) for r in rows], pa.int64()), pa.array([max(p[0] for p in r[3]) for r in rows], pa.int64()),
                pa.array([[{"doc": d, "rid": i, "start": s} for d, i, s in r[3]] for r in rows], pa.list_(pa.struct([("doc", pa.int64()), ("rid", pa.int64()), ("start", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(cells, ["mh", "ldoc", "lrid", "lidx", "content", "least", "most", "places"])

    return run


def first_documents(contents: list[bytes], least: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The first document of each window of all records, and where each record's windows start, with the end.

    All windows are sorted by hash, and those of equal hashes compared as they stand.
    """
    words = [c.split(b" ") for c in contents]
    count = np.array([len(w) for w in words])
    size = count - window + 1
    start = np.cumsum(count) - count
    bounds = np.r_[0, np.cumsum(size)]
    record = np.repeat(np.arange(len(words)), size)
    place = np.arange(bounds[-1]) - bounds[record]
    keys = _runs(_hashes([x for w in words for x in w]), window)[start[record] + place]
    out = least[record].copy()
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    ends = np.r_[starts[1:], len(order)]
    many = ends - starts > 1
    edges = [np.r_[0, np.cumsum([len(x) + 1 for x in w])].tolist() for w in words]
    record, place, order = record.tolist(), place.tolist(), order.tolist()
    for a, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
        same: dict[bytes, list[int]] = {}
        for i in order[a:e]:
            r, p = record[i], place[i]
            at = edges[r]
            same.setdefault(contents[r][at[p] : at[p + window] - 1], []).append(i)
        for group in same.values():
            if len(group) > 1:
                out[group] = out[group].min()
    return out, bounds


def _buckets(window: int):
    """Sorted by mh: records some of whose windows began in an earlier document than the record's last one. A bucket is held until its last row."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            mh = b.column(0).to_numpy()
            cut = int(np.searchsorted(mh, mh[-1]))
            if held and cut == 0 and held[-1].column(0)[-1].as_py() == int(mh[0]):
                held.append(b)
                continue
            yield solve(pa.concat_batches([*held, b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield solve(pa.concat_batches(held))

    def solve(b):
        mh, least, most = (b.column(k).to_numpy() for k in (0, 5, 6))
        if len(mh):
            starts = np.flatnonzero(np.r_[True, mh[1:] != mh[:-1]])
            size = np.diff(np.r_[starts, len(mh)])
            several = np.minimum.reduceat(least, starts) < np.maximum.reduceat(most, starts)
            at = np.flatnonzero(np.repeat(several, size))
        else:
            at = np.zeros(0, np.int64)
        own = b.take(pa.array(at))
        if not len(at):
            return pa.RecordBatch.from_arrays([*own.columns[1:4], pa.array([], pa.list_(pa.int64()))], ["ldoc", "lrid", "lidx", "firsts"])
        firsts, bounds = first_documents(own.column(4).to_pylist(), least[at], window)
        earlier = np.add.reduceat(firsts < np.repeat(most[at], np.diff(bounds)), bounds[:-1]) > 0
        found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(firsts, pa.int64()))
        return pa.RecordBatch.from_arrays([*own.columns[1:4], found], ["ldoc", "lrid", "lidx", "firsts"]).filter(pa.array(earlier))

    return run


def _each_window(content: bytes, window: int) -> list[bytes]:
    edges = [0]
    for w in content.split(b" "):
        edges.append(edges[-1] + len(w) + 1)
    return [content[a : b - 1] for a, b in zip(edges, edges[window:], strict=False)]


def _share_windows(window: int):
    """Of a share of a hot bucket: (mh, share, window, first) for each distinct window."""

    def run(t: pa.Table) -> pa.Table:
        first: dict[bytes, int] = {}
        for content, doc in zip(t.column("content").to_pylist(), t.column("least").to_pylist(), strict=True):
            for w in _each_window(content, window):
                if first.get(w, doc) >= doc:
                    first[w] = doc
        one = lambda c: pa.array([t.column(c)[0].as_py()] * len(first), pa.int64())
        return pa.table([one("mh"), one("share"), pa.array(list(first), pa.binary()), pa.array(list(first.values()), pa.int64())], ["mh", "share", "window", "first"])

    return run


def _share_records(window: int):
    """Of a share's records and its windows' first documents in the bucket: what _buckets gives."""

    def run(t: pa.Table, firsts: pa.Table) -> pa.Table:
        first = dict(zip(firsts.column("window").to_pylist(), firsts.column("first").to_pylist(), strict=True))
        rows = [[first[w] for w in _each_window(c, window)] for c in t.column("content").to_pylist()]
        keep = pa.array([min(r) < m for r, m in zip(rows, t.column("most").to_pylist(), strict=True)], pa.bool_())
        return t.select(["ldoc", "lrid", "lidx"]).append_column("firsts", pa.array(rows, pa.list_(pa.int64()))).filter(keep)

    return run


def _in_shares(hot: DataFrame, window: int) -> DataFrame:
    """Rows (mh, share, ...) of hot buckets, solved."""
    mine = common.spool(hot.groupBy("mh", "share").applyInArrow(_share_windows(window), "mh long, share long, window binary, first long"), "hot-windows")
    least = mine.groupBy("mh", "window").agg(F.min("first").alias("first"))
    firsts = mine.select("mh", "share", "window").join(least, ["mh", "window"])
    return hot.groupBy("mh", "share").cogroup(firsts.groupBy("mh", "share")).applyInArrow(_share_records(window), "ldoc long, lrid long, lidx int, firsts array<long>")


def _cut(window: int, schema: T.StructType):
    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for t, at in zip(b.column(1), b.column(2), strict=True):
                words = _words(t.as_py())
                gone = np.zeros(len(words) + 1, np.int64)
                for chunk in at.as_py() or []:
                    for s in chunk:
                        gone[s] += 1
                        gone[min(s + window, len(words))] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
                edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), edges.reshape(-1, 2).tolist()))
            cells = {"n_words": pa.array([x[0] for x in out], pa.int64()), "n_removed": pa.array([x[1] for x in out], pa.int64()), "kept_sha256": pa.array([x[2] for x in out], pa.string())}
            if "kept_text" in schema.fieldNames():
                cells |= {"kept_text": pa.array([x[3] for x in out], pa.string()), "removed": pa.array([x[4] for x in out], pa.list_(pa.list_(pa.int32())))}
            yield pa.RecordBatch.from_arrays([b.column(0), *cells.values()], schema.fieldNames())

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, mmer: int = MMER, key: str = "doc_id", text: str = "text", texts: bool = True, hot_records: int = HOT_RECORDS) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256), with texts also kept_text and removed ([first, end) word spans); one for each row of docs.

    Removes each word covered by a window that also starts in a document of a smaller
    key; windows are judged on the input. Null texts have no words; a null key counts as
    larger than all. Rows equal in key and text get equal results. Other columns of docs
    are ignored; an empty table gives an empty one. Keys are whole numbers or null.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    rows = docs.select(F.col(key), doc.alias("doc"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("rid"), F.col(text).alias("_text"))
    read = rows.select("doc", "rid", "_text")
    met = read.mapInArrow(_minimisers(window, mmer), "mh long, least long, most long")
    shared = common.spool(met.groupBy("mh").agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a < b").select("mh"), "minimisers")
    sent = spark.sparkContext.broadcast(_filter(shared, shared.count()))
    records = common.spool(read.mapInArrow(_records(window, mmer, sent), RECORD), "super-kmers")
    slim = records.select("mh", "ldoc", "lrid", "lidx", "content", "least", "most")
    hot = common.small(records.groupBy("mh").agg(F.count("*").alias("n"), F.min("least").alias("a"), F.max("most").alias("b")).where((F.col("n") > hot_records) & (F.col("a") < F.col("b"))).select("mh", F.ceil(F.col("n") / hot_records).alias("shares")), "hot-minimisers")
    some = hot.take(1)
    cold = slim.join(hot, "mh", "left_anti") if some else slim
    found = cold.repartition(common.partitions(spark), "mh").sortWithinPartitions("mh").mapInArrow(_buckets(window), "ldoc long, lrid long, lidx int, firsts array<long>")
    if some:
        found = found.unionByName(_in_shares(slim.join(hot, "mh").withColumn("share", F.pmod(F.xxhash64("ldoc", "lrid", "lidx"), "shares")).drop("shares"), window))
    found = found.distinct()
    places = records.select("ldoc", "lrid", "lidx", "places").join(found, ["ldoc", "lrid", "lidx"]).select(F.explode("places").alias("p"), "firsts")
    starts = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("p.doc"), F.col("p.start") + i)), lambda x: x.isNotNull())
    gone = places.select("p.doc", "p.rid", starts.alias("at")).where(F.size("at") > 0).groupBy("doc", "rid").agg(F.collect_list("at").alias("at"))  # no longer than the document's words
    joined = rows.join(common.spool(gone, "windows-gone"), ["doc", "rid"], "left").select(key, "_text", "at")
    fields = [joined.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if texts:
        fields += [T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType())))]
    schema = T.StructType(fields)
    return joined.mapInArrow(_cut(window, schema), schema)


def op6_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents"), texts=False)


QUERIES = {"op6_superkmers": op6_superkmers}
ORACLES: dict[str, str] = {}
