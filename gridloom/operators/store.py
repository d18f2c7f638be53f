"""The activation store: a row for each (layer, sample_idx), partitioned by layer, and questions about it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "layer int, sample_idx long, activation array<array<float>>, shape array<int>, text_preview string"
OVERHEAD = 1024


def nbytes(seq: Column, hidden: Column) -> Column:
    return seq.cast("long") * hidden * 4 + OVERHEAD


def write(records: DataFrame, path: str, rows_per_file: int = 1000, mode: str = "append") -> None:
    records.write.mode(mode).partitionBy("layer").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    """A filter on layers reads those folders alone."""
    rows = spark.read.parquet(path)
    return rows if layers is None else rows.where(F.col("layer").isin(*layers))


def finalize(records: DataFrame, path: str, shard: str = "shard_id") -> DataFrame:
    """Write what a store's shards hold beside its records, and return it."""
    described(records, shard).join(metadata(records, shard).select(shard, "layers"), shard).write.mode("overwrite").parquet(f"{path}/metadata")
    return records.sparkSession.read.parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    """The records of all shards of a finalized store, under path/records; an error where metadata is absent."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no metadata in {path}")
    return read(spark, f"{path}/records", layers)


def positions(activation: Column, at: list[int] | None) -> Column:
    """Rows of a [seq, hidden] array: all, or those at the positions, negative ones from the end."""
    if at is None:
        return activation
    return F.filter(F.array(*(F.try_element_at(activation, F.lit(p + 1 if p >= 0 else p)) for p in at)), lambda r: r.isNotNull())


def metadata(records: DataFrame, shard: str = "shard_id") -> DataFrame:
    """A row for each shard: its layers, records, distinct samples and bytes."""
    size = nbytes(F.get("shape", F.lit(0)), F.get("shape", F.lit(1)))
    return records.groupBy(shard).agg(F.array_sort(F.collect_set("layer")).alias("layers"), F.count("*").alias("total_samples"), F.countDistinct("sample_idx").alias("unique_samples"), F.sum(size).alias("buffer_bytes"))


def counters(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total_activations"), F.countDistinct("sample_idx").alias("total_unique_samples"), F.countDistinct("layer").alias("layers"))


def layer_counts(records: DataFrame, shard: str = "shard_id") -> DataFrame:
    """(shard, layer, samples), with rollups: layer null for a whole shard, both null for all."""
    return records.rollup(shard, "layer").agg(F.count("*").alias("samples"))


def described(records: DataFrame, shard: str = "shard_id") -> DataFrame:
    """A row for each shard: format version, its samples' range, samples, bytes, and a checksum that doesn't depend on the order of rows."""
    size = nbytes(F.get("shape", F.lit(0)), F.get("shape", F.lit(1)))
    digest = F.bit_xor(F.xxhash64("layer", "sample_idx", "activation"))
    return records.groupBy(shard).agg(F.lit("1.0").alias("version"), F.min("sample_idx").alias("first_sample"), F.max("sample_idx").alias("last_sample"), F.countDistinct("sample_idx").alias("num_samples"), F.sum(size).alias("size_bytes"), F.lower(F.hex(digest)).alias("checksum"))


def with_layer(shards: DataFrame, counts: DataFrame, layer: int, shard: str = "shard_id") -> DataFrame:
    """The shards that hold a layer."""
    return shards.join(counts.where(F.col("layer") == layer).select(shard), shard, "left_semi")


def item(records: DataFrame, shard_id: int, place: int, shard: str = "shard_id") -> DataFrame:
    """The place-th record (from 0) of one shard by sample and layer; that shard alone is read. No row where it has fewer."""
    return records.where(F.col(shard) == shard_id).orderBy("sample_idx", "layer").offset(place).limit(1)


def misshapen(records: DataFrame, hidden: int) -> DataFrame:
    """Records whose array isn't what shape says, or whose rows aren't `hidden` wide."""
    seq = F.get("shape", F.lit(0))
    ok = (F.size("activation") == seq) & (F.get("shape", F.lit(1)) == hidden) & F.forall("activation", lambda r: F.size(r) == hidden)
    return records.where(~F.coalesce(ok, F.lit(False)))


def sample_mb(seq: Column, hidden: int, layers: int = 1, width: int = 4) -> Column:
    """MB that a sample's activations take."""
    return seq * hidden * layers * width / (1 << 20)


def largest_batch(seq: Column, hidden: int, layers: int, free_gb: float, share: float = 0.8) -> Column:
    """How many samples of seq ids and their activations fit into a share of the free memory."""
    return F.floor(F.lit(free_gb) / (sample_mb(seq, hidden, layers) / 1024 + seq * 4 / (1 << 30)) * share).cast("long")


def coverage(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Layers that are expected and absent, or there and not expected."""
    there = records.select("layer").distinct()
    missing = expected.join(there, "layer", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(there.join(expected, "layer", "left_anti").withColumn("problem", F.lit("unexpected")))


def contiguity(records: DataFrame) -> DataFrame:
    """For each layer whether its sample numbers are 0, 1, ... once each."""
    n, d = F.count("*"), F.countDistinct("sample_idx")
    return records.groupBy("layer").agg(n.alias("n"), (n - d).alias("duplicates"), ((F.min("sample_idx") == 0) & (F.max("sample_idx") == d - 1)).alias("contiguous"))


def inconsistent(records: DataFrame, *columns: str) -> DataFrame:
    """Samples for which a column differs between layers."""
    by = records.groupBy("sample_idx").agg(*(F.countDistinct(c).alias(c) for c in columns))
    return by.where(F.greatest(*(F.col(c) for c in columns), F.lit(1)) > 1)


def flaws(values: Column) -> dict[str, Column]:
    return {"nans": F.size(F.filter(values, F.isnan)), "infs": F.size(F.filter(values, lambda v: F.abs(v) == float("inf")))}


Model = Callable[[np.ndarray], dict[int, np.ndarray]]


def toy_model(layers: list[int], hidden: int) -> Model:
    """A deterministic stand-in for a model: layer l of token t has components sin((t + 1)(l + 1)(k + 1))."""

    def run(tokens: np.ndarray) -> dict[int, np.ndarray]:
        k = np.arange(1, hidden + 1)
        return {layer: np.sin((tokens[..., None] + 1.0) * (layer + 1) * k).astype(np.float32) for layer in layers}

    return run


def linear_model(layers: list[int], hidden: int) -> Model:
    """A stand-in of whole numbers: component k of token t on layer l is (t + 1)(l + 1)(k + 1) mod 97."""

    def run(tokens: np.ndarray) -> dict[int, np.ndarray]:
        k = np.arange(1, hidden + 1)
        return {layer: ((tokens[..., None] + 1) * (layer + 1) * k % 97).astype(np.float32) for layer in layers}

    return run


def of_kind(model: Model, kind: str) -> Model:
    """A model whose layers give arrays by kind (residual, mlp, attn) as one that gives those of one kind; others stay."""

    def run(tokens: np.ndarray) -> dict[int, np.ndarray]:
        return {layer: v[kind] if isinstance(v, dict) else v for layer, v in model(tokens).items()}

    return run


def extract(prompts: DataFrame, model: Model, batch: int, width: int | None = None, pad: int = 0) -> DataFrame:
    """Records of all layers for rows (sample_idx, tokens, text_preview).

    The model is any function of a [batch, width] array, so it can be swapped without a
    change here. Short batches are filled with their last row, and what the model gives
    for that is left out; padding positions are cut off. width: tokens beyond it are
    dropped; None: nothing is, and each batch is padded to its own longest row.
    """

    def record(layer: int, values: np.ndarray, size: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        inside = np.arange(values.shape[1])[None, :] < size[:, None]
        cells, hidden = values[: len(size)][inside], values.shape[2]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * hidden, pa.int32()), pa.array(cells.ravel(), pa.float32()))
        grids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), rows)
        shape = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * 2, pa.int32()), pa.array(np.c_[size, np.full(len(size), hidden)].ravel(), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(size), layer, np.int32)), part.column("sample_idx").cast(pa.int64()), grids, shape, part.column("text_preview")], ["layer", "sample_idx", "activation", "shape", "text_preview"])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                rows = [t[:width] for t in part.column("tokens").to_pylist()]
                size = np.array([len(r) for r in rows], np.int64)
                ids = np.full((batch, int(size.max(initial=0)) if width is None else width), pad, np.int64)
                for k in range(batch):
                    row = rows[min(k, len(rows) - 1)]
                    ids[k, : len(row)] = row
                for layer, values in model(ids).items():
                    yield record(layer, values, size, part)

    return prompts.select("sample_idx", "tokens", "text_preview").mapInArrow(run, RECORD)
