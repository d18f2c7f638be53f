"""python -m gridloom.cli: convert example lists, deal tasks to streams or shards, claim and complete them, extract, and show a store's or ledger's state."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import Extraction
from gridloom.operators import control, extraction, partition, store, tasks
from gridloom.sources import jsonl, shards


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _tasks(spark: SparkSession, source: str, kind: str = "jsonl") -> DataFrame:
    return jsonl.read_tasks(spark, source, kind)


def _convert(spark, a) -> None:
    rows = partition.global_index(spark.read.parquet(a.source), a.order)
    done = tasks.convert(rows, a.column)
    jsonl.write_tasks(done.where("reject is null"), a.out)
    done.groupBy(F.coalesce("reject", F.lit("written")).alias("outcome")).count().show(truncate=False)


def _streams(spark, a) -> None:
    rows = _tasks(spark, a.source)
    jsonl.write_tasks(rows.withColumn("stream_id", partition.stream_of(F.col("line_idx"), a.streams)), a.out, "stream_id")
    ledger = control.Ledger(spark, f"{a.out}-manifest")
    ledger.create(control.manifest(spark, a.streams, a.out), a.overwrite)


def _shards(spark, a) -> None:
    rows = _tasks(spark, a.source).withColumnRenamed("line_idx", "idx")
    shards.write_counted(partition.global_index(rows, "idx", to="place").withColumn("idx", F.col("place")), a.out, a.per_shard, a.per_chunk).orderBy("shard", "chunk").show(1000, truncate=False)


def _claim(spark, a) -> None:
    ledger = control.Ledger(spark, a.source)
    row = control.preferred(ledger.read(), a.stream, control.STREAMS).first()
    if row is None:
        print("nothing is free")
        return
    ledger.write(control.claimed(ledger.read(), row["stream_id"], a.pod, _now()))
    print(row["stream_id"])


def _complete(spark, a) -> None:
    ledger = control.Ledger(spark, a.source)
    ledger.write(control.completed(ledger.read(), a.stream, _now()))


def _reset(spark, a) -> None:
    ledger = control.Ledger(spark, a.source)
    ledger.write(control.reset(ledger.read(), control.STREAMS))


def _extract(spark, a) -> None:
    """The model is what module:function gives for the layers and --hidden."""
    module, _, function = a.model.partition(":")
    layers = [int(x) for x in a.layers.split(",")]
    job = Extraction(dataset=a.source, out=a.out, layers=tuple(layers), batch=a.batch, machine=a.machine, machines=a.machines)
    done = extraction.run(spark, _tasks(spark, a.source, a.dataset_type), job, getattr(import_module(module), function)(layers, a.hidden), a.per_task, a.per_slice, order="line_idx")
    print(done)


def _status(spark, a) -> None:
    table = control.Ledger(spark, a.source).read()
    control.status(spark.read.parquet(a.source) if table is None else table).show(truncate=False)


def _store(spark, a) -> None:
    store.contiguity(store.read(spark, a.source)).orderBy("layer").show(1000, truncate=False)


#: Of each command: what it runs, and its options with their defaults; None: must be given.
COMMANDS = {
    "convert": (_convert, {"out": None, "order": "idx", "column": "examples"}),
    "streams": (_streams, {"out": None, "streams": 32, "overwrite": False}),
    "shards": (_shards, {"out": None, "per-shard": 1000, "per-chunk": 100}),
    "claim": (_claim, {"pod": None, "stream": -1}),
    "complete": (_complete, {"stream": -1}),
    "reset": (_reset, {}),
    "extract": (_extract, {"out": None, "model": "gridloom.operators.store:toy_model", "layers": "0", "hidden": 8, "batch": 4, "per-task": 8, "per-slice": 100_000, "machine": 0, "machines": 1, "dataset-type": "jsonl"}),
    "status": (_status, {}),
    "store": (_store, {}),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridloom")
    sub = p.add_subparsers(required=True)
    for name, (run, options) in COMMANDS.items():
        s = sub.add_parser(name)
        s.add_argument("source")
        for option, default in options.items():
            if default is False:
                s.add_argument(f"--{option}", action="store_true")
            else:
                s.add_argument(f"--{option}", required=default is None, default=default, type=type(default) if isinstance(default, int) else str)
        s.set_defaults(run=run)
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName("gridloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
