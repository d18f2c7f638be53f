"""Queries of whole jobs: numbered files, prompts of all variants, extraction with resume, stream loops, and what a store holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import Extraction
from gridloom.functions import tokens
from gridloom.operators import control, extraction, metrics, partition, store
from gridloom.plans import sql
from gridloom.plans.data import records, task_lines
from gridloom.plans.grids import prompt_sql
from gridloom.sources import jsonl, shards, shared
from gridloom.sources.tables import derived_tasks, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# Files


@query("global_index_payload", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice, o_orderpriority FROM orders")
def global_index_payload(spark: SparkSession, d: str) -> DataFrame:
    return partition.global_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey")


@query("scan_numbered_lines", f"WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS line_idx FROM part WHERE p_partkey % 11 <> 0) SELECT line_idx, {sql.text(sql.grid('p_partkey'))} AS txt FROM n")
def scan_numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tasks written as files of lines, and read back with the lines numbered over all files."""
    at = shared.fresh(spark, "lines")
    task_lines(spark, d).where("line not like '{oops%'").repartitionByRange(8, "line_idx").sortWithinPartitions("line_idx").select("line").write.text(at)
    rows = jsonl.parsed_tasks(jsonl.lines(spark, at))
    return rows.select("line_idx", F.array_join(F.transform(F.col("train")[0]["input"], lambda r: F.array_join(r.cast("array<string>"), "")), "\n").alias("txt"))


@query("shard_dataset_counted", "WITH n AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) SELECT (i // 300)::INT AS shard, ((i % 300) // 50)::INT AS chunk, count(*) AS tasks, 'available' AS status FROM n GROUP BY ALL")
def shard_dataset_counted(spark: SparkSession, d: str) -> DataFrame:
    tasks = partition.global_index(derived_tasks(spark, d), "key")
    return shards.write_counted(tasks, shared.fresh(spark, "shards"), 300, 50).drop("bytes")


# Prompts of all variants, and their extraction

VARIANTS = f"""{sql.TASKS}, {sql.AUG}, x0 AS (SELECT key, task_id, aug_idx, hflip, n_rot90, s.i AS i, s.g AS g FROM (SELECT key, task_id, unnest(list_concat(list_transform(train, lambda s, i: {{'i': 2 * i, 'g': s.input}}), list_concat(list_transform(train, lambda s, i: {{'i': 2 * i + 1, 'g': s.output}}), [{{'i': 0, 'g': test[1].input}}, {{'i': 1, 'g': test[1].output}}]))) AS s FROM t0), a0 WHERE aug_idx < 3),
x1 AS (SELECT key, task_id, aug_idx, list({sql.geometric('g', 'hflip', 'n_rot90')} ORDER BY i) AS gs FROM x0 GROUP BY ALL),
v0 AS (SELECT key, task_id, aug_idx, list_transform({sql.shuffled('range(0, 3)', "('0:' || task_id || ':' || aug_idx || ':0')")}, lambda i: {{'input': gs[2 * i + 3], 'output': gs[2 * i + 4]}}) AS train, [{{'input': gs[1], 'output': gs[2]}}] AS test FROM x1)"""


@query("prompt_cross_product", f"{prompt_sql('output-from-examples-v1', False, VARIANTS, 'v0', 'key, task_id, aug_idx')} SELECT key, aug_idx, 0 AS repeat, 0 AS idx, prompt FROM p")
def prompt_cross_product(spark: SparkSession, d: str) -> DataFrame:
    """Three prompts for each test: the first three augmentations, once."""
    return extraction.prompt_rows(derived_tasks(spark, d), 3, "output-from-examples-v1", order="key", colors=False).select("key", "aug_idx", "repeat", "idx", "prompt")


@query("prompt_variants", "SELECT p_partkey AS key, a::INT AS aug_idx, r::INT AS repeat, a >= 4 AS hflip, (a % 4)::INT AS n_rot90 FROM part, range(0, 8) x(a), range(0, 2) y(r)")
def prompt_variants(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen or more prompts a test: all augmentations, twice."""
    from gridloom.operators import tasks

    return tasks.variants(derived_tasks(spark, d), 17).select("key", "aug_idx", "repeat", "hflip", "n_rot90")


_FIRST = prompt_sql("output-from-examples-v1", False, VARIANTS.replace("aug_idx < 3", "aug_idx < 1"), "v0", "key, task_id, aug_idx")
_BYTES = "list_transform(range(0, octet_length(encode(prompt))), lambda i: ('0x' || hex(encode(prompt))[2 * i + 1:2 * i + 2])::INT)"


@query("extract_resume", f"""{_FIRST}, b AS (SELECT octet_length(encode(prompt)) AS n, {_BYTES} AS t FROM p), l(layer) AS (VALUES (0), (3))
SELECT layer, count(*) AS samples, sum(n)::BIGINT AS seq, sum(list_sum(list_transform(t, lambda x: (x + 1) * (layer + 1) % 97 + (x + 1) * (layer + 1) * 2 % 97)))::DOUBLE AS total FROM b, l GROUP BY layer""")
def extract_resume(spark: SparkSession, d: str) -> DataFrame:
    """All tasks' prompts extracted in slices, interrupted after the second and resumed: each sample is there once."""
    job = Extraction(dataset="derived", out=shared.fresh(spark, "extraction"), layers=(0, 3), batch=16)
    model, tasks = store.linear_model([0, 1, 3], 2), derived_tasks(spark, d)
    size = max(1, -(-tasks.count() // 4))
    for most in (2, None):
        done = extraction.run(spark, tasks, job, model, per_task=1, per_slice=size, order="key", colors=False, most_slices=most)
    if done.get("status") != "completed":
        raise RuntimeError("the resumed run has not come to its end")
    total = F.aggregate(F.flatten("activation"), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return extraction.records(spark, job).groupBy("layer").agg(F.count("*").alias("samples"), F.sum(F.get("shape", F.lit(0)).cast("long")).alias("seq"), F.sum(total).alias("total"))


@query("stream_loop", "SELECT range AS stream_id, CASE WHEN range BETWEEN 2 AND 6 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN range BETWEEN 2 AND 6 THEN 'pod_1' END AS pod_id FROM range(10)")
def stream_loop(spark: SparkSession, d: str) -> DataFrame:
    """A pod claims, works through and completes the streams of its range; one that failed first is taken up again."""
    ledger = control.Ledger(spark, shared.fresh(spark, "streams"))
    ledger.create(control.manifest(spark, 10, "data"))
    failed: list[int] = []

    def work(row) -> None:
        if row["stream_id"] == 4 and not failed:
            failed.append(4)
            raise RuntimeError("interrupted")

    clock = lambda: "2026-01-01T00:00:00"
    try:
        control.run_streams(ledger, "pod_1", work, clock, (2, 6))
    except RuntimeError:
        control.run_streams(ledger, "pod_1", work, clock, (2, 6))
    return ledger.read().select("stream_id", "status", "pod_id")


# What a store holds


@query("store_samples_per_layer", "SELECT coalesce(s, -1) AS shard_id, coalesce(label, -1) AS layer, count(*) AS samples FROM (SELECT vec_id // 50 AS s, label FROM embeddings) GROUP BY ROLLUP (s, label)")
def store_samples_per_layer(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each layer of a shard, of each shard (layer -1) and in all (shard -1)."""
    counts = store.layer_counts(records(spark, d).withColumn("shard_id", F.floor(F.col("sample_idx") / 50)))
    return counts.select(F.coalesce("shard_id", F.lit(-1)).alias("shard_id"), F.coalesce("layer", F.lit(-1)).alias("layer"), "samples")


@query("store_described", "SELECT vec_id // 50 AS shard_id, '1.0' AS version, min(vec_id) AS first_sample, max(vec_id) AS last_sample, count(DISTINCT vec_id) AS num_samples, (count(*) * 1280)::BIGINT AS size_bytes, TRUE AS stable FROM embeddings GROUP BY ALL")
def store_described(spark: SparkSession, d: str) -> DataFrame:
    """Shards' descriptions; stable: the checksum is the same when rows come in another order."""
    rows = records(spark, d).withColumn("shard_id", F.floor(F.col("sample_idx") / 50))
    again = store.described(rows.repartition(5, "sample_idx")).select("shard_id", F.col("checksum").alias("other"))
    return store.described(rows).join(again, "shard_id").withColumn("stable", F.col("checksum") == F.col("other")).drop("checksum", "other")


@query("store_with_layer", "SELECT DISTINCT vec_id // 10 AS shard_id FROM embeddings WHERE label = 3")
def store_with_layer(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).withColumn("shard_id", F.floor(F.col("sample_idx") / 10))
    return store.with_layer(rows.select("shard_id").distinct(), store.layer_counts(rows).where("shard_id is not null"), 3)


@query("store_item", "SELECT label AS layer, vec_id AS sample_idx FROM embeddings WHERE vec_id // 50 = 1 ORDER BY vec_id, label LIMIT 1 OFFSET 7")
def store_item(spark: SparkSession, d: str) -> DataFrame:
    """The eighth record of shard 1."""
    return store.item(records(spark, d).withColumn("shard_id", F.floor(F.col("sample_idx") / 50)), 1, 7).select("layer", "sample_idx")


@query("store_misshapen", "SELECT vec_id AS sample_idx FROM embeddings WHERE vec_id % 9 = 0")
def store_misshapen(spark: SparkSession, d: str) -> DataFrame:
    """Records with a row too many."""
    more = F.when(F.col("sample_idx") % 9 == 0, F.concat("activation", F.slice("activation", 1, 1))).otherwise(F.col("activation"))
    return store.misshapen(records(spark, d).withColumn("activation", more), 8).select("sample_idx")


@query("store_largest_batch", "SELECT doc_id, floor(16.0 / ((n_chars::DOUBLE * 896 * 14 * 4 / 1048576) / 1024 + n_chars::DOUBLE * 4 / 1073741824) * 0.8)::BIGINT AS most FROM documents")
def store_largest_batch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", store.largest_batch(F.col("n_chars").cast("double"), 896, 14, 16.0).alias("most"))


@query("parity_top_match", "SELECT vec_id, vec_id % 4 <> 0 AS matches FROM embeddings")
def parity_top_match(spark: SparkSession, d: str) -> DataFrame:
    """Vectors against copies of which every fourth has its largest entry moved to the front."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    spoilt = F.concat(F.array(F.array_max("x") + 1), F.slice("x", 2, 63))
    other = rows.withColumn("x", F.when(F.col("vec_id") % 4 == 0, F.when(F.array_position("x", F.array_max("x")) == 1, F.concat(F.array(F.array_min("x") - 1), F.slice("x", 2, 63))).otherwise(spoilt)).otherwise(F.col("x")))
    return metrics.top_match(rows, other, "vec_id", "x")


@query("act_softmax", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(e[1] / list_sum(e), 6) AS first, round(list_max(e) / list_sum(e), 6) AS largest FROM e")
def act_softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", tokens.softmax(F.transform("embedding", lambda v: v.cast("double"))).alias("p"))
    return rows.select("vec_id", F.round(F.col("p")[0], 6).alias("first"), F.round(F.array_max("p"), 6).alias("largest"))


@query("phase_seconds", "SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 6) AS s FROM events")
def phase_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since a user's event before."""
    from pyspark.sql import Window

    t = F.col("ts").cast("timestamp")
    before = F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", F.round(metrics.seconds_between(before, t), 6).alias("s"))


@query("timing_without_warm_up", "WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean FROM n WHERE i > 2 GROUP BY event_type")
def timing_without_warm_up(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.without_warm_up(table(spark, d, "events"), "event_type", "event_id", 2)
    return metrics.profile(rows, "event_type", "value").select(F.col("event_type").alias("name"), "n", F.round("mean", 6).alias("mean"))


@query("rr_samples_per_stream", "SELECT count(*) // 32 AS samples_per_stream FROM orders")
def rr_samples_per_stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(metrics.per_stream(F.count("*"), 32).alias("samples_per_stream"))
