"""Queries of ingest, partitioning, tokens, the activation store, control tables and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import grid, tokens
from gridloom.operators import control, metrics, partition, store
from gridloom.operators import tasks as ops
from gridloom.plans import sql
from gridloom.sources import jsonl, shared
from gridloom.sources.tables import derived_grid, table
from gridloom.streaming import ingest as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# Ingest

#: Lines of a task file, one for each part: some without an id, some with one that others have, every eleventh unreadable.
LINES = "l0 AS (SELECT p_partkey AS line_idx, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'task_' || (p_partkey % 50) END AS task_id FROM part WHERE p_partkey % 11 <> 0)"


def task_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    digits = lambda key: F.to_json(derived_grid(key))
    sample = F.concat(F.lit('[{"input": '), digits(k), F.lit(', "output": '), digits(k + 1), F.lit("}]"))
    line = F.concat(F.lit("{"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"task_id": "task_'), (k % 50).cast("string"), F.lit('", '))), F.lit('"train": '), sample, F.lit(', "test": '), sample, F.lit("}"))
    return table(spark, d, "part").select(k.alias("line_idx"), F.when(k % 11 == 0, F.lit("{oops")).otherwise(line).alias("line"))


IDS = f"""{LINES}, l1 AS (SELECT *, coalesce(task_id, printf('task_%08x', line_idx)) AS given FROM l0),
l2 AS (SELECT line_idx, CASE WHEN row_number() OVER (PARTITION BY given ORDER BY line_idx) = 1 THEN given ELSE printf('task_%08x', line_idx) END AS task_id FROM l1)"""


@query("scan_jsonl_ids", f"WITH {IDS} SELECT line_idx, task_id, {sql.text(sql.grid('line_idx'))} AS txt FROM l2")
def scan_jsonl_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = jsonl.unique_ids(jsonl.parsed_tasks(task_lines(spark, d)))
    return rows.select("line_idx", "task_id", grid.text(F.col("train")[0]["input"]).alias("txt"))


@query("scan_dedup_ids", f"WITH {LINES} SELECT coalesce(task_id, printf('task_%08x', line_idx)) AS task_id, min(line_idx) AS first_idx, max(line_idx) AS line_idx FROM l0 GROUP BY ALL")
def scan_dedup_ids(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.last_wins(jsonl.parsed_tasks(task_lines(spark, d))).select("task_id", "first_idx", "line_idx")


@query("scan_limit_after_filter", f"WITH {IDS} SELECT line_idx, task_id FROM l2 WHERE line_idx % 4 = 1 ORDER BY line_idx LIMIT 100")
def scan_limit_after_filter(spark: SparkSession, d: str) -> DataFrame:
    """A report of a machine's first 100 tasks: the limit counts what the filters leave."""
    rows = jsonl.unique_ids(jsonl.parsed_tasks(task_lines(spark, d)))
    return rows.where(partition.machine_filter(F.col("line_idx"), 1, 4)).select("line_idx", "task_id").orderBy("line_idx").limit(100)


@query("text_record_fallback", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE doc_id || '' END AS id, CASE WHEN doc_id % 3 < 2 THEN text ELSE '' END AS text FROM documents")
def text_record_fallback(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    line = F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("d"), k.cast("string"))).alias("id"), F.when(k % 3 == 0, F.col("text")).alias("text"), F.when(k % 3 == 1, F.col("text")).alias("content")))
    return table(spark, d, "documents").withColumn("r", jsonl.text_record(line, k)).select("doc_id", "r.id", "r.text")


@query("text_range", "SELECT doc_id, lang FROM documents WHERE doc_id >= 100 AND doc_id < 350")
def text_range(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.window_of(table(spark, d, "documents"), "doc_id", 100, 350).select("doc_id", "lang")


@query("dataset_shard", "SELECT doc_id FROM documents WHERE doc_id % 8 = 3 AND doc_id // 8 < 50")
def dataset_shard(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.dataset_shard(table(spark, d, "documents"), "doc_id", 8, 3, 50).select("doc_id")


def raw_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Example lists as JSON: by key % 11 unreadable (0), one pair (1), a bad first pair (2), a bad last one (3), all training pairs bad (4), null (5), else good."""
    k = F.col("p_partkey")
    g = lambda x: F.to_json(derived_grid(x))
    pair = lambda x: F.concat(F.lit("["), g(x), F.lit(","), g(x + 1), F.lit("]"))
    many = lambda *p: F.concat(F.lit("["), F.concat_ws(",", *p), F.lit("]"))
    bad, short = F.lit('[[["x"]],[[1]]]'), F.concat(F.lit("["), g(k), F.lit("]"))
    kind = k % 11
    text = F.when(kind == 0, F.lit("oops")).when(kind == 1, many(pair(k))).when(kind == 2, many(short, pair(k), pair(k + 2))).when(kind == 3, many(pair(k), bad)).when(kind == 4, many(bad, short, pair(k))).when(kind == 5, F.lit(None).cast("string")).otherwise(many(pair(k), pair(k + 1), pair(k + 2)))
    return table(spark, d, "part").select(k.alias("idx"), text.alias("examples"))


GOOD = "idx % 11 NOT IN (0, 1, 3, 4, 5)"


@query("convert_validate_tasks", f"WITH r AS (SELECT p_partkey AS idx FROM part) SELECT idx, printf('task_%08x', idx) AS task_id, CASE WHEN idx % 11 = 2 THEN 1 ELSE 2 END::INT AS n_train, {sql.text(sql.grid('idx'))} AS first_input, {sql.text(sql.grid('idx + 2'))} AS test_input FROM r WHERE {GOOD}")
def convert_validate_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.convert(raw_pairs(spark, d)).where("reject is null")
    return rows.select("idx", "task_id", F.size("train").alias("n_train"), grid.text(F.col("train")[0]["input"]).alias("first_input"), grid.text(F.col("test")[0]["input"]).alias("test_input"))


@query("convert_reject_counts", "SELECT CASE p_partkey % 11 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'too few pairs' WHEN 3 THEN 'bad test' WHEN 4 THEN 'no training pair' WHEN 5 THEN 'missing' ELSE 'good' END AS reject, count(*) AS n FROM part GROUP BY ALL")
def convert_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.convert(raw_pairs(spark, d)).groupBy(F.coalesce("reject", F.lit("good")).alias("reject")).agg(F.count("*").alias("n"))


# Partitioning


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return partition.global_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


IDX = "i0 AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)"


@query("global_index", f"WITH {IDX} SELECT o_orderkey, idx FROM i0")
def global_index(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d)


@query("rr_stream_assign", f"WITH {IDX} SELECT o_orderkey, (idx % 32)::INT AS stream_id, printf('task_%08x', idx) AS task_id FROM i0")
def rr_stream_assign(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("idx")
    return indexed(spark, d).select("o_orderkey", partition.stream_of(i, 32).alias("stream_id"), partition.task_id_of(i).alias("task_id"))


@query("rr_stream_counts", f"WITH {IDX} SELECT coalesce(s, -1)::INT AS stream_id, count(*) AS written, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS invalid FROM (SELECT *, (idx % 32)::INT AS s FROM i0) GROUP BY ROLLUP (s)")
def rr_stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """By stream, and in all (-1)."""
    return indexed(spark, d).withColumn("stream_id", partition.stream_of(F.col("idx"), 32)).rollup("stream_id").agg(F.count("*").alias("written"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("invalid")).withColumn("stream_id", F.coalesce("stream_id", F.lit(-1)))


@query("machine_filter", f"WITH {IDX} SELECT o_orderkey FROM i0 WHERE idx % 8 = 5")
def machine_filter(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).where(partition.machine_filter(F.col("idx"), 5, 8)).select("o_orderkey")


@query("two_level_filter", f"WITH {IDX} SELECT o_orderkey FROM i0 WHERE idx % 8 = 5 AND (idx // 8) % 4 = 2")
def two_level_filter(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("idx")
    return indexed(spark, d).where(partition.machine_filter(i, 5, 8) & partition.host_filter(i, 2, 4, 8)).select("o_orderkey")


def _total(rows: DataFrame):
    return F.lit(rows.count())


@query("contiguous_balanced", f"WITH {IDX} SELECT o_orderkey, (ntile(7) OVER (ORDER BY idx) - 1)::INT AS host, idx // 32 AS batch FROM i0")
def contiguous_balanced(spark: SparkSession, d: str) -> DataFrame:
    rows = indexed(spark, d)
    return rows.select("o_orderkey", partition.balanced(F.col("idx"), _total(rows), 7).alias("host"), partition.batch_of(F.col("idx"), 32).alias("batch"))


@query("contiguous_drop_remainder", f"WITH {IDX} SELECT o_orderkey, (idx // (n // 7))::INT AS shard FROM i0 WHERE idx < 7 * (n // 7)")
def contiguous_drop_remainder(spark: SparkSession, d: str) -> DataFrame:
    rows = indexed(spark, d)
    return rows.select("o_orderkey", partition.contiguous(F.col("idx"), _total(rows), 7, drop_remainder=True).alias("shard")).where("shard is not null")


@query("count_shard_chunk", f"WITH {IDX} SELECT (idx // 1000)::INT AS shard, ((idx % 1000) // 100)::INT AS chunk, count(*) AS n FROM i0 GROUP BY ALL")
def count_shard_chunk(spark: SparkSession, d: str) -> DataFrame:
    shard, chunk = partition.shard_and_chunk(F.col("idx"))
    return indexed(spark, d).groupBy(shard.alias("shard"), chunk.alias("chunk")).agg(F.count("*").alias("n"))


def packs(close_first: bool) -> str:
    """The fold of one stream after the other, as a recursive query."""
    over = "w.held > 0 AND w.held + s.size > 40000" if close_first else "w.full"
    held = f"CASE WHEN {over} THEN s.size ELSE w.held + s.size END"
    first = "SELECT lang, i, doc_id, size, size AS held, 0 AS pack" + ("" if close_first else ", size >= 40000 AS full") + " FROM s WHERE i = 1"
    step = f"SELECT s.lang, s.i, s.doc_id, s.size, {held}, CASE WHEN {over} THEN w.pack + 1 ELSE w.pack END" + ("" if close_first else f", ({held}) >= 40000") + " FROM w JOIN s ON s.lang = w.lang AND s.i = w.i + 1"
    return f"WITH RECURSIVE s AS (SELECT doc_id, lang, octet_length(encode(text)) + {0 if close_first else 1024} AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents), w AS ({first} UNION ALL {step}) SELECT doc_id, lang, pack::INT AS pack FROM w"


@query("chunk_pack_pre_flush", packs(True))
def chunk_pack_pre_flush(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", F.octet_length("text").alias("bytes"))
    return partition.pack(rows, "lang", "doc_id", F.col("bytes"), 40_000).select("doc_id", "lang", "pack")


@query("shard_pack_post_flush", packs(False))
def shard_pack_post_flush(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", F.octet_length("text").alias("bytes"))
    return partition.pack(rows, "lang", "doc_id", F.col("bytes"), 40_000, close_first=False, overhead=1024).select("doc_id", "lang", "pack")


@query("shard_pack_equal", f"WITH {IDX} SELECT (idx // 35 + 1)::INT AS shard, count(*) AS n FROM i0 GROUP BY ALL")
def shard_pack_equal(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).groupBy(partition.equal_shards(F.col("idx"), 3000, 104_000).alias("shard")).agg(F.count("*").alias("n"))


@query("region_assign", "WITH s AS (SELECT range AS stream_id FROM range(32)) SELECT stream_id, r_name AS region FROM s JOIN region ON stream_id // 8 = r_regionkey")
def region_assign(spark: SparkSession, d: str) -> DataFrame:
    """Thirty-two streams to four regions by ranges of eight."""
    ranges = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_name").alias("region"), (F.col("r_regionkey") * 8).alias("a"))
    own = spark.range(32).withColumnRenamed("id", "stream_id")
    return own.join(F.broadcast(ranges), F.col("stream_id").between(F.col("a"), F.col("a") + 7)).select("stream_id", "region")  # four rows


@query("batch_resume", f"WITH {IDX} SELECT o_orderkey, idx // 64 AS batch FROM i0 WHERE idx >= 10000 AND (idx // 64 + 1) * 64 > 10000")
def batch_resume(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).where("idx >= 10000").select("o_orderkey", partition.batch_of(F.col("idx"), 64).alias("batch"))


# Tokens

TOK = "t0 AS (SELECT doc_id, list_transform(range(0, 1 + doc_id % 40), lambda i: ((doc_id * 31 + i * 7) % 1000)::INT) AS ids FROM documents)"


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    ids = F.transform(F.sequence(F.lit(0).cast("long"), k % 40), lambda i: ((k * 31 + i * 7) % 1000).cast("int"))
    return table(spark, d, "documents").select("doc_id", ids.alias("ids"))


def _csv(c):
    return F.array_join(c.cast("array<string>"), ",")


@query("pad_truncate", f"WITH {TOK} SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(0, 16), lambda i: 0::INT))[1:16], ',') AS ids FROM t0")
def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(spark, d).select("doc_id", _csv(tokens.pad(F.col("ids"), 16)).alias("ids"))


@query("batch_max_pad", f"WITH {TOK}, m AS (SELECT doc_id, ids, max(len(ids)) OVER (PARTITION BY doc_id // 8) AS w FROM t0) SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(0, w - len(ids)), lambda i: 999::INT)), ',') AS ids FROM m")
def batch_max_pad(spark: SparkSession, d: str) -> DataFrame:
    rows = token_rows(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 8))
    width = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("w"))
    return rows.join(width, "batch").select("doc_id", _csv(tokens.pad(F.col("ids"), F.col("w"), 999)).alias("ids"))


@query("batch_pad", "WITH b AS (SELECT doc_id // 7 AS batch, list(doc_id ORDER BY doc_id) AS r FROM documents GROUP BY ALL) SELECT batch, array_to_string(list_concat(r, list_transform(range(0, 7 - len(r)), lambda i: r[len(r)])), ',') AS rows, 7 - len(r) AS pads FROM b")
def batch_pad(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 7).alias("batch")).agg(tokens.pad_batch(F.array_sort(F.collect_list("doc_id")), 7).alias("b"))  # seven rows at most
    return batches.select("batch", _csv(F.transform("b", lambda x: x["row"])).alias("rows"), F.size(F.filter("b", lambda x: x["is_pad"])).cast("long").alias("pads"))


@query("byte_tokenize", "SELECT item_id, array_to_string(list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || hex(encode(text))[2 * i + 1:2 * i + 2])::INT), ',') AS ids FROM benchmark")
def byte_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", _csv(tokens.byte_tokens(F.col("text"))).alias("ids"))


@query("token_counts", "SELECT lang, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, max(octet_length(encode(text)))::BIGINT AS longest FROM documents GROUP BY lang")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("bytes"), F.max(n).alias("longest"))


# The activation store


def records(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as records: label is the layer, 64 numbers are 8 positions of 8."""
    e = F.col("embedding")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 8 + 1, F.lit(8)))
    preview = F.concat(F.lit("vec "), F.col("vec_id").cast("string"))
    return table(spark, d, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("sample_idx"), rows.alias("activation"), F.array(F.lit(8), F.lit(8)).alias("shape"), preview.alias("text_preview"))


def _doubles(c):
    return F.transform(c, lambda v: v.cast("double"))


VALUES = "v0 AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query("act_explode_stats", f"WITH {VALUES} SELECT label AS layer, count(*) AS n, round(avg(abs(v)), 6) AS mean_abs, round(stddev_pop(v), 6) AS std, count(*) FILTER (WHERE v <> 0) AS non_zero FROM v0 GROUP BY label")
def act_explode_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).select("layer", F.explode(_doubles(F.flatten("activation"))).alias("v"))
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("v")), 6).alias("mean_abs"), F.round(F.stddev_pop("v"), 6).alias("std"), F.count_if(F.col("v") != 0).alias("non_zero"))


@query("act_nan_check", "SELECT vec_id AS sample_idx, (CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END)::INT AS nans, (CASE WHEN vec_id % 15 = 0 THEN 1 ELSE 0 END)::INT AS infs FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 15 = 0")
def act_nan_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("sample_idx")
    spoilt = F.concat(F.flatten("activation"), F.when(k % 10 == 0, F.array(F.lit(float("nan")).cast("float"))).otherwise(F.array().cast("array<float>")), F.when(k % 15 == 0, F.array(F.lit(float("-inf")).cast("float"))).otherwise(F.array().cast("array<float>")))
    return records(spark, d).withColumn("x", spoilt).select("sample_idx", *(c.alias(n) for n, c in store.flaws(F.col("x")).items())).where("nans > 0 or infs > 0")


@query("act_layer_filter", "SELECT label AS layer, vec_id AS sample_idx FROM embeddings WHERE label IN (2, 5, 7)")
def act_layer_filter(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(F.col("layer").isin(2, 5, 7)).select("layer", "sample_idx")


@query("act_token_filter", "SELECT vec_id AS sample_idx, round(list_sum(list_transform(list_concat(embedding[1:8], list_concat(embedding[25:32], embedding[57:64])), lambda x: x::DOUBLE)), 5) AS s FROM embeddings")
def act_token_filter(spark: SparkSession, d: str) -> DataFrame:
    x = F.flatten(store.positions(F.col("activation"), [0, 3, -1, 40]))
    return records(spark, d).select("sample_idx", F.round(F.aggregate(_doubles(x), F.lit(0.0), lambda a, v: a + v), 5).alias("s"))


@query("act_last_token", "SELECT vec_id AS sample_idx, round(embedding[57]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def act_last_token(spark: SparkSession, d: str) -> DataFrame:
    last = store.positions(F.col("activation"), [-1])[0]
    return records(spark, d).select("sample_idx", F.round(last[0].cast("double"), 6).alias("first"), F.round(last[7].cast("double"), 6).alias("last"))


@query("act_rmsnorm", "WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x)) / 64 + 1e-6) AS r FROM d) SELECT vec_id, round(e[1] / r, 5) AS first, round(list_sum(list_transform(e, lambda x: abs(x / r))), 4) AS total FROM m")
def act_rmsnorm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", tokens.rms_norm(_doubles(F.col("embedding"))).alias("x"))
    return rows.select("vec_id", F.round(F.col("x")[0], 5).alias("first"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("total"))


@query("act_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def act_argmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", tokens.argmax(F.col("embedding")).alias("best"))


@query("act_size_estimate", "SELECT doc_id, n_chars * 896 * 4 + 1024 AS bytes FROM documents")
def act_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", store.nbytes(F.col("n_chars"), F.lit(896)).alias("bytes"))


@query("store_metadata", "SELECT vec_id // 50 AS shard_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS layers, count(*) AS total_samples, count(DISTINCT vec_id) AS unique_samples, (count(*) * 1280)::BIGINT AS buffer_bytes FROM embeddings GROUP BY ALL")
def store_metadata(spark: SparkSession, d: str) -> DataFrame:
    return store.metadata(records(spark, d).withColumn("shard_id", F.floor(F.col("sample_idx") / 50))).withColumn("layers", _csv(F.col("layers")))


@query("store_counters", "SELECT count(*) AS total_activations, count(DISTINCT vec_id % 300) AS total_unique_samples, count(DISTINCT label) AS layers FROM embeddings")
def store_counters(spark: SparkSession, d: str) -> DataFrame:
    return store.counters(records(spark, d).withColumn("sample_idx", F.col("sample_idx") % 300))


@query("store_layer_coverage", "WITH e AS (SELECT range::INT AS layer FROM range(2, 14)), t AS (SELECT DISTINCT label AS layer FROM embeddings) SELECT layer, 'missing' AS problem FROM e WHERE layer NOT IN (SELECT layer FROM t) UNION ALL SELECT layer, 'unexpected' FROM t WHERE layer NOT IN (SELECT layer FROM e)")
def store_layer_coverage(spark: SparkSession, d: str) -> DataFrame:
    return store.coverage(records(spark, d), spark.range(2, 14).select(F.col("id").cast("int").alias("layer")))


@query("store_contiguity", "WITH r AS (SELECT label AS layer, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 + CASE WHEN label % 3 = 0 AND vec_id % 20 = 0 THEN 1 ELSE 0 END AS s FROM embeddings) SELECT layer, count(*) AS n, count(*) - count(DISTINCT s) AS duplicates, min(s) = 0 AND max(s) = count(DISTINCT s) - 1 AS contiguous FROM r GROUP BY layer")
def store_contiguity(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("layer").orderBy("sample_idx")) - 1
    return store.contiguity(records(spark, d).withColumn("sample_idx", n + F.when((F.col("layer") % 3 == 0) & (F.col("sample_idx") % 20 == 0), 1).otherwise(0)))


@query("store_cross_layer", "WITH r AS (SELECT vec_id % 60 AS sample_idx, 't' || (vec_id % 60) || CASE WHEN vec_id % 97 = 0 THEN 'x' ELSE '' END AS task_id FROM embeddings) SELECT sample_idx, count(DISTINCT task_id) AS task_id FROM r GROUP BY 1 HAVING count(DISTINCT task_id) > 1")
def store_cross_layer(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("sample_idx")
    rows = records(spark, d).select((k % 60).alias("sample_idx"), F.concat(F.lit("t"), (k % 60).cast("string"), F.when(k % 97 == 0, "x").otherwise("")).alias("task_id"))
    return store.inconsistent(rows, "task_id")


@query("store_missing_files", "SELECT vec_id // 10 AS shard_id FROM embeddings GROUP BY 1 HAVING (vec_id // 10) % 7 = 0")
def store_missing_files(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries without a file."""
    wanted = records(spark, d).select(F.floor(F.col("sample_idx") / 10).alias("shard_id")).distinct()
    return wanted.join(wanted.where("shard_id % 7 <> 0"), "shard_id", "left_anti")


@query("store_batch_join", "SELECT e.vec_id AS sample_idx, 'Task: ' || d.lang || ', Prompt: ' || d.text[1:100] AS preview FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def store_batch_join(spark: SparkSession, d: str) -> DataFrame:
    """Records get their prompt's preview by sample number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_idx"), "lang", "text")
    return records(spark, d).select("sample_idx").join(docs, "sample_idx").select("sample_idx", F.concat(F.lit("Task: "), "lang", F.lit(", Prompt: "), F.substring("text", 1, 100)).alias("preview"))


@query("store_roundtrip", "SELECT label AS layer, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE label IN (1, 4) GROUP BY label")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written by layer, and two layers read back."""
    at = shared.fresh(spark, "store")
    store.write(records(spark, d), at)
    return store.read(spark, at, [1, 4]).groupBy("layer").agg(F.count("*").alias("n"), F.sum("sample_idx").alias("ids"))


_BYTES = "list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || hex(encode(text))[2 * i + 1:2 * i + 2])::INT)"


@query("mapinpandas_model", f"WITH b AS (SELECT item_id, octet_length(encode(text)) AS n, {_BYTES} AS t FROM benchmark), l(layer) AS (VALUES (0), (3)) SELECT layer::INT AS layer, item_id AS sample_idx, n::INT AS seq, round(coalesce(list_sum(list_transform(t, lambda x: list_sum(list_transform(range(1, 9), lambda k: sin((x + 1.0::DOUBLE) * (layer + 1) * k)::FLOAT::DOUBLE)))), 0), 3) AS total FROM b, l")
def mapinpandas_model(spark: SparkSession, d: str) -> DataFrame:
    """Prompts through the stand-in model, layers 0 and 3, and what its records hold."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("sample_idx"), tokens.byte_tokens("text").alias("tokens"), F.substring("text", 1, 200).alias("text_preview"))
    out = store.extract(rows, store.toy_model([0, 3], 8), batch=16)
    return out.select("layer", "sample_idx", F.get("shape", F.lit(0)).alias("seq"), F.round(F.aggregate(_doubles(F.flatten("activation")), F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


# Control tables and metrics

EVENT = "e0 AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'look' END AS action, value FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    action = F.when(e.isin("signup", "view"), "claim").when(e == "purchase", "complete").when(e == "error", "fail").otherwise("look")
    return table(spark, d, "events").select("event_id", "ts", "user_id", action.alias("action"), "event_type", "value")


@query("shard_state_machine", f"""WITH RECURSIVE {EVENT}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e0),
w AS (SELECT user_id, i, event_id, action, 'available' AS before, CASE WHEN action = 'claim' THEN 'in_use' ELSE 'available' END AS after FROM s WHERE i = 1
UNION ALL SELECT s.user_id, s.i, s.event_id, s.action, w.after, CASE WHEN w.after = 'available' AND s.action = 'claim' THEN 'in_use' WHEN w.after = 'in_use' AND s.action = 'complete' THEN 'completed' WHEN w.after = 'in_use' AND s.action = 'fail' THEN 'available' ELSE w.after END FROM w JOIN s ON s.user_id = w.user_id AND s.i = w.i + 1)
SELECT event_id, before, after FROM w""")
def shard_state_machine(spark: SparkSession, d: str) -> DataFrame:
    return control.transitions(events(spark, d), "user_id", "ts", "event_id").select("event_id", "before", "after")


LATEST = f"{EVENT}, m0 AS (SELECT user_id AS stream_id, arg_max(CASE action WHEN 'claim' THEN 'in_progress' WHEN 'complete' THEN 'completed' ELSE 'pending' END, event_id) AS status, 'pod_' || (user_id % 5) AS pod_id FROM e0 GROUP BY user_id)"


def event_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = control.latest(events(spark, d), "user_id", "event_id", "action")
    state = F.when(F.col("action") == "claim", "in_progress").when(F.col("action") == "complete", "completed").otherwise("pending")
    none = F.lit(None).cast("string")
    return rows.select(F.col("user_id").alias("stream_id"), state.alias("status"), none.alias("dataset_path"), F.concat(F.lit("pod_"), (F.col("user_id") % 5).cast("string")).alias("pod_id"), none.alias("started_at"), none.alias("completed_at"))


@query("manifest_status", f"WITH {LATEST} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS free, count(*) FILTER (WHERE status = 'in_progress') AS taken, count(*) FILTER (WHERE status = 'completed') AS done, round(100 * count(*) FILTER (WHERE status = 'completed') / count(*), 1) AS pct_complete FROM m0")
def manifest_status(spark: SparkSession, d: str) -> DataFrame:
    return control.status(event_manifest(spark, d))


@query("manifest_by_pod", f"WITH {LATEST} SELECT pod_id, array_to_string(list_sort(list(stream_id)), ',') AS streams FROM m0 WHERE status = 'in_progress' GROUP BY pod_id")
def manifest_by_pod(spark: SparkSession, d: str) -> DataFrame:
    return event_manifest(spark, d).where("status = 'in_progress'").groupBy("pod_id").agg(_csv(F.array_sort(F.collect_list("stream_id"))).alias("streams"))  # a number for each stream of a pod


@query("manifest_claim_range", f"WITH {LATEST} SELECT stream_id, status = 'in_progress' AS resumed FROM m0 WHERE (status = 'pending' OR (status = 'in_progress' AND pod_id = 'pod_3')) AND stream_id BETWEEN 40 AND 79 ORDER BY stream_id LIMIT 1")
def manifest_claim_range(spark: SparkSession, d: str) -> DataFrame:
    return control.claimable(event_manifest(spark, d), "pod_3", (40, 79)).select("stream_id", "resumed")


@query("manifest_create", "SELECT range AS stream_id, 'pending' AS status, 'data/stream_' || lpad(range || '', 3, '0') || '.jsonl' AS dataset_path FROM range(32)")
def manifest_create(spark: SparkSession, d: str) -> DataFrame:
    return control.manifest(spark, 32, "data").select("stream_id", "status", "dataset_path")


@query("resume_skip", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'error')")
def resume_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    done = rows.where("event_type = 'error'").select(F.col("event_id").alias("last_processed_sample_idx"))
    return control.unfinished(rows, done, "event_id").select("event_id")


@query("checkpoint_latest", "SELECT user_id AS worker_id, max(event_id) AS last_processed_sample_idx, arg_max(event_type, event_id) AS status, max(event_id) + 1 AS start_idx FROM events GROUP BY user_id")
def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = control.latest(events(spark, d), "user_id", "event_id", "event_type")
    return rows.select(F.col("user_id").alias("worker_id"), F.col("event_id").alias("last_processed_sample_idx"), F.col("event_type").alias("status"), (F.col("event_id") + 1).alias("start_idx"))


def results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").where(k % 10 != 0)
    return rows.select(F.concat(F.lit("t"), k.cast("string")).alias("task_id"), (F.col("l_linenumber") % 2).alias("test_idx"), (k * 10 + F.col("l_linenumber")).alias("sample_idx"), grid.text(derived_grid(F.col("l_linenumber") + k)).alias("grid"))


RES = f"r0 AS (SELECT 't' || l_orderkey AS task_id, (l_linenumber % 2)::INT AS test_idx, l_orderkey * 10 + l_linenumber AS sample_idx, {sql.text(sql.grid('(l_linenumber + l_orderkey)'))} AS grid FROM lineitem WHERE l_orderkey % 10 <> 0)"
ATT = f"{RES}, a1 AS (SELECT *, 'attempt_' || row_number() OVER (PARTITION BY task_id, test_idx ORDER BY sample_idx) AS attempt FROM r0)"


@query("attempts_pivot", f"WITH {ATT} SELECT task_id, test_idx, max(CASE WHEN attempt = 'attempt_1' THEN grid END) AS attempt_1, max(CASE WHEN attempt = 'attempt_2' THEN grid END) AS attempt_2 FROM a1 WHERE attempt IN ('attempt_1', 'attempt_2') GROUP BY ALL")
def attempts_pivot(spark: SparkSession, d: str) -> DataFrame:
    return metrics.attempts(results(spark, d)).groupBy("task_id", "test_idx").pivot("attempt", ["attempt_1", "attempt_2"]).agg(F.max("grid"))


@query("solutions_left_outer", f"WITH {ATT}, t AS (SELECT DISTINCT 't' || o_orderkey AS task_id, x.test_idx FROM orders, (VALUES (0), (1)) x(test_idx)), s AS (SELECT task_id, test_idx, string_agg(attempt || '=' || grid, ';' ORDER BY sample_idx) AS solution FROM a1 GROUP BY ALL) SELECT t.task_id, t.test_idx::INT AS test_idx, coalesce(solution, '') AS solution FROM t LEFT JOIN s USING (task_id, test_idx)")
def solutions_left_outer(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "orders").select("o_orderkey").distinct().select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("task_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("test_idx"))
    own = metrics.solutions(tests, results(spark, d))
    return own.select("task_id", "test_idx", F.array_join(F.transform(F.map_entries("solution"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("solution"))


@query("profile_summary", "SELECT event_type AS name, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median FROM events GROUP BY event_type")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.profile(table(spark, d, "events"), "event_type", "value").withColumnRenamed("event_type", "name")
    return out.withColumns({"total": F.round("total", 3), "mean": F.round("mean", 6), "std": F.round("std", 6), "median": F.round("median", 6)})


@query("bottlenecks", "SELECT event_id, value FROM events WHERE value > 90 ORDER BY value DESC")
def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bottlenecks(table(spark, d, "events"), 90.0, "value").select("event_id", "value")


@query("timing_report", "WITH p AS (SELECT event_type, sum(value) AS s, count(*) AS n FROM events GROUP BY event_type) SELECT round(sum(s), 3) AS total_s, sum(n)::BIGINT AS items, round(sum(n) / sum(s), 6) AS items_per_s, round(sum(s) / sum(n), 6) AS s_per_item, arg_max(event_type, s) AS slowest, round(100 * max(s) / sum(s), 6) AS slowest_pct FROM p")
def timing_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("one", F.lit(1))
    out = metrics.timing_report(rows, "one", "event_type", "value")
    return out.withColumns({"total_s": F.round("total_s", 3), **{c: F.round(c, 6) for c in ("items_per_s", "s_per_item", "slowest_pct")}})


@query("parity_diff", "SELECT count(*) AS n, round(max(abs(v)), 8) AS most, round(avg(abs(v)), 8) AS mean, count(*) FILTER (WHERE abs(v) > 0.00050000001) AS beyond FROM (SELECT (vec_id % 10) / 10000 AS v FROM embeddings)")
def parity_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "embeddings").select("vec_id", F.lit(1.0).alias("v"))
    b = a.withColumn("v", 1.0 + (F.col("vec_id") % 10) / 10000)
    return metrics.difference(a, b, "vec_id", "v", 0.00050000001).withColumns({"most": F.round("most", 8), "mean": F.round("mean", 8)})


_TOPO = "k0(name, hosts, chips_per_host, mesh_rows, mesh_cols, batch, seq) AS (VALUES " + ", ".join(str(t) for t in metrics.TOPOLOGIES) + ")"


@query("topology_lookup", f"WITH {_TOPO}, m AS (SELECT p_partkey AS key, (1 << (p_partkey % 6))::INT AS hosts, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 8 END AS chips_per_host FROM part) SELECT key, name FROM m LEFT JOIN k0 USING (hosts, chips_per_host)")
def topology_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("key"), F.call_function("shiftleft", F.lit(1), (k % 6).cast("int")).alias("hosts"), F.when(k % 2 == 0, 4).otherwise(8).alias("chips_per_host"))
    return metrics.matched(rows.withColumn("total_chips", F.col("hosts") * F.col("chips_per_host")), metrics.topologies(spark)).select("key", "name")


@query("per_host_batch", f"WITH {_TOPO} SELECT name, (batch // hosts)::BIGINT AS per_host_batch, hosts * chips_per_host AS total_chips FROM k0")
def per_host_batch(spark: SparkSession, d: str) -> DataFrame:
    return metrics.topologies(spark).select("name", "per_host_batch", "total_chips")


@query("dataset_statistics", "SELECT lang, count(*) AS tasks, sum(octet_length(encode(text)))::BIGINT AS bytes, min(doc_id) AS first FROM documents GROUP BY ROLLUP (lang)")
def dataset_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("lang").agg(F.count("*").alias("tasks"), F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("first"))


# Streaming


@query("stream_available_now_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_type <> 'error' GROUP BY event_type")
def stream_available_now_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All events through a stream that ends when it has caught up, run twice: the second finds nothing new."""
    schema, out, done = table(spark, d, "events").schema, shared.fresh(spark, "stream"), shared.fresh(spark, "stream-checkpoint")
    inside = len(table(spark, d, "events").inputFiles()) == 1 and table(spark, d, "events").inputFiles()[0].endswith("/events.parquet")
    source, pattern = (d, "events.parquet") if inside else (f"{d}/events.parquet", None)
    for _ in range(2):
        streams.ingest(spark, source, schema, out, done, lambda df: df.where("event_type <> 'error'"), pattern)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("stream_tumbling_extension", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_extension(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.tumbling(table(spark, d, "events"), "ts", "1 day", "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
