import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import codec, grid, prompts, tokens
from gridloom.operators import control, partition, store, tasks
from gridloom.sources import jsonl

SPECS = ["MinimalGridEncoder()", "GridWithSeparationEncoder('|')", "GridCodeBlockEncoder(MinimalGridEncoder())", "GridCodeBlockEncoder(GridWithSeparationEncoder('|'))", "GridCodeBlockEncoder(RepeatNumberEncoder(3))", "GridCodeBlockEncoder(RepeatNumberEncoder(2))", "GridShapeEncoder(MinimalGridEncoder())", "GridShapeEncoder(RepeatNumberEncoder(3))", "GridCodeBlockEncoder(RowNumberEncoder(MinimalGridEncoder()))", codec.DEFAULT, "GridShapeEncoder(ReplaceNumberEncoder(MinimalGridEncoder()))", "GridShapeEncoder(RowNumberEncoder(ReplaceNumberEncoder(MinimalGridEncoder())))"]


def random_grids(n=12, seed=3):
    r = random.Random(seed)
    return [[[r.randrange(10) for _ in range(w)] for _ in range(h)] for h, w in ((r.randint(1, 12), r.randint(1, 12)) for _ in range(n))]


def frame(spark, grids):
    return spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "id int, g array<array<int>>")


@pytest.mark.parametrize("spec", SPECS)
def test_codecs_read_what_they_write(spark, spec):
    c = codec.parse(spec)
    rows = frame(spark, random_grids()).select("g", c.to_text(F.col("g")).alias("t")).select("g", c.to_grid(F.col("t")).alias("b")).collect()
    assert all(r["g"] == r["b"] for r in rows)


@pytest.mark.parametrize("spec", ["", "os.system('x')", "MinimalGridEncoder", "GridShapeEncoder(1, 2)", "Unknown()", "3"])
def test_other_specs_are_refused(spec):
    with pytest.raises(ValueError):
        codec.parse(spec)


def test_turns_and_their_inverses(spark):
    rows = frame(spark, random_grids())
    for flip in (True, False):
        for k in range(4):
            there = grid.geometric(F.col("g"), F.lit(flip), k)
            for r in rows.select("g", there.alias("t"), grid.revert_geometric(there, F.lit(flip), k).alias("b")).collect():
                want = [x[::-1] for x in r["g"]] if flip else r["g"]
                for _ in range(k):
                    want = [list(x) for x in zip(*want, strict=True)][::-1]
                assert r["t"] == want
                assert r["b"] == r["g"]


def test_unknown_color_is_null(spark):
    m = F.create_map(F.lit(1), F.lit(5))
    assert frame(spark, [[[1, 2]]]).select(grid.recolor(F.col("g"), m).alias("x")).first()["x"] == [[5, None]]


def test_cells_are_cast(spark):
    raw = [("[[[\"3\", 3.7, true]]]", [[3, 3, 1]]), ("[[[null]]]", None), ("[[[\"x\"]]]", None), ("[[[1], [1, 2]]]", [[1], [1, 2]])]
    rows = spark.createDataFrame([(a,) for a, _ in raw], "j string").select(grid.parse_cells(F.from_json("j", "array<array<array<string>>>")[0]).alias("g")).collect()
    assert [r["g"] for r in rows] == [b for _, b in raw]


def test_conversion_of_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, "{}"), (3, "[]"), (4, "[[[[1]],[[2]]]]"), (5, "[[[[1]],[[2]]],[[[3]],[[4]]]]"), (6, "[[[[1]],[[2]],[[3]]],[[[3]],[[4]]]]"), (7, "[[[[1]],[[2]]],[[[null]],[[4]]]]")]
    got = {r["idx"]: r["reject"] for r in tasks.convert(spark.createDataFrame(rows, "idx long, examples string")).collect()}
    assert got[5] is None
    assert got[0] == "missing"
    assert all(got[k] is not None for k in (1, 2, 3, 4, 6, 7))
    assert tasks.convert(spark.createDataFrame([], "idx long, examples string")).count() == 0


@pytest.mark.parametrize("close_first", [True, False])
def test_packing_equals_the_loop(spark, close_first):
    r = random.Random(1)
    rows = [(k, i, r.choice([1, 5, 10, 40, 100, 250])) for k in range(3) for i in range(200)]
    got = {(x["k"], x["i"]): x["pack"] for x in partition.pack(spark.createDataFrame(rows, "k int, i int, n int"), "k", "i", F.col("n"), 100, close_first).collect()}
    for k in range(3):
        held = number = 0
        for _, i, n in (x for x in rows if x[0] == k):
            if close_first and held and held + n > 100:
                held, number = 0, number + 1
            assert got[k, i] == number
            held += n
            if not close_first and held >= 100:
                held, number = 0, number + 1


@pytest.mark.parametrize(("total", "parts"), [(0, 3), (2, 5), (10, 3), (12, 4), (101, 7)])
def test_balanced_parts(spark, total, parts):
    got = [r["p"] for r in spark.range(total).select(partition.balanced(F.col("id"), F.lit(total), parts).alias("p")).collect()]
    want = [p for p in range(parts) for _ in range(total // parts + (p < total % parts))]
    assert got == want


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r["idx"] == r["k"] for r in partition.global_index(df, "k").collect()].count(False) == 0


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), ([4, 5, 6, 7, 8, 9],)], "a array<int>")
    assert [r[0] for r in df.select(tokens.pad(F.col("a"), 4, 9)).collect()] == [[1, 2, 3, 9], [9] * 4, [4, 5, 6, 7]]


def test_prompt_endings(spark):
    texts = ["a<|im_end|>b<|im_end|>\n", "x<|eot_id|>y<|im_end|>", "none"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(prompts.without_ending(F.col("t"))).collect()]
    assert got == ["a<|im_end|>b", "x", None]
    with pytest.raises(ValueError):
        prompts.version("output-from-nothing-v0")


def test_task_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"task_id": "x", "train": [{"input": [[1]], "output": [[2]]}], "test": [{"input": [[3]]}]}\nbroken\n{"train": [], "test": []}\n{"task_id": "x", "train": [], "test": []}\n')
    read = jsonl.unique_ids(jsonl.parsed_tasks(jsonl.lines(spark, str(tmp_path / "a.jsonl")))).cache()
    assert [r["task_id"] for r in read.orderBy("line_idx").collect()] == ["x", "task_00000002", "task_00000003"]
    jsonl.write_tasks(read, str(tmp_path / "out"))
    assert jsonl.parsed_tasks(jsonl.lines(spark, str(tmp_path / "out"))).count() == 3


def test_streams_are_claimed_in_order(spark):
    m = control.manifest(spark, 4, "d")
    first = control.claimable(m, "p0").first()
    assert (first["stream_id"], first["resumed"]) == (0, False)
    m = control.claimed(m, 0, "p0", "t0")
    assert control.claimable(m, "p0").first()["resumed"]
    assert control.claimable(m, "p1").first()["stream_id"] == 1
    assert control.claimable(m, "p1", (2, 3)).first()["stream_id"] == 2
    m = control.completed(m, 0, "t1")
    assert control.status(m).first()["pct_complete"] == 25.0
    assert control.claimable(m, "p1", (0, 0)).first() is None
    m = control.failed(control.claimed(m, 1, "p1", "t2"), 1, control.STREAMS)
    assert m.where("stream_id = 1").first()["pod_id"] is None


def test_extraction_keeps_rows_of_short_batches(spark):
    rows = spark.createDataFrame([(i, list(range(i + 1)), f"t{i}") for i in range(5)], "sample_idx long, tokens array<int>, text_preview string")
    got = store.extract(rows.coalesce(1), store.toy_model([1, 2], 4), batch=3, width=4).collect()
    assert len(got) == 10
    assert {tuple(r["shape"]) for r in got} == {(min(i + 1, 4), 4) for i in range(5)}


def test_global_index_with_payload_on_many_rows(spark):
    n = 400_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 30).cast("int")).alias("payload"), F.col("id"))
    got = partition.global_index(rows, "k", buckets=8)
    assert got.agg(F.count("*"), F.countDistinct("idx"), F.min("idx"), F.max("idx"), F.count_if(F.col("idx") == F.col("k"))).first() == (n, n, 0, n - 1, n)
    assert got.where(F.length("payload") != F.col("id") % 30).count() == 0
    assert partition.global_index(rows.limit(0), "k").count() == 0
    odd = spark.createDataFrame([(None, 1), (2, 1), (None, 2)], "a int, b int")
    assert [(r["a"], r["b"]) for r in partition.global_index(odd, "a", "b").orderBy("idx").collect()] == [(None, 1), (None, 2), (2, 1)]


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    want = []
    for f in range(3):
        own = [f"{f}-{i} " + "y" * (i % 90) for i in range(4000)]
        (tmp_path / f"part{f}.txt").write_text("\n".join(own) + "\n")
        want += own
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # many splits a file
    try:
        got = jsonl.lines(spark, str(tmp_path)).orderBy("line_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [r["line_idx"] for r in got] == list(range(len(want)))
    assert [r["line"] for r in got] == want


def test_packing_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1, 50), (None, 2, 60), ("a", 1, None), ("a", 2, 500), ("a", 3, 1)], "k string, i int, n int")
    got = {(r["k"], r["i"]): r["pack"] for r in partition.pack(rows, "k", "i", F.col("n"), 100).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 1): 0, ("a", 2): 0, ("a", 3): 1}
    assert partition.pack(rows.limit(0), "k", "i", F.col("n"), 100).count() == 0


def test_transitions_equal_the_loop(spark):
    r = random.Random(2)
    log = [(s, i, r.choice(["claim", "claim", "complete", "fail", "look", None])) for s in range(40) for i in range(r.randint(1, 25))]
    got = {(x["s"], x["i"]): (x["before"], x["after"]) for x in control.transitions(spark.createDataFrame(log, "s int, i int, action string"), "s", "i").collect()}
    state: dict = {}
    for s, i, a in log:
        was = state.get(s, "available")
        now = {("available", "claim"): "in_use", ("in_use", "complete"): "completed", ("in_use", "fail"): "available"}.get((was, a), was)
        assert got[s, i] == (was, now)
        state[s] = now


def test_solutions_are_in_order_of_attempts(spark):
    from gridloom.operators import metrics

    tests = spark.createDataFrame([("t", 0), ("t", 1)], "task_id string, test_idx int")
    results = spark.createDataFrame([("t", 0, i, f"g{i}") for i in range(12)], "task_id string, test_idx int, sample_idx int, grid string")
    got = {r["test_idx"]: [tuple(e) for e in r["e"]] for r in metrics.solutions(tests, results).select("test_idx", F.map_entries("solution").alias("e")).collect()}
    assert got == {0: [(f"attempt_{i + 1}", f"g{i}") for i in range(12)], 1: []}
    assert [len(r["solution"]) for r in metrics.solutions(tests, results, 2).where("test_idx = 0").collect()] == [2]


def test_conversion_reads_json_once(spark):
    rows = spark.createDataFrame([(5, "[[[[1]],[[2]]],[[[3]],[[4]]]]")], "idx long, examples string")
    plan = tasks.convert(rows).where("reject is null").select("train", "test", "task_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2  # in the filter and in the result


def test_decoding_reads_its_text_once(spark):
    own = codec.parse(codec.DEFAULT)
    rows = spark.createDataFrame([("a",)], "t string").select(own.to_grid(F.concat(F.col("t"), F.lit("mark"))).alias("g"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("mark") == 1


@pytest.mark.parametrize(
    "text, want",
    [
        (None, None),
        ("", None),
        ("1 12\n2 34", None),
        ("```grid shape: 2x2\n1 12\n2 34\n```", [[1, 2], [3, 4]]),
        ("so:\r\n```grid shape: 2x2\r\n1 12\r\n```grid shape: again\r\n2 34", [[1, 2], [3, 4]]),
        ("```grid shape: 2x2\n1 1a\n2 34  \n``` 3 56", [[1, None], [3, 4]]),
        ("```grid shape: 2x2\n1 12\n234\n```", None),
        ("```grid shape: 1x2\n1 \n2 34\n3 \n4 5\n```", [[3, 4], [], [5]]),
    ],
)
def test_decoding_of_odd_texts(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(codec.parse(codec.DEFAULT).to_grid(F.col("t")).alias("g")).first()["g"] == want


def test_large_grids_of_one_file_are_dealt_to_tasks(spark):
    from oracle import SF

    from gridloom.plans import grids

    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    assert grids.large_grids(spark, SF).rdd.getNumPartitions() > 1
