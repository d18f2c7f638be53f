"""Extraction, control tables and registries on small cases."""

import pytest
from pyspark.sql import functions as F

from gridloom.config import Extraction
from gridloom.functions import codec, grid, tokens
from gridloom.operators import control, extraction, metrics, store, tasks

TASK = "task_id string, train array<struct<input:array<array<int>>,output:array<array<int>>>>, test array<struct<input:array<array<int>>,output:array<array<int>>>>"


def some_tasks(spark, n=3, tests=2):
    g = lambda i: [[i % 10, 1], [2, 3]]
    s = lambda i: {"input": g(i), "output": g(i + 1)}
    return spark.createDataFrame([(f"t{i}", [s(i), s(i + 2)], [s(i + 4 + k) for k in range(tests)]) for i in range(n)], TASK)


@pytest.mark.parametrize(("asked", "want"), [(0, (1, 1)), (1, (1, 1)), (3, (1, 3)), (8, (1, 8)), (15, (1, 8)), (16, (2, 8)), (17, (2, 8))])
def test_rounds(asked, want):
    assert tasks.rounds(asked) == want


def test_prompts_are_a_cross_product(spark):
    rows = extraction.prompt_rows(some_tasks(spark), 3, "output-from-examples-v1").collect()
    assert {(r["task_id"], r["aug_idx"], r["repeat"], r["idx"]) for r in rows} == {(f"t{i}", a, 0, k) for i in range(3) for a in range(3) for k in range(2)}
    assert len(rows) == 18
    assert all(r["prompt"].endswith("```grid") and sorted(r["color_map"].values()) == list(range(10)) for r in rows)
    assert [r["idx"] for r in extraction.numbered(extraction.prompt_rows(some_tasks(spark), 1, "output-from-examples-v1")).orderBy("sample_idx").collect()] == [0, 1] * 3


def test_random_augmentation_keeps_grids_up_to_turns_and_colors(spark):
    rows = some_tasks(spark)
    train, test = tasks.randomly_augmented_task(F.col("train"), F.col("test"), F.col("task_id"))
    for r in rows.select("task_id", train.alias("a"), test.alias("b")).collect():
        assert (len(r["a"]), len(r["b"])) == (2, 2)
        assert all(len(s["input"]) == 2 and len(s["input"][0]) == 2 for s in [*r["a"], *r["b"]])


def test_extraction_resumes_and_shares_between_machines(spark, tmp_path):
    given, model = some_tasks(spark, 5), store.linear_model([0, 1], 3)
    seen = []
    for machine in range(2):
        job = Extraction(dataset="x", out=str(tmp_path / f"m{machine}"), layers=(1,), batch=4, machine=machine, machines=2)
        done = extraction.run(spark, given, job, model, per_task=2, per_slice=6, most_slices=1)
        assert done["status"] == "running"
        done = extraction.run(spark, given, job, model, per_task=2, per_slice=6)
        assert done["status"] == "completed"
        assert extraction.run(spark, given, job, model, per_task=2, per_slice=6) == {**done, "source": "store"}
        rows = extraction.records(spark, job).collect()
        assert {r["layer"] for r in rows} == {1}
        assert all(r["sample_idx"] % 2 == machine for r in rows)
        seen += [r["sample_idx"] for r in rows]
    assert sorted(seen) == list(range(20))


def test_extraction_of_nothing(spark, tmp_path):
    job = Extraction(dataset="x", out=str(tmp_path / "none"), layers=None, batch=4)
    assert extraction.run(spark, some_tasks(spark).limit(0), job, store.linear_model([0], 2)) == {}


def test_model_records_equal_a_loop(spark):
    rows = [(0, [5, 6, 7], "a"), (1, [], "b"), (2, [1], None), (3, [9] * 20, "d"), (4, [2, 3], "e")]
    got = {(r["layer"], r["sample_idx"]): r for r in store.extract(spark.createDataFrame(rows, "sample_idx long, tokens array<int>, text_preview string").coalesce(1), store.linear_model([0, 2], 3), 2).collect()}
    assert len(got) == 10
    for i, ids, preview in rows:
        for layer in (0, 2):
            r = got[layer, i]
            assert r["activation"] == [[float((t + 1) * (layer + 1) * (k + 1) % 97) for k in range(3)] for t in ids]
            assert (r["shape"], r["text_preview"]) == ([len(ids), 3], preview)


def test_shards_are_claimed_preferred_first(spark):
    table = control.manifest(spark, 4, "x").withColumn("status", F.when(F.col("stream_id") == 2, "in_use").otherwise("available"))
    pick = lambda want: control.preferred(table, want).first()["stream_id"]
    assert (pick(3), pick(2), pick(None)) == (3, 0, 0)
    assert {r["status"] for r in control.reset(table).collect()} == {"available"}


def test_checkpoints_fall_through(spark, tmp_path):
    near, far, broken = (control.Ledger(spark, str(tmp_path / x)) for x in ("near", "far", "broken"))
    assert control.load_checkpoint({"near": near, "far": far}) == {}
    far.write(control.checkpoint(spark, worker_id="w", last_processed_sample_idx=7))
    (tmp_path / "broken" / "v0").mkdir(parents=True)
    (tmp_path / "broken" / "v0" / "_SUCCESS").write_text("")
    (tmp_path / "broken" / "v0" / "part-0.parquet").write_text("no parquet")
    assert control.load_checkpoint({"broken": broken, "near": near, "far": far}) == {"worker_id": "w", "last_processed_sample_idx": 7, "source": "far"}
    near.write(control.checkpoint(spark, worker_id="w", last_processed_sample_idx=9))
    (tmp_path / "near" / "v1").mkdir()  # cut short: no _SUCCESS
    assert control.load_checkpoint({"near": near, "far": far})["last_processed_sample_idx"] == 9


def test_registries(spark):
    class Upper:
        def __init__(self, inner):
            self.inner = inner

        def to_text(self, g):
            return F.upper(self.inner.to_text(g))

        def to_grid(self, t):
            return self.inner.to_grid(t)

    with pytest.raises(ValueError):
        codec.register("Bad", int)
    codec.register("Upper", Upper)
    try:
        row = spark.sql("select array(array(1, 2)) as g").select(codec.parse("Upper(MinimalGridEncoder())").to_text(F.col("g")).alias("t")).first()
        assert row["t"] == "12"
    finally:
        del codec.KINDS["Upper"]
    one = spark.sql("select array(array(1, 2)) as g").select(tasks.changed(F.col("g"), "mirror", F.lit("k"), F.struct(F.lit(1).alias("rows"), F.lit(2).alias("cols"))).alias("m")).first()["m"]
    assert one in ([[1, 2], [1, 2]], [[1, 2, 2, 1]], [[2, 1, 1, 2]])
    with pytest.raises(ValueError):
        tasks.changed(F.col("g"), "other", F.lit("k"), F.col("g"))


def test_small_expressions(spark):
    row = spark.sql("select array(3, 4, 0, 5) as ids, '10.0.0.1:8470,10.0.0.2:8471' as e, array(1D, 2D, 3D) as x").select(tokens.until_end(F.col("ids"), 0).alias("a"), tokens.until_end(F.col("ids"), 9).alias("b"), tokens.port_of(F.col("e")).alias("p"), F.aggregate(tokens.softmax(F.col("x")), F.lit(0.0), lambda a, v: a + v).alias("s")).first()
    assert (row["a"], row["b"], row["p"]) == ([3, 4], [3, 4, 0, 5], "8470")
    assert abs(row["s"] - 1) < 1e-9
    assert spark.range(7).where(tokens.every(F.col("id"), 3)).count() == 3


def test_solutions_are_written(spark, tmp_path):
    solved = spark.createDataFrame([("t", 1, {"attempt_1": "b"}), ("t", 0, {"attempt_1": "a"}), ("u", 0, {})], "task_id string, test_idx int, solution map<string,string>")
    metrics.write_solutions(solved, str(tmp_path / "s"))
    got = {r["task_id"]: r["solutions"] for r in spark.read.schema("task_id string, solutions array<map<string,string>>").json(str(tmp_path / "s")).collect()}
    assert got == {"t": [{"attempt_1": "a"}, {"attempt_1": "b"}], "u": [{}]}


def test_large_ragged_grids(spark):
    g = [[(r * 7 + c) % 10 for c in range(30)] for r in range(30)]
    rows = spark.createDataFrame([(g,), ([[1, 2], [3]],), ([],)], "g array<array<int>>")
    own = codec.parse(codec.DEFAULT)
    got = rows.select("g", grid.is_valid(F.col("g")).alias("ok"), grid.rot90(grid.rot90(F.col("g"), F.lit(1)), F.lit(3)).alias("b"), own.to_grid(own.to_text(F.col("g"))).alias("t")).collect()
    assert [r["ok"] for r in got] == [True, False, False]
    assert got[0]["b"] == got[0]["t"] == g


def test_commands(spark, tmp_path, capsys):
    from gridloom import cli

    grid = "[[1, 2], [3, 4]]"
    line = f'{{"train": [{{"input": {grid}, "output": {grid}}}], "test": [{{"input": {grid}, "output": {grid}}}]}}'
    (tmp_path / "in.jsonl").write_text("\n".join([line] * 7 + ["oops"]) + "\n")
    source, out = str(tmp_path / "in.jsonl"), lambda x: str(tmp_path / x)
    cli.main(["streams", source, "--out", out("streams"), "--streams", "3"])
    assert spark.read.text(out("streams")).count() == 7
    ledger = out("streams-manifest")
    capsys.readouterr()
    cli.main(["claim", ledger, "--pod", "p", "--stream", "2"])
    cli.main(["claim", ledger, "--pod", "p"])
    assert capsys.readouterr().out.split() == ["2", "0"]
    cli.main(["complete", ledger, "--stream", "2"])
    states = lambda: [r["status"] for r in control.Ledger(spark, ledger).read().orderBy("stream_id").collect()]
    assert states() == ["in_progress", "pending", "completed"]
    cli.main(["status", ledger])
    assert "33.3" in capsys.readouterr().out
    cli.main(["reset", ledger])
    assert states() == ["pending"] * 3
    cli.main(["shards", source, "--out", out("shards"), "--per-shard", "4", "--per-chunk", "2"])
    assert [r["tasks"] for r in spark.read.parquet(out("shards/metadata")).orderBy("shard", "chunk").collect()] == [2, 2, 2, 1]
    cli.main(["extract", source, "--out", out("store"), "--per-task", "2", "--layers", "0,1", "--hidden", "2"])
    assert "completed" in capsys.readouterr().out
    assert store.read(spark, out("store/records")).count() == 7 * 2 * 2


def test_kinds_of_datasets_and_activations(spark, tmp_path):
    import json

    import numpy as np

    from gridloom.sources import jsonl

    task = {"train": [{"input": [[1]], "output": [[2]]}], "test": [{"input": [[3]], "output": [[4]]}]}
    (tmp_path / "all.json").write_text(json.dumps({"b": task, "a": task}))
    rows = jsonl.read_tasks(spark, str(tmp_path / "all.json"), "arc").orderBy("line_idx").collect()
    assert [(r["line_idx"], r["task_id"]) for r in rows] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        jsonl.read_tasks(spark, "x", "other")
    both = lambda t: {0: {"residual": np.zeros((*t.shape, 1)), "mlp": np.ones((*t.shape, 1))}, 1: np.full((*t.shape, 1), 5.0)}
    got = store.of_kind(both, "mlp")(np.zeros((2, 3), int))
    assert (got[0].max(), got[1].max()) == (1, 5)


def test_shards_with_bad_lines(spark, tmp_path):
    from gridloom.sources import shards

    task = lambda i, name: '{"task_id": "%s", "train": [{"input": [[%d]], "output": [[1]]}], "test": [{"input": [[1]]}]}' % (name, i)
    bare = lambda i: '{"train": [{"input": [[%d]], "output": [[1]]}], "test": [{"input": [[1]]}]}' % i
    chunks = {(0, 0): [task(0, "a"), bare(1), "oops", task(2, "lost")], (0, 1): [task(3, "a"), bare(4), task(5, "b")], (1, 0): [task(6, "c")]}
    for (s, c), lines in chunks.items():
        folder = tmp_path / "data" / f"shard={s}" / f"chunk={c}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text("\n".join(lines) + "\n")
    got = [(r["task_id"], r["train"][0]["input"][0][0]) for r in shards.read(spark, str(tmp_path), 0).orderBy("line_idx").collect()]
    assert got == [("a", 3), ("task_00000001", 1), ("task_00000002", 4), ("b", 5)]
    assert [r["task_id"] for r in shards.read(spark, str(tmp_path), 1).collect()] == ["c"]
    assert shards.read(spark, str(tmp_path), 7).count() == 0


def test_streams_are_written_and_counted(spark, tmp_path):
    from gridloom.sources import jsonl

    good = "[[[[1]],[[2]]],[[[3]],[[4]]]]"
    rows = spark.createDataFrame([(i, good if i % 3 else "oops") for i in range(10)], "idx long, examples string")
    counts = jsonl.write_streams(tasks.convert(rows), str(tmp_path / "s"), 2)
    assert {(r["stream_id"], r["written"], r["invalid"]) for r in counts.collect()} == {(0, 3, 2), (1, 3, 2)}
    assert spark.read.text(str(tmp_path / "s")).groupBy("stream_id").count().orderBy("stream_id").collect() == [(0, 3), (1, 3)]


def test_a_store_without_metadata_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(0, i, [[1.0, 2.0]], [1, 2], "p", i // 2) for i in range(4)], store.RECORD + ", shard_id long")
    store.write(rows, str(tmp_path / "s" / "records"))
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "s"))
    about = store.finalize(rows, str(tmp_path / "s")).orderBy("shard_id").collect()
    assert [(r["first_sample"], r["last_sample"], r["num_samples"], r["layers"]) for r in about] == [(0, 1, 2, [0]), (2, 3, 2, [0])]
    assert store.load(spark, str(tmp_path / "s"), [0]).count() == 4
