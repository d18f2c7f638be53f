"""Queries of the grid algebra, the codecs and the prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codec, grid, prompts
from gridloom.operators import tasks as ops
from gridloom.plans import sql
from gridloom.sources.tables import derived_grid, derived_tasks, large_grid, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def grids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), derived_grid(F.col("p_partkey")).alias("g"))


def on_grids(name: str, f, oracle: str) -> None:
    """A query (key, txt) of one expression over each derived grid; oracle: the same text in SQL."""
    query(name, f"WITH {sql.GRIDS} SELECT key, {oracle} AS txt FROM g0")(lambda spark, d: grids(spark, d).select("key", f(F.col("g"), F.col("key")).alias("txt")))


K = sql.shuffled("range(1, 10)", "(key || '')")
on_grids("grid_hflip", lambda g, k: grid.text(grid.hflip(g)), sql.text(sql.hflip("g")))
on_grids("grid_rot90", lambda g, k: grid.text(grid.rot90(g, 1)), sql.text(sql.rot90("g", 1)))
on_grids("grid_rot180", lambda g, k: grid.text(grid.rot90(g, 2)), sql.text(sql.rot90("g", 2)))
on_grids("grid_rot270", lambda g, k: grid.text(grid.rot90(g, -1)), sql.text(sql.rot90("g", 3)))
on_grids("grid_pad", lambda g, k: grid.text(grid.pad(g, (k % 10).cast("int"), (1 + k % 3).cast("int"), (1 + k % 2).cast("int"))), sql.text("(list_concat(list_transform(range(0, 1 + key % 3), lambda a: list_transform(range(0, len(g[1]) + 2 * (1 + key % 2)), lambda b: (key % 10)::INT)), list_transform(g, lambda r: list_concat(list_concat(list_transform(range(0, 1 + key % 2), lambda b: (key % 10)::INT), r), list_transform(range(0, 1 + key % 2), lambda b: (key % 10)::INT))), list_transform(range(0, 1 + key % 3), lambda a: list_transform(range(0, len(g[1]) + 2 * (1 + key % 2)), lambda b: (key % 10)::INT))))"))
on_grids("grid_upscale", lambda g, k: grid.text(grid.upscale(g, (1 + k % 3).cast("int"), (1 + k % 2).cast("int"))), sql.text("list_transform(range(0, len(g) * (1 + key % 3)), lambda i: list_transform(range(0, len(g[1]) * (1 + key % 2)), lambda j: g[i // (1 + key % 3) + 1][j // (1 + key % 2) + 1]))"))
on_grids("grid_mirror", lambda g, k: grid.text(grid.mirror(g, (k % 2).cast("int"), k % 4 >= 2)), sql.text(f"(CASE WHEN key % 2 = 0 AND key % 4 >= 2 THEN list_concat(list_reverse(g), g) WHEN key % 2 = 0 THEN list_concat(g, list_reverse(g)) WHEN key % 4 >= 2 THEN list_transform(g, lambda r: list_concat(list_reverse(r), r)) ELSE list_transform(g, lambda r: list_concat(r, list_reverse(r))) END)"))
MAP = "list_concat([0], " + K + ")"
on_grids("grid_color_swap", lambda g, k: grid.text(grid.recolor(g, grid.color_map(k.cast("string"), swap_background=0.0))), sql.text(f"list_transform(g, lambda r: list_transform(r, lambda c: ({MAP})[c + 1]))"))
on_grids("grid_color_revert", lambda g, k: grid.text(grid.recolor(grid.recolor(g, grid.color_map(k.cast("string"))), grid.inverted(grid.color_map(k.cast("string"))))), sql.text("g"))
BACKGROUND = "('0x' || md5(key || ':background')[1:4])::BIGINT / 65536 < 0.1"
on_grids("grid_color_permutation", lambda g, k: F.array_join(F.map_values(grid.color_map(k.cast("string"))).cast("array<string>"), ","), f"array_to_string(CASE WHEN {BACKGROUND} THEN {sql.shuffled('range(0, 10)', '(key || chr(0))').replace('chr(0)', chr(39) + chr(39))} ELSE {MAP} END, ',')")
BROKEN = "CASE key % 6 WHEN 1 THEN [] WHEN 2 THEN list_concat(g, [[]]) WHEN 3 THEN list_concat(g, [[10]]) WHEN 4 THEN list_transform(g, lambda r: list_concat(r, [-1])) WHEN 5 THEN list_concat(g, [NULL]) ELSE g END"


@query("grid_validate", f"WITH {sql.GRIDS} SELECT key, key % 6 = 0 AS valid FROM g0")
def grid_validate(spark: SparkSession, d: str) -> DataFrame:
    g, k = F.col("g"), F.col("key") % 6
    none = F.array().cast(grid.GRID)
    row = lambda x: F.array(F.lit(x).cast("int"))
    bad = F.when(k == 1, none).when(k == 2, F.concat(g, F.array(F.array().cast("array<int>")))).when(k == 3, F.concat(g, F.array(row(10)))).when(k == 4, F.transform(g, lambda r: F.concat(r, row(-1)))).when(k == 5, F.concat(g, F.array(F.lit(None).cast("array<int>")))).otherwise(g)
    return grids(spark, d).select("key", grid.is_valid(bad).alias("valid"))


@query("grid_geometric_all8", f"WITH {sql.GRIDS}, {sql.AUG} SELECT key, aug_idx, {sql.text(sql.geometric('g', 'hflip', 'n_rot90'))} AS txt FROM g0, a0")
def grid_geometric_all8(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.augmentations(grids(spark, d))
    return rows.select("key", "aug_idx", grid.text(grid.geometric(F.col("g"), F.col("hflip"), F.col("n_rot90"))).alias("txt"))


@query("grid_revert_roundtrip", f"WITH {sql.GRIDS}, {sql.AUG} SELECT key, aug_idx, {sql.text('g')} AS txt FROM g0, a0")
def grid_revert_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.augmentations(grids(spark, d))
    there = grid.geometric(F.col("g"), F.col("hflip"), F.col("n_rot90"))
    return rows.withColumn("t", there).select("key", "aug_idx", grid.text(grid.revert_geometric(F.col("t"), F.col("hflip"), F.col("n_rot90"))).alias("txt"))


ORDER = sql.shuffled("range(0, 3)", "(key || '')")


@query("grid_permute_train", f"WITH {sql.TASKS} SELECT key, array_to_string(list_transform({ORDER}, lambda i: {sql.text('train[i + 1].input')}), '/') AS txt FROM t0")
def grid_permute_train(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key").cast("string")
    rows = derived_tasks(spark, d).withColumn("p", F.transform(grid.shuffled(F.sequence(F.lit(0), F.size("train") - 1), k), lambda i: F.get("train", i)))
    return rows.select("key", F.array_join(F.transform("p", lambda s: grid.text(s["input"])), "/").alias("txt"))


ALL = sql.shuffled("range(0, 4)", "(key || '')")


@query("grid_swap_train_test", f"WITH {sql.TASKS}, o AS (SELECT key, list_transform({ALL}, lambda i: list_concat(train, test)[i + 1]) AS s FROM t0) SELECT key, {sql.text('s[1].output')} AS first, {sql.text('s[4].output')} AS test FROM o")
def grid_swap_train_test(spark: SparkSession, d: str) -> DataFrame:
    train, test = ops.swap_train_and_test(F.col("train"), F.col("test"), F.col("key").cast("string"))
    return derived_tasks(spark, d).select("key", grid.text(train[0]["output"]).alias("first"), grid.text(test[0]["output"]).alias("test"))


@query("grid_max_shape", f"WITH {sql.TASKS}, s AS (SELECT key, list_concat(train, test) AS s FROM t0) SELECT key, list_max(list_transform(s, lambda x: len(x.output)))::INT AS rows, list_max(list_transform(s, lambda x: len(x.output[1])))::INT AS cols FROM s")
def grid_max_shape(spark: SparkSession, d: str) -> DataFrame:
    return derived_tasks(spark, d).withColumn("m", grid.max_shape(F.concat("train", "test"), "output")).select("key", F.col("m.rows").alias("rows"), F.col("m.cols").alias("cols"))


DRAW = lambda name, n: f"(('0x' || md5(key || ':{name}')[1:7])::BIGINT % ({n}))"
_S = "list_concat(train, test)"


@query(
    "grid_compose",
    f"""WITH {sql.TASKS}, m AS (SELECT key, test[1].input AS g, list_max(list_transform({_S}, lambda x: len(x.input))) AS h, list_max(list_transform({_S}, lambda x: len(x.input[1]))) AS w, {DRAW('kind', 4)} AS kind,
  {DRAW('hflip', 2)} = 1 AS hflip, {DRAW('turns', 4)} AS n_rot90, {DRAW('color', 10)}::INT AS color, {DRAW('before', 2)} = 1 AS before, {DRAW('same', 2)} = 0 AS same FROM t0),
r AS (SELECT *, least(30 - h, 5) AS pr, least(30 - w, 5) AS pc, least(30 // h, 4) AS ur, least(30 // w, 4) AS uc FROM m),
q AS (SELECT *, CASE WHEN same THEN {DRAW('both', 'least(pr, pc)')} + 1 ELSE {DRAW('rows', 'pr')} + 1 END AS rows_, CASE WHEN same THEN {DRAW('both', 'least(pr, pc)')} + 1 ELSE {DRAW('cols', 'pc')} + 1 END AS cols_,
  {DRAW('rows', 'ur')} + 1 AS fr FROM r),
f AS (SELECT *, CASE WHEN fr = 1 AND uc >= 2 THEN {DRAW('cols', 'greatest(uc - 1, 1)')} + 2 ELSE {DRAW('cols', 'uc')} + 1 END AS fc, {DRAW('axis', 2)} AS axis FROM q),
z AS (SELECT *, CASE WHEN same AND least(ur, uc) >= 2 THEN {DRAW('both', 'greatest(least(ur, uc) - 1, 1)')} + 2 WHEN fr = 1 AND fc = 1 THEN 2 ELSE fr END AS zr, CASE WHEN same AND least(ur, uc) >= 2 THEN {DRAW('both', 'greatest(least(ur, uc) - 1, 1)')} + 2 ELSE fc END AS zc FROM f)
SELECT key, {sql.text(f'''(CASE kind WHEN 0 THEN {sql.geometric('g', 'hflip', 'n_rot90')}
  WHEN 1 THEN list_transform(range(0, len(g) + 2 * rows_), lambda i: list_transform(range(0, len(g[1]) + 2 * cols_), lambda j: CASE WHEN i >= rows_ AND i < len(g) + rows_ AND j >= cols_ AND j < len(g[1]) + cols_ THEN g[i - rows_ + 1][j - cols_ + 1] ELSE color END))
  WHEN 2 THEN list_transform(range(0, len(g) * zr), lambda i: list_transform(range(0, len(g[1]) * zc), lambda j: g[i // zr + 1][j // zc + 1]))
  ELSE CASE WHEN axis = 0 AND before THEN list_concat(list_reverse(g), g) WHEN axis = 0 THEN list_concat(g, list_reverse(g)) WHEN before THEN list_transform(g, lambda r: list_concat(list_reverse(r), r)) ELSE list_transform(g, lambda r: list_concat(r, list_reverse(r))) END END)''')} AS txt FROM z""",
)
def grid_compose(spark: SparkSession, d: str) -> DataFrame:
    """One drawn change of all inputs of a task; the test sample's is shown."""
    every = ops.composed(F.concat("train", "test"), F.col("key").cast("string"), "input")
    return derived_tasks(spark, d).withColumn("s", every).select("key", grid.text(F.element_at("s", -1)["input"]).alias("txt"))


#: A grid costs some thousand times what its key does.
TASKS_A_CORE = 4
LARGE = "l0 AS (SELECT p_partkey AS key, p_partkey % 8 >= 4 AS hflip, (p_partkey % 4)::INT AS n_rot90, list_transform(range(0, 1 + p_partkey % 30), lambda r: list_transform(range(0, 1 + p_partkey * 7 % 30), lambda c: ((p_partkey * 7 + r * 3 + c * 5 + r * c) % 10)::INT)) AS g FROM part)"


def large_grids(spark: SparkSession, d: str) -> DataFrame:
    """(key, g, hflip, n_rot90): grids up to 30 x 30, each with one of the eight augmentations. The keys of one small file are dealt to many tasks."""
    k = F.col("p_partkey")
    dealt = table(spark, d, "part").select(k).repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return dealt.select(k.alias("key"), large_grid(k).alias("g"), (k % 8 >= 4).alias("hflip"), (k % 4).cast("int").alias("n_rot90"))


@query("grid_large_geometric", f"WITH {LARGE} SELECT key, {sql.text(sql.geometric('g', 'hflip', 'n_rot90'))} AS txt FROM l0")
def grid_large_geometric(spark: SparkSession, d: str) -> DataFrame:
    return large_grids(spark, d).select("key", grid.text(grid.geometric(F.col("g"), F.col("hflip"), F.col("n_rot90"))).alias("txt"))


@query("grid_large_encoded", f"WITH {LARGE} SELECT key, {sql.text('g')} AS txt FROM l0")
def grid_large_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Large grids written and read by the default codec."""
    own = codec.parse(codec.DEFAULT)
    return large_grids(spark, d).select("key", grid.text(own.to_grid(own.to_text(F.col("g")))).alias("txt"))


@query("grid_ragged_validate", f"WITH {LARGE} SELECT key, key % 5 <> 0 OR len(g) = 1 AS valid FROM l0")
def grid_ragged_validate(spark: SparkSession, d: str) -> DataFrame:
    """Of every fifth grid the last row gets a cell more."""
    last = F.transform("g", lambda r, i: F.when((F.col("key") % 5 == 0) & (i == F.size("g") - 1), F.concat(r, F.array(F.lit(1)))).otherwise(r))
    return large_grids(spark, d).select("key", grid.is_valid(last).alias("valid"))


# Codecs

NUMBERED = "array_to_string(list_transform(range(0, len(g)), lambda i: (i + 1) || ' ' || array_to_string(g[i + 1], '')), chr(10))"
SHAPED = f"'```grid shape: ' || len(g) || 'x' || len(g[1]) || chr(10) || {NUMBERED} || chr(10) || '```'"
on_grids("enc_minimal", lambda g, k: codec.parse("MinimalGridEncoder()").to_text(g), sql.text("g"))
on_grids("enc_sep", lambda g, k: codec.parse("GridWithSeparationEncoder('|')").to_text(g), sql.text("g", "|"))
on_grids("enc_codeblock", lambda g, k: codec.parse("GridCodeBlockEncoder(MinimalGridEncoder())").to_text(g), f"'```grid' || chr(10) || {sql.text('g')} || chr(10) || '```'")
on_grids("enc_shape_rownum", lambda g, k: codec.parse(codec.DEFAULT).to_text(g), SHAPED)
on_grids("enc_repeat", lambda g, k: codec.parse("RepeatNumberEncoder(3)").to_text(g), sql.text("list_transform(g, lambda r: list_transform(r, lambda c: repeat(c || '', 3)))"))
on_grids("enc_replace", lambda g, k: codec.parse("ReplaceNumberEncoder(RowNumberEncoder(MinimalGridEncoder()))").to_text(g), f"translate({NUMBERED}, '{codec.DIGITS}', '{codec.MARKS}')")
on_grids("dec_shape_rownum", lambda g, k: grid.text(codec.parse(codec.DEFAULT).to_grid(codec.parse(codec.DEFAULT).to_text(g))), sql.text("g"))
for _n, _spec in enumerate(("GridWithSeparationEncoder('|')", "GridCodeBlockEncoder(RepeatNumberEncoder(2))", "GridShapeEncoder(RowNumberEncoder(ReplaceNumberEncoder(MinimalGridEncoder())))")):
    on_grids(f"dec_roundtrip_{_n}", lambda g, k, s=_spec: grid.text(codec.parse(s).to_grid(codec.parse(s).to_text(g))), sql.text("g"))


@query("dec_invalid_to_empty", f"WITH {sql.GRIDS} SELECT key, CASE WHEN key % 5 IN (0, 1) THEN {sql.text('g')} ELSE '' END AS txt FROM g0")
def dec_invalid_to_empty(spark: SparkSession, d: str) -> DataFrame:
    """Responses: whole, without a closing fence, with a letter, without row numbers, without a header."""
    own = codec.parse(codec.DEFAULT)
    t, k = F.substring(own.to_text(F.col("g")), F.lit(8), F.lit(1000)), F.col("key") % 5
    said = F.when(k == 1, F.regexp_replace(t, "\n```$", "")).when(k == 2, F.concat(F.regexp_replace(t, "\n```$", "x"), F.lit("\n```"))).when(k == 3, F.regexp_replace(t, r"\n\d+ ", "\n")).when(k == 4, F.lit("```")).otherwise(t)
    return grids(spark, d).select("key", grid.text(codec.parsed_or_empty(own, said)).alias("txt"))


# Prompts


def encoded(samples: Column) -> Column:
    own = codec.parse(codec.DEFAULT)
    return F.transform(samples, lambda s: F.struct(own.to_text(s["input"]).alias("input"), own.to_text(s["output"]).alias("output")))


CODE = "def task(grid):\n    return grid"


def rendered(spark: SparkSession, d: str, name: str, train_prompt: bool = True) -> DataFrame:
    rows = derived_tasks(spark, d).select("key", "task_id", encoded(F.col("train")).alias("train"), encoded(F.col("test"))[0].alias("test"))
    extra = {"choices": F.array("test.output", F.get("train", F.lit(0))["output"]), "code": F.lit(CODE), "choice": F.lit(1), "correct": F.when(F.col("key") % 2 == 0, "yes").otherwise("no")}
    return rows.select("key", "task_id", prompts.render(name, F.col("train"), F.col("test.input"), F.col("test.output"), train_prompt, **extra).alias("prompt"))


def _shaped(g: str) -> str:
    numbered = f"array_to_string(list_transform(range(0, len({g})), lambda i: (i + 1) || ' ' || array_to_string({g}[i + 1], '')), chr(10))"
    return f"('```grid shape: ' || len({g}) || 'x' || len({g}[1]) || chr(10) || {numbered} || chr(10) || '```')"


def prompt_sql(name: str, train_prompt: bool = True, tasks: str = sql.TASKS, source: str = "t0", keep: str = "key, task_id") -> str:
    """A WITH clause that ends in p (keep, prompt), of the tasks in source."""
    v = prompts.VERSIONS[name]
    t = lambda s: sql.lit(s)
    parts = [t(v.intro)]
    if v.examples == "pairs":
        parts.append(f"array_to_string(list_transform(range(0, 3), lambda i: {t(chr(10) + v.level + ' Example ')} || (i + 1) || {t(chr(10) * 2 + v.level + '# Input' + chr(10) * 2)} || ei[i + 1] || {t(chr(10) * 2 + v.level + '# Output' + chr(10) * 2)} || eo[i + 1] || chr(10)), '')")
    elif v.examples:
        parts.append(f"array_to_string(list_transform(range(0, 3), lambda i: {t(chr(10) + '## Grid example ')} || (i + 1) || chr(10) || chr(10) || {'ei' if v.examples == 'inputs' else 'eo'}[i + 1] || chr(10)), '')")
    for p in v.parts:
        if p == "test":
            parts += [t(f"\n{v.level} Test case\n\n{v.level}# Input\n\n"), "ti"]
        elif p == "code":
            parts += [t(f"\n## Code\n\n```python\n{CODE}\n```\n\n## Example\n\n### Input\n\n"), "ti"]
        elif p == "choices":
            parts += [t("\n\n### Output option 1\n\n"), "too", t("\n\n### Output option 2\n\n"), "eo[1]", t("\n")]
        else:
            parts += [t("\n\n### Output\n\n"), "too"]
    parts.append(t(v.tail))
    if not train_prompt:
        reply = t("```grid")
    elif name.startswith("output"):
        reply = "too"
    elif name.startswith("input"):
        reply = "ti"
    elif name.startswith("code"):
        reply = t(f"```python\n{CODE}\n```")
    else:
        reply = "'1'" if name.startswith("select") else "CASE WHEN key % 2 = 0 THEN 'yes' ELSE 'no' END"
    end = "'<|im_end|>' || chr(10)"
    whole = f"'<|im_start|>system' || chr(10) || {t(v.system)} || {end} || '<|im_start|>user' || chr(10) || {' || '.join(parts)} || {end} || '<|im_start|>assistant' || chr(10) || {t(v.answer)} || ({reply})"
    whole += f" || {end}" if train_prompt else ""
    e = f"e AS (SELECT {keep}, list_transform(train, lambda s: {_shaped('s.input')}) AS ei, list_transform(train, lambda s: {_shaped('s.output')}) AS eo, {_shaped('test[1].input')} AS ti, {_shaped('test[1].output')} AS too FROM {source})"
    return f"WITH {tasks}, {e}, p AS (SELECT {keep}, {whole} AS prompt FROM e)"


for _name in prompts.VERSIONS:
    query(f"prompt_render_{_name.replace('-', '_')}", f"{prompt_sql(_name)} SELECT key, prompt FROM p")(lambda spark, d, n=_name: rendered(spark, d, n).select("key", "prompt"))
_V1 = "output-from-examples-v1"
query("prompt_inference_trim", f"{prompt_sql(_V1, False)} SELECT key, prompt FROM p")(lambda spark, d: rendered(spark, d, _V1, False).select("key", "prompt"))
query("preview", f"{prompt_sql(_V1)} SELECT key, substr('Task: ' || task_id || ', Prompt: ' || substr(prompt, 1, 100), 1, 200) AS preview FROM p")(lambda spark, d: rendered(spark, d, _V1).select("key", prompts.preview(F.col("task_id"), F.col("prompt")).alias("preview")))
query("shortest_prompt", f"{prompt_sql(_V1)} SELECT key, length(prompt) AS n FROM p ORDER BY n, key LIMIT 1")(lambda spark, d: rendered(spark, d, _V1).select("key", F.length("prompt").cast("long").alias("n")).orderBy("n", "key").limit(1))


@query("chat_template", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY conv_id")
def chat_template(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))  # a conversation is one prompt
    return rows.select("conv_id", prompts.chat(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))).alias("prompt"))


@query("prompt_cap", "SELECT p_partkey AS key, ((1 + p_partkey % 3) * CASE WHEN p_partkey % 60 < 8 THEN greatest(1, p_partkey % 60) ELSE 8 * ((p_partkey % 60) // 8) END)::BIGINT AS n FROM part")
def prompt_cap(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("key"), prompts.prompt_cap(k % 60, 1 + k % 3).cast("long").alias("n"))


@query("flagship", f"WITH {sql.TASKS}, {sql.AUG}, x AS (SELECT aug_idx, {sql.geometric('g', 'hflip', 'n_rot90')} AS g FROM (SELECT unnest(list_concat(train, test)).input AS g FROM t0), a0), y AS (SELECT aug_idx, {SHAPED} AS t FROM x) SELECT aug_idx, count(*) AS n, sum(length(t))::BIGINT AS chars, max(length(t))::BIGINT AS longest FROM y GROUP BY aug_idx")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Derived tasks under all eight augmentations, encoded: how many texts and how long."""
    rows = ops.augmentations(derived_tasks(spark, d).select(F.explode(F.concat("train", "test")).alias("s")))
    t = codec.parse(codec.DEFAULT).to_text(grid.geometric(F.col("s.input"), F.col("hflip"), F.col("n_rot90")))
    return rows.select("aug_idx", F.length(t).cast("long").alias("n")).groupBy("aug_idx").agg(F.count("*").alias("n"), F.sum("n").alias("chars"), F.max("n").alias("longest"))
