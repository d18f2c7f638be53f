"""Converting and validating raw example lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators.partition import task_id_of

RAW = "array<array<array<array<string>>>>"


def convert(rows: DataFrame, examples: str = "examples", idx: str = "idx") -> DataFrame:
    """rows with task_id, train, test and reject.

    examples: JSON, a list of [input, output] pairs of which the last is the test, whose
    output is left out. A pair that isn't two readable grids is dropped; a task goes
    where that leaves no training pair or no test. reject: null, or why the task goes.
    """
    rows = rows.withColumn("_raw", grid.bound(F.from_json(F.col(examples), RAW), _converted))
    part = lambda c: F.col(f"_raw.{c}").alias(c)
    reject = F.when(F.col(examples).isNull(), "missing").otherwise(F.col("_raw.reject"))
    return rows.select(*(F.col(c) for c in rows.columns if c != "_raw"), part("train"), part("test"), task_id_of(F.col(idx)).alias("task_id"), reject.alias("reject"))


def _converted(raw: Column) -> Column:
    """(train, test, reject) of a list of pairs of grids of strings."""
    pair = lambda p: F.struct(grid.parse_cells(F.get(p, F.lit(0))).alias("input"), grid.parse_cells(F.get(p, F.lit(1))).alias("output"))
    whole = lambda s: s["input"].isNotNull() & s["output"].isNotNull()
    n = F.coalesce(F.size(raw), F.lit(-1))
    train = F.filter(F.transform(F.filter(F.slice(raw, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda p: F.size(p) == 2), pair), whole)
    last = F.element_at(raw, -1)
    test = F.when((n >= 2) & (F.size(last) >= 1), grid.parse_cells(F.get(last, F.lit(0))))

    def judged(x: Column) -> Column:
        test = x["test"]
        reject = F.when(n < 0, "unreadable").when(n < 2, "too few pairs").when(F.size(x["train"]) < 1, "no training pair").when(test.isNull(), "bad test")
        one = F.when(test.isNotNull(), F.array(F.struct(test.alias("input"), F.lit(None).cast(grid.GRID).alias("output"))))
        return F.struct(x["train"].alias("train"), one.alias("test"), reject.alias("reject"))

    return grid.bound(F.struct(train.alias("train"), test.alias("test")), judged)


def augmentations(tasks: DataFrame) -> DataFrame:
    """Each task with the eight (aug_idx, hflip, n_rot90)."""
    each = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("aug_idx")
    return tasks.select("*", each).withColumn("hflip", F.col("aug_idx") >= 4).withColumn("n_rot90", F.col("aug_idx") % 4)


def augmented(samples: Column, flip: Column, turns: Column, colors: Column | None = None) -> Column:
    def both(g: Column) -> Column:
        g = grid.geometric(g, flip, turns)
        return g if colors is None else grid.recolor(g, colors)

    return grid.on_samples(samples, both, "input", "output")


def augmented_task(train: Column, test: Column, flip: Column, turns: Column, colors: Column | None, *key: Column) -> tuple[Column, Column]:
    """A task turned and recolored, its training samples in an order drawn by key."""
    order = grid.shuffled(F.sequence(F.lit(0), F.size(train) - 1), *key)
    turned = grid.bound(augmented(train, flip, turns, colors), lambda t: F.transform(order, lambda i: F.get(t, i)))
    return turned, augmented(test, flip, turns, colors)


def randomly_augmented_task(train: Column, test: Column, *key: Column, swap: bool = True) -> tuple[Column, Column]:
    """A task under drawn turns and colors, its samples dealt anew to train and test if swap."""
    train, test = augmented_task(train, test, grid.draw("hflip", 2, *key) == 1, grid.draw("turns", 4, *key), grid.color_map(*key), *key)
    return swap_train_and_test(train, test, *key) if swap else (train, test)


def rounds(per_task: int, augmentations: int = 8) -> tuple[int, int]:
    """(repeats of each augmentation, augmentations used) when per_task prompts for each test are wanted: whole rounds, until there are enough."""
    repeats = max(1, per_task // augmentations)
    return repeats, min(augmentations, max(1, -(-per_task // repeats)))


def variants(tasks: DataFrame, per_task: int, colors: bool = True, seed: str = "0") -> DataFrame:
    """tasks (task_id, train, test) with a row for each augmentation and repeat: aug_idx, hflip, n_rot90, repeat, color_map (null without colors), and train and test under them.

    The order of rows is (the tasks' own, aug_idx, repeat); draws are keyed by seed, task, augmentation and repeat.
    """
    repeats, used = rounds(per_task)
    rows = augmentations(tasks).where(F.col("aug_idx") < used).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = F.concat_ws(":", F.lit(seed), "task_id", F.col("aug_idx").cast("string"), F.col("repeat").cast("string"))
    rows = rows.withColumn("color_map", grid.color_map(key) if colors else F.lit(None).cast("map<int,int>"))
    train, test = augmented_task(F.col("train"), F.col("test"), F.col("hflip"), F.col("n_rot90"), F.col("color_map") if colors else None, key)
    return rows.withColumns({"train": train, "test": test})


#: Changes of a grid by name, which callers can add to: a function of (grid, key, shape) that is null where it has no room.
CHANGES = {
    "geometric": lambda g, key, shape: grid.geometric(g, grid.draw("hflip", 2, key) == 1, grid.draw("turns", 4, key)),
    "padding": lambda g, key, shape: grid.bound(grid.padding_size(shape, key), lambda n: F.when(n.isNotNull(), grid.pad(g, grid.draw("color", 10, key), n["rows"], n["cols"]))),
    "upscale": lambda g, key, shape: grid.bound(grid.upscale_factors(shape, key), lambda n: F.when(n.isNotNull(), grid.upscale(g, n["rows"], n["cols"]))),
    "mirror": lambda g, key, shape: grid.mirror(g, grid.mirror_axis(shape, key), grid.draw("before", 2, key) == 1),
}


def changed(g: Column, name: str, key: Column, shape: Column) -> Column:
    """One grid under a registered change; ValueError for a name that isn't registered."""
    if name not in CHANGES:
        raise ValueError(f"unknown change {name}; known: {sorted(CHANGES)}")
    return CHANGES[name](g, key, shape)


def swap_train_and_test(train: Column, test: Column, *key: Column) -> tuple[Column, Column]:
    """All samples in drawn order, the first of them as many as there were for training."""
    every = F.concat(train, test)
    places = grid.shuffled(F.sequence(F.lit(0), F.size(every) - 1), *key)
    mixed = F.transform(places, lambda i: F.get(every, i))
    return F.slice(mixed, F.lit(1), F.size(train)), F.slice(mixed, F.size(train) + 1, F.size(test))


def composed(samples: Column, key: Column, target: str) -> Column:
    """One drawn change (geometric, padding, upscale or mirror) of all target grids; samples as they are where it has no room."""
    shape = grid.max_shape(samples, target)
    kind = grid.draw("kind", 4, key)
    flip, turns = grid.draw("hflip", 2, key) == 1, grid.draw("turns", 4, key)
    size, factor, axis = grid.padding_size(shape, key), grid.upscale_factors(shape, key), grid.mirror_axis(shape, key)
    color, before = grid.draw("color", 10, key), grid.draw("before", 2, key) == 1
    change = lambda f: grid.on_samples(samples, f, target)
    out = F.when(kind == 0, change(lambda g: grid.geometric(g, flip, turns)))
    out = out.when((kind == 1) & size.isNotNull(), change(lambda g: grid.pad(g, color, size["rows"], size["cols"])))
    out = out.when((kind == 2) & factor.isNotNull(), change(lambda g: grid.upscale(g, factor["rows"], factor["cols"])))
    out = out.when((kind == 3) & axis.isNotNull(), change(lambda g: grid.mirror(g, axis, before)))
    return out.otherwise(samples)
