"""Grid algebra as column expressions. A grid is array<array<int>>; H and W its rows and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = "array<array<int>>"
SAMPLE = f"struct<input:{GRID},output:{GRID}>"
TASK = f"task_id string, train array<{SAMPLE}>, test array<{SAMPLE}>"
MAX_SIDE = 30


def height(g: Column) -> Column:
    return F.size(g)


def width(g: Column) -> Column:
    return F.coalesce(F.size(F.get(g, F.lit(0))), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def hflip(g: Column) -> Column:
    return F.transform(g, F.reverse)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def transposed(g: Column) -> Column:
    """Columns as rows; cells that a ragged grid lacks are null."""
    return F.transform(_upto(width(g)), lambda i: F.transform(g, lambda r: F.get(r, i)))


def rot90(g: Column, k: int | Column) -> Column:
    """k quarter turns counter-clockwise; negative k turns back."""
    if isinstance(k, Column):
        k = F.pmod(k, F.lit(4))
        return bound(g, lambda x: F.when(k == 1, F.reverse(transposed(x))).when(k == 2, F.reverse(hflip(x))).when(k == 3, transposed(F.reverse(x))).otherwise(x))
    k %= 4
    if k == 0:
        return g
    return bound(g, lambda x: (F.reverse(transposed(x)), F.reverse(hflip(x)), transposed(F.reverse(x)))[k - 1])


def geometric(g: Column, flip: Column, turns: int | Column) -> Column:
    """Flip, then turn."""
    return rot90(F.when(flip, hflip(g)).otherwise(g), turns)


def revert_geometric(g: Column, flip: Column, turns: int | Column) -> Column:
    """Turn back, then flip."""
    return bound(rot90(g, -turns), lambda back: F.when(flip, hflip(back)).otherwise(back))


def cells(g: Column, f) -> Column:
    return F.transform(g, lambda r: F.transform(r, f))


def recolor(g: Column, colors: Column) -> Column:
    """Cells by a map; a color that it lacks becomes null."""
    return cells(g, lambda c: F.try_element_at(colors, c))


def inverted(colors: Column) -> Column:
    return F.map_from_arrays(F.map_values(colors), F.map_keys(colors))


def shuffled(items: Column, *key: Column) -> Column:
    """Items in the order of md5(key:item), the same wherever it is computed."""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct(F.md5(F.concat_ws(":", *key, x.cast("string"))).alias("h"), x.alias("x"))))
    return F.transform(ranked, lambda s: s["x"])


def color_map(*key: Column, swap_background: float = 0.1) -> Column:
    """A permutation of the colors 0 to 9 drawn by key; 0 moves too with the given chance."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", *key, F.lit("background"))), 1, 4), 16, 10).cast("int") / 65536
    rest = shuffled(F.sequence(F.lit(1), F.lit(9)), *key)
    whole = shuffled(F.sequence(F.lit(0), F.lit(9)), *key)
    return F.map_from_arrays(F.sequence(F.lit(0), F.lit(9)), F.when(bucket < swap_background, whole).otherwise(F.concat(F.array(F.lit(0)), rest)))


def pad(g: Column, color: Column, rows: Column, cols: Column) -> Column:
    """rows above and below, cols left and right."""
    side = F.array_repeat(color, cols)
    band = F.array_repeat(F.array_repeat(color, width(g) + 2 * cols), rows)
    return F.concat(band, F.transform(g, lambda r: F.concat(side, r, side)), band)


def upscale(g: Column, rows: Column, cols: Column) -> Column:
    return F.flatten(F.transform(g, lambda r: F.array_repeat(F.flatten(F.transform(r, lambda c: F.array_repeat(c, cols))), rows)))


def mirror(g: Column, axis: Column, before: Column) -> Column:
    """The grid and its mirror image, along rows (axis 0) or columns (1); other axes give null."""
    rows, cols = F.reverse(g), lambda r: F.reverse(r)
    down = F.when(before, F.concat(rows, g)).otherwise(F.concat(g, rows))
    across = F.when(before, F.transform(g, lambda r: F.concat(cols(r), r))).otherwise(F.transform(g, lambda r: F.concat(r, cols(r))))
    return F.when(axis == 0, down).when(axis == 1, across)


def is_valid(g: Column) -> Column:
    """Two-dimensional, not empty, all cells 0 to 9; false for null."""
    row = lambda r: (F.size(r) > 0) & (F.size(r) == width(g)) & F.forall(r, lambda c: F.coalesce(c.between(0, 9), F.lit(False)))
    return F.coalesce((F.size(g) > 0) & F.forall(g, lambda r: F.coalesce(row(r), F.lit(False))), F.lit(False))


def parse_cells(g: Column) -> Column:
    """Cells of array<array<string>> as whole numbers: decimals are cut, true and false are 1 and 0; null if one can't be read."""
    cell = lambda c: F.coalesce(c.try_cast("double").cast("int"), F.when(F.lower(c) == "true", 1).when(F.lower(c) == "false", 0))
    return bound(cells(g, cell), lambda out: F.when(~F.exists(out, lambda r: F.coalesce(F.exists(r, lambda c: c.isNull()), F.lit(True))), out))


def max_shape(samples: Column, *targets: str) -> Column:
    """(rows, cols): the largest of each over the samples' target grids."""
    sides = F.flatten(F.transform(samples, lambda s: F.array(*(F.struct(height(s[t]).alias("h"), width(s[t]).alias("w")) for t in targets))))
    return F.struct(F.array_max(F.transform(sides, lambda x: x["h"])).alias("rows"), F.array_max(F.transform(sides, lambda x: x["w"])).alias("cols"))


def on_samples(samples: Column, f, *targets: str) -> Column:
    """f on the target grids of each sample; the other stays."""
    if not set(targets) & {"input", "output"}:
        raise ValueError("no target grid")
    part = lambda s, t: (f(s[t]) if t in targets else s[t]).alias(t)
    return F.transform(samples, lambda s: F.struct(part(s, "input"), part(s, "output")))


def text(g: Column) -> Column:
    """Digits of a row side by side, rows by line."""
    return F.array_join(F.transform(g, lambda r: F.array_join(r.cast("array<string>"), "")), "\n")


# Random parameters: all are drawn from the first hex digits of md5(key:name).


def draw(name: str, n: int | Column, *key: Column) -> Column:
    """A whole number below n; null for n < 1."""
    n = F.lit(n) if isinstance(n, int) else n
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *key, F.lit(name))), 1, 7), 16, 10).cast("int")
    return F.when(n >= 1, F.pmod(h, n))


def padding_size(shape: Column, *key: Column, most: int = 5) -> Column:
    """(rows, cols) to pad with, of equal size half of the time; null where a side has no room."""
    room = [F.least(MAX_SIDE - shape[c], F.lit(most)) for c in ("rows", "cols")]
    both = draw("both", F.least(*room), *key) + 1
    same = draw("same", 2, *key) == 0
    sizes = [F.when(same, both).otherwise(draw(c, r, *key) + 1).alias(c) for c, r in zip(("rows", "cols"), room, strict=True)]
    return F.when(F.least(*room) >= 1, F.struct(*sizes))


def upscale_factors(shape: Column, *key: Column, most: int = 4) -> Column:
    """(rows, cols) to multiply by; null where neither side has room for two."""
    room = [F.least(F.floor(MAX_SIDE / shape[c]).cast("int"), F.lit(most)) for c in ("rows", "cols")]
    same = (draw("same", 2, *key) == 0) & (F.least(*room) >= 2)
    both = draw("both", F.least(*room) - 1, *key) + 2
    rows = F.coalesce(draw("rows", room[0], *key) + 1, F.lit(1))
    cols = F.when((rows == 1) & (room[1] >= 2), draw("cols", room[1] - 1, *key) + 2).otherwise(draw("cols", room[1], *key) + 1)
    rows = F.when((rows == 1) & (cols == 1), F.lit(2)).otherwise(rows)
    return F.when((F.greatest(*room) >= 2), F.struct(F.when(same, both).otherwise(rows).alias("rows"), F.when(same, both).otherwise(cols).alias("cols")))


def mirror_axis(shape: Column, *key: Column) -> Column:
    """0 or 1; forced where the other axis has no room for the image, null where none has."""
    fits = [shape[c] * 2 <= MAX_SIDE for c in ("rows", "cols")]
    return F.when(fits[0] & fits[1], draw("axis", 2, *key)).when(fits[0], 0).when(fits[1], 1)
