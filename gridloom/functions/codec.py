"""Text codecs of grids. A codec is named by a nested call such as GridShapeEncoder(RowNumberEncoder(MinimalGridEncoder())), which is parsed, never evaluated."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import grid

#: The characters that stand for the digits 0 to 9.
DIGITS, MARKS = "0123456789", "ñò÷ûąćďęĚĞ"
FENCE = "```"
DEFAULT = "GridShapeEncoder(RowNumberEncoder(MinimalGridEncoder()))"


def lines_of(t: Column) -> Column:
    return F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def _digits(row: Column) -> Column:
    """Single characters as numbers; one that is no digit gives null."""
    return F.when(row == "", F.array().cast("array<int>")).otherwise(F.split(row, "").try_cast("array<int>"))


@dataclass(frozen=True)
class Minimal:
    def to_text(self, g: Column) -> Column:
        return grid.text(g)

    def to_grid(self, t: Column) -> Column:
        return F.transform(lines_of(t), _digits)


@dataclass(frozen=True)
class Separated:
    separator: str

    def to_text(self, g: Column) -> Column:
        return F.array_join(F.transform(g, lambda r: F.array_join(r.cast("array<string>"), self.separator)), "\n")

    def to_grid(self, t: Column) -> Column:
        return F.transform(lines_of(t), lambda r: F.transform(F.split(r, re.escape(self.separator)), lambda c: c.try_cast("int")))


@dataclass(frozen=True)
class Repeated:
    n: int = 3

    def to_text(self, g: Column) -> Column:
        return F.array_join(F.transform(g, lambda r: F.array_join(F.transform(r, lambda c: F.repeat(c.cast("string"), F.lit(self.n))), "")), "\n")

    def to_grid(self, t: Column) -> Column:
        return F.transform(lines_of(t), lambda r: F.filter(_digits(r), lambda _, i: i % self.n == 0))


@dataclass(frozen=True)
class CodeBlock:
    inner: object

    def to_text(self, g: Column) -> Column:
        return F.concat(F.lit(f"{FENCE}grid\n"), self.inner.to_text(g), F.lit(f"\n{FENCE}"))

    def to_grid(self, t: Column) -> Column:
        """Null where the opening is missing; without a closing fence the text goes to its end."""
        body = F.get(F.split(t, f"{FENCE}grid\n"), F.lit(1))
        return self.inner.to_grid(F.get(F.split(body, f"\n{FENCE}"), F.lit(0)))


@dataclass(frozen=True)
class Shape:
    inner: object

    def to_text(self, g: Column) -> Column:
        size = lambda x: F.concat_ws("x", grid.height(x).cast("string"), grid.width(x).cast("string"))
        return grid.bound(g, lambda x: F.concat(F.lit(f"{FENCE}grid shape: "), size(x), F.lit("\n"), self.inner.to_text(x), F.lit(f"\n{FENCE}")))

    def to_grid(self, t: Column) -> Column:
        """The lines from the first header on, without repeated headers, up to a closing fence or the end; null without a header."""
        header = lambda x: x.startswith(f"{FENCE}grid shape:")
        first = lambda lines, f: F.array_position(F.transform(lines, f), F.lit(True)).cast("int")
        after = lambda lines, start: F.when(start > 0, F.filter(F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines)), lambda x: ~header(x)))
        upto = lambda rest, stop: F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
        rest = grid.bound(F.split(t, r"\r\n|[\n\r]"), lambda lines: grid.bound(first(lines, header), lambda start: after(lines, start)))
        body = grid.bound(rest, lambda r: grid.bound(first(r, lambda x: x.startswith(FENCE)), lambda stop: upto(r, stop)))
        return self.inner.to_grid(F.array_join(body, "\n"))


@dataclass(frozen=True)
class RowNumber:
    inner: object

    def to_text(self, g: Column) -> Column:
        lines = F.split(self.inner.to_text(g), "\n")
        return F.array_join(F.transform(lines, lambda x, i: F.concat_ws(" ", (i + 1).cast("string"), x)), "\n")

    def to_grid(self, t: Column) -> Column:
        """A line without a space gives null."""
        cut = F.transform(lines_of(t), lambda x: F.when(F.instr(x, " ") > 0, F.substr(x, F.instr(x, " ") + 1)))
        return self.inner.to_grid(grid.bound(cut, lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.array_join(c, "\n"))))


@dataclass(frozen=True)
class Replaced:
    inner: object

    def to_text(self, g: Column) -> Column:
        return F.translate(self.inner.to_text(g), DIGITS, MARKS)

    def to_grid(self, t: Column) -> Column:
        return self.inner.to_grid(F.translate(t, MARKS, DIGITS))


KINDS = {"MinimalGridEncoder": Minimal, "GridWithSeparationEncoder": Separated, "RepeatNumberEncoder": Repeated, "GridCodeBlockEncoder": CodeBlock, "GridShapeEncoder": Shape, "RowNumberEncoder": RowNumber, "ReplaceNumberEncoder": Replaced}


def register(name: str, kind: type) -> None:
    """Let specs name a further codec: a class of one argument or none with to_text and to_grid."""
    if not (hasattr(kind, "to_text") and hasattr(kind, "to_grid")):
        raise ValueError(f"{name} has no to_text and to_grid")
    KINDS[name] = kind


def parse(spec: str):
    """The codec that spec names; ValueError for anything else."""

    def build(node: ast.expr):
        if isinstance(node, ast.Constant) and isinstance(node.value, str | int):
            return node.value
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in KINDS and not node.keywords and len(node.args) <= 1:
            return KINDS[node.func.id](*map(build, node.args))
        raise ValueError(f"not a grid codec: {spec}")

    try:
        found = build(ast.parse(spec, mode="eval").body)
    except (SyntaxError, TypeError) as e:
        raise ValueError(f"not a grid codec: {spec}") from e
    if not isinstance(found, tuple(KINDS.values())):
        raise ValueError(f"not a grid codec: {spec}")
    return found


def parsed_or_empty(codec, t: Column, revert=lambda g: g) -> Column:
    """The grid of a response that continues "```grid", reverted; an empty one where anything fails."""
    g = revert(codec.to_grid(F.concat(F.lit(f"{FENCE}grid"), t)))
    return grid.bound(g, lambda x: F.when(grid.is_valid(x), x).otherwise(F.array().cast(grid.GRID)))
