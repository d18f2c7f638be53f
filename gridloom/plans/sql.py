"""Pieces of DuckDB SQL for the oracles of the query catalogue."""

from __future__ import annotations


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def grid(k: str) -> str:
    return f"list_transform(range(0, 1 + ({k}) % 5), lambda r: list_transform(range(0, 1 + (({k}) // 5) % 6), lambda c: ((({k}) * 7 + r * 3 + c * 5 + r * c) % 10)::INT))"


def text(g: str, sep: str = "") -> str:
    return f"array_to_string(list_transform({g}, lambda r: array_to_string(r, {lit(sep)})), chr(10))"


def hflip(g: str) -> str:
    return f"list_transform({g}, lambda r: list_reverse(r))"


def rot90(g: str, k: int) -> str:
    h, w = f"len({g})", f"len({g}[1])"
    if k % 4 == 0:
        return g
    if k % 4 == 2:
        return f"list_reverse(list_transform({g}, lambda r: list_reverse(r)))"
    cell = f"{g}[j + 1][{w} - i]" if k % 4 == 1 else f"{g}[{h} - j][i + 1]"
    return f"list_transform(range(0, {w}), lambda i: list_transform(range(0, {h}), lambda j: {cell}))"


def geometric(g: str, flip: str, turns: str) -> str:
    """g is a column; flip and turns are columns too."""
    plain = " ".join(f"WHEN NOT {flip} AND {turns} = {k} THEN {rot90(g, k)}" for k in range(4))
    return f"(CASE {plain} " + " ".join(f"WHEN {turns} = {k} THEN {rot90(f'({hflip(g)})', k)}" for k in range(4)) + " END)"


def shuffled(items: str, key: str) -> str:
    """items in order of md5(key:item)."""
    return f"list_transform(list_sort(list_transform({items}, lambda x: {{'h': md5({key} || ':' || x), 'x': x}})), lambda s: s.x)"


#: (key, g) and (key, train, test) as the derived tables give them.
GRIDS = f"g0 AS (SELECT p_partkey AS key, {grid('p_partkey')} AS g FROM part)"
SAMPLE = lambda k: f"{{'input': {grid(k)}, 'output': {grid(f'({k}) * 3 + 1')}}}"
TASKS = f"t0 AS (SELECT p_partkey AS key, printf('task_%08x', p_partkey) AS task_id, [{', '.join(SAMPLE(f'p_partkey * 4 + {t}') for t in range(3))}] AS train, [{SAMPLE('p_partkey * 4 + 3')}] AS test FROM part)"
AUG = "a0 AS (SELECT a::INT AS aug_idx, a >= 4 AS hflip, (a % 4)::INT AS n_rot90 FROM range(0, 8) x(a))"
