"""The main expressions as SQL functions, for use from spark.sql.

They are temporary SQL functions with an expression body, so Catalyst inlines them like any
built-in.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from nearname.functions.keyboard import qwerty_edges
from nearname.operators.candidates import DIGITS, DOT_REPLACEMENT, LETTERS

# One cell of the edit table: i runs over a, j over b; ``line`` is the row being built, ``last``
# and ``before`` are the two rows above it.
_CELL = """least(
    get(acc.last, j) + 1, get(line, j - 1) + 1, get(acc.last, j - 1) + {cost},
    CASE WHEN i > 1 AND j > 1 AND substr(a, i, 1) = substr(b, j - 1, 1) AND substr(a, i - 1, 1) = substr(b, j, 1)
         THEN get(acc.before, j - 2) + {cost} END)"""
_TABLE = """CASE WHEN length(a) = 0 THEN cast(length(b) AS {num}) WHEN length(b) = 0 THEN cast(length(a) AS {num})
  ELSE aggregate(
    sequence(1, length(a)),
    named_struct('before', transform(sequence(0, length(b)), j -> cast(j AS {num})),
                 'last', transform(sequence(0, length(b)), j -> cast(j AS {num}))),
    (acc, i) -> named_struct(
      'before', acc.last,
      'last', aggregate(sequence(1, length(b)), array(cast(i AS {num})),
                        (line, j) -> array_append(line, cast({cell} AS {num})))),
    acc -> element_at(acc.last, -1))
  END"""
_DOTS = "(length({x}) - length(replace({x}, '.', '')))"


def _edit(cost: str, num: str) -> str:
    return _TABLE.format(num=num, cell=_CELL.format(cost=cost))


def sql_functions(edges: list[tuple[str, str]] | None = None) -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, result type, expression)."""
    same = "substr(a, i, 1) = substr(b, j, 1)"
    near = ", ".join("'" + (x + y).replace("\\", "\\\\").replace("'", "\\'") + "'" for x, y in edges or qwerty_edges())
    keyboard = f"CASE WHEN {same} THEN 0D WHEN concat(substr(a, i, 1), substr(b, j, 1)) IN ({near}) THEN 0.5D ELSE 1D END"
    depth = f"({_DOTS.format(x='reference')} + 1)"
    return {
        "name_suffix": (
            "name STRING, reference STRING",
            "STRING",
            f"CASE WHEN {_DOTS.format(x='name')} = {depth} THEN name "
            f"ELSE concat(substring_index(rtrim('.', name), '.', -{depth}), '.') END",
        ),
        "net16": (
            "ip STRING",
            "STRING",
            "CASE WHEN size(split(rtrim('.', ip), '[.]')) >= 4 THEN concat(substring_index(ip, '.', 2), '.0.0') END",
        ),
        "osa_distance": ("a STRING, b STRING", "INT", _edit(f"CASE WHEN {same} THEN 0 ELSE 1 END", "int")),
        "keyboard_distance": ("a STRING, b STRING", "DOUBLE", _edit(keyboard, "double")),
    }


def table_functions() -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, result columns, query) of functions that give rows, for LATERAL."""
    chars = lambda text: f"split('{text}', '')"
    places = "sequence(1, length(site))"
    replaced = f"filter(concat({chars(LETTERS + DIGITS)}, if(substr(site, i, 1) = '.', array('{DOT_REPLACEMENT}'), array())), c -> c <> substr(site, i, 1))"
    parts = [
        f"flatten(transform(sequence(1, length(site) + 1), i -> transform({chars(LETTERS)}, c -> concat(substr(site, 1, i - 1), c, substr(site, i)))))",
        f"transform({places}, i -> concat(substr(site, 1, i - 1), substr(site, i + 1)))",
        f"flatten(transform({places}, i -> transform({replaced}, c -> concat(substr(site, 1, i - 1), c, substr(site, i + 1)))))",
        f"transform(filter({places}, i -> i < length(site) AND substr(site, i, 1) <> substr(site, i + 1, 1)), "
        "i -> concat(substr(site, 1, i - 1), substr(site, i + 1, 1), substr(site, i, 1), substr(site, i + 2)))",
    ]
    every = f"CASE WHEN length(site) > 0 THEN array_distinct(concat({', '.join(parts)})) WHEN length(site) = 0 THEN {chars(LETTERS)} END"
    return {"typo_candidates": ("site STRING", "candidate STRING", f"SELECT explode({every})")}


def register(spark: SparkSession, edges: list[tuple[str, str]] | None = None) -> list[str]:
    """Create the functions in the session; returns their names."""
    functions = sql_functions(edges)
    for name, (parameters, result, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    rows = table_functions()
    for name, (parameters, columns, query) in rows.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {query}")
    return [*functions, *rows]
