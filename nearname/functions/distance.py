"""Edit and vector distances as Column expressions.

``osa`` is the restricted Damerau-Levenshtein distance: unit insert, delete and substitute,
plus a swap of two neighbouring characters that are not edited again. It runs as a fold over
the characters, which Spark interprets, so callers narrow pairs down first (see
``operators.fuzzy``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearname.functions.keyboard import qwerty_edges


def _char(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def _edit_fold(a: Column, b: Column, cost_of, num: str) -> Column:
    """Edit-distance table row by row; the state holds the last two finished rows."""
    n, m = F.length(a), F.length(b)

    def lit(x):
        return F.lit(x).cast(num)

    row_type = f"array<{num}>"
    first_row = F.transform(F.sequence(F.lit(0), m), lambda j: j.cast(num))

    def next_row(before: Column, last: Column, i: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            cost = cost_of(_char(a, i), _char(b, j))
            swapped = (i > 1) & (j > 1) & (_char(a, i) == _char(b, j - 1)) & (_char(a, i - 1) == _char(b, j))
            best = F.least(
                F.get(last, j) + lit(1),
                F.get(row, j - 1) + lit(1),
                F.get(last, j - 1) + cost,
                F.when(swapped, F.get(before, j - 2) + cost),
            )
            return F.concat(row, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), m), F.array(i.cast(num)).cast(row_type), cell)

    table = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(first_row.alias("before"), first_row.alias("last")),
        lambda acc, i: F.struct(acc["last"].alias("before"), next_row(acc["before"], acc["last"], i).alias("last")),
        lambda acc: F.element_at(acc["last"], -1),
    )
    return F.when(n == 0, m.cast(num)).when(m == 0, n.cast(num)).otherwise(table)


def osa(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return _edit_fold(a, b, lambda x, y: F.when(x == y, 0).otherwise(1), "int")


def keyboard_osa(a: Column | str, b: Column | str, edges: list[tuple[str, str]] | None = None) -> Column:
    """As ``osa``, but replacing a character of ``a`` by a neighbouring key costs one half.

    The same cost applies to a swap. Neighbourhood is directed, so the distance is not
    symmetric; characters without a key have no neighbours.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    near = [x + y for x, y in (edges if edges is not None else qwerty_edges())]

    def cost(x: Column, y: Column) -> Column:
        return F.when(x == y, 0.0).when(F.concat(x, y).isin(near), 0.5).otherwise(1.0)

    return _edit_fold(a, b, cost, "double")


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two vectors; raises when their sizes differ."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    squares = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(
        F.raise_error(F.lit("vectors differ in size")).cast("double")
    )
