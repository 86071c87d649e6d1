"""Size-checked broadcasts and joins that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.session import reliable_checkpoint

MAX_BROADCAST_ROWS = 1_000_000  # of narrow rows: a name or a hash, some tens of MB
SPLIT_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int | None = None, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when its row count is known to be small, else for a
    sort-merge join (which adaptive execution can split on skew).

    ``rows`` is an exact or upper count when the caller has one; otherwise rows are counted,
    stopping past the bound.
    """
    if rows is None:
        rows = df.limit(most + 1).count()
    return F.broadcast(df) if rows <= most else df.hint("merge")


def hot_keys(counts: DataFrame, on: Sequence[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Keys with more than ``split_rows`` rows and the number of pieces each is cut into, as a
    table. ``counts`` has one row per key with its ``count``."""
    pieces = F.ceil(F.col("count") / split_rows).cast("bigint").alias("pieces")
    return counts.where(F.col("count") > split_rows).select(*on, pieces)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    split_rows: int = SPLIT_ROWS,
    sizes: DataFrame | None = None,
    small_sizes: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join in which hot keys of either side are cut into pieces.

    Rows of a key that is hot in ``big`` are dealt over pieces by a hash of the row and the
    matching rows of ``small`` are repeated once per piece, and the other way round; a key that
    is hot on both sides makes a grid of pieces. Without hot keys this is the plain join.
    Finding them costs one pre-aggregated count over the key columns of each side, or nothing
    much when the caller has ``sizes``: rows per key as ``count``, or more than that.
    """
    on = list(on)
    hot_big = hot_keys(big.groupBy(*on).count() if sizes is None else sizes, on, split_rows)
    hot_small = hot_keys(small.groupBy(*on).count() if small_sizes is None else small_sizes, on, split_rows)
    table = hot_big.withColumnRenamed("pieces", "_bp").join(hot_small.withColumnRenamed("pieces", "_sp"), on, "full")
    table = reliable_checkpoint(table)  # its size is known to the planner from here on
    if table.isEmpty():
        return big.join(small, on)
    one = F.lit(1).cast("bigint")
    every = lambda pieces: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(pieces, one) - 1))

    def dealt(df: DataFrame, pieces: str) -> Column:
        return F.pmod(F.xxhash64(*[c for c in df.columns if not _is_map(df, c)]), F.coalesce(pieces, one))

    left = big.join(table, on, "left").withColumn("_b", dealt(big, "_bp")).withColumn("_s", every(F.col("_sp")))
    right = small.join(table, on, "left").withColumn("_s", dealt(small, "_sp")).withColumn("_b", every(F.col("_bp")))
    return left.drop("_bp", "_sp").join(right.drop("_bp", "_sp"), [*on, "_b", "_s"]).drop("_b", "_s")


def _is_map(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "map"
