"""One order over all rows, without a window that holds them all.

Rows are dealt into ranges of the order and written with the number of their range. Inside a
range an ordinary window does; what crosses a border is carried by the driver, which holds one
row per range that has any. A range without rows has none, so carries pass over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearname.session import reliable_checkpoint, small_table

PART = "_part"


def ordered_parts(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` in a written table with ``_part``, the number of their range of the order.

    Ranges are taken from a sample of the order's columns, so these should tell rows apart:
    rows that agree in all of them lie in one range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reliable_checkpoint(rows.repartitionByRange(ranges, *order).withColumn(PART, F.spark_partition_id()))


def with_place(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``rows`` with the number, from 1, that each has in the order."""
    parts = ordered_parts(rows, *order)
    counts = sorted(parts.groupBy(PART).count().collect())  # one row per range
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = small_table(rows.sparkSession, before, f"{PART} int, _before long")
    placed = parts.join(F.broadcast(offsets), PART)
    inside = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return placed.select(*rows.columns, (F.col("_before") + inside).alias(name))


def with_next(rows: DataFrame, columns: Sequence[str], *order: str) -> DataFrame:
    """``rows`` with ``next_<column>``, the values of the row that follows in the order; they are
    null behind the last row."""
    parts = ordered_parts(rows, *order)
    spark = rows.sparkSession
    head = F.min_by(F.struct(*columns), F.struct(*order))
    firsts = sorted(parts.groupBy(PART).agg(head.alias("head")).collect(), key=lambda r: r[PART])  # one row per range
    carried = [(r[PART], *after["head"]) for r, after in zip(firsts, firsts[1:])]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    table = small_table(spark, carried, ", ".join([f"{PART} int", *(f"_next_{c} {types[c]}" for c in columns)]))
    inside = Window.partitionBy(PART).orderBy(*order)
    # A value may be null in a row that is there, so the row tells whether there is one.
    follows = F.lead(F.lit(True)).over(inside)
    found = parts.join(F.broadcast(table), PART, "left")
    # Ascending orders put nulls first; ranges do so as well.
    return found.select(
        *rows.columns, *[F.when(follows, F.lead(c).over(inside)).otherwise(F.col(f"_next_{c}")).alias(f"next_{c}") for c in columns]
    )
