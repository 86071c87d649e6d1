"""Keeping costly expressions from being copied around a plan.

The optimizer moves a filter below the projection that computes its column and puts the whole
expression in its place, and below a grouping when it only uses the grouping keys. For folds
over arrays that means work repeated per reference and per row. These two helpers mark the
places where an expression must be computed as written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose expression is evaluated exactly once per row.

    Filters on generated columns stay above the generator.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def distinct_with(df: DataFrame, keys: Sequence[str], name: str, value: Column) -> DataFrame:
    """Distinct ``keys`` with a column computed per distinct key, not per row.

    The value is tied to the row count of its key, so it cannot move below the grouping.
    """
    groups = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return groups.select(*keys, F.when(F.col("_rows") > 0, value).alias(name))
