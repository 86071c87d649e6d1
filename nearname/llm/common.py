"""Shared pieces: words and white space, running totals without a window over a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of all contracts here: blank and the five ASCII controls, nothing of Unicode.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
CELL_BITS = 12


def sliced(texts: pa.Array, rows: int = 512) -> Iterator[list]:
    """Values of an Arrow column as Python lists of at most ``rows``, so that a batch of long
    texts is not held twice; buffers Arrow no longer uses go back to the system at the end."""
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def one_space(text: Column) -> Column:
    """Runs of white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    flat = F.trim(one_space(text))
    blanks = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(blanks + 1).cast("bigint")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def numbered(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with its columns renamed to c0, c1, ... and these names by the old ones, so that
    helper columns, which begin with an underscore or are words, replace none of them."""
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    return rows.toDF(*names.values()), names


def with_own_names(rows: DataFrame, names: dict[str, str], added: dict[str, Column]) -> DataFrame:
    """The columns of ``numbered`` under their old names and behind them the ``added`` ones; an
    added name that the input has already gets underscores behind it."""
    taken = {c.lower() for c in names}
    new = []
    for name, value in added.items():
        while name.lower() in taken:
            name += "_"
        new.append(name)
    # Renamed last: a name given in the same select would be seen inside the added expressions.
    values = [v.alias(f"_new{i}") for i, v in enumerate(added.values())]
    return rows.select(*names.values(), *values).toDF(*names, *new)


def seeded_hash(seed: int, *columns: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def running(rows: DataFrame, group: str, order: list[str], size: str | None = None, bits: int = CELL_BITS) -> DataFrame:
    """Rows with ``place`` (number of earlier rows of the group) and, given ``size``, ``before``
    (their total size).

    ``group`` must not be null and ``order[0]`` is a 64-bit hash: rows are dealt by its leading
    bits over 2**bits cells of each group, cells are totalled, and only rows of one cell are
    sorted together. A group with a third of all rows is spread over all its cells. ``rows`` is
    read twice, so callers pass a written table.
    """
    weight = F.col(size) if size else F.lit(0)
    # The sign bit is flipped so that cells follow the signed order of the hash.
    celled = rows.withColumn("_cell", F.shiftrightunsigned(F.col(order[0]).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits))
    sums = celled.groupBy(group, "_cell").agg(F.count("*").alias("_n"), F.sum(weight).alias("_s"))
    earlier = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        group, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0")
    )
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    placed = celled.withColumn("_k", F.row_number().over(inside) - 1)
    if size:
        so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_b", F.coalesce(F.sum(size).over(so_far), F.lit(0)))
    joined = placed.join(offsets, [group, "_cell"])
    result = joined.select(*rows.columns, (F.col("_n0") + F.col("_k")).alias("place"), *([(F.col("_s0") + F.col("_b")).alias("before")] if size else []))
    return result
