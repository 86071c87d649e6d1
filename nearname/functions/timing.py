"""Epoch-second buckets, as used to prune five-minute log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_S = 300
MOST_BUCKETS = 1_000_000  # about ten years; as a broadcast, some tens of MB


def bucket_of(ts: Column, width: int = BUCKET_S) -> Column:
    """Start of the bucket that holds ``ts``."""
    return ts - F.pmod(ts, F.lit(width))


def nearest_bucket(ts: Column, width: int = BUCKET_S) -> Column:
    """Bucket boundary closest to ``ts``; the half-way point rounds up."""
    rest = F.pmod(ts, F.lit(width))
    return F.when(rest < F.lit(width / 2), ts - rest).otherwise(ts + width - rest)


def bucket_stamp(ts: Column, width: int = BUCKET_S) -> Column:
    """``yyyyMMdd.HHmm`` of the bucket that holds ``ts``, in UTC whatever the session zone."""
    at = bucket_of(ts, width)
    second_of_day = F.pmod(at, F.lit(86400))
    day = F.date_from_unix_date(F.floor(at / 86400).cast("int"))
    return F.concat(
        F.date_format(day, "yyyyMMdd"),
        F.lit("."),
        F.lpad(F.floor(second_of_day / 3600).cast("string"), 2, "0"),
        F.lpad(F.floor(F.pmod(second_of_day, F.lit(3600)) / 60).cast("string"), 2, "0"),
    )


def to_date(ts: Column) -> Column:
    return F.timestamp_seconds(ts)


def day_of(ts: Column) -> Column:
    """Calendar day in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(ts / 86_400).cast("int"))


def neighbour_buckets(ts: Column, first: Column | int, last: Column | int, width: int = BUCKET_S) -> Column:
    """The nearest bucket with the one before and the one after it, kept within [first, last]."""
    low = first if isinstance(first, Column) else F.lit(first)
    high = last if isinstance(last, Column) else F.lit(last)
    mid = F.when(ts < low, low).when(ts > high, high).otherwise(nearest_bucket(ts, width))
    return F.filter(
        F.array(mid - width, mid, mid + width), lambda b: (b >= low) & (b <= high)
    )


def around(df: DataFrame, ts: int, first: int, last: int, column: str = "bucket", width: int = BUCKET_S) -> DataFrame:
    """Rows of a table partitioned by bucket that lie around ``ts``; prunes partitions.

    The three buckets are worked out here as plain numbers, so the filter is a partition
    filter and no other folder is listed or read.
    """
    rest = ts % width
    mid = first if ts < first else last if ts > last else ts - rest if rest < width / 2 else ts + width - rest
    wanted = [b for b in (mid - width, mid, mid + width) if first <= b <= last]
    return df.where(F.col(column).isin(wanted))


def around_stamps(
    df: DataFrame, stamps: DataFrame, first: int, last: int, column: str = "bucket", ts: str = "ts", width: int = BUCKET_S
) -> DataFrame:
    """Rows of a table partitioned by bucket that lie around any of the ``stamps`` (column ``ts``).

    The buckets come from a table, so which folders are read is known at run time: the distinct
    buckets, of which there are at most one per ``width`` between ``first`` and ``last``, are
    broadcast, and the scan skips all other folders.
    """
    if (last - first) // width >= MOST_BUCKETS:
        raise ValueError(f"more than {MOST_BUCKETS} buckets between {first} and {last}")
    near = stamps.select(F.explode(neighbour_buckets(F.col(ts), first, last, width)).alias(column)).distinct()
    wanted = near.where(F.col(column).between(first, last))
    return df.join(F.broadcast(wanted), column, "left_semi")
