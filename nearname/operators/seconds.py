"""Log rows condensed to seconds, and running totals over them.

Pairing and cache questions depend on a lookup's site, network, second and compared name
only. So the log is first counted by those four; the rows of a busy site shrink to at most
one per name and second before anything is shuffled, and every later step works on counts.

Running totals are taken in two levels. Within a time bin they come from a window over that
bin; what happened in earlier bins of the same group enters as one carried row. No window
ever spans a whole group, however large its share of the log.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearname.functions.names import name_suffix, net16
from nearname.functions.records import answer_ttl

BIN_S = 3600
GROUP = ["target", "net16"]


def with_keys(site_log: DataFrame, extra_labels: int = 1) -> DataFrame:
    """Site log with the compared name ``suffix``, ``net16`` and the answer's TTL ``a_ttl``."""
    return site_log.withColumns(
        {
            "suffix": name_suffix("qname", "target", extra_labels),
            "net16": net16("src_ip"),
            "a_ttl": answer_ttl("qname"),
        }
    )


def second_counts(site_log: DataFrame, extra_labels: int = 1) -> DataFrame:
    """Counts by (target, net16, ts, suffix).

    ``n``: lookups. ``own_n``, ``own_ttl``: lookups whose name is the suffix itself, and the
    sum of their TTLs. ``expiry``: latest end of a cached correct answer given in that second.
    Sources without a dotted address have NULL as ``net16``.
    """
    rows = with_keys(site_log, extra_labels)
    own = name_suffix("qname", "suffix", extra_labels) == F.col("suffix")
    caches = (F.col("suffix") == F.col("target")) & (F.col("a_ttl") != 0)
    return rows.groupBy(*GROUP, "ts", "suffix").agg(
        F.count("*").alias("n"),
        F.count_if(own).alias("own_n"),
        F.sum(F.when(own, F.col("a_ttl")).otherwise(F.lit(0))).alias("own_ttl"),
        F.max(F.when(caches, F.col("ts") + F.col("a_ttl"))).alias("expiry"),
    )


def add_counts(parts: DataFrame) -> DataFrame:
    """Second counts of a log from second counts of its parts."""
    return parts.groupBy(*GROUP, "ts", "suffix").agg(
        *[F.sum(c).alias(c) for c in ("n", "own_n", "own_ttl")], F.max("expiry").alias("expiry")
    )


_FOLDS = {"sum": F.sum, "max": F.max}


def running_fold(
    points: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    at: str = "at",
    bin_s: int = BIN_S,
) -> DataFrame:
    """For every probe the fold (``sum`` or ``max``) of the points of its group up to and
    including the probe's time.

    ``points`` has keys, ``at`` and the value columns; ``probes`` has keys, ``at`` and any
    further columns, which are kept. A fold over no points is NULL.
    """
    keys = list(keys)
    extra = [c for c in probes.columns if c not in (*keys, at)]
    p = points.select(*keys, at, *values)
    q = probes.select(*keys, at, *extra)
    bin_of = F.floor(F.col(at) / bin_s).alias("_bin")

    folds = [_FOLDS[how](v).alias(v) for v, how in values.items()]
    per_bin = p.select(*keys, bin_of, *values).groupBy(*keys, "_bin").agg(*folds)
    asked = q.select(*keys, bin_of).distinct()
    before = Window.partitionBy(*keys).orderBy("_bin").rangeBetween(Window.unboundedPreceding, -1)
    # One row per bin and group: a month of hours is 744 rows.
    bins = per_bin.unionByName(asked, allowMissingColumns=True)
    carried = (
        bins.select(*keys, "_bin", *[_FOLDS[how](v).over(before).alias(v) for v, how in values.items()])
        .groupBy(*keys, "_bin")
        .agg(*[F.max(v).alias(v) for v in values])
        .withColumn(at, F.col("_bin") * bin_s - 1)
    )
    rows = (
        p.select(*keys, at, bin_of, *values)
        .unionByName(carried)
        .unionByName(q.select(*keys, at, bin_of, *extra, F.lit(True).alias("_probe")), allowMissingColumns=True)
    )
    upto = Window.partitionBy(*keys, "_bin").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    done = rows.select(
        *keys, at, *extra, "_probe", *[_FOLDS[how](v).over(upto).alias(v) for v, how in values.items()]
    )
    return done.where(F.col("_probe")).drop("_probe")
