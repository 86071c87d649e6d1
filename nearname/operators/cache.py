"""Lookups that a network's cached correct answer makes uninformative.

A correct answer given at ``t`` with time-to-live ``ttl`` hides later lookups of the same
site from the same /16 while ``t < ts < t + ttl``. Such an answer exists exactly when the
latest expiry of all earlier answers lies after ``ts``, which is a running maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.operators.seconds import BIN_S, GROUP, running_fold, second_counts, with_keys


def hidden_seconds(counts: DataFrame, bin_s: int = BIN_S) -> DataFrame:
    """(target, net16, ts) of seconds whose lookups are hidden."""
    dotted = counts.where(F.col("net16").isNotNull())
    points = (
        dotted.where(F.col("expiry").isNotNull())
        .groupBy(*GROUP, F.col("ts").alias("at"))
        .agg(F.max("expiry").alias("expiry"))
    )
    probes = dotted.select(*GROUP, (F.col("ts") - 1).alias("at")).distinct()
    cover = running_fold(points, probes, GROUP, {"expiry": "max"}, bin_s=bin_s)
    return cover.where(F.col("expiry") > F.col("at") + 1).select(*GROUP, (F.col("at") + 1).alias("ts"))


def visible_counts(counts: DataFrame, bin_s: int = BIN_S) -> DataFrame:
    """Second counts of dotted sources that no cached answer hides."""
    dotted = counts.where(F.col("net16").isNotNull())
    return dotted.join(hidden_seconds(counts, bin_s), [*GROUP, "ts"], "left_anti")


def hidden_lookups(site_log: DataFrame, counts: DataFrame | None = None, bin_s: int = BIN_S) -> DataFrame:
    """Rows of the site log that are hidden."""
    counts = second_counts(site_log) if counts is None else counts
    return with_keys(site_log).join(hidden_seconds(counts, bin_s), [*GROUP, "ts"], "left_semi")


def visible_lookups(site_log: DataFrame, counts: DataFrame | None = None, bin_s: int = BIN_S) -> DataFrame:
    """Rows of the site log from dotted sources that are not hidden, with their keys."""
    counts = second_counts(site_log) if counts is None else counts
    rows = with_keys(site_log).where(F.contains("src_ip", F.lit(".")))
    return rows.join(hidden_seconds(counts, bin_s), [*GROUP, "ts"], "left_anti")
