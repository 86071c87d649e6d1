"""The study from end to end, as one Spark application per step or all in one.

raw logs -> site logs -> candidates -> ratios, existence, pair statistics -> summaries
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearname.operators.existence import exists_by_rules, with_status
from nearname.operators.extract import lookups_at_site_depth, unpopular
from nearname.operators.fuzzy import match_names, with_sites
from nearname.operators.pairs import WINDOW_S
from nearname.operators.seconds import second_counts
from nearname.operators.stats import delay_by_exists, pair_ratios, summary_by_exists, typo_stats
from nearname.session import reliable_checkpoint, scratch
from nearname.sources.logs import read_logs
from nearname.sources.sinks import write_table_by


def build_site_logs(
    spark: SparkSession, paths: str | Sequence[str], sites: DataFrame, out: str, load: str | None = None, **options
) -> DataFrame:
    """Raw logs to the table of lookups by site, written once and read by every report.

    Names are read from the headers alone and matched first; records are parsed only on the
    way into the table. Each load has a folder of its own, named by ``load`` or else by its
    paths, and replaces it: a load that is run again does not double its rows.
    """
    if load is None:
        load = "paths-" + hashlib.sha256("\n".join([paths] if isinstance(paths, str) else paths).encode()).hexdigest()[:16]
    with scratch(spark):
        names = reliable_checkpoint(match_names(read_logs(spark, paths, sections=False, **options), sites))
        matched = with_sites(read_logs(spark, paths, **options), names)
        write_table_by(matched, ["target"], f"{out}/load={load}", "overwrite")
    return spark.read.parquet(out).drop("load")


@dataclass
class Study:
    """Results of one study; all lazy except the counts they share."""

    counts: DataFrame
    candidates: DataFrame
    ratios: DataFrame
    stats: DataFrame
    summary: DataFrame
    delays: DataFrame


def study(
    site_log: DataFrame,
    popular: DataFrame,
    window_s: int = WINDOW_S,
    order: tuple[str, ...] = ("ts", "lookup_id"),
    min_ratio: float = 0.1,
    min_pair_ratio: float = 0.2,
) -> Study:
    """All reports of a site log.

    The log is condensed to seconds once and that table is written; the reports read it
    instead of the log. Only existence by rules goes back to the rows it needs. Within
    ``session.scratch`` the written tables are deleted when the results have been used.
    """
    counts = condensed(site_log)
    names = counts.where(F.col("suffix") != F.col("target")).select("target", F.col("suffix").alias("candidate")).distinct()
    candidates = reliable_checkpoint(unpopular(names, popular, "candidate"))
    ratios = reliable_checkpoint(pair_ratios(counts, popular, window_s, min_ratio))
    listed = ratios.select("target", F.col("typo").alias("candidate"))
    exists = reliable_checkpoint(exists_by_rules(lookups_at_site_depth(site_log, listed), order))
    rated = with_status(ratios, exists)
    statuses = rated.select("target", "typo", (F.col("status") == "yes").alias("exists"))
    stats = typo_stats(counts, window_s)
    return Study(
        counts=counts,
        candidates=candidates,
        ratios=rated,
        stats=stats,
        summary=summary_by_exists(stats, min_pair_ratio),
        delays=delay_by_exists(counts, statuses, window_s),
    )


def condensed(site_log: DataFrame) -> DataFrame:
    """Second counts of a site log, written to the shared folder and read back: one scan of
    the log serves every report, and no report's plan can trigger another."""
    return reliable_checkpoint(second_counts(site_log))
