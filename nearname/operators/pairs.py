"""Pairs of a look-alike lookup and a correct lookup that follows it.

``pair_rows`` lists pairs: both sides are put into time bins as wide as the window, so the
join is an equi-join on site, network and bin with the exact bound as a condition. Only the
reports that ask for the pairs themselves use it.

``pair_totals`` counts pairs and sums their delays without making any: the number of correct
lookups in a window is a difference of two running totals, so each look-alike second needs
two probes however many correct lookups follow it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.functions.distance import osa
from nearname.functions.names import name_suffix
from nearname.functions.once import distinct_with
from nearname.functions.records import export_line
from nearname.operators.cache import visible_lookups
from nearname.operators.extract import lookalike_lookups
from nearname.operators.seconds import BIN_S, GROUP, running_fold, second_counts, with_keys
from nearname.operators.skew import SPLIT_ROWS, salted_join
from nearname.session import reliable_checkpoint

WINDOW_S = 60


def pair_rows(
    typos: DataFrame,
    targets: DataFrame,
    on: Sequence[str],
    low: int,
    high: int,
    split_rows: int = SPLIT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join look-alike rows with target rows where low <= target_ts - typo_ts <= high.

    Inputs carry ``on`` and ``typo_ts`` / ``target_ts`` and whatever else is to be kept, under
    different names. ``counts``, the second counts of the log, tell which bins are hot
    without reading the rows for it.
    """
    width = high - low + 1
    first = F.floor((F.col("typo_ts") + low) / width)
    last = F.floor((F.col("typo_ts") + high) / width)
    spread = typos.withColumn("_bin", F.explode(F.sequence(first, last)))  # at most two bins
    placed = targets.withColumn("_bin", F.floor(F.col("target_ts") / width))
    sizes = typo_sizes = None
    if counts is not None:
        here, heads = F.floor(F.col("ts") / width), F.col("suffix") == F.col("target")
        sizes = counts.where(heads).groupBy(*on, here.alias("_bin")).agg(F.sum("n").alias("count"))
        bins = F.explode(F.sequence(F.floor((F.col("ts") + low) / width), F.floor((F.col("ts") + high) / width)))
        typo_sizes = counts.where(~heads).select(*on, bins.alias("_bin"), "n").groupBy(*on, "_bin").agg(F.sum("n").alias("count"))
    joined = salted_join(placed, spread, [*on, "_bin"], split_rows, sizes, typo_sizes)
    delay = F.col("target_ts") - F.col("typo_ts")
    return joined.withColumn("delay_s", delay).where(F.col("delay_s").between(low, high)).drop("_bin")


def _side(
    rows: DataFrame, side: str, on: Sequence[str], records: bool, name: str | None = None, lines: bool = False
) -> DataFrame:
    columns = [*on, F.col("ts").alias(f"{side}_ts")]
    if name:
        columns.append(F.col(name).alias(side))
    if "lookup_id" in rows.columns:
        columns.append(F.col("lookup_id").alias(f"{side}_id"))
    if records:
        kept = ("ts", "typ", "src_ip", "dst_ip", "qname", "qtype", "rcode", "answer", "authority", "additional")
        columns.append(F.struct(*kept).alias(f"{side}_record"))
    if lines:
        # Below the join: a lookup's text is made once, however many pairs the lookup is in.
        columns.append(export_line().alias(f"{side}_line"))
    return rows.select(*columns)


def visible_pairs(
    site_log: DataFrame,
    counts: DataFrame | None = None,
    window_s: int = WINDOW_S,
    records: bool = False,
    split_rows: int = SPLIT_ROWS,
    bin_s: int = BIN_S,
    lines: bool = False,
) -> DataFrame:
    """Every look-alike lookup with each correct lookup 0..window_s seconds later from the
    same /16, both not hidden by a cached answer; with ``records`` both lookups whole, with
    ``lines`` their text forms."""
    counts = second_counts(site_log) if counts is None else counts
    rows = visible_lookups(site_log, counts, bin_s).where(F.col("net16").isNotNull())
    if not (records or lines):
        # Both sides come from one written narrow table, so visibility is worked out once.
        kept = [c for c in ("lookup_id",) if c in rows.columns]
        rows = reliable_checkpoint(rows.select(*GROUP, "ts", "suffix", *kept))
    typos = _side(rows.where(F.col("suffix") != F.col("target")), "typo", GROUP, records, "suffix", lines)
    targets = _side(rows.where(F.col("suffix") == F.col("target")), "target", GROUP, records, lines=lines)
    return pair_rows(typos, targets, GROUP, 0, window_s, split_rows, counts)


def status_pairs(
    site_log: DataFrame,
    statuses: DataFrame,
    window_s: int = WINDOW_S,
    split_rows: int = SPLIT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Pairs of the listed look-alikes with their existence: 0 < delay <= window_s, same /16,
    cached answers not considered. ``statuses`` has (target, typo, exists).
    """
    rows = with_keys(site_log).where(F.col("net16").isNotNull())
    targets = _side(rows.where(F.col("suffix") == F.col("target")), "target", GROUP, False)
    listed = statuses.select("target", F.col("typo").alias("candidate"), "exists")
    typos = _side(lookalike_lookups(rows, listed), "typo", [*GROUP, "exists"], False, "typo")
    return pair_rows(typos, targets, GROUP, 1, window_s, split_rows, counts)


def near_pairs(
    site_log: DataFrame,
    distance: int = 1,
    window_s: int = WINDOW_S,
    split_rows: int = SPLIT_ROWS,
    counts: DataFrame | None = None,
    records: bool = False,
    lines: bool = False,
) -> DataFrame:
    """Pairs over all networks whose look-alike is exactly ``distance`` edits from the site:
    0 <= delay < window_s; with ``records`` both lookups whole, with ``lines`` their text forms."""
    rows = site_log.withColumn("suffix", name_suffix("qname", "target"))
    # Every edit is at most two of the built-in Levenshtein distance, which stops at its bound:
    # the interpreted distance is left for names near their site, not all that were looked up.
    near = F.levenshtein("suffix", "target", 2 * distance) >= 0
    names = distinct_with(rows, ["target", "suffix"], "distance", F.when(near, osa("suffix", "target")))
    close = reliable_checkpoint(names.where(F.col("distance") == distance).select("target", "suffix"))
    typos = _side(rows.join(close, ["target", "suffix"], "left_semi"), "typo", ["target"], records, "suffix", lines)
    targets = _side(rows.where(F.col("suffix") == F.col("target")), "target", ["target"], records, lines=lines)
    return pair_rows(typos, targets, ["target"], 0, window_s - 1, split_rows, counts)


def pair_totals(counts: DataFrame, low: int, high: int, bin_s: int = BIN_S) -> DataFrame:
    """Pairs and summed delays by (target, typo) over low <= delay <= high, same /16.

    ``counts`` are second counts, e.g. all of them or the visible ones. Look-alikes without
    any pair are left out.
    """
    dotted = counts.where(F.col("net16").isNotNull())
    # Sums of times are decimals: at log scale they leave the range of a 64-bit integer.
    stamp = F.col("ts").cast("decimal(12,0)")
    points = (
        dotted.where(F.col("suffix") == F.col("target"))
        .groupBy(*GROUP, F.col("ts").alias("at"))
        .agg(F.sum("n").alias("c"), F.sum(F.col("n") * stamp).cast("decimal(30,0)").alias("s"))
    )
    ends = F.array(
        F.struct((F.col("ts") + high).alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col("ts") + (low - 1)).alias("at"), F.lit(-1).alias("sign")),
    )
    probes = (
        dotted.where(F.col("suffix") != F.col("target"))
        .select(*GROUP, F.col("suffix").alias("typo"), "n", "ts", F.explode(ends).alias("_e"))
        .select(*GROUP, F.col("_e.at").alias("at"), "typo", (F.col("n") * F.col("_e.sign")).alias("w"), "ts")
    )
    totals = running_fold(points, probes, GROUP, {"c": "sum", "s": "sum"}, bin_s=bin_s)
    found = totals.where(F.col("c").isNotNull())
    wide = "decimal(38,0)"
    sums = found.groupBy("target", "typo").agg(
        F.sum(F.col("w") * F.col("c")).alias("pair_count"),
        F.sum(F.col("w").cast("decimal(19,0)").cast(wide) * (F.col("s") - F.col("c").cast(wide) * F.col("ts").cast(wide)).cast(wide))
        .cast("bigint")
        .alias("delay_sum"),
    )
    return sums.where(F.col("pair_count") > 0)
