"""Which name follows which at the same source, and the pairs that stand out.

n(a -> b) counts lookups of b that have at least one lookup of a by the same source less than
a window earlier. Instead of comparing lookups pairwise, the seconds in which a was seen are
turned into disjoint stretches of time that lie within the window after some a; every second
of b then meets at most one stretch per a.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearname.functions.distance import osa
from nearname.functions.names import name_suffix
from nearname.functions.once import distinct_with
from nearname.operators.ordered import with_next
from nearname.operators.skew import salted_join

WINDOW_S = 60
SPLIT_ROWS = 50_000  # rows of one source and bin on either side before they are cut into pieces


def near_name_seconds(site_log: DataFrame, max_distance: int = 2) -> DataFrame:
    """Counts by (target, src_ip, ts, name) over names within ``max_distance`` of the site."""
    rows = site_log.select("target", "src_ip", "ts", name_suffix("qname", "target").alias("name"))
    seconds = rows.groupBy("target", "src_ip", "ts", "name").agg(F.count("*").alias("n"))
    # From the seconds, not the log: names are read off the already condensed rows.
    names = distinct_with(seconds, ["target", "name"], "distance", osa("name", "target"))
    near = names.where(F.col("distance") <= max_distance)
    return seconds.join(near, ["target", "name"], "left_semi")


def name_counts(seconds: DataFrame) -> DataFrame:
    """Lookups per name and in total for each site: (target, name, lookups, site_lookups)."""
    per_name = seconds.groupBy("target", "name").agg(F.sum("n").alias("lookups"))
    total = per_name.groupBy("target").agg(F.sum("lookups").alias("site_lookups"))
    return per_name.join(total, "target").select("target", "name", "lookups", "site_lookups")


def covered_counts(seconds: DataFrame, low: int, high: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(target, a, b, n): lookups of b with some lookup of a by the same source such that
    low <= ts(b) - ts(a) <= high; a and b differ."""
    width = high - low + 1
    heads = seconds.select("target", "src_ip", F.col("name").alias("a"), "ts").distinct()
    first, last = F.floor((F.col("ts") + low) / width), F.floor((F.col("ts") + high) / width)
    pieces = heads.withColumn("_bin", F.explode(F.sequence(first, last))).select(
        "target", "src_ip", "a", "_bin",
        F.greatest(F.col("ts") + low, F.col("_bin") * width).alias("lo"),
        F.least(F.col("ts") + high, (F.col("_bin") + 1) * width - 1).alias("hi"),
    )
    # At most 2 * width rows per window: one per second that reaches into the bin.
    inside = Window.partitionBy("target", "src_ip", "_bin", "a").orderBy("lo", "hi")
    stretches = pieces.withColumn(
        "hi", F.least("hi", F.coalesce(F.lead("lo").over(inside) - 1, F.col("hi")))
    ).where(F.col("lo") <= F.col("hi"))
    tails = seconds.select(
        "target", "src_ip", F.col("name").alias("b"), "ts", "n", F.floor(F.col("ts") / width).alias("_bin")
    )
    # A source with very many names in one bin is cut into a grid of pieces. Stretches are at
    # most as many as pieces, which are counted without the window.
    key = ["target", "src_ip", "_bin"]
    met = salted_join(tails, stretches, key, split_rows, small_sizes=pieces.groupBy(*key).count())
    met = met.where(
        F.col("ts").between(F.col("lo"), F.col("hi")) & (F.col("a") != F.col("b"))
    )
    return met.groupBy("target", "a", "b").agg(F.sum("n").alias("n"))


def transition_counts(seconds: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """(target, a, b, n): lookups of b preceded by a strictly within the window."""
    return covered_counts(seconds, 1, window_s - 1)


def transition_scores(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Scores of every transition that occurs.

    ``share_out``: part of all that follows a which is b; ``fan_out``: names that follow a;
    ``share_in``: part of all that precedes b which is a; ``fan_in``: names preceding b;
    ``fan_in_pos``: 0-based place of b among the site's names by fan-in, ties by name.
    """
    out = counts.groupBy("target", "a").agg(F.sum("n").alias("n_out"), F.count("*").alias("fan_out"))
    into = counts.groupBy("target", "b").agg(F.sum("n").alias("n_in"), F.count("*").alias("fan_in"))
    every = names.select("target", F.col("name").alias("b")).join(into, ["target", "b"], "left")
    every = every.withColumns({"fan_in": F.coalesce("fan_in", F.lit(0)), "n_in": F.coalesce("n_in", F.lit(0))})
    # Names within two edits of one site: a list that the site's length bounds, not the log.
    by_fan_in = Window.partitionBy("target").orderBy(F.desc("fan_in"), "b")
    placed = every.withColumn("fan_in_pos", F.row_number().over(by_fan_in) - 1)
    n = F.col("n").cast("double")
    return counts.join(out, ["target", "a"]).join(placed, ["target", "b"]).select(
        "target", "a", "b", "n",
        F.try_divide(n, F.col("n_out").cast("double")).alias("share_out"),
        "fan_out",
        F.coalesce(F.try_divide(n, F.col("n_in").cast("double")), F.lit(0.0)).alias("share_in"),
        "fan_in",
        "fan_in_pos",
    )


def select_pairs(
    scores: DataFrame, min_share: float = 0.5, max_fan_out: int = 3, max_fan_in_pos: int = 3
) -> DataFrame:
    """Transitions that look like a look-alike being corrected."""
    return scores.where(
        (F.col("share_out") >= min_share)
        & (F.col("fan_out") <= max_fan_out)
        & (F.col("fan_in_pos") <= max_fan_in_pos)
    )


def co_lookup_shares(seconds: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """For each name: the other names looked up just before and just after it, as a share of
    its own lookups. ``direction`` is 'before' (other precedes) or 'after'.
    """
    # "after": lookups of other that have the name strictly within the window before them.
    after = covered_counts(seconds, 1, window_s - 1).withColumn("direction", F.lit("after"))
    before = covered_counts(seconds, 1 - window_s, -1).withColumn("direction", F.lit("before"))
    own = seconds.groupBy("target", F.col("name").alias("a")).agg(F.sum("n").alias("lookups"))
    share = F.try_divide(F.col("n").cast("double"), F.col("lookups").cast("double"))
    return after.unionByName(before).join(own, ["target", "a"]).select(
        "target", F.col("a").alias("name"), F.col("b").alias("other"), "direction", "n", share.alias("share")
    )


def consecutive_gaps(lookups: DataFrame, max_gap_s: int = 300, key: str = "src_ip") -> DataFrame:
    """Consecutive lookups of a source less than ``max_gap_s`` apart: (key, ts, next_ts, gap_s).

    Rows are counted by source and second first: all but the last row of a second are followed
    within it. A gap below the limit ends in the same time bin or the next one, so the seconds of
    each bin are ordered by themselves, closed by the first second of the bin after it.
    """
    seconds = lookups.groupBy(key, "ts").agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("ts") / max_gap_s))
    first = seconds.groupBy(key, "_bin").agg(F.min("ts").alias("ts"))
    closing = first.select(key, (F.col("_bin") - 1).alias("_bin"), "ts", F.lit(0).cast("bigint").alias("_n"))
    in_order = Window.partitionBy(key, "_bin").orderBy("ts")
    following = seconds.select(key, "_bin", "ts", "_n").unionByName(closing).withColumn("_next", F.lead("ts").over(in_order)).where(F.col("_n") > 0)
    near = F.when(F.col("_next") - F.col("ts") < max_gap_s, F.array("_next")).otherwise(F.array().cast("array<bigint>"))
    nexts = F.concat(F.array_repeat(F.col("ts"), (F.col("_n") - 1).cast("int")), near)
    return following.select(key, "ts", F.explode(nexts).alias("next_ts")).withColumn("gap_s", F.col("next_ts") - F.col("ts"))


def consecutive_lookups(lookups: DataFrame, max_gap_s: int = 300, row_id: str = "lookup_id", keep: Sequence[str] = ()) -> DataFrame:
    """Neighbours in the time order of the whole log less than ``max_gap_s`` apart, whatever their
    sources: (ts, row_id, ``keep``, and the same as next_..., gap_s). ``row_id`` orders rows of
    one second, so a second with very many is spread over ranges too."""
    columns = ["ts", row_id, *keep]
    both = with_next(lookups.select(*columns), columns, "ts", row_id)
    return both.withColumn("gap_s", F.col("next_ts") - F.col("ts")).where(F.col("gap_s") < max_gap_s)
