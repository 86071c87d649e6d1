"""Counts, ratios and delays by look-alike and by existence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.functions.names import is_ipv6, swap_tld
from nearname.functions.records import first_answer_ttl
from nearname.operators.cache import visible_counts
from nearname.operators.extract import unpopular
from nearname.operators.pairs import WINDOW_S, pair_totals
from nearname.operators.seconds import BIN_S, running_fold


def count_rows(lookups: DataFrame) -> DataFrame:
    return lookups.agg(F.count("*").alias("lookups"))


def single_counts(counts: DataFrame, own_depth: bool = False) -> DataFrame:
    """Lookups per look-alike: (target, typo, single_count).

    By default names count by the suffix at the site's depth; ``own_depth`` counts only
    lookups whose name is the look-alike itself.
    """
    rows = counts.where(F.col("suffix") != F.col("target")).groupBy("target", F.col("suffix").alias("typo"))
    return rows.agg(F.sum("own_n" if own_depth else "n").alias("single_count"))


def pair_ratios(
    counts: DataFrame,
    popular: DataFrame,
    window_s: int = WINDOW_S,
    min_ratio: float = 0.1,
    bin_s: int = BIN_S,
) -> DataFrame:
    """(typo, target, ratio, join_count, single_count) of look-alikes that are no popular
    site and whose pairs per lookup exceed ``min_ratio``. Pairs have 0 < delay < window_s."""
    single = unpopular(single_counts(counts), popular, "typo")
    joined = pair_totals(counts, 1, window_s - 1, bin_s).select("target", "typo", F.col("pair_count").alias("join_count"))
    rows = single.join(joined, ["target", "typo"], "left").withColumn("join_count", F.coalesce("join_count", F.lit(0)))
    ratio = F.try_divide(F.col("join_count").cast("double"), F.col("single_count").cast("double"))
    return (
        rows.withColumn("ratio", ratio)
        .where((F.col("single_count") != 0) & (F.col("ratio") > min_ratio))
        .select("typo", "target", "ratio", "join_count", "single_count")
    )


def typo_stats(counts: DataFrame, window_s: int = WINDOW_S, bin_s: int = BIN_S) -> DataFrame:
    """(typo, target, single_count, pair_count, mean_delay, exists) of look-alikes with at
    least one pair among the lookups that no cached answer hides. One that was only looked up
    through deeper names has no log of its own and is left out."""
    pairs = pair_totals(visible_counts(counts, bin_s), 0, window_s, bin_s)
    facts = counts.where(F.col("suffix") != F.col("target")).groupBy("target", F.col("suffix").alias("typo"))
    facts = facts.agg(F.sum("own_n").alias("single_count"), (F.sum("own_ttl") != 0).alias("exists"))
    facts = facts.where(F.col("single_count") > 0)
    mean = F.try_divide(F.col("delay_sum").cast("double"), F.col("pair_count").cast("double"))
    return pairs.join(facts, ["target", "typo"]).select(
        "typo", "target", "single_count", "pair_count", mean.alias("mean_delay"), "exists"
    )


def summary_by_exists(stats: DataFrame, min_ratio: float = 0.2) -> DataFrame:
    """Per existence: look-alikes, their pairs and the mean delay of a pair, over look-alikes
    with more than ``min_ratio`` pairs per lookup."""
    kept = stats.where(
        F.try_divide(F.col("pair_count").cast("double"), F.col("single_count").cast("double")) > min_ratio
    )
    weighted = F.sum(F.col("pair_count") * F.col("mean_delay"))
    return kept.groupBy("exists").agg(
        F.count("*").alias("lookalikes"),
        F.sum("pair_count").alias("pairs"),
        F.try_divide(weighted, F.sum("pair_count").cast("double")).alias("mean_delay"),
    )


def delay_by_exists(counts: DataFrame, statuses: DataFrame, window_s: int = WINDOW_S, bin_s: int = BIN_S) -> DataFrame:
    """Per existence: pairs with 0 < delay <= window_s of the listed look-alikes and their mean
    delay, from totals alone. ``statuses`` has (target, typo, exists).

    Counts look-alikes by the suffix at the site's depth restricted to lookups of the name
    itself, which is what a look-alike's own log holds.
    """
    own = counts.where(F.col("suffix") != F.col("target")).withColumn("n", F.col("own_n")).where(F.col("n") > 0)
    heads = counts.where(F.col("suffix") == F.col("target"))
    totals = pair_totals(own.unionByName(heads), 1, window_s, bin_s)
    rows = totals.join(statuses.select("target", "typo", "exists"), ["target", "typo"])
    return rows.groupBy("exists").agg(
        F.sum("pair_count").alias("pairs"),
        F.try_divide(F.sum("delay_sum").cast("double"), F.sum("pair_count").cast("double")).alias("mean_delay"),
    )


def summary_sentences(summary: DataFrame) -> DataFrame:
    """The two-line text report of either summary; the one by look-alikes names their number."""
    # The wording of the two reports.
    by_pairs = "For %s domain, there are %d records, average time is %s"
    by_lookalikes = (
        "For %s typo domain, there are %d pairs of typo and target website, %d records. The average time is %s."
    )
    kind = F.when(F.col("exists"), F.lit("existed")).otherwise(F.lit("non-existed"))
    if "lookalikes" in summary.columns:
        text = F.format_string(by_lookalikes, kind, "lookalikes", "pairs", "mean_delay")
    else:
        text = F.format_string(by_pairs, kind, "pairs", "mean_delay")
    return summary.select("exists", text.alias("line"))


def delays(pairs: DataFrame) -> DataFrame:
    """Raw delays of pairs with their existence."""
    return pairs.select("exists", (F.col("target_ts") - F.col("typo_ts")).alias("delay_s"))


def ipv6_share(lookups: DataFrame) -> DataFrame:
    """Lookups, those from IPv6 sources, and their share."""
    v6 = F.count_if(is_ipv6("src_ip"))
    return lookups.agg(
        F.count("*").alias("lookups"),
        v6.alias("ipv6_lookups"),
        F.try_divide(v6.cast("double"), F.count("*").cast("double")).alias("ipv6_share"),
    )


def swapped_tld_check(
    lookups: DataFrame,
    wrong: str = ".ocm.",
    right: str = ".com.",
    same_source: bool = False,
    window_s: int = WINDOW_S,
    bin_s: int = BIN_S,
) -> DataFrame:
    """For each lookup of a name under ``wrong``: the state of the corrected name.

    ``expired_before``: answered lookups of the corrected name whose first answer ran out
    before this lookup. ``cached_at``: those still valid at this second. ``followed``: lookups
    of the corrected name strictly within ``window_s`` seconds after. All are differences of
    running totals, over all sources or (``same_source``) this lookup's own.
    """
    keys = ["name", "src_ip"] if same_source else ["name"]
    ask = lookups.where(F.lower("qname").endswith(wrong)).withColumn("name", swap_tld(F.lower("qname"), wrong, right))
    wanted = ask.select("name").distinct()
    rightful = lookups.withColumn("name", F.lower("qname")).join(wanted, "name", "left_semi")

    # Each lookup of a corrected name moves up to four counters, each at its own second.
    ttl, ts = F.col("ttl"), F.col("ts")
    names = ["seen", "ended", "begun", "over"]
    times = [ts, ts + ttl, F.when(ttl > 0, ts), F.when(ttl > 0, ts + ttl)]
    marks = F.array(*[F.struct(t.alias("at"), F.lit(n).alias("what")) for n, t in zip(names, times)])
    marked = rightful.select(*keys, "ts", first_answer_ttl().alias("ttl")).select(*keys, F.explode(marks).alias("_m"))
    points = (
        marked.where(F.col("_m.at").isNotNull())
        .groupBy(*keys, F.col("_m.at").alias("at"))
        .agg(*[F.count_if(F.col("_m.what") == n).alias(n) for n in names])
    )

    offsets = F.array(F.lit(-1), F.lit(0), F.lit(window_s - 1))
    probes = ask.select(*keys, "ts").distinct().withColumn("off", F.explode(offsets))
    probes = probes.select(*keys, (F.col("ts") + F.col("off")).alias("at"), "ts", "off")
    found = running_fold(points, probes, keys, dict.fromkeys(names, "sum"), bin_s=bin_s)

    def at(offset: int, counter: str):
        return F.coalesce(F.max(F.when(F.col("off") == offset, F.col(counter))), F.lit(0))

    state = found.groupBy(*keys, "ts").agg(
        at(-1, "ended").alias("expired_before"),
        (at(0, "begun") - at(0, "over")).alias("cached_at"),
        (at(window_s - 1, "seen") - at(0, "seen")).alias("followed"),
    )
    return ask.join(state, [*keys, "ts"])


def followup_share(checked: DataFrame) -> DataFrame:
    """Of lookups whose corrected name had no expired answer before: how many were followed
    by the corrected name, as count and share; and how many had such an answer."""
    fresh = F.col("expired_before") == 0
    followed = F.count_if(fresh & (F.col("followed") > 0))
    return checked.agg(
        F.count_if(~fresh).alias("with_answer_before"),
        F.count_if(fresh).alias("without_answer_before"),
        followed.alias("followed"),
        F.try_divide(followed.cast("double"), F.count_if(fresh).cast("double")).alias("followed_share"),
    )
