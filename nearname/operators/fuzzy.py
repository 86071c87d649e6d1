"""Joins on edit distance.

Two names within ``k`` edits of each other share at least one string that is left after
deleting at most ``k`` characters from each. Every name is expanded to hashes of those
strings, an equi-join on the hash finds candidates, and the exact distance decides. Nothing
is compared pairwise beyond the candidates, and the work is linear in the number of names.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.functions.distance import keyboard_osa, osa
from nearname.functions.names import dot_count, name_suffix, suffix_at
from nearname.functions.once import distinct_with
from nearname.operators.skew import MAX_BROADCAST_ROWS, broadcast_if_small

_RANK_SPACE = 1 << 32  # ranks are 32-bit


def deletion_keys(df: DataFrame, name: str, radius: int, key: str = "_key") -> DataFrame:
    """Rows repeated once per way to delete at most ``radius`` characters of ``name``, with
    the 64-bit hash of what is left.

    Positions to delete are exploded one column each, in rising order, unused ones being 0;
    all of it is generated code.
    """
    text, size = F.col(name), F.length(name)
    out, before = df, F.lit(0)
    places = [f"_d{i}" for i in range(1, radius + 1)]
    for i, place in enumerate(places, start=1):
        low = F.when(before == 0, 0).otherwise(before + 1)
        high = F.greatest(size - (radius - i), F.lit(0))
        out = out.withColumn(place, F.explode(F.sequence(low, high)))
        before = F.col(place)
    cuts = [F.lit(0), *[F.col(p) for p in places]]
    pieces = [F.substring(text, a + 1, b - a - 1) for a, b in zip(cuts, cuts[1:])]
    pieces.append(F.substring(text, cuts[-1] + 1, size))
    return out.withColumn(key, F.xxhash64(F.concat(*pieces))).drop(*places)


def deletion_key_count(length: int, radius: int) -> int:
    return sum(comb(length, d) for d in range(min(length, radius) + 1))


def fuzzy_pairs(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    max_distance: float = 2,
    on: Sequence[str] = (),
    keyboard: bool = False,
    edges: list[tuple[str, str]] | None = None,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Distinct (``on``, left name, right name, distance) within ``max_distance``.

    ``on`` names columns both sides share that must be equal. ``right`` is the side that may
    be small: the number of its keys follows from its name lengths, so whether it can be
    broadcast is known before any key is made. Beyond the bound both sides are shuffled on
    the key.
    """
    on = list(on)
    # Half-cost replacements and swaps: up to two plain edits per unit of keyboard distance.
    radius = int(max_distance * 2) if keyboard else int(max_distance)
    a = left.select(*on, F.col(left_name).alias("_a")).distinct()
    b = right.select(*on, F.col(right_name).alias("_b")).distinct()

    lengths = b.groupBy(F.length("_b").alias("n")).count().collect()  # one row per name length
    if not lengths:
        shortest = longest = keys = 0
    else:
        shortest, longest = min(r["n"] for r in lengths), max(r["n"] for r in lengths)
        keys = sum(r["count"] * deletion_key_count(r["n"], radius) for r in lengths)
    a = a.where(F.length("_a").between(shortest - radius, longest + radius))

    a_keys = deletion_keys(a, "_a", radius)
    b_keys = broadcast_if_small(deletion_keys(b, "_b", radius), keys, max_broadcast)
    # Every plain edit is at most two edits of the simple Levenshtein distance.
    near = F.levenshtein("_a", "_b", 2 * radius) >= 0
    candidates = (
        a_keys.join(b_keys, [*on, "_key"])
        .where(F.abs(F.length("_a") - F.length("_b")) <= radius)
    )
    # A pair occurs once per shared key; both distances are computed once per distinct pair.
    distance = F.when(near, keyboard_osa("_a", "_b", edges) if keyboard else osa("_a", "_b"))
    return (
        distinct_with(candidates, [*on, "_a", "_b"], "distance", distance)
        .where(F.col("distance") <= max_distance)
        .select(*on, F.col("_a").alias(left_name), F.col("_b").alias(right_name), "distance")
    )


def depths(df: DataFrame, name: str) -> list[int]:
    """Distinct dot counts of a name column, all of them: one number per depth in use."""
    rows = df.select(dot_count(name).alias("d")).distinct().collect()
    return sorted(r["d"] for r in rows)


def suffixes_by_depth(df: DataFrame, qname: str, wanted: Sequence[int], extra_labels: int = 1) -> DataFrame:
    """Rows repeated per reference depth, with the suffix compared at that depth."""
    if not wanted:
        return df.select("*", F.lit(0).alias("depth"), F.lit("").alias("suffix")).limit(0)
    keys = F.array(
        *[
            F.struct(F.lit(d).alias("depth"), suffix_at(qname, d, extra_labels).alias("suffix"))
            for d in wanted
        ]
    )
    return df.select("*", F.explode(keys).alias("_k")).select(*df.columns, "_k.depth", "_k.suffix")


def match_names(names: DataFrame, sites: DataFrame, max_distance: int = 2, extra_labels: int = 1) -> DataFrame:
    """For each distinct queried name the closest watched site within ``max_distance``.

    Ties go to the better rank. Columns: qname, target, rank, distance.
    """
    # Read twice below; equal filters let both uses share one exchange.
    distinct = names.select("qname").where(F.col("qname").isNotNull()).distinct()
    ranked = sites.withColumn("depth", dot_count("site"))
    keyed = suffixes_by_depth(distinct, "qname", depths(sites, "site"), extra_labels)
    pairs = fuzzy_pairs(keyed, ranked, "suffix", "site", max_distance, on=["depth"])
    scored = pairs.join(ranked, ["depth", "site"]).select("depth", "suffix", "rank", "distance")
    # One number orders by distance, then rank, and keeps the aggregate hash-based.
    best = F.min(F.col("distance").cast("bigint") * _RANK_SPACE + F.col("rank")).alias("_best")
    return (
        keyed.join(scored, ["depth", "suffix"])
        .groupBy("qname")
        .agg(best)
        .select(
            "qname",
            (F.col("_best") % _RANK_SPACE).cast("int").alias("rank"),
            F.floor(F.col("_best") / _RANK_SPACE).cast("int").alias("distance"),
        )
        .join(sites.select("rank", F.col("site").alias("target")), "rank")
        .select("qname", "target", "rank", "distance")
    )


def assign_sites(lookups: DataFrame, sites: DataFrame, max_distance: int = 2, extra_labels: int = 1) -> DataFrame:
    """Lookups with the watched site (``target``) their name belongs to; others drop out.

    Matching runs on distinct names only. The match table has one row per name, so the join
    back keeps row counts, and a name that makes up much of the log is split by adaptive skew
    handling.
    """
    return with_sites(lookups, match_names(lookups, sites, max_distance, extra_labels))


def with_sites(lookups: DataFrame, matched: DataFrame) -> DataFrame:
    """Lookups joined with the sites that ``match_names`` found for their names."""
    rest = [c for c in lookups.columns if c not in ("target", "rank", "distance")]
    return lookups.select(*rest).join(matched, "qname").select(*rest, "target", "rank", "distance")


def far_names(site_log: DataFrame, max_distance: int = 2) -> DataFrame:
    """Quality check: names in a site's log that are farther than ``max_distance`` from it."""
    names = site_log.select("target", name_suffix("qname", "target").alias("name"))
    scored = distinct_with(names, ["target", "name"], "distance", osa("name", "target"))
    return scored.where(F.col("distance") > max_distance)


def regroup_lists(lists: DataFrame, sites: DataFrame, max_distance: int = 2) -> DataFrame:
    """Candidates regrouped by nearest site within each list.

    ``lists`` has (list_id, name). Every member of a list that is a watched site becomes a
    target; the other members of the same list at distance 1..max_distance are its
    candidates.
    """
    members = lists.select("list_id", F.col("name")).distinct()
    popular = members.join(sites.select(F.col("site").alias("name")).distinct(), "name", "left_semi")
    heads = popular.select("list_id", F.col("name").alias("target"))
    pairs = fuzzy_pairs(
        members.withColumnRenamed("name", "candidate"), heads, "candidate", "target", max_distance, on=["list_id"]
    )
    return pairs.where(F.col("distance") > 0).select("list_id", "target", "candidate", "distance")


def names_in_band(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs whose distance lies in a closed band, e.g. 0..0, 1..1 or 1..2."""
    return pairs.where(F.col("distance").between(low, high))
