"""Selecting lookups and names: per look-alike, by zone, without popular names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.functions.names import dot_count, first_label, name_suffix, suffix_at, with_dot


def matched_names(site_log: DataFrame, candidates: DataFrame, extra_labels: int = 1) -> DataFrame:
    """(target, qname, typo and further columns of ``candidates``): which queried names of a site
    belong to which of its listed look-alikes.

    ``candidates`` has (target, candidate), each pair once. A name is compared at the depth of
    the candidate. Names and depths are made distinct first, so this works on names, not rows.
    """
    listed = candidates.withColumnRenamed("candidate", "typo").withColumn("_depth", dot_count("typo"))
    names = site_log.select("target", "qname").distinct()
    at_depth = names.join(listed.select("target", "_depth").distinct(), "target")
    keyed = at_depth.withColumn("typo", suffix_at("qname", F.col("_depth"), extra_labels))
    return keyed.join(listed, ["target", "_depth", "typo"]).drop("_depth")


def lookalike_lookups(site_log: DataFrame, candidates: DataFrame, extra_labels: int = 1) -> DataFrame:
    """Lookups of every listed look-alike of their site, with ``typo`` and whatever else
    ``candidates`` carries; names are compared at the depth of the look-alike. Rows meet the
    list once, on their name."""
    return site_log.join(matched_names(site_log, candidates, extra_labels), ["target", "qname"])


def lookups_at_site_depth(site_log: DataFrame, candidates: DataFrame, extra_labels: int = 1) -> DataFrame:
    """Lookups whose suffix at the depth of their *site* is a listed look-alike: those that
    existence is judged from."""
    listed = candidates.select("target", F.col("candidate").alias("typo")).distinct()
    return site_log.withColumn("typo", name_suffix("qname", "target", extra_labels)).join(listed, ["target", "typo"])


def unpopular(names: DataFrame, popular: DataFrame, name: str = "name") -> DataFrame:
    """Names that are no popular site; case and a missing final dot do not matter."""
    key = with_dot(F.lower(F.col(name)))
    listed = popular.select(with_dot(F.lower("site")).alias("_site")).distinct()
    return names.join(listed, key == F.col("_site"), "left_anti")


def observed_candidates(site_log: DataFrame, popular: DataFrame) -> DataFrame:
    """Candidate list (target, candidate): distinct compared names of a site's log other than
    the site itself, without popular sites."""
    names = site_log.select("target", name_suffix("qname", "target").alias("candidate")).distinct()
    return unpopular(names.where(F.col("candidate") != F.col("target")), popular, "candidate")


def candidate_lines(candidates: DataFrame, per_line: int = 1000) -> DataFrame:
    """``target candidate ...`` lines of at most about ``per_line`` names.

    A target with many candidates gets several lines, which readers treat as one list, so no
    list is ever gathered whole in one place.
    """
    sizes = candidates.groupBy("target").count()
    pieces = sizes.select("target", F.ceil(F.col("count") / per_line).alias("_lines"))
    dealt = candidates.join(pieces, "target").withColumn(
        "_line", F.pmod(F.xxhash64("candidate"), F.col("_lines"))
    )
    lists = dealt.groupBy("target", "_line").agg(F.array_sort(F.collect_set("candidate")).alias("names"))
    return lists.select("target", F.concat_ws(" ", F.col("target"), F.col("names")).alias("line"))


def zone_sites(zones: DataFrame, sites: DataFrame) -> DataFrame:
    """Zones that carry the first label of a watched site: (zone, site)."""
    labels = sites.select("site", first_label("site").alias("_label"))
    distinct = zones.select(F.col("zone")).distinct()
    return distinct.join(labels, F.lower("zone") == F.col("_label")).select("zone", "site")


def zone_site_names(zones: DataFrame, sites: DataFrame, site_log: DataFrame) -> DataFrame:
    """Distinct queried names of the sites found in a zone file: (zone, target, qname)."""
    found = zone_sites(zones, sites).withColumnRenamed("site", "target")
    names = site_log.select("target", "qname").distinct()
    return found.join(names, "target").select("zone", "target", "qname")


def pending(inputs: DataFrame, outputs: DataFrame, on: list[str]) -> DataFrame:
    """Keys that have input but no output yet."""
    return inputs.select(*on).distinct().join(outputs.select(*on).distinct(), on, "left_anti")
