"""Queries over the driver's tables, one per operator or report.

Each takes (spark, sf_dir) and runs over whole tables. Lookups are derived from ``events``,
names from ``pages``, vectors from ``embeddings``; see ``sources.events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearname.functions import names as N
from nearname.functions import timing
from nearname.functions.distance import l2
from nearname.functions.records import answer_ttl, explode_records, export_line, first_answer_ttl
from nearname.operators import cluster, existence, extract, fuzzy, paired, pairs, stats, transitions
from nearname.operators.cache import hidden_lookups
from nearname.operators.candidates import candidate_hits, typo_candidates
from nearname.operators.candidates import observed_candidate_hits as observed_hits
from nearname.operators.ordered import with_place
from nearname.operators.segments import segment_pairs
from nearname.plans.loads import LoadStore
from nearname.plans.study import condensed
from nearname.session import reliable_checkpoint, small_table, work_dir
from nearname.sources.events import log_lines_from_events, lookups_from_events, popular_sites, watched_sites
from nearname.functions.sql import register
from nearname.schema import RATIO_STATUS, TYPO_STATS
from nearname.sources.ledger import ingest_manifest, read_site_lines
from nearname.sources.lists import (
    parse_candidate_lines,
    parse_features,
    parse_zone,
    read_candidates,
    read_features,
    read_pairs,
    read_ratios,
    read_sites,
    read_status_pairs,
    read_typo_stats,
    read_zone,
)
from nearname.sources.logs import lookups_of, parse_lines, read_lines, rejects_of
from nearname.sources.sinks import (
    pair_lines,
    read_lines_by,
    sorted_log,
    split_lists_by_first,
    write_csv,
    write_lines,
    write_lines_by,
    write_status_pairs,
    write_table_by,
)
from nearname.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
KMEANS_PASSES = 3


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. These come as one file of few row groups, which would leave most cores idle;
    its rows are dealt out. A table of many files is left as it is read."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def site_log(spark: SparkSession, sf: str) -> DataFrame:
    return lookups_from_events(table(spark, sf, "events"))


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    return log_lines_from_events(table(spark, sf, "events"))


def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    host = F.lower(F.split_part("url", F.lit("/"), F.lit(3)))
    return table(spark, sf, "pages").select(host.alias("host")).distinct()


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), vec.alias("vec"), "label")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Reading and writing logs


@query
def ingest_parse(spark, sf):
    parsed = parse_lines(raw_lines(spark, sf), keep=["lookup_id"])
    sizes = [F.size(s).alias(f"n_{s}") for s in ("answer", "authority", "additional")]
    return lookups_of(parsed, keep=["lookup_id"]).select(
        "lookup_id", "ts", "typ", "src_ip", "dst_ip", "qname", "qtype", "rcode", *sizes
    )


@query
def ingest_rr(spark, sf):
    parsed = parse_lines(raw_lines(spark, sf), keep=["lookup_id"])
    return explode_records(lookups_of(parsed, keep=["lookup_id"]), ["lookup_id"])


@query
def ingest_rejects(spark, sf):
    return rejects_of(parse_lines(raw_lines(spark, sf), keep=["lookup_id"], sections=False), keep=["lookup_id"])


@query
def export_roundtrip(spark, sf):
    """Lookups written as lines, read again and written again."""
    lines = site_log(spark, sf).select("lookup_id", export_line().alias("line"))
    again = lookups_of(parse_lines(lines, keep=["lookup_id", "line"]), keep=["lookup_id", "line"])
    again = again.select("lookup_id", "line", (export_line() == F.col("line")).alias("same"))
    return again


@query
def count_log(spark, sf):
    return stats.count_rows(lookups_of(parse_lines(raw_lines(spark, sf), sections=False)))


@query
def log_sorted(spark, sf):
    log = site_log(spark, sf).select("target", "ts", "lookup_id", "qname")
    return sorted_log(log, spark.sparkContext.defaultParallelism, ties=["lookup_id"])


@query
def file_union(spark, sf):
    """Names of two sources as one list, without repeats."""
    looked_up = site_log(spark, sf).select(F.col("qname").alias("name"))
    hosts = page_hosts(spark, sf).select(N.with_dot("host").alias("name"))
    return looked_up.unionByName(hosts).distinct()


# Expressions


@query
def name_suffix(spark, sf):
    names = site_log(spark, sf).select("target", "qname").distinct()
    return names.select(
        "target",
        "qname",
        N.name_suffix("qname", "target").alias("suffix"),
        N.name_suffix("qname", "target", extra_labels=0).alias("registered"),
        N.first_label("qname").alias("label"),
        N.with_dot(N.without_dot(F.upper("qname"))).alias("dotted"),
    )


@query
def net16(spark, sf):
    sources = site_log(spark, sf).groupBy("src_ip").agg(F.count("*").alias("lookups"))
    return sources.select(
        "src_ip", "lookups", N.net16("src_ip").alias("net16"), N.is_ipv4("src_ip").alias("ipv4"), N.is_ipv6("src_ip").alias("ipv6")
    )


@query
def distinct_networks(spark, sf):
    rows = site_log(spark, sf).where(N.is_ipv4("src_ip"))
    return rows.select("target", N.net16("src_ip").alias("net16")).distinct()


@query
def answer_ttls(spark, sf):
    return site_log(spark, sf).select(
        "lookup_id", "qname", answer_ttl().alias("a_ttl"), first_answer_ttl().alias("first_ttl")
    )


@query
def bucket_5min(spark, sf):
    seconds = site_log(spark, sf).groupBy("ts").agg(F.count("*").alias("lookups"))
    near = timing.neighbour_buckets(F.col("ts"), 28401300, 28443900)
    return seconds.select(
        "ts",
        "lookups",
        timing.bucket_of(F.col("ts")).alias("bucket"),
        timing.bucket_stamp(F.col("ts")).alias("stamp"),
        F.array_join(F.transform(near, lambda b: b.cast("string")), " ").alias("near"),
    )


FIRST_STAMP, LAST_STAMP = 28401300, 28443900  # the time the given events cover


@query
def lookups_near_stamps(spark, sf):
    """The log written by five-minute bucket, read around the first sight of each look-alike."""
    log, out = site_log(spark, sf), work_dir(spark, "buckets")
    write_table_by(log.select("lookup_id", "ts", "target", "qname", timing.bucket_of(F.col("ts")).alias("bucket")), ["bucket"], out)
    seen = log.select("ts", "target", N.name_suffix("qname", "target").alias("typo")).where(F.col("typo") != F.col("target"))
    stamps = seen.groupBy("target", "typo").agg(F.min("ts").alias("ts"))
    stored = spark.read.schema("lookup_id long, ts long, target string, qname string, bucket long").parquet(out)
    return timing.around_stamps(stored, stamps, FIRST_STAMP, LAST_STAMP)


@query
def tld_swap(spark, sf):
    rows = site_log(spark, sf).where(F.col("qname").endswith(".ocm."))
    return rows.select("lookup_id", "qname", N.swap_tld("qname").alias("corrected"))


# Names


@query
def typo_candidates_of_hosts(spark, sf):
    return typo_candidates(page_hosts(spark, sf), "host")


@query
def candidate_hits_in_log(spark, sf):
    log = site_log(spark, sf)
    return candidate_hits(typo_candidates(log.select(F.col("target").alias("site"))), log)


@query
def observed_candidate_hits(spark, sf):
    """As above, with candidates left out before the shuffle by a bit filter of the log's names."""
    log = site_log(spark, sf)
    return observed_hits(log.select(F.col("target").alias("site")), log)


@query
def fuzzy_osa(spark, sf):
    hosts = reliable_checkpoint(page_hosts(spark, sf))
    found = fuzzy.fuzzy_pairs(hosts.withColumnRenamed("host", "x"), hosts.withColumnRenamed("host", "y"), "x", "y", 2)
    return fuzzy.names_in_band(found, 1, 2)


@query
def fuzzy_keyboard(spark, sf):
    hosts = reliable_checkpoint(page_hosts(spark, sf))
    found = fuzzy.fuzzy_pairs(
        hosts.withColumnRenamed("host", "x"), hosts.withColumnRenamed("host", "y"), "x", "y", 1.5, keyboard=True
    )
    return found.where(F.col("distance") > 0)


@query
def fuzzy_segments(spark, sf):
    """Names of the log up to three edits from a host of the pages or a watched site, by segments."""
    names = site_log(spark, sf).select(F.col("qname").alias("x"))
    hosts = page_hosts(spark, sf).select(F.col("host").alias("y"))
    return segment_pairs(names, hosts.unionByName(watched_sites(spark).select(F.col("site").alias("y"))), "x", "y", 3)


@query
def fuzzy_segments_keyboard(spark, sf):
    hosts = page_hosts(spark, sf)
    found = segment_pairs(hosts.withColumnRenamed("host", "x"), hosts.withColumnRenamed("host", "y"), "x", "y", 1.5, keyboard=True)
    return found.where(F.col("distance") > 0)


@query
def fuzzy_site_assign(spark, sf):
    matched = fuzzy.assign_sites(site_log(spark, sf).drop("target"), watched_sites(spark))
    return matched.select("lookup_id", "qname", "target", "rank", "distance")


@query
def fuzzy_regroup(spark, sf):
    lists = site_log(spark, sf).select(F.col("target").alias("list_id"), F.col("qname").alias("name"))
    return fuzzy.regroup_lists(lists, popular_sites(spark))


@query
def qc_far_names(spark, sf):
    return fuzzy.far_names(site_log(spark, sf))


@query
def popular_anti(spark, sf):
    return extract.observed_candidates(site_log(spark, sf), popular_sites(spark))


@query
def candidate_lines(spark, sf):
    return extract.candidate_lines(_observed(spark, site_log(spark, sf)), per_line=10_000)


@query
def candidate_lines_read(spark, sf):
    return parse_candidate_lines(extract.candidate_lines(_observed(spark, site_log(spark, sf)), per_line=7))


@query
def extract_typo_lookups(spark, sf):
    log = site_log(spark, sf)
    return extract.lookalike_lookups(log, _observed(spark, log)).select("lookup_id", "target", "typo")


@query
def zone_sites(spark, sf):
    """Zone lines made of the first labels of the log, some of other record types."""
    kind = F.when(F.col("lookup_id") % 4 == 0, " A ").otherwise(" NS ")
    line = F.concat(F.upper(N.first_label("qname")), kind, F.lit("ns1.example.net."))
    log = site_log(spark, sf)
    zones = parse_zone(log.select(line.alias("line")))
    return extract.zone_site_names(zones, watched_sites(spark), log)


# Caching and pairs


@query
def typo_stats_by_loads(spark, sf):
    """Pair statistics of a log that comes in three loads, the last part first."""
    log = site_log(spark, sf)
    third = (LAST_STAMP - FIRST_STAMP) // 3
    store = LoadStore(spark, work_dir(spark, "loads"))
    for name, low, high in (("c", 2, None), ("a", None, 1), ("b", 1, 2)):
        part = log if low is None else log.where(F.col("ts") >= FIRST_STAMP + low * third)
        store.add(part if high is None else part.where(F.col("ts") < FIRST_STAMP + high * third), name)
    return rounded(store.typo_stats(), "mean_delay")


@query
def ttl_suppressed(spark, sf):
    log = site_log(spark, sf)
    return hidden_lookups(log, condensed(log)).select("lookup_id", "target", "net16", "ts", "suffix")


@query
def pairs_v1(spark, sf):
    log = site_log(spark, sf)
    return pairs.visible_pairs(log, condensed(log)).select(
        "target", "typo", "typo_id", "typo_ts", "target_id", "target_ts", "net16", "delay_s"
    )


@query
def pairs_stored(spark, sf):
    """Pairs from two bucketed tables: nothing is shuffled below the join."""
    log = site_log(spark, sf)
    path = work_dir(spark, "pair_store")
    store = paired.write_pair_store(log, f"pairs_{path[-32:]}", path, condensed(log))
    return store.pairs(spark).select("target", "typo", "typo_id", "typo_ts", "target_id", "target_ts", "net16", "delay_s")


@query
def pair_lines_v1(spark, sf):
    log = site_log(spark, sf)
    return pair_lines(pairs.visible_pairs(log, condensed(log), lines=True))


def _statuses(log: DataFrame, counts: DataFrame, spark: SparkSession) -> DataFrame:
    rated = stats.pair_ratios(counts, popular_sites(spark))
    listed = rated.select("target", F.col("typo").alias("candidate"))
    listed = reliable_checkpoint(listed)
    return reliable_checkpoint(existence.exists_by_rules(extract.lookups_at_site_depth(log, listed)))


def _observed(spark: SparkSession, log: DataFrame) -> DataFrame:
    # The candidate list is read several times; the log should not be.
    return reliable_checkpoint(extract.observed_candidates(log, popular_sites(spark)))


@query
def pairs_status(spark, sf):
    log = site_log(spark, sf)
    counts = condensed(log)
    found = pairs.status_pairs(log, _statuses(log, counts, spark), counts=counts)
    return found.select("typo", "typo_ts", "typo_id", "target", "target_ts", "target_id", "net16", "exists")


@query
def pairs_dist1(spark, sf):
    return pairs.near_pairs(site_log(spark, sf)).select(
        "target", "typo", "typo_id", "target_id", "delay_s"
    )


@query
def pair_ratio(spark, sf):
    return rounded(stats.pair_ratios(condensed(site_log(spark, sf)), popular_sites(spark)), "ratio")


@query
def single_counts(spark, sf):
    return stats.single_counts(condensed(site_log(spark, sf)))


# Existence and statistics


@query
def exists_by_ttl(spark, sf):
    return existence.exists_by_ttl(condensed(site_log(spark, sf)))


@query
def exists_by_rules(spark, sf):
    log = site_log(spark, sf)
    return existence.exists_by_rules(extract.lookups_at_site_depth(log, _observed(spark, log)))


@query
def ratio_status(spark, sf):
    log = site_log(spark, sf)
    counts = condensed(log)
    rated = stats.pair_ratios(counts, popular_sites(spark))
    return rounded(existence.with_status(rated, _statuses(log, counts, spark)), "ratio")


@query
def typo_stats(spark, sf):
    return rounded(stats.typo_stats(condensed(site_log(spark, sf))), "mean_delay")


@query
def summary_by_exists(spark, sf):
    return rounded(stats.summary_by_exists(stats.typo_stats(condensed(site_log(spark, sf)))), "mean_delay")


@query
def delay_by_exists(spark, sf):
    log = site_log(spark, sf)
    counts = condensed(log)
    return rounded(stats.delay_by_exists(counts, _statuses(log, counts, spark)), "mean_delay")


@query
def delay_sentences(spark, sf):
    log = site_log(spark, sf)
    counts = condensed(log)
    return stats.summary_sentences(rounded(stats.delay_by_exists(counts, _statuses(log, counts, spark)), "mean_delay", digits=3))


@query
def summary_sentences(spark, sf):
    summary = stats.summary_by_exists(stats.typo_stats(condensed(site_log(spark, sf))))
    return stats.summary_sentences(rounded(summary, "mean_delay", digits=3))


@query
def pending_lookalikes(spark, sf):
    """Look-alikes of the candidate list that got no ratio row."""
    log = site_log(spark, sf)
    listed = extract.observed_candidates(log, popular_sites(spark)).withColumnRenamed("candidate", "typo")
    return extract.pending(listed, stats.pair_ratios(condensed(log), popular_sites(spark)), ["target", "typo"])


@query
def ipv6_share(spark, sf):
    return rounded(stats.ipv6_share(site_log(spark, sf)), "ipv6_share")


@query
def tld_cached_check(spark, sf):
    return stats.swapped_tld_check(site_log(spark, sf)).select(
        "lookup_id", "name", "ts", "expired_before", "cached_at", "followed"
    )


@query
def uncached_followup(spark, sf):
    """As the check above, by the same network and from sources of one provider block."""
    log = site_log(spark, sf).where(F.col("src_ip").startswith("10."))
    nets = log.withColumn("src_ip", N.net16("src_ip"))
    return rounded(stats.followup_share(stats.swapped_tld_check(nets, same_source=True)), "followed_share")


# Transitions


def _near_seconds(spark: SparkSession, sf: str) -> DataFrame:
    # Sources of the derived log rarely ask twice in a minute; the /16 stands for the source.
    log = site_log(spark, sf)
    nets = log.withColumn("src_ip", F.coalesce(N.net16("src_ip"), F.col("src_ip")))
    return reliable_checkpoint(transitions.near_name_seconds(nets))


@query
def name_counts(spark, sf):
    return transitions.name_counts(_near_seconds(spark, sf))


@query
def transition_counts(spark, sf):
    return transitions.transition_counts(_near_seconds(spark, sf))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    seconds = _near_seconds(spark, sf)
    return transitions.transition_scores(transitions.transition_counts(seconds), transitions.name_counts(seconds))


@query
def transition_scores(spark, sf):
    return rounded(_scores(spark, sf), "share_out", "share_in")


@query
def transition_pairs(spark, sf):
    """Selected pairs; the derived log mixes names evenly, so the limits are set wider."""
    chosen = transitions.select_pairs(_scores(spark, sf), min_share=0.12, max_fan_out=30, max_fan_in_pos=3)
    return rounded(chosen, "share_out", "share_in")


@query
def co_lookup_share(spark, sf):
    return rounded(transitions.co_lookup_shares(_near_seconds(spark, sf)), "share")


@query
def consecutive_gap(spark, sf):
    return transitions.consecutive_gaps(site_log(spark, sf))


@query
def consecutive_global(spark, sf):
    """Neighbours in time over all sources, less than five minutes apart."""
    return transitions.consecutive_lookups(site_log(spark, sf), keep=["qname"])


# Clusters


def _centres(spark: SparkSession, sf: str):
    points = vectors(spark, sf)
    return points, cluster.kmeans(points, max_iterations=KMEANS_PASSES, eps=-1.0)[0]


@query
def kmeans_fixed_passes(spark, sf):
    points, centres = _centres(spark, sf)
    sizes = cluster.assign(points, centres).groupBy("cluster").agg(F.count("*").alias("size"))
    tall = cluster.centre_table(points, centres).select("cluster", F.posexplode("centre").alias("pos", "x"))
    return rounded(tall.join(sizes, "cluster"), "x", digits=5)


@query
def kmeans_converged(spark, sf):
    """Centres after which no pass moves them by more than the default bound."""
    points = vectors(spark, sf)
    centres, _ = cluster.kmeans(points)
    sizes = cluster.assign(points, centres).groupBy("cluster").agg(F.count("*").alias("size"))
    tall = cluster.centre_table(points, centres).select("cluster", F.posexplode("centre").alias("pos", "x"))
    return rounded(tall.join(sizes, "cluster"), "x", digits=4)


@query
def kmeans_members(spark, sf):
    points, centres = _centres(spark, sf)
    return cluster.members(cluster.assign(points, centres)).select("cluster", "place", "name")


@query
def kmeans_oversampled_start(spark, sf):
    """Start vectors by oversampling and how many vectors lie closest to each."""
    found = cluster.oversampled_start(vectors(spark, sf))
    rows = [(place, name, weight) for place, (name, _, weight) in enumerate(found, start=1)]  # k rows
    return small_table(spark, rows, "place int, name bigint, weight bigint")


@query
def centre_distance(spark, sf):
    """Distance of every vector to its closest start centre."""
    points = vectors(spark, sf)
    centres = cluster.start_centres(points)
    table = cluster.centre_table(points, centres)  # k rows
    near = cluster.assign(points, centres).join(F.broadcast(table), "cluster")
    return near.select("name", "cluster", F.round(l2("vec", "centre"), 5).alias("distance"))


@query
def label_means(spark, sf):
    """Means per label and position, merged from means per label, position and bucket."""
    tall = vectors(spark, sf).select("label", "name", F.posexplode("vec").alias("pos", "x"))
    parts = tall.groupBy("label", "pos", (F.col("name") % 7).alias("part")).agg(
        F.avg("x").alias("mean"), F.count("*").alias("count")
    )
    return rounded(cluster.merged_mean(parts, ["label", "pos"]), "mean")


@query
def features_from_text(spark, sf):
    text = F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")
    lines = vectors(spark, sf).select("name", text.alias("text"))
    parsed = parse_features(lines)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return parsed.select("name", F.size("vec").alias("dims"), F.round(total, 5).alias("total"))


# Files: each query writes with a sink and reads back with a source


@query
def log_files_read(spark, sf):
    """Compressed log files in one folder per site, read by a glob and by a recursive listing."""
    out = work_dir(spark, "files")
    write_lines_by(site_log(spark, sf), ["target"], out)
    ways = {"glob": read_lines(spark, f"{out}/target=*", "*.gz"), "recursive": read_lines(spark, out, "*.gz", recursive=True)}
    found = [lookups_of(parse_lines(lines)).withColumn("how", F.lit(how)) for how, lines in ways.items()]
    return found[0].unionByName(found[1]).groupBy("how", "qname").agg(F.count("*").alias("lookups"))


@query
def ingest_ledger(spark, sf):
    """Five-minute files taken in by two manifests, the second with the first one's files too:
    what the ledger says of each file."""
    times = site_log(spark, sf).select("lookup_id", timing.bucket_of(F.col("ts")).alias("bucket"))
    lines, out, root = raw_lines(spark, sf).join(times, "lookup_id"), work_dir(spark, "files"), work_dir(spark, "ingest")
    lines.select("bucket", F.col("line").alias("value")).repartition("bucket").write.partitionBy("bucket").text(out)
    ingest_manifest(spark, [f"{out}/bucket=28[0-3]*/part-*", f"{out}/bucket=2841*/part-*"], root)
    ledger, _ = ingest_manifest(spark, [f"{out}/bucket=*/part-*"], root)
    bucket = F.regexp_extract("file", "bucket=([0-9]+)", 1).cast("bigint").alias("bucket")
    return ledger.entries().groupBy(bucket).agg(F.sum("rows").alias("rows"), F.sum("rejects").alias("rejects"))


@query
def ledger_lookups(spark, sf):
    """The rows behind the ledger: lookups and rejects of all files that are in, by name."""
    out, root = work_dir(spark, "files"), work_dir(spark, "ingest")
    raw_lines(spark, sf).select(F.col("line").alias("value")).write.text(out)
    ledger, _ = ingest_manifest(spark, [f"{out}/part-*"], root, files_per_round=3)
    good = ledger.lookups().groupBy("qname").agg(F.count("*").alias("lookups"), F.sum(F.size("answer")).alias("answers"))
    bad = ledger.rejects().groupBy(F.col("reason").alias("qname")).agg(F.count("*").alias("lookups"), F.lit(None).cast("bigint").alias("answers"))
    return good.unionByName(bad)


@query
def site_files_read(spark, sf):
    """Log files in folders that bear the site's name: each line's site comes from its path."""
    log, out = site_log(spark, sf), work_dir(spark, "sites")
    for site in [r["site"] for r in watched_sites(spark).collect()]:  # the watch-list, four sites
        write_lines(log.where(F.col("target") == site), f"{out}/{site.rstrip('.')}")
    lines = read_site_lines(spark, out)
    return lookups_of(parse_lines(lines, keep=["target"], sections=False), keep=["target"]).groupBy("target", "qname").agg(F.count("*").alias("lookups"))


@query
def pair_files_read(spark, sf):
    log, out = site_log(spark, sf), work_dir(spark, "pairs")
    pair_lines(pairs.visible_pairs(log, condensed(log), lines=True)).write.text(out)
    names = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("typo", "target") for c in ("ts", "src_ip", "qname")]
    return read_pairs(spark, out).select(*names)


@query
def ratio_file_read(spark, sf):
    log, out = site_log(spark, sf), work_dir(spark, "ratios")
    counts = condensed(log)
    rated = existence.with_status(stats.pair_ratios(counts, popular_sites(spark)), _statuses(log, counts, spark))
    write_csv(rated.select(*RATIO_STATUS.names), out)
    return rounded(read_ratios(spark, out, with_status=True), "ratio")


@query
def typo_stats_file_read(spark, sf):
    out = work_dir(spark, "stats")
    write_csv(stats.typo_stats(condensed(site_log(spark, sf))).select(*TYPO_STATS.names), out)
    return rounded(read_typo_stats(spark, out), "mean_delay")


def _status_pairs(spark: SparkSession, sf: str) -> DataFrame:
    log = site_log(spark, sf)
    counts = condensed(log)
    return pairs.status_pairs(log, _statuses(log, counts, spark), counts=counts)


@query
def status_pair_files_read(spark, sf):
    """Pairs in a folder for existing and one for other look-alikes; the folders give the status."""
    out = work_dir(spark, "status")
    write_status_pairs(_status_pairs(spark, sf), out)
    parts = [read_status_pairs(spark, f"{out}/status={s}").withColumn("status", F.lit(s)) for s in ("existed", "nonexisted")]
    return parts[0].unionByName(parts[1])


@query
def delay_list(spark, sf):
    return stats.delays(_status_pairs(spark, sf))


@query
def write_modes(spark, sf):
    """Rows per site after overwriting and appending, and after overwriting again."""
    log, out = site_log(spark, sf).select("target", "lookup_id"), work_dir(spark, "modes")
    write_table_by(log.where("lookup_id % 2 = 0"), ["target"], out, "overwrite")
    write_table_by(log.where("lookup_id % 2 = 1"), ["target"], out, "append")
    both = reliable_checkpoint(spark.read.parquet(out).groupBy("target").agg(F.count("*").alias("appended")))
    write_table_by(log.where("lookup_id % 2 = 0"), ["target"], out, "overwrite")
    last = spark.read.schema("lookup_id long, target string").parquet(out).groupBy("target").agg(F.count("*").alias("overwritten"))
    return both.join(last, "target")


@query
def typo_files_read(spark, sf):
    """Log lines in one folder per site and look-alike."""
    log, out = site_log(spark, sf), work_dir(spark, "typos")
    write_lines_by(extract.lookalike_lookups(log, _observed(spark, log)), ["target", "typo"], out)
    return read_lines_by(spark, out, ["target", "typo"]).groupBy("target", "typo").agg(F.count("*").alias("lookups"))


@query
def list_files_read(spark, sf):
    """Candidate lines cut into one folder per site and read again."""
    out = work_dir(spark, "lists")
    split_lists_by_first(extract.candidate_lines(_observed(spark, site_log(spark, sf)), per_line=9), out)
    return read_candidates(spark, out).select("target", "candidate")


@query
def site_files_ranked(spark, sf):
    """Watch-lists of several files: hosts of the pages by their first letter, ranked over all files."""
    out = work_dir(spark, "lists")
    hosts = page_hosts(spark, sf).where(F.col("host") != "").select("host", F.substring("host", 1, 1).alias("first"))
    hosts.repartition("first").sortWithinPartitions("first", "host").select("first", F.col("host").alias("value")).write.partitionBy("first").text(out)
    return read_sites(spark, out)


@query
def co_lookup_ranked(spark, sf):
    """Names looked up around a name, the largest share first, with their place in that order."""
    shares = rounded(transitions.co_lookup_shares(_near_seconds(spark, sf)), "share")
    return with_place(shares, F.desc("share"), "target", "name", "other", "direction")


@query
def lookup_dates(spark, sf):
    """Lookups by calendar day, with the moments of the first and the last."""
    day, moment = timing.day_of(F.col("ts")).cast("string").alias("day"), timing.to_date(F.col("ts"))
    ends = [F.min(moment).cast("bigint").alias("first_ts"), F.max(moment).cast("bigint").alias("last_ts")]
    return site_log(spark, sf).groupBy(day).agg(F.count("*").alias("lookups"), *ends)


@query
def zone_file_read(spark, sf):
    out = work_dir(spark, "zone")
    kind = F.when(F.col("lookup_id") % 4 == 0, " A ").otherwise(" NS ")
    line = F.concat(F.upper(N.first_label("qname")), kind, F.lit("ns1.example.net."))
    site_log(spark, sf).select(line.alias("value")).write.text(out)
    return read_zone(spark, out).groupBy("zone").agg(F.count("*").alias("lines"))


@query
def feature_file_read(spark, sf):
    out = work_dir(spark, "features")
    text = F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")
    vectors(spark, sf).select(F.concat_ws("\t", F.col("name").cast("string"), text).alias("value")).write.text(out)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return read_features(spark, out).select("name", F.size("vec").alias("dims"), F.round(total, 5).alias("total"))


@query
def pair_lines_dist1(spark, sf):
    """Text of both lookups for pairs whose look-alike is one edit away."""
    return pair_lines(pairs.near_pairs(site_log(spark, sf), lines=True))


@query
def sql_distances(spark, sf):
    """The SQL functions in a query: names of the log and the site each belongs to."""
    register(spark)
    site_log(spark, sf).createOrReplaceTempView("site_log")
    return spark.sql(
        "SELECT target, suffix, osa_distance(suffix, target) AS distance, net16('10.1.2.' || length(suffix)) AS net16 "
        "FROM (SELECT DISTINCT target, name_suffix(qname, target) AS suffix FROM site_log)"
    )


@query
def sql_keyboard_distances(spark, sf):
    register(spark)
    site_log(spark, sf).createOrReplaceTempView("site_log")
    return spark.sql(
        "SELECT target, suffix, keyboard_distance(suffix, target) AS distance "
        "FROM (SELECT DISTINCT target, name_suffix(qname, target) AS suffix FROM site_log)"
    )


@query
def sql_typo_candidates(spark, sf):
    """Candidates of all hosts from SQL alone."""
    register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    return spark.sql(
        "SELECT host, candidate FROM (SELECT DISTINCT lower(split_part(url, '/', 3)) AS host FROM pages), LATERAL typo_candidates(host)"
    )


# Streams


@query
def stream_ingest_by_site(spark, sf):
    """Raw files to site logs, a few files per round."""
    source, out = work_dir(spark, "raw"), work_dir(spark, "sites")
    write_lines(site_log(spark, sf).repartition(8), source)
    stream = jobs.log_stream(spark, source)
    jobs.ingest_by_site(stream, watched_sites(spark), out, work_dir(spark, "progress")).awaitTermination()
    return jobs.read_by_site(spark, out).groupBy("target", "qname", "distance").agg(F.count("*").alias("lookups"))


def _streamed_log(spark: SparkSession, sf: str, reader) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return lookups_from_events(reader.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def _streamed_pairs(spark: SparkSession, sf: str, keep: list[str]) -> DataFrame:
    typos, targets = jobs.split_site_stream(_streamed_log(spark, sf, jobs.state_session(spark).readStream))
    out = work_dir(spark, "pairs")
    jobs.run_to_table(jobs.stream_pairs(typos, targets, keep=keep), out, work_dir(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("target", "net16", "typo", *keep, "typo_ts", "target_ts", "delay_s")


@query
def stream_pairs(spark, sf):
    """Pairs found while the log streams in, cached answers not considered."""
    return _streamed_pairs(spark, sf, ["lookup_id"])


@query
def stream_pairs_visible(spark, sf):
    """Pairs found while the log streams in, those left out that a cached answer hides."""
    out = work_dir(spark, "counts")
    jobs.count_seconds(_streamed_log(spark, sf, spark.readStream), out, work_dir(spark, "progress")).awaitTermination()
    found = _streamed_pairs(spark, sf, ["lookup_id"])
    return jobs.visible_stream_pairs(found, jobs.read_second_counts(spark, out))


@query
def stream_pairs_any_order(spark, sf):
    """Pairs of a log whose files come in no order of time, a few files per round."""
    source, out = work_dir(spark, "rows"), work_dir(spark, "pairs")
    log = site_log(spark, sf).drop("authority", "additional")
    log.repartition(8, "lookup_id").write.parquet(source)
    none = F.array().cast(log.schema["answer"].dataType)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 3).parquet(source).withColumns({"authority": none, "additional": none})
    jobs.pair_rounds(stream, out, work_dir(spark, "progress"), keep=["lookup_id"]).awaitTermination()
    return jobs.read_pair_rounds(spark, out, "lookup_id long")
