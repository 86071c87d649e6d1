"""Sinks, streams and the whole study through files."""

import os

from pyspark.sql import functions as F

from nearname.operators import pairs
from nearname.operators.extract import candidate_lines, observed_candidates
from nearname.operators.seconds import second_counts
from nearname.operators.stats import typo_stats
from nearname.plans.study import build_site_logs, study
from nearname.session import scratch
from nearname.sources import lists, sinks
from nearname.sources.events import SITES, log_lines_from_events, lookups_from_events, popular_sites, watched_sites
from nearname.sources.logs import lookups_of, parse_lines, read_logs, rejects_of
from nearname.streaming import jobs
from tests.test_brute_force import FIXTURE, as_log

EVENTS = "/root/testdata/sf0.001/events.parquet"


def log_of(spark):
    return lookups_from_events(spark.read.parquet(EVENTS))


def as_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lines_by_site(spark, tmp_path):
    log, out = log_of(spark), str(tmp_path / "sites")
    sinks.write_lines_by(log, ["target"], out)
    sinks.write_lines_by(log, ["target"], out)  # append
    assert {p.name for p in (tmp_path / "sites").iterdir() if p.is_dir()} == {f"target={s}." for s in SITES}
    back = read_logs(spark, out, recursive=True, name_glob="*.gz")
    assert as_set(back, "ts", "src_ip", "qname") == sorted(as_set(log, "ts", "src_ip", "qname") * 2)


def test_table_by_pair(spark, tmp_path):
    log = log_of(spark).withColumn("typo", F.col("qname"))
    sinks.write_table_by(log, ["target", "typo"], str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).where((F.col("target") == "google.com.") & (F.col("typo") == "gogle.com."))
    assert back.count() == log.where("target = 'google.com.' AND qname = 'gogle.com.'").count() > 0
    assert "PartitionFilters: [isnotnull(target" in back._jdf.queryExecution().toString()


def test_lists_and_reports(spark, tmp_path):
    log = log_of(spark)
    found = observed_candidates(log, popular_sites(spark))
    lines = candidate_lines(found, per_line=5)
    sinks.split_lists_by_first(lines, str(tmp_path / "lists"))
    back = lists.read_candidates(spark, str(tmp_path / "lists"))
    assert as_set(back.select("target", "candidate"), "target", "candidate") == as_set(found, "target", "candidate")
    stats = spark.createDataFrame([("a.", "b.", 3, 2, 1.5, True)], "a string, b string, c long, d long, e double, f boolean")
    sinks.write_csv(stats, str(tmp_path / "stats"))
    assert tuple(lists.read_typo_stats(spark, str(tmp_path / "stats")).first()) == ("a.", "b.", 3, 2, 1.5, True)
    ratio = spark.createDataFrame([("a.", "b.", 0.5, 1, 2, "yes")], "a string, b string, c double, d long, e long, s string")
    sinks.write_csv(ratio, str(tmp_path / "ratio"))
    assert lists.read_ratios(spark, str(tmp_path / "ratio"), with_status=True).first()["status"] == "yes"


def test_pair_files(spark, tmp_path):
    log = as_log(spark, FIXTURE)
    found = pairs.visible_pairs(log, second_counts(log), records=True)
    sinks.pair_lines(found).write.text(str(tmp_path / "pairs"))
    back = lists.read_pairs(spark, str(tmp_path / "pairs"))
    assert as_set(back, "typo.ts", "target.ts") == [(1000, 1030), (1160, 1200), (1160, 1220)]
    sinks.write_status_pairs(found.withColumn("exists", F.col("delay_s") > 35), str(tmp_path / "status"))
    assert {p.name for p in (tmp_path / "status").iterdir() if p.is_dir()} == {"status=existed", "status=nonexisted"}
    existed = lists.read_status_pairs(spark, str(tmp_path / "status" / "status=existed"))
    assert as_set(existed, "typo_ts", "target_ts") == [(1160, 1200), (1160, 1220)]


def test_sorted_log(spark):
    parts = sinks.sorted_log(log_of(spark), 4, ties=["lookup_id"]).select("ts", F.spark_partition_id().alias("p")).collect()
    assert [r["ts"] for r in parts] == sorted(r["ts"] for r in parts) and len({r["p"] for r in parts}) > 1


def test_stream_ingest_resumes(spark, tmp_path):
    log = log_of(spark)
    raw, out, state = str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = jobs.log_stream(spark, raw, files_per_round=2)
        jobs.ingest_by_site(stream, watched_sites(spark), out, state).awaitTermination()
        return jobs.read_by_site(spark, out).count()

    sinks.write_lines(log.where("ts % 2 = 0").repartition(3), raw)
    first = run()
    assert run() == first  # nothing new
    sinks.write_lines(log.where("ts % 2 = 1").repartition(1), raw, mode="append")
    from nearname.operators.fuzzy import assign_sites

    assert run() == assign_sites(log, watched_sites(spark)).count() > first


def test_stream_pairs_bounds(spark, tmp_path):
    rows = [
        ("s.", "10.1.0.0", "x.", 1000), ("s.", "10.1.0.0", None, 1030), ("s.", "10.1.0.0", None, 1060),
        ("s.", "10.1.0.0", None, 1061), ("s.", "10.2.0.0", None, 1030), ("s.", "10.1.0.0", None, 1000),
    ]
    schema = "target string, net16 string, typo string, ts long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = jobs.stream_pairs(stream.where("typo is not null"), stream.where("typo is null").drop("typo"))
    jobs.run_to_table(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["delay_s"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 30, 60]


def test_streamed_pairs_and_late_answers(spark, tmp_path):
    """Rounds out of order: the answers that hide lookups come last."""
    log = as_log(spark, FIXTURE)
    raw, read = str(tmp_path / "in"), lambda name: spark.read.parquet(str(tmp_path / name))
    early = F.col("lookup_id").isin(2, 4)

    def both():
        site_log = lambda: spark.readStream.schema(log.schema).parquet(raw)
        jobs.count_seconds(site_log(), str(tmp_path / "counts"), str(tmp_path / "s1")).awaitTermination()
        found = jobs.stream_pairs(*jobs.split_site_stream(site_log()))
        jobs.run_to_table(found, str(tmp_path / "pairs"), str(tmp_path / "s2")).awaitTermination()
        counts = jobs.read_second_counts(spark, str(tmp_path / "counts"))
        return jobs.visible_stream_pairs(read("pairs"), counts), counts

    for part in (log.where(~early), log.where(early)):
        part.coalesce(1).write.mode("append").parquet(raw)
        visible, counts = both()
        seen = spark.read.parquet(raw)
        batch = pairs.visible_pairs(seen, second_counts(seen))
        assert as_set(visible, "typo_ts", "target_ts") == as_set(batch, "typo_ts", "target_ts")
        assert counts.exceptAll(second_counts(seen).select(*counts.columns)).isEmpty()
    assert read("pairs").count() > visible.count() > 0


def test_counts_need_no_sections(spark):
    lines = log_lines_from_events(spark.read.parquet(EVENTS))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    fold = "aggregate("
    assert fold in plan(lookups_of(parse_lines(lines)))
    header = parse_lines(lines, sections=False)
    assert fold not in plan(lookups_of(header)) and fold not in plan(rejects_of(header))
    full = parse_lines(lines)
    assert lookups_of(header).exceptAll(lookups_of(full).select(*lookups_of(header).columns)).isEmpty()
    assert lookups_of(header).count() == lookups_of(full).count()
    assert as_set(rejects_of(header), "line", "reason") == as_set(rejects_of(full), "line", "reason")


def test_stats_leave_out_names_never_looked_up_themselves(spark):
    # id, ts, source, name: the look-alike is seen through a deeper name alone.
    rows = [(1, 1000, "10.1.0.5", "a.www.gogle.com.", None), (2, 1030, "10.1.9.9", "google.com.", None)]
    assert typo_stats(second_counts(as_log(spark, rows))).count() == 0
    rows.append((3, 1010, "10.1.0.5", "www.gogle.com.", None))
    assert [r["single_count"] for r in typo_stats(second_counts(as_log(spark, rows))).collect()] == [1]


def test_study_from_raw_files(spark, tmp_path):
    lines = log_lines_from_events(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    lines.select("line").write.option("compression", "gzip").text(str(tmp_path / "raw"))
    held = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(held))
    site_log = build_site_logs(spark, str(tmp_path / "raw"), watched_sites(spark), str(tmp_path / "sites"))
    once = site_log.count()
    again = build_site_logs(spark, str(tmp_path / "raw"), watched_sites(spark), str(tmp_path / "sites"))
    assert again.count() == once > 0
    site_log = again
    with scratch(spark):
        study_results(spark, site_log)
    assert set(os.listdir(held)) == before


def study_results(spark, site_log):
    assert {r["target"] for r in site_log.select("target").distinct().collect()} == {f"{s}." for s in SITES}
    done = study(site_log, popular_sites(spark), order=("ts", "src_ip", "qname", "qtype"), min_ratio=0.02, min_pair_ratio=0.01)
    # A look-alike seen only as the tail of deeper names has no lookups to judge it by.
    assert {r["status"] for r in done.ratios.collect()} >= {"yes", "no"}
    assert {r["exists"] for r in done.summary.collect()} == {True, False}
    assert {r["exists"] for r in done.delays.collect()} == {True, False}
    assert done.stats.where("mean_delay < 0 or mean_delay > 60").count() == 0
