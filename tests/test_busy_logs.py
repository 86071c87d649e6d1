"""Steps whose work must follow the lookups of a busy log, not its pairs or its stray names."""

from pyspark.sql import functions as F

from nearname.operators import pairs
from nearname.operators.seconds import second_counts
from nearname.sources import lists, sinks
from nearname.streaming import jobs
from tests.test_brute_force import FIXTURE, SITE, as_log


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distance_only_of_near_names(spark, monkeypatch):
    """The interpreted distance is not reached by names far from their site."""
    asked = []
    monkeypatch.setattr(pairs, "osa", lambda a, b: asked.append(1) or F.when(F.length(a) > 12, F.raise_error(F.lit("far")).cast("int")).otherwise(F.levenshtein(a, b)))
    rows = [(1, 1000, "10.1.0.5", "gogle.com.", None), (2, 1030, "10.9.0.1", SITE, None), (3, 1010, "10.1.0.5", "a.far.example.net.", None)]
    found = pairs.near_pairs(as_log(spark, rows)).collect()
    assert asked and [(r["typo_id"], r["target_id"], r["delay_s"]) for r in found] == [(1, 2, 30)]


def test_swapped_letters_are_near(spark):
    """Two edits of the built-in distance, one of the study's."""
    rows = [(1, 1000, "10.1.0.5", "ogogle.com.", None), (2, 1059, "10.9.0.1", SITE, None), (3, 1000, "10.1.0.5", "ogoglee.com.", None)]
    assert [r["typo_id"] for r in pairs.near_pairs(as_log(spark, rows)).collect()] == [1]


def test_text_is_made_below_the_join(spark):
    log = as_log(spark, FIXTURE)
    for made in (pairs.near_pairs, pairs.visible_pairs):
        lines = sinks.pair_lines(made(log, lines=True))
        top = plan_of(lines).split("Join")[0]
        assert "transform" not in top and "transform" in plan_of(lines)
        assert sorted(lines.collect()) == sorted(sinks.pair_lines(made(log, records=True)).collect()) != []


def test_status_pairs_are_not_gathered(spark, tmp_path):
    """Both folders come from the tasks that make the pairs, compressed; an unknown status is none."""
    rows = [("a.", 1, "s.", 2, "10.1.0.0", e) for e in (True, False, None)]
    found = spark.createDataFrame(rows, "typo string, typo_ts long, target string, target_ts long, net16 string, exists boolean")
    sinks.write_status_pairs(found.repartition(3), str(tmp_path / "s"))
    read = lambda s: lists.read_status_pairs(spark, str(tmp_path / "s" / f"status={s}")).count()
    assert (read("existed"), read("nonexisted")) == (1, 2)
    files = [p.name for p in (tmp_path / "s").rglob("part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    sinks.write_status_pairs(found.where("exists"), str(tmp_path / "s"))
    assert (read("existed"), read("nonexisted")) == (1, 0)


def test_hidden_seconds_meet_pairs_without_a_shuffle(spark):
    rows = [*FIXTURE, (11, -100, "10.1.0.5", "gogle.com.", None), (12, -70, "10.1.0.5", SITE, 40), (13, -65, "10.1.0.5", "gogle.com.", None), (14, -30, "10.1.0.5", SITE, None)]
    log = as_log(spark, rows)
    counts = second_counts(log)
    keyed = jobs.with_keys(log).where("net16 IS NOT NULL")
    typos = keyed.where("suffix <> target").select("target", "net16", F.col("ts").alias("typo_ts"))
    targets = keyed.where("suffix = target").select("target", "net16", F.col("ts").alias("target_ts"))
    seen = jobs.visible_stream_pairs(pairs.pair_rows(typos, targets, ["target", "net16"], 0, 60), counts)
    want = pairs.visible_pairs(log, counts).select("typo_ts", "target_ts").collect()
    assert sorted(seen.select("typo_ts", "target_ts").collect()) == sorted(want) and (-100, -70) in [tuple(r) for r in want]
    all_pairs = spark.range(10).selectExpr("'s.' AS target", "'10.1.0.0' AS net16", "id AS typo_ts", "id AS target_ts")
    physical = jobs.visible_stream_pairs(all_pairs, counts)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in physical
