"""The bit filter of names, and streamed pairs whose rows come in any order."""

import random

import pytest
from pyspark.sql import functions as F

from nearname.operators import candidates as C
from nearname.operators.pairs import pair_rows
from nearname.operators.seconds import GROUP, with_keys
from nearname.session import reliable_checkpoint
from nearname.streaming import jobs
from tests.test_brute_force import as_log


def test_filter_loses_no_name_and_merges(spark):
    names = spark.range(3000).select(F.concat(F.lit("n"), "id", F.lit(".com.")).alias("qname"))
    other = spark.range(3000, 6000).select(F.concat(F.lit("n"), "id", F.lit(".com.")).alias("qname"))
    parts = [C.name_filter(names), C.name_filter(other)]
    both = reliable_checkpoint(C.merge_filters(*parts))
    every = names.unionByName(other)
    assert C.maybe_in(every, both, "qname").count() == 6000
    strangers = spark.range(100_000).select(F.concat(F.lit("s"), "id", F.lit(".net.")).alias("x"), F.lit(1).alias("bits"))
    assert C.maybe_in(strangers.select("x"), both, "x").count() < 100
    assert both.count() <= C.PAGES and C.maybe_in(names, C.name_filter(names.where("FALSE")), "qname").isEmpty()
    few = reliable_checkpoint(C.name_filter(every, pages=1))  # a full filter lets all pass, and loses none
    assert C.maybe_in(every, few, "qname", pages=1).count() == 6000


def test_candidates_are_left_out_before_the_shuffle(spark):
    log = as_log(spark, [(i, i, "10.1.0.1", "gogle.com." if i % 2 else "google.com.", None) for i in range(50)])
    sites = spark.createDataFrame([("google.com.",), ("wikipedia.org.",), ("bbc.co.uk.",)], "site string")
    got = C.observed_candidate_hits(sites, log)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in C.candidate_hits(C.typo_candidates(sites), log).collect()] != []
    seen = log.groupBy(F.col("qname").alias("candidate")).count()
    kept = C.maybe_in(C.typo_candidates(sites), reliable_checkpoint(C.name_filter(seen, "candidate")), "candidate")
    assert kept.count() <= 3 < 1000 < C.typo_candidates(sites).count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Generate")]  # what stands above the candidates
    assert "BroadcastHashJoin" in after and "hashpartitioning(candidate" not in after


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    names = ["google.com.", "gogle.com.", "googel.com."]
    return [(i, rng.randint(0, 9000), "10.1.0.1" if i % 3 else f"10.{i % 4}.0.1", rng.choice(names), None) for i in range(400)] + [(999, 50, "::1", names[1], None)]


def expected(log):
    keyed = with_keys(log).where("net16 IS NOT NULL")
    typos = keyed.where("suffix <> target").select(*GROUP, F.col("suffix").alias("typo"), "lookup_id", F.col("ts").alias("typo_ts"))
    targets = keyed.where("suffix = target").select(*GROUP, F.col("ts").alias("target_ts"))
    return as_rows(pair_rows(typos, targets, GROUP, 0, 60))


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*GROUP, "typo", "lookup_id", "typo_ts", "target_ts").collect())


def run(spark, folder, schema, out, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.pair_rounds(stream, out, checkpoint, bin_s=600, keep=["lookup_id"]).awaitTermination()


def write_rounds(spark, rows, folder, rounds, key):
    for i in range(rounds):
        as_log(spark, [r for r in rows if key(r) == i]).coalesce(1).write.mode("append").parquet(folder)
    return as_log(spark, rows)


def test_rows_in_any_order(spark, rows, tmp_path, monkeypatch):
    log = write_rounds(spark, rows, str(tmp_path / "in"), 5, lambda r: r[0] % 5)
    want = expected(log)
    assert len(want) > 30
    real, calls = jobs.pair_rows, []

    def dies_once(*args):  # in the third round, after its rows are written
        calls.append(1)
        if len(calls) == 5:
            raise RuntimeError("killed")
        return real(*args)

    monkeypatch.setattr(jobs, "pair_rows", dies_once)
    with pytest.raises(Exception, match="killed"):
        run(spark, str(tmp_path / "in"), log.schema, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert len(jobs.committed(spark, str(tmp_path / "out/pairs"))) == 2
    run(spark, str(tmp_path / "in"), log.schema, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert as_rows(jobs.read_pair_rounds(spark, str(tmp_path / "out"), "lookup_id long")) == want


def test_held_rows_stay_flat(spark, rows, tmp_path, monkeypatch):
    """Twenty rounds that follow one another in time: the earlier rows a round reads do not grow."""
    log = write_rounds(spark, rows, str(tmp_path / "in"), 20, lambda r: r[1] * 20 // 9001)
    read, real = [], jobs.reliable_checkpoint
    monkeypatch.setattr(jobs, "reliable_checkpoint", lambda df: read.append(real(df)) or read[-1])
    monkeypatch.setattr(jobs, "scratch", lambda spark: __import__("contextlib").nullcontext())
    run(spark, str(tmp_path / "in"), log.schema, str(tmp_path / "out"), str(tmp_path / "progress"))
    sizes = [df.count() for df in read]
    assert len(sizes) == 20 and max(sizes[10:]) <= 2 * max(sizes[2:10]) and max(sizes) < 120
    assert as_rows(jobs.read_pair_rounds(spark, str(tmp_path / "out"), "lookup_id long")) == expected(log)
