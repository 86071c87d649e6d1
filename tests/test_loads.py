"""Statistics kept load by load against the run over the whole log."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from nearname.functions import timing
from nearname.operators.pairs import visible_pairs
from nearname.operators.seconds import second_counts
from nearname.operators.stats import typo_stats
from nearname.operators.transitions import consecutive_gaps, consecutive_lookups
from nearname.plans.loads import LoadStore
from nearname.session import reliable_checkpoint
from nearname.sources.sinks import write_table_by
from tests.test_brute_force import as_log

BIN = 200


def skewed_log(seed=6, rows=500):
    """Rows of one site mostly, answers that live from a second to far beyond a load."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        name = rng.choice(["gogle.com.", "google.com.", "google.com.", "w.gogle.com.", "goolge.com."])
        ttl = rng.choice([0, 0, 0, 5, 90, 700]) if rng.random() < 0.3 else 0
        src = "10.1.0.5" if i % 3 else rng.choice(["10.2.0.1", "10.3.3.3", "::1"])
        out.append((i, rng.randint(0, 3000), src, name, ttl))
    return out


def found(df):
    return sorted((r["target"], r["typo"], r["single_count"], r["pair_count"], round(r["mean_delay"], 9), r["exists"]) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    return reliable_checkpoint(as_log(spark, skewed_log()))


@pytest.fixture(scope="module")
def whole(log):
    want = found(typo_stats(second_counts(log), bin_s=BIN))
    assert want
    return want


@pytest.mark.parametrize("order", [(2, 0, 1), (1, 2, 0)], ids=str)
def test_loads_in_any_order(spark, log, whole, tmp_path, order):
    store = LoadStore(spark, str(tmp_path / "s"), bin_s=BIN)
    for i in order:
        store.add(log.where((F.col("ts") >= i * 1000) & (F.col("ts") < i * 1000 + (1000 if i < 2 else 9999))), f"part-{i}")
    assert found(store.typo_stats()) == whole


def test_loads_that_overlap_in_time(spark, log, whole, tmp_path):
    store = LoadStore(spark, str(tmp_path / "s"), bin_s=BIN)
    for i in range(3):
        store.add(log.where(F.col("lookup_id") % 3 == i), str(i))
        store.add(log, str(i))  # a load that is in is left as it is
    assert found(store.typo_stats()) == whole
    store.add(log.where("FALSE"), "empty")
    assert found(store.typo_stats()) == whole and len(store.loads()) == 4


def test_killed_load(spark, log, whole, tmp_path):
    store = LoadStore(spark, str(tmp_path / "s"), bin_s=BIN)
    store.add(log.where("ts < 1500"), "a")
    store.add(log.where("ts >= 1500"), "b")
    (tmp_path / "s/changes/load=b/_SUCCESS").unlink()  # as if its last job had not ended
    assert found(store.typo_stats()) == found(typo_stats(second_counts(log.where("ts < 1500")), bin_s=BIN))
    store.add(log.where("ts >= 1500"), "b")
    assert found(store.typo_stats()) == whole


def test_only_borders_are_read(spark, tmp_path):
    """Old seconds out of the new load's reach are damaged; nothing that adds it may notice."""
    rows = [(i, ts, src, name, ttl if ts < 1000 else min(ttl, 90)) for i, ts, src, name, ttl in skewed_log(9, 400)]
    log = reliable_checkpoint(as_log(spark, rows))
    want = found(typo_stats(second_counts(log), bin_s=BIN))
    store = LoadStore(spark, str(tmp_path / "s"), bin_s=BIN)
    store.add(log.where("ts < 2400"), "old")
    damaged = 0
    for folder in (tmp_path / "s/seconds/load=old").glob("bin=*"):
        if int(folder.name[4:]) < 2400 // BIN - 1:
            for file in folder.glob("*.parquet"):
                pathlib.Path(file).write_bytes(b"no parquet")
                damaged += 1
            for sums in folder.glob(".*.crc"):
                sums.unlink()
    assert damaged > 5
    store.add(log.where("ts >= 2400"), "new")
    assert found(store.typo_stats()) == want


def test_buckets_are_pruned_at_run_time(spark, log, tmp_path):
    write_table_by(log.select("lookup_id", "ts", timing.bucket_of(F.col("ts")).alias("bucket")), ["bucket"], str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    stamps = reliable_checkpoint(log.where("lookup_id IN (3, 7)").select("ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = timing.around_stamps(stored, stamps, 0, 3000)
        got = sorted(r["lookup_id"] for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan()
        assert "dynamicpruning" in plan.toString()
        scans = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
        read = [s.metrics().apply("numPartitions").value() for s in scans if s.metrics().contains("numPartitions")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    near = set()
    for ts in [r[0] for r in stamps.collect()]:
        mid = ts - ts % 300 if ts % 300 < 150 else ts - ts % 300 + 300
        near |= {b for b in (mid - 300, mid, mid + 300) if 0 <= b <= 3000}
    rows = [(r["lookup_id"], r["ts"]) for r in log.collect()]
    assert got == sorted(i for i, ts in rows if ts - ts % 300 in near)
    assert read == [len(near)] and len(near) < stored.select("bucket").distinct().count()
    with pytest.raises(ValueError, match="buckets"):
        timing.around_stamps(stored, stamps, 0, 10**9)


def test_consecutive_over_all_sources(spark):
    rows = [(i, 77 if i % 3 else 40 * i, f"10.{i % 4}.0.1", "n.", 0) for i in range(200)]
    got = sorted(tuple(r) for r in consecutive_lookups(as_log(spark, rows), max_gap_s=100, keep=["src_ip"]).collect())
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = [(a[1], a[0], a[2], b[1], b[0], b[2], b[1] - a[1]) for a, b in zip(order, order[1:]) if b[1] - a[1] < 100]
    assert got == sorted(want)


def test_consecutive_rows_of_a_source(spark):
    rows = [(i, 77 if i % 3 else 9 * i, f"10.{i % 2}.0.1", "n.", 0) for i in range(150)]
    got = sorted(tuple(r) for r in consecutive_gaps(as_log(spark, rows), max_gap_s=40).collect())
    want = []
    for src in ("10.0.0.1", "10.1.0.1"):
        order = sorted(r[1] for r in rows if r[2] == src)
        want += [(src, a, b, b - a) for a, b in zip(order, order[1:]) if b - a < 40]
    assert got == sorted(want)


def test_visibility_is_worked_out_once(spark, log):
    plan = visible_pairs(log, reliable_checkpoint(second_counts(log)))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
