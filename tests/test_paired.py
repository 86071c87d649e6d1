"""Pairs from bucketed tables against pairs from the log."""

import random
import uuid

import pytest

from nearname.operators import paired, pairs
from nearname.operators.seconds import second_counts
from tests.test_brute_force import SITE, as_log

WANTED = ["typo_id", "target_id", "delay_s"]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(*WANTED).collect())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        hot = rng.random() < 0.5
        name = rng.choice([SITE, "gogle.com.", "googel.com."])
        ttl = rng.randint(1, 20) if name == SITE and rng.random() < 0.1 else None
        rows.append((i, 5000 + rng.randint(0, 5 if hot else 900), f"10.{1 if hot else rng.randint(2, 4)}.0.1", name, ttl))
    return as_log(spark, rows).cache()


def store(log, tmp_path, **more):
    return paired.write_pair_store(log, f"t_{uuid.uuid4().hex}", str(tmp_path), **more)


@pytest.mark.parametrize("split_rows", [1_000_000, 7])
def test_equal_to_the_pairs_of_the_log(spark, log, tmp_path, split_rows):
    kept = store(log, tmp_path, split_rows=split_rows)
    want = rows_of(pairs.visible_pairs(log, second_counts(log)))
    assert want and rows_of(kept.pairs(spark)) == want
    part = [r for r in want if 3 <= r[2] <= 20]
    assert rows_of(kept.pairs(spark, 3, 20)) == part
    pieces = spark.table(kept.typos).select("piece").distinct().count()
    assert (pieces > 1) == (split_rows == 7)
    with pytest.raises(ValueError):
        kept.pairs(spark, 0, 61)
    kept.drop(spark)


def test_no_exchange_and_a_bin_in_pieces_is_spread(spark, log, tmp_path):
    kept = store(log, tmp_path, split_rows=7)
    plan = plan_of(kept.pairs(spark))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Broadcast" not in plan
    buckets = spark.table(kept.typos).selectExpr("input_file_name()").distinct().count()
    assert buckets == paired.BUCKETS
    kept.drop(spark)


def test_empty_log(spark, log, tmp_path):
    kept = store(log.limit(0), tmp_path)
    assert kept.pairs(spark).count() == 0
    kept.drop(spark)
