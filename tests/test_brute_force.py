"""Fast forms against their definitions on random data with one dominant key."""

import random

import pytest
from pyspark.sql import functions as F

from nearname.operators import cache, fuzzy, pairs, skew, stats, transitions
from nearname.operators.cluster import assign, cluster_means, kmeans, merged_mean
from nearname.operators.existence import exists_by_rules
from nearname.operators.seconds import running_fold, second_counts
from nearname.schema import LOOKUP

SITE = "google.com."
LOG = "lookup_id long, ts long, src_ip string, qname string, ttl long, target string"


def as_log(spark, rows):
    """(id, ts, src, qname, ttl) rows as a site log; a TTL makes an address record."""
    frame = spark.createDataFrame([(*r, SITE) for r in rows], LOG)
    rr = F.struct(
        F.col("qname").alias("owner"), F.col("ttl").cast("string").alias("ttl"), F.lit("IN").alias("rclass"),
        F.lit("A").alias("rtype"), F.lit("1.1.1.1").alias("rdata"),
    )
    none = F.array().cast(LOOKUP["answer"].dataType)
    return frame.select(
        "lookup_id", "ts", F.lit(0).alias("typ"), "src_ip", F.lit("d").alias("dst_ip"), "qname", F.lit(1).alias("qtype"),
        F.lit(0).alias("rcode"), F.when(F.col("ttl").isNotNull(), F.array(rr)).otherwise(none).alias("answer"),
        none.alias("authority"), none.alias("additional"), "target",
    )


FIXTURE = [
    (1, 1000, "10.1.0.5", "gogle.com.", None),
    (2, 1030, "10.1.9.9", SITE, 100),
    (3, 1050, "10.1.0.5", "gogle.com.", None),
    (4, 1060, "10.1.7.7", SITE, 100),
    (5, 1130, "10.1.0.6", "gogle.com.", None),
    (6, 1160, "10.1.0.6", "gogle.com.", None),
    (7, 1200, "10.1.2.2", SITE, None),
    (8, 1220, "10.1.2.2", SITE, 30),
    (9, 1221, "10.2.0.1", "gogle.com.", None),
    (10, 1160, "::1", "gogle.com.", None),
]


def test_fixture(spark):
    log = as_log(spark, FIXTURE)
    counts = second_counts(log)
    assert {r["lookup_id"] for r in cache.hidden_lookups(log, counts).collect()} == {3, 4, 5}
    v1 = pairs.visible_pairs(log, counts).collect()
    assert {(r["typo_id"], r["target_id"], r["delay_s"]) for r in v1} == {(1, 2, 30), (6, 7, 40), (6, 8, 60)}
    popular = spark.createDataFrame([(1, SITE)], "rank int, site string")
    ratio = stats.pair_ratios(counts, popular).first()
    assert (ratio["join_count"], ratio["single_count"], ratio["ratio"]) == (3, 6, 0.5)
    listed = spark.createDataFrame([(SITE, "gogle.com.", True)], "target string, typo string, exists boolean")
    v3 = pairs.status_pairs(log, listed).collect()
    assert {(r["typo_id"], r["target_id"]) for r in v3} == {(1, 2), (1, 4), (3, 4), (6, 7), (6, 8)}
    done = stats.typo_stats(counts).first()
    assert (done["single_count"], done["pair_count"], round(done["mean_delay"], 3), done["exists"]) == (6, 3, 43.333, False)


@pytest.fixture(scope="module")
def random_log(spark):
    rng = random.Random(7)
    names = [SITE, SITE, "gogle.com.", "googel.com.", "w.google.com."]
    rows = []
    for i in range(500):
        src = "10.1.0.1" if rng.random() < 0.6 else f"10.{rng.randint(2, 4)}.0.{rng.randint(1, 2)}"
        name = rng.choice(names)
        ttl = rng.randint(1, 40) if name == SITE and rng.random() < 0.4 else None
        rows.append((i, 100_000 + rng.randint(0, 3000), src, name, ttl))
    return rows, as_log(spark, rows).cache()


def net(ip):
    return ".".join(ip.split(".")[:2])


def hidden_ids(rows):
    answers = [r for r in rows if r[3] == SITE and r[4]]
    return {r[0] for r in rows if any(net(a[2]) == net(r[2]) and a[1] < r[1] < a[1] + a[4] for a in answers)}


@pytest.mark.parametrize("bin_s", [7, 3600])
def test_cache_and_pairs(spark, random_log, bin_s):
    rows, log = random_log
    counts = second_counts(log)
    hidden = hidden_ids(rows)
    assert {r["lookup_id"] for r in cache.hidden_lookups(log, counts, bin_s).collect()} == hidden
    seen = [r for r in rows if r[0] not in hidden]
    want = {
        (a[0], b[0])
        for a in seen for b in seen
        if a[3] != SITE and b[3] == SITE and net(a[2]) == net(b[2]) and 0 <= b[1] - a[1] <= 60
    }
    # A split limit of 3 rows cuts every busy bin into pieces.
    got = pairs.visible_pairs(log, counts, split_rows=3, bin_s=bin_s).select("typo_id", "target_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    totals = stats.pair_totals(cache.visible_counts(counts, bin_s), 0, 60, bin_s).collect()
    by_id = {r[0]: r for r in rows}
    for name in {r["typo"] for r in totals}:
        mine = [(a, b) for a, b in want if by_id[a][3] == name]
        row = next(r for r in totals if r["typo"] == name)
        assert row["pair_count"] == len(mine)
        assert row["delay_sum"] == sum(by_id[b][1] - by_id[a][1] for a, b in mine)


def test_near_pairs(spark, random_log):
    rows, log = random_log
    want = {
        (a[0], b[0])
        for a in rows for b in rows
        if a[3] in ("gogle.com.", "googel.com.") and b[3] == SITE and 0 <= b[1] - a[1] < 60
    }
    got = pairs.near_pairs(log, split_rows=5).select("typo_id", "target_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("split_rows", [3, 50_000])
def test_transitions(spark, random_log, split_rows):
    rows, log = random_log
    seconds = transitions.near_name_seconds(log)
    for low, high in ((1, 59), (-59, -1)):
        want = {}
        for b in rows:
            for a in {r[3] for r in rows if r[2] == b[2] and r[3] != b[3] and low <= b[1] - r[1] <= high}:
                want[(a, b[3])] = want.get((a, b[3]), 0) + 1
        got = {(r["a"], r["b"]): r["n"] for r in transitions.covered_counts(seconds, low, high, split_rows).collect()}
        assert got == want


def test_consecutive(spark, random_log):
    rows, log = random_log
    want = []
    for src in {r[2] for r in rows}:
        times = sorted(r[1] for r in rows if r[2] == src)
        want += [(src, a, b, b - a) for a, b in zip(times, times[1:]) if b - a < 20]
    got = [tuple(r) for r in transitions.consecutive_gaps(log, 20).collect()]
    assert sorted(got) == sorted(want)


def test_swapped_tld(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        name = rng.choice(["shop.ocm.", "shop.com."])
        ttl = rng.randint(0, 60) if name == "shop.com." and rng.random() < 0.7 else None
        rows.append((i, rng.randint(1000, 1800), rng.choice(["10.1.0.1", "10.2.0.1"]), name, ttl))
    for same in (False, True):
        got = stats.swapped_tld_check(as_log(spark, rows), same_source=same, bin_s=50).collect()
        assert len(got) == sum(r[3] == "shop.ocm." for r in rows)
        for g in got:
            others = [r for r in rows if r[3] == "shop.com." and (not same or r[2] == g["src_ip"])]
            answered = [r for r in others if r[4] is not None]
            assert g["expired_before"] == sum(r[1] + r[4] < g["ts"] for r in answered)
            assert g["cached_at"] == sum(r[1] <= g["ts"] < r[1] + r[4] for r in answered)
            assert g["followed"] == sum(g["ts"] < r[1] < g["ts"] + 60 for r in others)


def py_osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            c = a[i - 1] != b[j - 1]
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + c)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + c)
    return d[-1][-1]


@pytest.mark.parametrize("max_broadcast", [0, 1_000_000])
def test_fuzzy_blocking(spark, max_broadcast):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abc.") for _ in range(rng.randint(1, 8))) for _ in range(150)})
    left = spark.createDataFrame([(w,) for w in words], "x string")
    right = spark.createDataFrame([(w,) for w in words[::3]], "y string")
    for k in (1, 2):
        want = {(x, y, d) for x in words for y in words[::3] if (d := py_osa(x, y)) <= k}
        got = fuzzy.fuzzy_pairs(left, right, "x", "y", k, max_broadcast=max_broadcast).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_salted_join(spark):
    big = spark.range(3000).select((F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50)).alias("k"), F.col("id").alias("v"))
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = {tuple(r) for r in big.join(small, "k").select("k", "v", "w").collect()}
    salted = skew.salted_join(big, small, ["k"], split_rows=100).select("k", "v", "w").collect()
    assert len(salted) == 3000 and {tuple(r) for r in salted} == plain
    assert [tuple(r) for r in skew.hot_keys(big.groupBy("k").count(), ["k"], 100).collect()] == [(0, 11)]
    both = skew.salted_join(big, big.withColumnRenamed("v", "u"), ["k"], split_rows=300).groupBy("k").count()
    assert {r["k"]: r["count"] for r in both.collect()} == {r["k"]: r["count"] ** 2 for r in big.groupBy("k").count().collect()}


def test_running_fold(spark):
    rng = random.Random(5)
    points = [(rng.randint(0, 1), rng.randint(-50, 400), rng.randint(1, 9)) for _ in range(80)]
    probes = [(k, t) for k in (0, 1, 2) for t in range(-60, 420, 7)]
    p = spark.createDataFrame(points, "k int, at long, x long").groupBy("k", "at").agg(F.sum("x").alias("x"))
    q = spark.createDataFrame(probes, "k int, at long")
    got = {(r["k"], r["at"]): r["x"] for r in running_fold(p, q, ["k"], {"x": "sum"}, bin_s=16).collect()}
    assert got == {(k, t): sum(x for a, s, x in points if a == k and s <= t) or None for k, t in probes}


def test_existence_rules(spark):
    empty = []
    reg, other = "a.gtld-servers.net.", "ns.other.net."

    def rr(owner, kind, data):
        return (owner, "60", "IN", kind, data)

    cases = {  # name: lookups in order as (answer, authority), expected
        "nothing": ([(empty, empty)], False),
        "address": ([(empty, [rr("z.", "NS", other)]), ([rr("address", "A", "1.1.1.1")], empty)], True),
        "foreign": ([([rr("else", "A", "1.1.1.1")], [rr("z.", "NS", reg)])], False),
        "mail": ([([rr("q", "MX", "10 mail.q")], empty)], True),
        "mail_reg": ([([rr("q", "MX", f"10 {reg}")], [rr("z.", "NS", reg)])], False),
        "soa": ([(empty, [rr("com.", "SOA", f"{reg};x;1")])], False),
        "soa_first": ([(empty, [rr("com.", "SOA", f"{reg};x;1"), rr("q", "MX", "10 m")])], False),
        "mx_first": ([(empty, [rr("q", "MX", "10 m"), rr("com.", "SOA", f"{reg};x;1")])], True),
        "votes": ([(empty, [rr("z.", "NS", reg), rr("z.", "NS", other)])] * 2 + [(empty, [rr("z.", "NS", other)])], False),
        "tie": ([(empty, [rr("z.", "NS", reg)]), (empty, [rr("z.", "NS", other)])], True),
        "late": ([(empty, [rr("z.", "NS", other)])] * 20 + [(empty, empty)], True),
    }
    rows = [
        ("s.", name, i, i, answer, authority, [])
        for name, (lookups, _) in cases.items()
        for i, (answer, authority) in enumerate(lookups)
    ]
    record = "array<struct<owner:string,ttl:string,rclass:string,rtype:string,rdata:string>>"
    schema = f"target string, typo string, ts long, lookup_id long, answer {record}, authority {record}, additional {record}"
    got = {r["typo"]: r["exists"] for r in exists_by_rules(spark.createDataFrame(rows, schema)).collect()}
    assert got == {name: want for name, (_, want) in cases.items()}


def test_kmeans(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(10 * (i % 3), 0.1), rng.gauss(0, 0.1)]) for i in range(90)]
    points = spark.createDataFrame(rows, "name long, vec array<double>")
    starts = [[0.5, 0.0], [9.0, 1.0], [21.0, 0.0], [500.0, 500.0]]  # the last one gets no members
    centres, passes = kmeans(points, centres=starts)
    assert passes <= 5 and centres[3] == [500.0, 500.0]
    assert [round(c[0]) for c in centres[:3]] == [0, 10, 20]
    assert assign(points, centres).groupBy("cluster").count().count() == 3
    sizes = {r["cluster"]: r["size"] for r in cluster_means(points, centres).collect()}
    assert sizes == {0: 30, 1: 30, 2: 30}
    parts = spark.createDataFrame([("k", 1.0, 1), ("k", 4.0, 2)], "k string, mean double, count long")
    assert merged_mean(parts, ["k"]).first()["mean"] == 3.0
