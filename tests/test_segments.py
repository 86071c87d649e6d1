"""Joins on name segments against brute force."""

from __future__ import annotations

import itertools
import random
import string

import pytest
from pyspark.sql import functions as F

from nearname.functions.keyboard import qwerty_edges
from nearname.operators import segments
from nearname.operators.skew import hot_keys
from tests.test_brute_force import py_osa


def near(rng, name, edits):
    """A name some edits away, swaps of neighbours among them."""
    for _ in range(edits):
        i = rng.randrange(len(name) + 1)
        kind = rng.choice("ids" + "w" * 3)
        if kind == "i":
            name = name[:i] + rng.choice("abc.") + name[i:]
        elif kind == "d":
            name = name[:i] + name[i + 1 :]
        elif kind == "s":
            name = name[:i] + rng.choice("abc.") + name[i + 1 :]
        else:
            name = name[: max(i - 2, 0)] + name[max(i - 2, 0) : i][::-1] + name[i:]
    return name


def table(spark, names, column):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_segments_are_apart_and_inside(spark, radius):
    sizes = spark.range(segments.shortest_cut(radius), 40).select(F.col("id").cast("int").alias("n"))
    start, length = segments.segment(F.col("n"), F.col("i"), radius)
    cut = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(radius)))).select("n", "i", start.alias("s"), length.alias("l"))
    for n, rows in itertools.groupby(sorted(map(tuple, cut.collect())), key=lambda r: r[0]):
        spans = [(s, s + size) for _, _, s, size in rows]
        assert len(spans) == radius + 1 and spans[0][0] == 0 and spans[-1][1] == n
        assert all(e > s for s, e in spans) and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize(
    "k, most, max_broadcast, split_rows", [(1, 64, 1_000_000, 20_000), (2, 2, 0, 5), (2, 0, 1_000_000, 20_000), (3, 64, 1_000_000, 20_000)]
)
def test_pairs_equal_brute_force(spark, k, most, max_broadcast, split_rows):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc.") for _ in range(rng.randint(0, 16))) for _ in range(40)]
    words = sorted({near(rng, w, e) + rng.choice(["", ".com"]) for w in base for e in (0, 1, 2, 3)} | {"", "a"})
    some = words[::2]
    want = {(x, y, d) for x in words for y in some if (d := py_osa(x, y)) <= k}
    got = segments.segment_pairs(
        table(spark, [*words, *words[:9], None], "x"), table(spark, [*some, None], "y"), "x", "y", k,
        most=most, max_broadcast=max_broadcast, split_rows=split_rows,
    ).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_equal_columns_and_empty_tables(spark):
    rows = [("u", "example.com"), ("v", "exmaple.com"), ("u", "exmaple.com")]
    left = spark.createDataFrame(rows, "g string, x string")
    right = left.withColumnRenamed("x", "y")
    got = segments.segment_pairs(left, right, "x", "y", 1, on=["g"])
    assert {tuple(r) for r in got.where("distance > 0").collect()} == {
        ("u", "example.com", "exmaple.com", 1), ("u", "exmaple.com", "example.com", 1),
    }
    assert segments.segment_pairs(left, right.limit(0), "x", "y", 1, on=["g"]).isEmpty()
    assert segments.segment_pairs(left.limit(0), right, "x", "y", 1, on=["g"]).isEmpty()


def keyboard_distance(a, b, edges):
    d = [[float(i + j) if not i or not j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            c = 0.0 if a[i - 1] == b[j - 1] else 0.5 if (a[i - 1], b[j - 1]) in edges else 1.0
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + c)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + c)
    return d[-1][-1]


def test_two_letter_names_of_one_domain(spark):
    """Names that share one deletion key are cut into a grid, and all pairs are right."""
    signs = string.ascii_lowercase + string.digits
    names = [x + y + ".com" for x in signs for y in signs]
    assert len(names) == 1296
    keys = segments.deletion_keys(table(spark, names, "x"), "x", 3)
    cut = {r["pieces"] for r in hot_keys(keys.distinct().groupBy("_key").count(), ["_key"], 100).collect()}
    assert max(cut) == 13  # one key holds them all
    probe = names[::37]
    pairs = segments.segment_pairs(table(spark, probe, "x"), table(spark, names, "y"), "x", "y", 1.5, keyboard=True, split_rows=100)
    edges = set(qwerty_edges())
    # The common end cannot make the distance larger, nor can it make it smaller than the plain one.
    want = {(x, y, d) for x in probe for y in names if (d := keyboard_distance(x, y, edges)) <= 1.5}
    got = pairs.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
