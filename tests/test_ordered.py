"""One order over all rows, held against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from nearname.operators.ordered import ordered_parts, with_next, with_place

SCHEMA = "ts long, id long, name string"


@pytest.fixture(scope="module", params=["spread", "hot second", "few", "nulls", "none"])
def rows(request):
    rng = random.Random(5)
    if request.param == "spread":
        return [(rng.randint(0, 10**6), i, f"n{i % 7}") for i in range(500)]
    if request.param == "hot second":
        return [(77 if i % 3 else rng.randint(0, 150), i, None if i % 5 == 0 else "x") for i in range(600)]
    if request.param == "few":  # fewer rows than ranges: some are empty
        return [(5, 1, "a"), (5, 2, None), (900, 3, "c")]
    if request.param == "nulls":
        return [(None if i % 4 == 0 else i, i, None) for i in range(60)]
    return []


def by_time(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_next(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["id"]: (r["next_ts"], r["next_id"], r["next_name"]) for r in with_next(df, ["ts", "id", "name"], "ts", "id").collect()}
    want = by_time(rows)
    assert got == {r[1]: after for r, after in zip(want, [*want[1:], (None, None, None)])}


def test_place(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["id"]: r["place"] for r in with_place(df, "ts", "id").collect()}
    assert got == {r[1]: i for i, r in enumerate(by_time(rows), 1)}
    down = with_place(df, F.col("id").desc(), name="nr").collect()
    assert [r["id"] for r in sorted(down, key=lambda r: r["nr"])] == sorted((r[1] for r in rows), reverse=True)


def test_hot_second_is_spread(spark):
    rows = [(77, i, "x") for i in range(4000)]
    parts = ordered_parts(spark.createDataFrame(rows, SCHEMA).repartition(8), "ts", "id").groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2500
