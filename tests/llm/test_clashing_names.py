"""Input columns named like helpers or outputs keep their values, and nothing else changes."""

import random

import pytest
from pyspark.sql import functions as F

from nearname.llm import exact_dedup, mixing, packing, sharding

HELPERS = "_h _cell _k _b _n _s _n0 _s0 _key _p _low _high _slot _whole _rest _flow _bucket place before c0 c1 c2 c3".split()
OUTPUTS = "shard home_shard Slot pattern taken credited bucket bucket_length batch padding".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    made = [(i, rng.randint(0, 90), rng.choice([["a"], ["b"], ["a", "b"], [None], []])) for i in range(400)]
    return spark.createDataFrame(made, "id long, size long, of array<string>").cache()


def clashing(rows):
    return rows.select("*", *[F.concat(F.lit(f"{n} of "), F.col("id")).alias(n) for n in HELPERS + OUTPUTS])


@pytest.mark.parametrize(
    "run",
    [
        lambda r: sharding.assign_shards(r, ["id"], "size", 5),
        lambda r: sharding.assign_shards(r, ["id"], "size", 5, by="bytes"),
        lambda r: packing.pack(r, "size", ["id"], 4, 200),
        lambda r: mixing.mix(r, "of", "size", ["id"]),
    ],
    ids=["rows", "bytes", "pack", "mix"],
)
def test_columns_of_any_name_stay(rows, run):
    plain, loaded = run(rows), run(clashing(rows))
    carried = len(rows.columns)
    added = plain.columns[carried:]
    assert added and loaded.columns[: carried + len(HELPERS + OUTPUTS)] == [*rows.columns, *HELPERS, *OUTPUTS]
    assert loaded.columns[-len(added) :] == [n + "_" for n in added]
    want = {r["id"]: r for r in plain.collect()}
    got = loaded.collect()
    assert len(got) == len(want) == 400
    for r in got:
        assert all(r[n] == f"{n} of {r['id']}" for n in HELPERS + OUTPUTS)
        assert tuple(r[-len(added) :]) == tuple(want[r["id"]][carried:])


def test_row_kept_of_copies_of_one_identifier(spark):
    """Rows alike in identifier and text differ elsewhere: the same one stays in any order."""
    made = [(1, "same  text", s, m) for s in ("u", "v", None) for m in ({"k": "1"}, {"k": "2"}, None)] + [(2, "same text", "w", None), (3, None, "x", None)]
    kept = set()
    for seed in range(4):
        random.Random(seed).shuffle(made)
        docs = spark.createDataFrame(made, "doc_id long, text string, source string, _whole map<string, string>").repartition(seed + 1)
        got = exact_dedup.drop_copies(docs).orderBy("doc_id")
        assert got.columns == docs.columns
        kept.add(str(got.collect()))
        assert [r["doc_id"] for r in got.collect()] == [1, 3]
    assert len(kept) == 1
