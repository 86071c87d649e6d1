"""Nearest neighbours in a table whose vectors differ in length."""

import random

from pyspark.sql import functions as F

from nearname.llm import ann


def test_each_length_is_searched_among_itself(spark):
    rng = random.Random(2)
    vecs = {i: [rng.gauss(0, 1) for _ in range((3, 4, 5, 2)[i % 4])] for i in range(60)}  # 15 of each: all are near
    vecs |= {60: [1.0] * 9, 61: [], 62: None, 63: [0.0, 0.0], 64: [float("nan"), 1.0], 65: [None, 2.0]}
    frame = spark.createDataFrame([(i, v, "x") for i, v in vecs.items()], "vec_id long, vec array<double>, asks string")
    found = {}
    for r in ann.search(frame, F.col("vec_id") % 20 < 4).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))

    usable = {i: v for i, v in vecs.items() if v and all(x is not None and x == x for x in v) and any(v)}
    for q in (i for i in usable if i % 20 < 4):
        dot = lambda i, q=q: sum(a * b for a, b in zip(usable[q], usable[i]))
        near = sorted((-dot(i), i) for i in usable if i != q and len(usable[i]) == len(usable[q]))[:20]
        rows = found.pop(q, [])
        assert [i for i, _ in rows] == [i for _, i in near] or not near
        assert all(abs(s + d) < 1e-9 for (_, s), (d, _) in zip(rows, near))
    assert not found
