"""State of the stream join follows the seconds of the log, and its result the lookups."""

import json
import random
from collections import Counter

import pytest

from nearname.streaming import jobs


def streamed(spark, tmp_path, rows, **options):
    ddl = "target string, net16 string, ts long, typo string, note array<string>"
    for i, part in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.state_session(spark, 2).readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = jobs.stream_pairs(stream.where("typo is not null"), stream.where("typo is null").drop("typo"), keep=["note"], **options)
    query = jobs.run_to_table(found, str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    got = Counter((r["target"], r["net16"], r["typo"], tuple(r["note"] or ()), r["typo_ts"], r["target_ts"], r["delay_s"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    return got, [json.loads(p.json) for p in query.recentProgress]


def wanted(rows, window=60):
    typos, targets = [r for r in rows if r[3]], [r for r in rows if not r[3]]
    return Counter(
        (a[0], a[1], a[3], tuple(a[4] or ()), a[2], b[2], b[2] - a[2])
        for a in typos for b in targets
        if None not in a[:3] and a[:2] == b[:2] and b[2] is not None and 0 <= b[2] - a[2] <= window
    )


def busy(rows=600):
    rng = random.Random(4)
    kinds = [("a.", ["x", None]), ("b.", []), ("a.", None), (None, None), (None, None)]
    out = []
    for _ in range(rows):
        typo, note = rng.choice(kinds)
        target = None if rng.random() < 0.02 else rng.choice(["s.", "t."])
        net = None if rng.random() < 0.02 else rng.choice(["10.1.0.0", "10.2.0.0"])
        out.append((target, net, None if rng.random() < 0.02 else 10_000 + rng.randint(-3, 4) * 40, typo, note))
    return out


@pytest.mark.parametrize("options", [{}, {"pieces": 3}, {"lateness": "1 hour"}], ids=str)
def test_pairs_of_busy_seconds(spark, tmp_path, monkeypatch, options):
    monkeypatch.setattr(jobs, "GATHER_BYTES", 4_000)
    rows = busy()
    got, _ = streamed(spark, tmp_path, rows, **options)
    assert got == wanted(rows) and max(got.values()) > 10


def test_state_holds_seconds(spark, tmp_path):
    rows = [("s.", "10.1.0.0", 100 + i % 2, "a." if i % 4 < 2 else None, None) for i in range(400)]
    got, progress = streamed(spark, tmp_path, rows)
    assert got == wanted(rows) and sum(got.values()) == 100 * 100 * 3
    held = sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"])
    assert held <= 16  # two seconds of two sides, look-alikes in up to two bins, two rounds
