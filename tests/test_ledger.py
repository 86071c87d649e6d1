"""Manifest ingest: what a failed round leaves, what a second run does, odd file names."""

import gzip

import pytest
from pyspark.sql import functions as F

from nearname.sources import ledger as L

GOOD = "1306627003,0,208.67.219.13,184.82.51.169,www3.greatmarchblog.net.,1,5,0,0,0"
BAD = "x,0,1.2.3.4,5.6.7.8,name.,1,5,0,0,0"


def put(folder, name, lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    data = "".join(line + "\n" for line in lines).encode()
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return path


@pytest.fixture
def files(tmp_path):
    raw = tmp_path / "raw"
    return {
        put(raw, "a/one.gz", [GOOD] * 3 + [BAD]): (3, 1),
        put(raw, "a/two words+plus%41.txt", [GOOD]): (1, 0),
        put(raw, "a/[b]{c}.txt", [BAD] * 2): (0, 2),
        put(raw, "b/empty.txt", []): (0, 0),
        put(raw, "b/é.txt", [GOOD] * 5): (5, 0),
    }


def entries(ledger):
    return {r["file"].removeprefix("file:"): (r["rows"], r["rejects"]) for r in ledger.entries().collect()}


def test_accounts_by_file(spark, files, tmp_path):
    ledger, missing = L.ingest_manifest(spark, [f"{tmp_path}/raw/*/*", f"{tmp_path}/raw/a/*.gz", f"{tmp_path}/later/*"], str(tmp_path / "t"), files_per_round=2)
    assert entries(ledger) == {str(p): n for p, n in files.items()} and len(ledger.rounds()) == 3
    assert missing == [f"{tmp_path}/later/*"]
    assert {r["file"].removeprefix("file:"): r["size"] for r in ledger.entries().collect()} == {str(p): p.stat().st_size for p in files}
    assert ledger.lookups().count() == 9 and ledger.rejects().count() == 3
    assert {r["line"] for r in ledger.rejects().collect()} == {BAD}
    put(tmp_path / "later", "new.txt", [GOOD, BAD])
    before = ledger.rounds()
    again, missing = L.ingest_manifest(spark, [f"{tmp_path}/raw/*/*", f"{tmp_path}/later/*"], str(tmp_path / "t"))
    assert len(again.rounds()) == len(before) + 1 and missing == [] and again.lookups().count() == 10


@pytest.mark.parametrize("step", ["rows", "entry"])
def test_killed_round_counts_nothing_twice(spark, files, tmp_path, monkeypatch, step):
    root, manifest = str(tmp_path / "t"), [f"{tmp_path}/raw/*/*"]
    listed = sorted(tuple(r) for r in L.list_manifest(spark, manifest)[0].collect())
    ledger = L.Ledger(spark, root)
    ledger.take(listed[:2])
    held = entries(ledger)
    with monkeypatch.context() as patch:
        if step == "rows":  # the entry is never begun
            patch.setattr(L, "small_table", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        else:  # the entry's job does not end: its folder lacks the mark
            patch.setattr(L, "committed", lambda spark, path: ["round=0"])
        if step == "rows":
            with pytest.raises(RuntimeError, match="killed"):
                ledger.take(listed[2:4])
        else:
            ledger.take(listed[2:4])
            (tmp_path / "t/ledger/round=1/_SUCCESS").unlink()
    assert entries(ledger) == held  # neither its entry nor its rows are read
    assert ledger.lookups().select("file").distinct().count() == sum(1 for n in held.values() if n[0])
    again, _ = L.ingest_manifest(spark, manifest, root, files_per_round=2)
    assert entries(again) == {str(p): n for p, n in files.items()}
    assert again.lookups().count() == 9 and again.rejects().count() == 3


def test_lost_lines_are_noticed(spark, files, tmp_path, monkeypatch):
    ledger = L.Ledger(spark, str(tmp_path / "t"))
    listed = sorted(tuple(r) for r in L.list_manifest(spark, [f"{tmp_path}/raw/a/*"])[0].collect())
    monkeypatch.setattr(L, "small_table", lambda s, rows, ddl: s.createDataFrame(rows[1:], ddl))
    with pytest.raises(RuntimeError, match="accounted for"):
        ledger.take(listed)
    assert ledger.rounds() == [] and ledger.lookups() is None and ledger.rejects() is None


def test_site_from_path(spark, tmp_path):
    put(tmp_path / "logs", "google.com/part-0", [GOOD])
    put(tmp_path / "logs", "deep/Bbc.co.uk./part-1.gz", [GOOD] * 2)
    got = L.read_site_lines(spark, str(tmp_path / "logs")).groupBy("target").count().collect()
    assert {tuple(r) for r in got} == {("google.com.", 1), ("bbc.co.uk.", 2)}
    put(tmp_path / "flat", "wikipedia.org", [GOOD])
    assert L.read_site_lines(spark, str(tmp_path / "flat"), by="file").first()["target"] == "wikipedia.org."


def test_nothing_to_take(spark, tmp_path):
    ledger, missing = L.ingest_manifest(spark, [f"{tmp_path}/none/*"], str(tmp_path / "t"))
    assert missing and ledger.entries().count() == 0 and ledger.entries().where(F.col("round") > 0).isEmpty()
