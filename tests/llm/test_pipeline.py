"""The pipeline's stages against brute force over a given table."""

import re

import corpus_pipeline
from nearname.llm.queries import QUERIES
from tests.llm.test_operators import brute_fingerprint, parts

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name == "pack":
            assert sorted(r["doc_id"] for r in rows) == seen
            break
        assert docs.columns == columns
        left = {r["doc_id"]: r["text"] for r in rows}
        assert all(before[i] == t for i, t in left.items())
        if name == "language":
            assert len(left) >= 0.99 * len(before)
        if name == "exact_dedup":
            groups = {}
            for i in sorted(before):
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
            assert sorted(left) == sorted(groups.values()) and len(rows) == len(left)
        if name == "near_dedup":
            ids = sorted(before)
            least = {}
            for i, root in zip(ids, parts([brute_fingerprint(before[i]) for i in ids])):
                least.setdefault(root, i)
            assert sorted(left) == sorted(least.values()) and len(rows) == len(left)
        before, seen = left, sorted(r["doc_id"] for r in rows)
    assert seen


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
