"""Runs, best-fit packing and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearname.llm import best_fit, resampling, runs
from nearname.llm.queries import QUERIES
from nearname.session import reliable_checkpoint

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, length long, place long, runs string, score string, _h int, piece int"
WORD = r"[^\x20\x09-\x0D]+"


def awkward():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [rng.choice(["a", "b", "Cé", "d-e", "1"]) for _ in range(rng.randint(0, 80))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(100 + i, " ".join(["x", "Y", "z"] * 30)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \x0b\n"), (None, "no id " * 20), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(203, "word " * 40_000), (204, "y" * 30_000), (205, "t<|endoftext|>u <|endoftext|> v 　  ̀x 's"), (206, " a\u0085b\x1cc " * 30)]
    return [(*r, 1, 2, "clash", "clash", 3, 4) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return reliable_checkpoint(spark.createDataFrame(awkward(), SCHEMA).repartition(4))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Runs


def brute_runs(words, least=24, times=3):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                found.setdefault((s, i + p - s), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def repeats(rng, words):
    n = len(words)
    a = rng.randrange(n)
    p = 1 + (n - a) // (3 + rng.randrange(8))
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 120))]
            for _ in range(rng.randint(0, 3)):
                words = repeats(rng, words) if words else words
            texts.append(words)
        bounds = rng.choice([(24, 3), (2, 2), (4, 2), (3, 3), (9, 4)])
        assert runs.find_runs(texts, *bounds) == [brute_runs(t, *bounds) for t in texts]


def test_every_tested_child_is_a_smaller_one():
    """The squares of a random text that may not move right are those of a plain search."""
    rng = random.Random(2)
    words = np.array([rng.randrange(2) for _ in range(200)])
    rank, levels = runs.suffix_ranks(words, np.full(200, 200))
    got = set(zip(*(x.tolist() for x in runs.branching_squares(rank, levels, np.full(200, 100)))))
    want = set()
    for p in range(1, 101):
        for i in range(201 - 2 * p):
            if (words[i : i + p] == words[i + p : i + 2 * p]).all() and (i + 2 * p == 200 or words[i + 2 * p] != words[i + p]):
                want.add((i, p))
    assert got == want


def changed(doc, text):
    words = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def digest(doc, text):
    words = changed(doc, text)
    if len(set(words)) == 1:  # brute force is quadratic
        found = [(0, len(words), 1)] if len(words) >= 24 else []
    else:
        found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    of = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, of(lines), of(kept))


def test_run_digests(spark, docs, empty):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for table in (docs, spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000")):
        want = Counter(digest(r["doc_id"], r["text"]) for r in table.collect())
        got = runs.run_digests(table)
        assert got.columns == names and Counter(tuple(r) for r in got.collect()) == want
    assert sum(n for row, n in want.items() if row[1]) > 3
    assert runs.run_digests(empty).count() == 0
    whole = runs.run_table(docs).where("doc_id = 203").first()
    assert whole["n_words"] == 40_000 and [tuple(r) for r in whole["runs"]] == [(0, 40_000, 1)] and whole["collapsed"] == "word"


# Packing


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([8, 16, 50])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 10))}
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [i for i, room in enumerate(rooms) if room >= length]
                if fits:
                    rooms[min(fits, key=lambda i: rooms[i])] -= length
                else:
                    rooms.append(capacity - length)
        slots = best_fit.plan_slots(counts, capacity)
        held, ranks = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset, each in slots:
            ranks[length] += range(rank, rank + n)
            for i in range(n):
                held[first + i // each].append((offset + i % each * length, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        left = []
        for pieces in held.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            left.append(capacity - at)
        assert sorted(left) == sorted(rooms)
    assert len(best_fit.plan_slots({n: 10**9 + n for n in range(1, 1025)})) < 5000


def test_cut():
    assert best_fit.cut(1024) == [(0, 1024)] and best_fit.cut(1) == [(0, 1)]
    assert best_fit.cut(2048) == [(0, 1024), (1024, 1024)] and best_fit.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)]


def test_ids_are_those_of_the_model():
    """Over all characters, for the faster library as for the model's own."""
    encoder = best_fit.Encoder(*map(public_tokenizers.path, best_fit.TOKENIZER))
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c} {c}b1{c}  {c}{c}'s" for c in letters[i : i + 64]) for i in range(0, len(letters), 64)]
    for text, want in zip(texts, encoder.model.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids


def check_packing(rows, texts):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, lengths = Counter(), []
    for doc, text in texts:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        starts = [0] if len(ids) <= 1024 else [0, *range(first, len(ids), 1024)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            lengths.append(b - a)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= math.ceil(sum(lengths) / 1024) * 1.1 + 1


def test_best_fit(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(best_fit, "SLOTS", 5)  # slots in several pieces
    for table in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        check_packing(best_fit.pack_documents(table).collect(), [(r["doc_id"], r["text"]) for r in table.collect()])
    assert best_fit.pack_documents(empty).count() == 0


# Resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, max_n):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def test_crcs_from_prefixes():
    texts = [t for _, t, *_ in awkward()] + ["ÀÉ İſK x9", "A" * 5000 + " b"]
    for max_n in (1, 2, 4):
        parts = list(resampling.feature_crcs(texts, max_n))
        for i, text in enumerate(texts):
            got = [int(c) for sizes, crcs in parts for c in crcs[sizes[:i].sum() : sizes[: i + 1].sum()]]
            assert got == features(text, max_n)


def brute_resample(docs, target, max_n=1, buckets=10_000, least=20, percent=10):
    def count(texts):
        return Counter(c % buckets for t in texts for c in features(t, max_n))

    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        found = features(text, max_n)
        weight = sum(gain[c % buckets] for c in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = drawn[: percent * len(drawn) // 100]
    out = Counter((*r[:4], i) for i, r in enumerate(drawn, 1))
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return out + Counter({(*r, None): n for r, n in left.items()})


@pytest.mark.parametrize("settings", [{}, {"max_n": 2, "buckets": 50, "least_words": 5, "percent": 60}])
def test_resample(spark, docs, empty, settings):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    goal = [r["text"] for r in target.collect()]
    brute = {"least" if k == "least_words" else k: v for k, v in settings.items()}
    for table in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = resampling.resample(table, target, **settings).drop("n_words")
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == brute_resample([(r["doc_id"], r["text"]) for r in table.collect()], goal, **brute)
    assert resampling.resample(empty, target, **settings).count() == 0
    alone = resampling.resample(docs, empty, **settings).drop("n_words").collect()
    assert Counter(map(tuple, alone)) == brute_resample([(r[0], r[1]) for r in awkward()], [], **brute)


def test_registered(spark):
    for name in ("op11_runs", "op12_best_fit", "op13_resampling"):
        assert QUERIES[name](spark, SF).where(F.col("doc_id").isNull()).isEmpty()
