"""Packing into length buckets whose boundaries minimise padding.

The histogram of all lengths goes through a dynamic programme that chooses the bucket
boundaries with the least total padding. Inside a bucket every row is padded to the boundary,
so a batch holds as many rows as the token budget divided by the boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.functions.once import once
from nearname.llm.common import numbered, running, seeded_hash, with_own_names, word_count
from nearname.session import reliable_checkpoint

BUCKETS = 16
BUDGET = 65_536


def best_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries (lengths that occur, rising) of at most ``buckets`` buckets with the
    least sum of boundary minus length; of equally good ones, those that start later buckets
    earlier.

    Padding of a bucket obeys the quadrangle inequality, so the best split of each prefix moves
    monotonically: each layer is solved by halving, in O(n log n) for n lengths.
    """
    lengths = np.array(sorted(histogram), dtype="int64")
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype="int64")
    n = len(lengths)
    rows = np.concatenate([[0], np.cumsum(counts)])
    # Cost of the bucket (i, j]: lengths[j - 1] * rows in it; the tokens themselves are constant.
    best = np.concatenate([[0], lengths * rows[1:]])
    splits = []
    for _ in range(1, min(buckets, n)):
        new, split = best.copy(), np.zeros(n + 1, dtype="int64")
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            end = min(last, j - 1)
            cost = best[first : end + 1] + lengths[j - 1] * (rows[j] - rows[first : end + 1])
            at = first + int(cost.argmin())
            new[j], split[j] = cost[at - first], at
            todo += [(lo, j - 1, first, at), (j + 1, hi, at, last)]
        splits.append(split)
        best = new
    ends, j = [], n
    for split in [*splits[::-1], np.zeros(n + 1, dtype="int64")]:
        if j:
            ends.append(int(lengths[j - 1]))
            j = int(split[j])
    return sorted(set(ends))


def pack(rows: DataFrame, length: str, key: list[str], buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 0) -> DataFrame:
    """``rows`` with bucket, bucket_length, batch (gapless per bucket), slot in the batch and
    padding.

    A row longer than the budget fills a batch of its own; rows of length 0 lie in the first
    bucket. An empty table gives an empty table. The driver holds one number per length that
    occurs, which the longest row bounds, not the number of rows. ``rows`` is read several
    times, so pass a narrow written table. Equal rows are interchangeable. Columns of any name
    stay as they are; an output whose name the input has gets underscores behind it.
    """
    rows, names = numbered(rows)
    length, key = names[length], [names[k] for k in key]
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}  # one row per length
    ends = best_boundaries(counts, buckets)
    bounds = F.array(*[F.lit(e).cast("bigint") for e in ends]) if ends else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda e: e < F.col(length)))
    # Pinned, as the optimizer else puts the fold over the boundaries where its input is gone.
    keyed = once(rows, "_bucket", bucket).withColumn("_h", seeded_hash(seed, *key))
    placed = running(keyed, "_bucket", ["_h", *key, length])
    bound = F.get(bounds, F.col("_bucket"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1)))).cast("bigint")
    batch, slot = F.floor(F.col("place") / fits).cast("bigint"), F.pmod("place", fits).cast("bigint")
    added = {"bucket": F.col("_bucket"), "bucket_length": bound, "batch": batch, "slot": slot, "padding": bound - F.col(length)}
    return with_own_names(placed, names, added)


def pack_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every document's bucket and batch by its number of words, with the ``keep`` columns; null
    text has length 0, long texts are counted whole. Equal rows are interchangeable."""
    narrow = docs.select(*keep, word_count(F.col("text")).alias("n_words"), F.xxhash64("text").alias("_text"))
    return pack(reliable_checkpoint(narrow), "n_words", [keep[0], "_text"]).drop("_text")
