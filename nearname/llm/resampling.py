"""Importance resampling towards a target text: hashed n-gram features, gains, Gumbel draws.

A text is normalised to its words joined by one blank and scanned once; the running CRC-32 is
kept where words begin and end. CRCs are linear over GF(2): the CRC of a piece is the running
one at its end, without the one at its beginning shifted by as many zero bits as the piece has.
So the CRC of any n-gram comes from two stored values and its length; n-grams are not built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.llm.common import sliced
from nearname.operators.ordered import with_place
from nearname.session import reliable_checkpoint

BUCKETS = 10_000
MAX_N = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
POLYNOMIAL = 0xEDB88320  # fixed value of CRC-32

#: Bytes of words stand for themselves, in lower case; all others part words.
KEEP = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


class ZeroShifts:
    """CRCs as they are after a number of zero bytes more."""

    def __init__(self):
        bits = np.arange(256, dtype="uint32")
        for _ in range(8):
            bits = np.where(bits & 1, (bits >> 1) ^ np.uint32(POLYNOMIAL), bits >> 1).astype("uint32")
        value = [np.arange(256, dtype="uint32") << np.uint32(8 * j) for j in range(4)]
        self.tables = [[(v >> np.uint32(8)) ^ bits[v & np.uint32(255)] for v in value]]  # by 1, 2, 4, ... bytes

    @staticmethod
    def _apply(table: list[np.ndarray], crcs: np.ndarray) -> np.ndarray:
        low = np.uint32(255)
        out = table[0][crcs & low]
        for j in range(1, 4):
            out ^= table[j][(crcs >> np.uint32(8 * j)) & low]
        return out

    def behind_blank(self, crcs: np.ndarray) -> np.ndarray:
        return self._apply(self.tables[0], crcs) ^ np.uint32(crc32(b" "))

    def shift(self, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each CRC with its number of zero bytes behind it."""
        out, k = crcs.copy(), 0
        while len(sizes) and int(sizes.max()) >> k:
            if k == len(self.tables):
                self.tables.append([self._apply(self.tables[-1], t) for t in self.tables[-1]])
            wanted = np.flatnonzero((sizes >> k) & 1)
            out[wanted] = self._apply(self.tables[k], out[wanted])
            k += 1
        return out


SHIFTS = ZeroShifts()


def _step(crc: int, word: bytes) -> int:
    return crc32(word, crc)


def prefixes(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(words of each text; CRC and byte place at which each word begins; the same for its end).

    The texts are scanned with a blank before each word; the CRC behind that blank follows from
    the one before it for all words at once.
    """
    sizes, lengths, running = [], [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(KEEP).split() if text else []
        sizes.append(len(words))
        lengths += map(len, words)
        running += accumulate([b" " + w for w in words], _step, initial=0)
    number, crcs = np.array(sizes, dtype="int64"), np.array(running, dtype="uint32")
    ends = np.cumsum(np.array(lengths, dtype="int64") + 1)
    first = np.cumsum(number + 1) - number - 1  # each text has one running CRC more than words
    last = np.ones(len(crcs), dtype=bool)
    last[first] = False
    before = SHIFTS.behind_blank(crcs[np.r_[last[1:], False]])
    return number, before, ends - np.array(lengths, dtype="int64"), crcs[last], ends


def feature_crcs(texts: list[str | None], max_n: int = MAX_N) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``max_n``: number of n-grams of each text, and their CRCs in text order."""
    sizes, before, begins, after, ends = prefixes(texts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for n in range(1, max_n + 1):
        first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, dtype="int64")
        last = first + n - 1
        yield np.maximum(sizes - n + 1, 0), after[last] ^ SHIFTS.shift(before[first], ends[last] - begins[first])


def bucket_counts(docs: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all rows by bucket. Each task hands on one row per bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype="int64")
        for b in batches:
            for texts in sliced(b.column(0), 256):
                for _, crcs in feature_crcs(texts, max_n):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandfold log ratio of the smoothed shares of each bucket in target and source, floored."""
    s_all, t_all = sum(source.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def weigh(docs: DataFrame, gain: list[int], text: str = "text", max_n: int = MAX_N) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each row's features."""
    table = np.array(gain, dtype="int64")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in sliced(b.column(1), 256):
                words, sums, counts = np.zeros(len(texts), dtype="int64"), np.zeros(len(texts), dtype="int64"), np.zeros(len(texts), dtype="int64")
                for n, (sizes, crcs) in enumerate(feature_crcs(texts, max_n), 1):
                    total = np.r_[0, np.cumsum(table[crcs % np.uint32(len(table))])]
                    ends = np.cumsum(sizes)
                    sums += total[ends] - total[ends - sizes]
                    counts += sizes
                    words = sizes if n == 1 else words
                mean = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
                ids = b.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(counts), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(read, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandfold Gumbel variate of an identifier, floored; a null one counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; rank counts the
    drawn rows from the highest score on, ties to the smaller identifier, and is null for others.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (floored) are drawn.
    Words are runs of digits, ASCII letters (in lower case) and all characters beyond ASCII. Null
    and empty texts have no features and weight 0; an empty table on either side gives whole
    results; repeated rows are drawn each for itself; null identifiers come first among ties;
    further columns are not carried. Texts are read whole, twice, and never shuffled. The driver
    holds ``buckets`` counts of either table and one count per score that occurs: scores are
    logarithms of counts, below a hundred thousand different ones whatever the table.
    """
    spread = lambda rows: {r[0]: r[1] for r in bucket_counts(rows, text, max_n, buckets).collect()}
    gain = gains(spread(docs), spread(target), buckets)
    weighed = weigh(docs, gain, text, max_n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = reliable_checkpoint(weighed)
    fit = F.col("n_words") >= least_words
    by_score = sorted(rows.where(fit).groupBy("score").count().collect(), reverse=True)
    wanted = percent * sum(n for _, n in by_score) // 100
    bound, held = None, 0
    for score, n in by_score:  # the lowest score of which some are drawn
        if held >= wanted:
            break
        bound, held = score, held + n
    none = F.lit(None).cast("bigint")
    if bound is None:
        return rows.withColumn("rank", none)
    near = fit & (F.col("score") >= bound)
    placed = with_place(rows.where(near), F.col("score").desc(), F.col("doc_id"), name="rank")
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(rows.where(~near).withColumn("rank", none))


def resampled_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
