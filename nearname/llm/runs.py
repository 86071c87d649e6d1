"""Runs: stretches of words that repeat with a period.

The words of a text get a suffix array and its LCP array. In an LCP interval of depth d all
suffixes share their first d words and fall into child intervals by the next one. A suffix i of
any child but the largest is tested against i+d and i-d through the inverse suffix array: if
that lies in the interval but in another child, a square of period d begins there that cannot
be moved one word to the right. Moved to the left as far as it goes, it becomes the run that
ends with it. Intervals stand as index ranges over the LCP array; there is no tree.

Ranks by the first 1, 2, 4, ... words, which sorting the suffixes yields, answer how far two
places agree in either direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.llm.common import one_space, sliced

MIN_LENGTH = 24
MIN_EXPONENT = 3
WORDS = 1 << 16  # words sorted together; a longer text is sorted alone
CHECKS = 1 << 20  # suffixes tested together
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_ranks(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rank of every suffix, ranks by the first 1, 2, 4, ... ids as long as any two agree).

    ``ends`` holds where the text of each place ends; texts share no id. A rank is the number
    of suffixes before the first of those that agree; each list ends in one more rank of -1.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.r_[True, ids[order][1:] != ids[order][:-1]]
    rank = np.empty(n + 1, dtype="int64")
    rank[order], rank[n] = np.maximum.accumulate(np.where(first, np.arange(n), 0)), -1
    active = order[~(first & np.r_[first[1:], True])]
    levels, size = [], 1
    while len(active):
        levels.append(rank.copy())
        at = active + size
        after = np.where(at < ends[active], rank[np.minimum(at, n)], -1)
        key = rank[active] * (n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old, place = rank[active], np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        first = np.r_[True, key[1:] != key[:-1]]
        rank[active] = old + np.maximum.accumulate(np.where(first, place, 0)) - group
        active = active[~(first & np.r_[first[1:], True])]
        size *= 2
    return rank[:n], levels


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """How many ids agree from the places ``a`` and ``b`` on, or before them."""
    same = np.zeros(len(a), dtype="int64")
    for k in range(len(levels) - 1, -1, -1):
        x, y = (a - same - (1 << k), b - same - (1 << k)) if left else (a + same, b + same)
        hit = levels[k][x] == levels[k][y]
        if left:
            hit &= (x >= 0) & (y >= 0)
        same[hit] += 1 << k
    return same


def first_not_above(mins: list[np.ndarray], at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The first place from ``at`` on whose value is not above ``bound``."""
    at = at.copy()
    for k in range(len(mins) - 1, -1, -1):
        above = mins[k][at] > bound
        at[above] += 1 << k
    return at


def minima(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Least value of the 1, 2, 4, ... next places up to ``longest``; the last value is a least one."""
    out = [values]
    while 1 << len(out) <= longest:
        half, held = 1 << (len(out) - 1), out[-1]
        out.append(np.minimum(held, np.r_[held[half:], np.full(half, values[-1])]))
    return out


def branching_squares(rank: np.ndarray, levels: list[np.ndarray], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that do not move to the right, of periods up to ``most`` of
    their place; some may come twice."""
    n = len(rank)
    none = np.zeros(0, dtype="int64")
    sa = np.empty(n, dtype="int64")
    sa[rank] = np.arange(n)
    lcp = np.zeros(n + 1, dtype="int64")
    lcp[1:n] = agreement(levels, sa[:-1], sa[1:])
    bare = np.flatnonzero(lcp == 0)
    longest = int(np.diff(bare).max()) if len(bare) > 1 else 0
    at = np.flatnonzero(lcp > 0)
    at = at[lcp[at] <= most[sa[at]]]
    if not len(at):
        return none, none
    depth = lcp[at]
    ahead, behind = minima(lcp, longest), minima(lcp[::-1].copy(), longest)
    end = first_not_above(ahead, at + 1, depth - 1)
    child_end = first_not_above(ahead, at + 1, depth)
    start = n - first_not_above(behind, n - at + 1, depth - 1)
    before = n - first_not_above(behind, n - at + 1, depth)
    lead = before == start  # boundaries that end the first child of their interval
    lo, hi, d = (np.r_[x, x[lead]] for x in (start, end, depth))
    c0, c1 = np.r_[at, start[lead]], np.r_[child_end, at[lead]]
    # All children but the largest of each interval.
    by = np.lexsort((c0 - c1, lo * (n + 1) + hi))
    small = by[~np.r_[True, (lo[by][1:] != lo[by][:-1]) | (hi[by][1:] != hi[by][:-1])]]
    total = np.cumsum(c1[small] - c0[small])
    found = []
    first = 0
    while first < len(small):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + CHECKS, side="right")))
        part = small[first:last]
        sizes = c1[part] - c0[part]
        which = np.repeat(part, sizes)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, p = sa[c0[which] + inner], d[which]
        for j, begin in ((i + p, i), (i - p, i - p)):
            valid = (j >= 0) & (j < n)
            r = rank[np.where(valid, j, 0)]
            hit = valid & (r >= lo[which]) & (r < hi[which]) & ((r < c0[which]) | (r >= c1[which]))
            found.append((begin[hit], p[hit]))
        first = last
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(texts: list[list], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Per word list its runs as (start, length, period), by start and period: stretches of at
    least ``min_length`` words and ``min_exponent`` (2 or more) periods that no neighbour extends,
    each once, with its smallest period."""
    sizes = np.array([len(t) for t in texts], dtype="int64")
    starts = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), dtype="int64")
    used = 0
    for at, words in zip(starts.tolist(), texts):
        known: dict = {}
        ids[at : at + len(words)] = [used + known.setdefault(w, len(known)) for w in words]
        used += len(known)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(ids):
        return out
    rank, levels = suffix_ranks(ids, np.repeat(starts + sizes, sizes))
    begin, period = branching_squares(rank, levels, np.repeat(sizes // min_exponent, sizes))
    first = begin - agreement(levels, begin, begin + period, left=True)
    end = begin + 2 * period
    long = end - first >= np.maximum(min_length, min_exponent * period)
    first, end, period = first[long], end[long], period[long]
    by = np.lexsort((period, end, first))
    first, end, period = first[by], end[by], period[by]
    least = np.r_[True, (first[1:] != first[:-1]) | (end[1:] != end[:-1])] if len(first) else np.zeros(0, dtype=bool)
    rows = np.stack([first[least], end[least], period[least]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = np.searchsorted(starts, rows[:, 0], side="right") - 1
    for t, (a, b, p) in zip(owner.tolist(), rows.tolist()):
        out[t].append((a - int(starts[t]), b - a, p))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype="int64")
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    keep = np.cumsum(depth[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def _batches(ids: list, texts: list, min_length: int, min_exponent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    at = 0
    while at < len(words):
        last, held = at + 1, len(words[at])
        while last < len(words) and held + len(words[last]) <= WORDS:
            held += len(words[last])
            last += 1
        part = words[at:last]
        found = find_runs(part, min_length, min_exponent)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[at:last], pa.int64()),
                pa.array([len(w) for w in part], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], schema.field("runs").type),
                pa.array([b" ".join(collapsed(w, r)) for w, r in zip(part, found)], pa.binary()).cast(pa.string()),
            ],
            schema=schema,
        )
        at = last


def run_table(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``, which needs doc_id and ``text``.

    Words are what stands between blanks and the ASCII controls 9 to 13; ``runs`` is sorted by
    start and period; ``collapsed`` are the words that no run holds after its first period,
    joined by one blank. Null and empty texts have no words and no runs; repeated rows and null
    identifiers give a row each; an empty table gives an empty one; further columns are not
    carried. A text is read whole by one task, whose memory is about 200 bytes a word, and its
    time is n log n: no text is cut, however long. There is no shuffle.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in sliced(b.column(1), 256):
                ids = b.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                yield from _batches(ids, texts, min_length, min_exponent, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(read, SCHEMA)


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text as words joined by blanks, where every tenth document by its identifier's CRC
    repeats a part of its words from some place to its end. A null identifier changes nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("bigint")
        unit = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        again = F.floor((n - a) / p)
        rest = (n - a) - again * p
        pieces = F.concat(F.slice(w, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(unit, again.cast("int"))), F.slice(unit, F.lit(1), rest.cast("int")))
        return F.array_join(pieces, " ")

    flat = F.trim(one_space(text))
    # The words are bound once; named more than once, they would be split more than once.
    whole = F.get(F.transform(F.array(F.split(flat, " ")), repeated), F.lit(0))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (flat != ""), whole).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document its number of runs, the run of the greatest exponent and digests of all runs
    and of the collapsed text."""
    changed = docs.select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    rows = run_table(changed)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    # Runs come by start and period, so only a greater exponent replaces an earlier run.
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
