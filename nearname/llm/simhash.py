"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into BLOCKS blocks. Two fingerprints that differ in at most
RADIUS bits agree in at least BLOCKS - RADIUS of them, so they meet under some choice of that
many blocks. Distinct fingerprints are keyed once per choice; those under one key are compared
in one array, and each array yields the links that connect it (a spanning forest), never all
its pairs. A key with more than MOST fingerprints is keyed again over the bits it leaves open:
then all but 12 bits are fixed, and 4096 distinct fingerprints are the most a key can have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.llm.common import one_space, sliced
from nearname.llm.components import components
from nearname.llm.exact_dedup import rows_of
from nearname.session import reliable_checkpoint

WORDS = 3
RADIUS = 3
BLOCKS = 6
FINE_BLOCKS = 8
MOST = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of a text whose words are separated by single blanks; of no words, 0."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, dtype="uint8") == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    if len(starts) <= words:
        return digest(data, 42)
    hashes = np.array([digest(data[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype="int64")
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].view("uint8").reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="int64")
    bits = (ones * 2 > len(hashes)).astype("uint8")
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Documents with their signed 64-bit fingerprint."""
    flat = F.trim(one_space(F.translate(text, UPPER, LOWER)))

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        found = [np.array([fingerprint(t) for t in part], dtype="uint64") for part in sliced(texts)]
        return pa.array(np.concatenate(found).view("int64") if found else [], pa.int64())

    return docs.withColumn(name, fingerprints(flat))


def _masks(width: int, offset: int, blocks: int, keep: int) -> list[int]:
    edges = [offset + round(i * width / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(block, keep)]


def coarse_masks() -> list[int]:
    """Bits that must agree, one mask per choice of blocks."""
    return _masks(64, 0, BLOCKS, BLOCKS - RADIUS)


def fine_masks(coarse: int) -> list[int]:
    """As above over the bits that ``coarse`` leaves open, in FINE_BLOCKS blocks."""
    open_bits = [1 << i for i in range(64) if not coarse >> i & 1]
    cuts = [round(i * len(open_bits) / FINE_BLOCKS) for i in range(FINE_BLOCKS + 1)]
    block = [sum(open_bits[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [coarse | sum(chosen) for chosen in combinations(block, FINE_BLOCKS - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _long(x: int) -> Column:
    return F.lit(_signed(x)).cast("bigint")


def _keys(masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(_long(m)).alias("bits")) for i, m in enumerate(masks)])


def _keyed(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.explode(_keys(coarse_masks())).alias("_k")).select("fp", "_k.mask", "_k.bits")


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all unsigned values within ``radius`` bits of each other, as (a, b) with the
    smallest value of each part as ``a``.

    A part grows by one value at a time: its distances to all values not yet reached are taken
    in one pass, so memory is linear.
    """
    rest = np.sort(values)
    links = []
    while len(rest):
        root, wave = int(rest[0]), [rest[0]]
        rest = rest[1:]
        while wave and len(rest):
            near = np.bitwise_count(rest ^ wave.pop()) <= radius
            if near.any():
                reached = rest[near]
                links += [(root, int(x)) for x in reached]
                wave += list(reached)
                rest = rest[~near]
    return links


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
        ends = ends - ends[0]
        sizes = np.diff(ends)
        twos = ends[:-1][sizes == 2]
        low, high = np.minimum(flat[twos], flat[twos + 1]), np.maximum(flat[twos], flat[twos + 1])
        close = np.bitwise_count((low ^ high).view("uint64")) <= RADIUS
        a, b = [low[close]], [high[close]]
        for i in np.flatnonzero(sizes > 2):
            if links := forest(flat[ends[i] : ends[i + 1]].view("uint64")):
                pairs = np.array(links, dtype="uint64").view("int64")
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within RADIUS bits, directly or over
    others. ``fps`` holds distinct fingerprints as ``fp`` and is read several times."""
    keyed = _keyed(fps)
    sized = reliable_checkpoint(keyed.groupBy("mask", "bits").count().where(F.col("count") > 1))
    key = ["mask", "bits"]
    small = keyed.join(sized.where(F.col("count") <= most).select(*key), key)
    arrays = small.groupBy(*key).agg(F.collect_list("fp").alias("fps")).select("fps")  # most entries at most
    hot = sized.where(F.col("count") > most).select(*key)
    if not hot.isEmpty():
        fine = F.array(*[
            F.array(*[F.struct(F.lit(100 * i + j).alias("mask"), F.col("fp").bitwiseAND(_long(m)).alias("bits")) for j, m in enumerate(fine_masks(c))])
            for i, c in enumerate(coarse_masks())
        ])
        again = keyed.join(hot, key).select("fp", F.explode(F.get(fine, F.col("mask"))).alias("_k"))
        fixed = again.groupBy("_k.mask", "_k.bits").agg(F.collect_list("fp").alias("fps"))  # 2**12 entries at most
        arrays = arrays.unionByName(fixed.where(F.size("fps") > 1).select("fps"))
    return arrays.mapInArrow(_forests, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, tie (hash of the raw text), fingerprint (hex), root (a number
    of the component) and component_id, the smallest identifier it is linked with, itself
    included.

    Texts without words, null among them, have fingerprint 0 and are linked like any other.
    Documents without identifier stay in their component, whose id is null if none has one.
    Equal documents share a fingerprint, so groups of copies cost one entry.
    """
    marked = with_fingerprints(docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("_text")), "_text")
    marked = reliable_checkpoint(marked.drop("_text"))
    fps = reliable_checkpoint(marked.groupBy("fp").agg(F.min("id").alias("_least")))
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "root", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(by_fp, "fp").select("id", "tie", hexed, "root", "component_id")


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents of which one per component stays: the smallest identifier, null last, then the
    smallest text hash."""
    found = near_duplicates(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tie")).alias("f"))
    return rows_of(docs, first.select("f.id", "f.tie"))
