"""Exact duplicates by Grace hash partitioning.

Records are hashed into buckets. A bucket whose distinct contents are larger than the memory
budget is partitioned again by the next hash, and so on until every bucket fits; each then goes
through one open-addressing table that compares complete contents. Copies inside one input
partition are merged by the same table before anything is moved, so a text with very many
copies counts once per partition; what still meets in one bucket without being separable is
merged over pieces first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.llm.common import free_names, one_space
from nearname.session import reliable_checkpoint

TABLE_BYTES = 16 << 20
SLICE = 1024  # rows turned into Python objects at a time
FANOUT = 16
LEVELS = 8


class OpenTable:
    """Content to class number: linear probing over a power of two of slots, at most half full.
    Equal hashes are told apart by comparing the whole contents."""

    def __init__(self):
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[str] = []
        self.bytes = 0

    def find_or_add(self, h: int, content: str) -> int:
        at = h & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & self.mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return len(self.hashes) - 1

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.slots, self.mask = [-1] * size, size - 1
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


class Copies:
    """An open table with, per content, the first row by (identifier, tie) and the row count."""

    def __init__(self):
        self.table, self.first, self.counts = OpenTable(), [], []

    def add(self, h: int, content: str, row: tuple) -> int:
        entry = self.table.find_or_add(h, content)
        if entry == len(self.first):
            self.first.append(row)
            self.counts.append(1)
        else:
            self.counts[entry] += 1
            self.first[entry] = min(self.first[entry], row)
        return entry


_ROWS = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("content", pa.string())])
_SPILLED = "part long, id long, tie long, row long, n long, h long, content string"


def _combine(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, tie, h, content) to one narrow row each, naming its part, and one record per
    distinct content with its first row and count. A table over the budget is emitted and begun
    anew; its contents meet again in their bucket."""
    row = part = TaskContext.get().partitionId() << 33
    copies = Copies()

    def records() -> pa.RecordBatch:
        ids = [None if last else i for (last, i, _, _) in copies.first]
        columns = [
            range(part, part + len(ids)), ids, [f[2] for f in copies.first], [f[3] for f in copies.first],
            copies.counts, copies.table.hashes, copies.table.contents,
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROWS.types)], schema=_ROWS)

    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        ids, ties, hashes, contents = (c.to_pylist() for c in batch.columns)
        first, parts = row, []
        for i, tie, h, content in zip(ids, ties, hashes, contents):
            parts.append(part + copies.add(h, content, (i is None, i or 0, tie, row)))
            row += 1
        columns = [pa.array(parts, pa.int64()), batch.column(0), batch.column(1), pa.array(range(first, row), pa.int64())]
        columns += [pa.nulls(len(ids), t) for t in _ROWS.types[4:]]
        yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)
        if copies.table.bytes > budget:
            yield records()
            part += len(copies.first)
            copies = Copies()
            pa.default_memory_pool().release_unused()
    if copies.first:
        yield records()


def _resolve(bucket: pa.Table) -> pa.Table:
    """Records of one bucket to (part, leader): records of equal content share a leader."""
    table, leaders, out = OpenTable(), [], []
    parts = bucket.column("part").to_pylist()
    for part, h, content in zip(parts, bucket.column("h").to_pylist(), bucket.column("content").to_pylist()):
        entry = table.find_or_add(h, content)
        if entry == len(leaders):
            leaders.append(part)
        out.append(leaders[entry])
    return pa.table({"part": pa.array(parts, pa.int64()), "leader": pa.array(out, pa.int64())})


def _by_table(records: DataFrame, *keys: str) -> DataFrame:
    return records.select(*keys, "part", "h", "content").groupBy(*keys).applyInArrow(_resolve, "part long, leader long")


def _leaders(records: DataFrame, budget: int, level: int = 0) -> DataFrame:
    """(part, leader) of records (part, h, content), partitioned until each bucket fits."""
    sized = records.withColumn("_size", F.octet_length("content").cast("bigint"))
    if level == 0:
        total = sized.agg(F.sum("_size")).first()[0] or 0
        fan, path = -(-4 * total // budget) or 1, F.lit(0)
    else:
        fan, path = FANOUT, F.col("bucket")
    split = F.xxhash64(path, F.pmod(F.xxhash64(F.lit(level), "h"), F.lit(fan)))
    bucketed = sized.withColumn("bucket", split)
    sizes = bucketed.groupBy("bucket").agg(F.sum("_size").alias("size"), F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("one"))
    over = reliable_checkpoint(sizes.where((F.col("size") > budget) & (F.col("n") > 1)))
    if over.isEmpty():
        return _by_table(bucketed, "bucket")
    found = _by_table(bucketed.join(over.select("bucket"), "bucket", "left_anti"), "bucket")
    spread = over.where(~F.col("one")).select("bucket")
    if not spread.isEmpty():  # the next level of spill files holds the large buckets alone
        spilled = reliable_checkpoint(bucketed.join(spread, "bucket").select("bucket", "part", "h", "content"))
        found = found.unionByName(_leaders(spilled, budget, level + 1))
    stuck = over.where("one")
    if not stuck.isEmpty():  # one hash: copies from many partitions, merged over pieces of at least two records
        pieces = F.greatest(F.lit(1), F.least(F.ceil(F.col("size") / budget), F.floor(F.col("n") / 2))).cast("bigint")
        dealt = bucketed.join(stuck.select("bucket", pieces.alias("_pieces")), "bucket")
        dealt = reliable_checkpoint(dealt.withColumn("piece", F.pmod(F.xxhash64("part", F.lit(level)), F.col("_pieces"))).select("bucket", "piece", "part", "h", "content"))
        once = reliable_checkpoint(_by_table(dealt, "bucket", "piece"))
        heads = reliable_checkpoint(dealt.join(once.where("part = leader").select("part"), "part", "left_semi").drop("piece"))
        # Without progress the contents differ under one hash and go through one table.
        fewer = heads.count() < once.count()
        last = _leaders(heads, budget, level + 1) if fewer else _by_table(heads, "bucket")
        last = last.select(F.col("part").alias("leader"), F.col("leader").alias("_last"))
        found = found.unionByName(once.join(last, "leader").select("part", F.col("_last").alias("leader")))
    return found


def exact_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id", budget: int = TABLE_BYTES) -> DataFrame:
    """One row per document: id, tie (hash of the raw text), keep_id, keep_tie, group_size, kept,
    text_sha256.

    Texts are equal when their white-space runs are alike as one blank; null counts as empty.
    Of equal texts the row with the smallest identifier stays, null last, then the smallest tie;
    of rows repeated in full exactly one is kept.
    """
    content = one_space(F.col(text))
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("tie"), content.alias("content"))
    rows = rows.select("id", "tie", F.xxhash64("content").alias("h"), "content")
    spilled = reliable_checkpoint(rows.mapInArrow(lambda batches: _combine(batches, budget), _SPILLED))
    members, records = spilled.where(F.col("n").isNull()), spilled.where(F.col("n").isNotNull())
    leaders = reliable_checkpoint(_leaders(records.select("part", "h", "content"), budget))
    narrow = records.select("part", "id", "tie", "row", "n", F.sha2("content", 256).alias("text_sha256"))
    led = reliable_checkpoint(narrow.join(leaders, "part"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tie", "row")).alias("_first")
    groups = led.groupBy("leader").agg(first, F.sum("n").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    by_part = led.select("part", "leader").join(groups, "leader")
    joined = members.select("part", "id", "tie", "row").join(by_part, "part")
    return joined.select(
        "id", "tie", F.col("_first.id").alias("keep_id"), F.col("_first.tie").alias("keep_tie"), "group_size",
        (F.col("row") == F.col("_first.row")).alias("kept"), "text_sha256",
    )


def duplicate_table(docs: DataFrame) -> DataFrame:
    found = exact_groups(docs)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (id, tie), each once: tie is the hash of the raw
    text. Of several rows alike in both, the one with the smallest hash of all its columns stays,
    so only rows repeated in full are interchangeable. Further columns of any name stay as they
    are."""
    id_, tie, count, own, whole = free_names(docs, "_id", "_tie", "_count", "_own", "_whole")
    numbers = docs.groupBy(F.col("doc_id").alias(id_), F.xxhash64("text").alias(tie)).agg(F.count("*").alias(count))
    wanted = kept.select(F.col("id").alias("_kept"), F.col("tie").alias("_kept_tie")).distinct()
    keys = numbers.join(wanted, F.col(id_).eqNullSafe(F.col("_kept")) & (F.col(tie) == F.col("_kept_tie"))).select(id_, tie, count)
    keys = reliable_checkpoint(keys)
    found = docs.withColumn(own, F.xxhash64("text")).join(keys, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(tie)))
    if keys.where(F.col(count) > 1).isEmpty():
        return found.select(*docs.columns)
    alone = found.where(F.col(count) == 1).select(*docs.columns)
    order = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])
    first = F.min_by(F.struct(*docs.columns), order).alias(whole)
    repeated = found.where(F.col(count) > 1).groupBy(id_, tie).agg(first).select(f"{whole}.*")
    return alone.unionByName(repeated)


def drop_copies(docs: DataFrame) -> DataFrame:
    """Documents without exact copies: the kept row of each group, with all its columns."""
    return rows_of(docs, exact_groups(docs).where("kept"))
