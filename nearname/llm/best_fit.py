"""Best-fit packing planned on the histogram of lengths.

Pieces of one length are interchangeable, so best fit is run over counts: lengths from the
longest on, each count into the fullest sequences that still hold it, a whole range of equal
sequences at a time. The plan is a list of slots, each for a range of ranks of one length. The
pieces are ranked within their length and take the slot of their rank in a join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearname.llm.common import running, seeded_hash, sliced
from nearname.session import reliable_checkpoint, small_table

CAPACITY = 1024
TOKENIZER = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
END = 2
SLOTS = 1 << 16  # ranks that one task spreads out at a time
SPECIAL = "<|"  # how special tokens begin


@lru_cache(2)
def _encoders(model: str, ranks: str) -> tuple[Tokenizer, tiktoken.Encoding]:
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return Tokenizer.from_file(model), fast


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, as the ``model`` file gives them.

    Its merges, also written as ``ranks``, are carried out several times faster by another
    library with the same ids; texts that may hold special tokens go through the model.
    """

    def __init__(self, model: str, ranks: str):
        self.model, self.fast = _encoders(model, ranks)

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


def cut(size: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one if it fits; otherwise full ones, behind a
    shorter one where the size is no multiple."""
    if size <= capacity:
        return [(0, size)]
    first = size % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, size, capacity))]


def tokenized_pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs``: its ids and the id
    ``end``, cut where they exceed the capacity. ``tokenizer`` are the paths of the model and
    of its ranks, which every executor can read; None takes the public ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*(tokenizer or map(public_tokenizers.path, TOKENIZER)))
        last = end.to_bytes(4, "little")
        for b in batches:
            at = 0
            for texts in sliced(b.column(1), 128):
                ids = b.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                rows = []
                for doc, text in zip(ids, texts):
                    data = encoder.encode(text or "") + last
                    for number, (start, size) in enumerate(cut(len(data) // 4, capacity)):
                        rows.append((doc, number, start, size, crc32(data[4 * start : 4 * (start + size)])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(read, ddl)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank, n, sequence, offset, each): ranks from ``rank`` on, ``n`` of them, fill the
    sequences from ``sequence`` on, ``each`` pieces apiece, from ``offset`` on.

    Best fit, longest first: each piece goes into the fullest sequence that holds it, and to a
    new one if there is none. Equal sequences are handled as one range, so the work depends on
    the lengths that occur and not on the number of pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, how many)
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        space = length
        while left:
            while space <= capacity and not room[space]:
                space += 1
            if space > capacity:  # nothing holds it: new sequences
                each = capacity // length
                room[capacity].append((opened, -(-left // each)))
                opened += room[capacity][-1][1]
                space = capacity
            first, n = room[space].pop()
            each = space // length
            used = min(n, -(-left // each))
            if used < n:
                room[space].append((first + used, n - used))
            placed = min(left, used * each)
            slots.append((length, rank, placed, first, capacity - space, each))
            whole, part = divmod(placed, each)
            if whole:
                room[space - each * length].append((first, whole))
            if part:
                room[space - part * length].append((first + whole, 1))
            rank, left = rank + placed, left - placed
    return slots


def pack_pieces(pieces: DataFrame, key: list[str], capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``length`` is between 1 and the capacity; ``key``
    are columns that order pieces of one length, after a hash of theirs.

    The driver holds one count per length, at most ``capacity``, and the plan. Slots are spread
    out as rows, SLOTS of them at a time, so no task holds a frequent length. ``pieces`` is read
    several times, so pass a narrow written table.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # one row per length
    plan = small_table(pieces.sparkSession, plan_slots(counts, capacity), "length long, _rank long, _n long, _sequence long, _offset long, _each long")
    begun = plan.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(SLOTS).cast("bigint"))))
    dealt = begun.repartition("length", "_rank", "_from")
    last = F.least(F.col("_n"), F.col("_from") + SLOTS) - 1
    spread = dealt.withColumn("_i", F.explode(F.sequence("_from", last)))
    slots = spread.select(
        "length", (F.col("_rank") + F.col("_i")).alias("place"), (F.col("_sequence") + F.expr("_i div _each")).alias("sequence_id"),
        (F.col("_offset") + F.col("length") * F.pmod("_i", "_each")).alias("offset"),
    )
    ranked = running(pieces.withColumn("_h", seeded_hash(seed, *key)), "length", ["_h", *key])
    # The plan looks small, but there are as many slots as pieces: they must not be broadcast.
    return ranked.join(slots.hint("merge"), ["length", "place"]).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of ``docs``.

    Null and empty texts are the end id alone. A text is tokenized whole, however long, and once;
    only documents beyond the capacity are cut. Repeated rows and null identifiers are pieces of
    their own, and pieces alike in all columns are interchangeable; an empty table gives an empty
    one; further columns are not carried.
    """
    pieces = reliable_checkpoint(tokenized_pieces(docs, text, capacity, tokenizer))
    return pack_pieces(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity)
