"""Consistent hashing with virtual nodes and bounded loads.

The ring has 2**RING_BITS cells. Each shard owns ``vnodes`` of them, chosen by a hash of shard
and replica, and a key belongs to the first virtual node clockwise of its cell. Keys arrive in
a seeded order of their cells; a shard that has reached its bound is full, and keys that meet
it continue clockwise to the next shard with room. Only counts per cell, whose number is a
constant, reach the driver; rows are ranked inside their cell and take the shard that the walk
gave to their rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearname.llm.common import numbered, with_own_names
from nearname.session import reliable_checkpoint

RING_BITS = 14
VNODES = 64
SLACK = 0.01


def _mix(x: int) -> int:
    """A 64-bit finaliser: spreads small integers over the ring."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order. A shard's nodes depend on its own
    number only, so one more shard takes nodes from all others and moves none between them."""
    nodes = {(_mix(shard << 20 | replica) >> (64 - RING_BITS), _mix(replica << 20 | shard), shard) for shard in range(shards) for replica in range(vnodes)}
    return [(cell, shard) for cell, _, shard in sorted(nodes)]


def walk(loads: dict[int, tuple[int, int]], shards: int, by: str = "rows", slack: float = SLACK, vnodes: int = VNODES) -> list[tuple]:
    """Pieces (cell, low, high, shard, home, first slot) for ``loads``: cell to (rows, bytes).

    By rows the bounds are the two integers next to the mean and cells are cut where a shard
    fills up, so counts differ by one at most. By bytes the bound is (1 + slack) times the mean
    and cells stay whole; when no shard has room for one, it goes to the emptiest.
    """
    nodes = ring(shards, vnodes)
    total = sum(x[by == "bytes"] for x in loads.values())
    if by == "rows":
        free = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        free = [int(total / shards * (1 + slack)) + 1] * shards
    owner, at = [0] * (1 << RING_BITS), 0
    for cell in range(1 << RING_BITS):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        owner[cell] = at % len(nodes)
    following = list(range(len(nodes)))  # the node itself, or one further on when its shard is full

    def with_room(node: int) -> int:
        path = []
        while free[nodes[node][1]] <= 0 or following[node] != node:
            path.append(node)
            node = following[node] if following[node] != node else (node + 1) % len(nodes)
        for p in path:
            following[p] = node
        return node

    pieces, filled = [], [0] * shards
    for cell in sorted(loads, key=lambda c: _mix(c)):
        rows, size = loads[cell]
        home = nodes[owner[cell]][1]
        low = 0
        while low < rows:
            if by == "rows":
                shard = nodes[with_room(owner[cell])][1]
                take = min(rows - low, free[shard])
                free[shard] -= take
            else:
                start = owner[cell]
                clockwise = dict.fromkeys(nodes[(start + i) % len(nodes)][1] for i in range(len(nodes)))
                shard = next((s for s in clockwise if free[s] >= size), None)
                shard = max(range(shards), key=lambda s: (free[s], -s)) if shard is None else shard
                take = rows
                free[shard] -= size
            pieces.append((cell, low, low + take, shard, home, filled[shard]))
            filled[shard] += take
            low += take
    return pieces


def assign_shards(rows: DataFrame, key: list[str], size: str, shards: int = 16, by: str = "rows", slack: float = SLACK, seed: int = 0, vnodes: int = VNODES) -> DataFrame:
    """``rows`` with shard, home_shard (the ring's choice without bounds) and slot (gapless from
    0 in each shard).

    Nulls in ``key`` hash like any value; equal rows are interchangeable; an empty table gives
    an empty table. ``rows`` is read twice, so pass a written or narrow table. The key should
    tell rows apart: rows equal in all of ``key`` share a cell. Columns of any name stay as they
    are; an output whose name the input has gets underscores behind it. Text is not looked at, so
    its length does not matter.
    """
    rows, names = numbered(rows)
    key, size = [names[k] for k in key], names[size]
    celled = rows.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_cell", F.shiftrightunsigned("_h", 64 - RING_BITS).cast("int"))
    counts = celled.groupBy("_cell").agg(F.count("*").alias("n"), F.sum(size).alias("b")).collect()  # 2**RING_BITS rows at most
    pieces = walk({r["_cell"]: (r["n"], r["b"] or 0) for r in counts}, shards, by, slack, vnodes)
    table = rows.sparkSession.createDataFrame(pieces, "_cell int, _low long, _high long, shard int, home_shard int, _slot long")
    inside = Window.partitionBy("_cell").orderBy("_h", *key, size)
    ranked = celled.withColumn("_k", F.row_number().over(inside) - 1)
    met = ranked.join(table, "_cell").where((F.col("_k") >= F.col("_low")) & (F.col("_k") < F.col("_high")))
    slot = F.col("_slot") + F.col("_k") - F.col("_low")
    return with_own_names(met, names, {"shard": F.col("shard"), "home_shard": F.col("home_shard"), "slot": slot})


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document in one of ``shards`` shards whose counts differ by one at most.

    Null text counts as empty (size 1, checksum 0). The text is read once; only identifier,
    size and checksum are shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = reliable_checkpoint(docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32")))
    placed = assign_shards(narrow, ["doc_id", "text_crc32"], "size", shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
