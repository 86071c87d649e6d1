"""Edit-distance joins on name segments.

A name of at least 2k + 1 characters is cut into k + 1 segments with one character left out
between neighbours. An edit (a swap of neighbours included) touches one segment at most, so of
two names within k edits one segment of the first stands unchanged in the second. How far it
can have moved follows from the lengths: edits left and right of it add up to at most k, their
insertions less deletions to the difference in length. A name thus has k + 1 index keys and a
fixed number of probes, where ``fuzzy.deletion_keys`` makes one key per set of k places.

Two kinds of names go by deletion keys instead, exactly: those too short to be cut, and those
with a segment that more than ``most`` names share, as the end of a domain often is. Probes
meet ``most`` names per key at the most, so candidates grow with the names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.functions.distance import keyboard_osa, osa
from nearname.functions.once import distinct_with
from nearname.operators.fuzzy import deletion_keys
from nearname.operators.skew import MAX_BROADCAST_ROWS, broadcast_if_small, salted_join
from nearname.session import reliable_checkpoint

SHARED = 64  # names that may share a segment
SPLIT_KEYS = 20_000  # rows of one key that a task joins


def shortest_cut(radius: int) -> int:
    """Length from which a name has radius + 1 segments and a character between each two."""
    return 2 * radius + 1


def segment(size: Column, i: Column, radius: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a name of ``size`` characters."""
    parts = radius + 1
    inside = size - radius
    base = F.floor(inside / parts).cast("int")
    longer_from = parts - F.pmod(inside, F.lit(parts))  # the last ones take what is over
    return i * (base + 1) + F.greatest(i - longer_from, F.lit(0)), base + (i >= longer_from).cast("int")


def _key(size: Column, i: Column, text: Column) -> Column:
    return F.xxhash64(size, i, text)


def index_keys(names: DataFrame, name: str, radius: int, key: str = "_key") -> DataFrame:
    """Rows repeated once per segment of ``name``; names too short to be cut have none."""
    size = F.length(name)
    cut = names.where(size >= shortest_cut(radius)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(radius))))
    start, length = segment(size, F.col("_i"), radius)
    return cut.withColumn(key, _key(size, F.col("_i"), F.substring(F.col(name), start + 1, length))).drop("_i")


def probes(radius: int) -> list[tuple[int, int, int]]:
    """(longer, moved, i): by how much a probing name is longer than an indexed one, how far to
    the right the segment ``i`` may stand in it. |moved| + |longer - moved| is at most radius."""
    every = range(-radius, radius + 1)
    return [(d, m, i) for d in every for m in every if abs(m) + abs(d - m) <= radius for i in range(radius + 1)]


def probe_keys(names: DataFrame, name: str, radius: int, key: str = "_key") -> DataFrame:
    """Rows repeated once per piece of ``name`` that may be a segment of a name in the index."""
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(m).alias("m"), F.lit(i).alias("i")) for d, m, i in probes(radius)])
    tried = names.withColumn("_p", F.explode(table))
    size = F.length(name) - F.col("_p.d")
    start, length = segment(size, F.col("_p.i"), radius)
    at = start + F.col("_p.m")
    inside = (size >= shortest_cut(radius)) & (at >= 0) & (at + length <= F.length(name))
    return tried.where(inside).withColumn(key, _key(size, F.col("_p.i"), F.substring(F.col(name), at + 1, length))).drop("_p")


def segment_pairs(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    max_distance: float = 2,
    on: Sequence[str] = (),
    keyboard: bool = False,
    edges: list[tuple[str, str]] | None = None,
    most: int = SHARED,
    split_rows: int = SPLIT_KEYS,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Distinct (``on``, left name, right name, distance) within ``max_distance``, as
    ``fuzzy.fuzzy_pairs`` gives them, with ``right`` indexed by segments.

    Null names match nothing, empty ones count as names; empty tables give an empty table.
    ``split_rows`` bounds the rows of a deletion key that meet in one task.
    """
    on = list(on)
    # A neighbouring key and a swap cost one half: two edits per unit of keyboard distance.
    radius = int(max_distance * 2) if keyboard else int(max_distance)

    def names(df: DataFrame, name: str, to: str) -> DataFrame:
        return reliable_checkpoint(df.where(F.col(name).isNotNull()).select(*on, F.col(name).alias(to)).distinct())

    a, b = names(left, left_name, "_left"), names(right, right_name, "_right")
    count = b.count()
    indexed = index_keys(b, "_right", radius)
    keyed = [*on, "_key"]
    shared = reliable_checkpoint(indexed.groupBy(*keyed).count().where(F.col("count") > most).select(*keyed))
    few = broadcast_if_small(shared, most=max_broadcast)
    tried = probe_keys(a, "_left", radius)
    rare = broadcast_if_small(indexed.join(few, keyed, "left_anti"), count * (radius + 1), max_broadcast)
    by_segment = tried.join(rare, keyed).select(*on, "_left", "_right")

    # What is short or shares a segment goes by deletion keys; a key with many rows is a grid of pieces.
    no_index = F.length("_right") < shortest_cut(radius)
    by_keys_b = b.where(no_index).unionByName(indexed.join(few, keyed, "left_semi").drop("_key")).distinct()
    near_short = F.length("_left") < shortest_cut(radius) + radius
    by_keys_a = a.where(near_short).unionByName(tried.join(few, keyed, "left_semi").drop("_key")).distinct()
    keys_a = reliable_checkpoint(deletion_keys(by_keys_a, "_left", radius).distinct())
    keys_b = reliable_checkpoint(deletion_keys(by_keys_b, "_right", radius).distinct())
    by_deletion = salted_join(keys_a, keys_b, keyed, split_rows).select(*on, "_left", "_right")

    near = F.levenshtein("_left", "_right", 2 * radius) >= 0  # a swap is two plain edits
    candidates = by_segment.unionByName(by_deletion).where((F.abs(F.length("_left") - F.length("_right")) <= radius) & near)
    distance = keyboard_osa("_left", "_right", edges) if keyboard else osa("_left", "_right")
    return (
        distinct_with(candidates, [*on, "_left", "_right"], "distance", distance)
        .where(F.col("distance") <= max_distance)
        .select(*on, F.col("_left").alias(left_name), F.col("_right").alias(right_name), "distance")
    )
