"""A log kept ready for pairing: both sides bucketed and sorted by the keys of the pair join.

``write_pair_store`` works visibility out once and writes two tables with the same buckets over
(target, net16, bin, piece). Any later pair job over them, with whatever further conditions,
joins bucket with bucket and shuffles nothing below the join.

A look-alike lies in each bin that its window touches (two at most, as bins are as wide as the
longest window), so the join finds every pair exactly once. A busy network is spread over its time
bins; a bin with more than ``split_rows`` lookups of a side is cut into pieces, to which that side's
rows are dealt and for which the other side's are repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearname.operators.cache import visible_lookups
from nearname.operators.pairs import WINDOW_S
from nearname.operators.seconds import BIN_S, GROUP, second_counts
from nearname.operators.skew import SPLIT_ROWS, hot_keys
from nearname.session import reliable_checkpoint

BUCKETS = 8
KEYS = [*GROUP, "bin", "piece"]


@dataclass(frozen=True)
class PairStore:
    """Names of the two tables and the longest window they serve."""

    typos: str
    targets: str
    window_s: int = WINDOW_S

    def pairs(self, spark: SparkSession, low: int = 0, high: int | None = None) -> DataFrame:
        """Pairs with low <= delay <= high (both within the window the tables were written for)."""
        high = self.window_s if high is None else high
        if not 0 <= low <= high <= self.window_s:
            raise ValueError(f"delays must lie within 0..{self.window_s}")
        # A merge join of buckets; no side is ever broadcast, whatever its files' size.
        typos, targets = spark.table(self.typos).hint("merge"), spark.table(self.targets)
        joined = typos.join(targets, KEYS).withColumn("delay_s", F.col("target_ts") - F.col("typo_ts"))
        return joined.where(F.col("delay_s").between(low, high)).drop("bin", "piece")

    def drop(self, spark: SparkSession) -> None:
        for name in (self.typos, self.targets):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_pair_store(
    site_log: DataFrame,
    name: str,
    path: str | None = None,
    counts: DataFrame | None = None,
    window_s: int = WINDOW_S,
    buckets: int = BUCKETS,
    split_rows: int = SPLIT_ROWS,
    bin_s: int = BIN_S,
) -> PairStore:
    """Write the visible lookups of ``site_log`` as ``<name>_typos`` and ``<name>_targets``.

    ``path`` is a shared folder; without one the tables lie in the warehouse. ``buckets`` should
    make a bucket some hundred MB. Tables of that name are replaced.
    """
    counts = second_counts(site_log) if counts is None else counts
    width = window_s + 1
    rows = visible_lookups(site_log, counts, bin_s).where(F.col("net16").isNotNull())
    kept = [c for c in ("lookup_id",) if c in rows.columns]
    # Numbers that deal rows to pieces are written, so a task run again deals alike.
    rows = reliable_checkpoint(rows.select(*GROUP, "ts", "suffix", *kept, F.monotonically_increasing_id().alias("_row")))

    is_target = F.col("suffix") == F.col("target")
    last = F.floor((F.col("ts") + window_s) / width)
    bins = F.when(is_target, F.array(F.floor(F.col("ts") / width))).otherwise(F.sequence(F.floor(F.col("ts") / width), last))
    placed = rows.withColumn("bin", F.explode(bins))

    # Rows per bin and side in one pass; only hot ones stay, and they are few: each has a full piece.
    sizes = placed.groupBy(*GROUP, "bin", is_target.alias("is_target")).agg(F.count("*").alias("count"))
    hot = reliable_checkpoint(hot_keys(sizes, [*GROUP, "bin", "is_target"], split_rows))
    cuts = reliable_checkpoint(
        hot.groupBy(*GROUP, "bin").agg(
            F.max(F.when(~F.col("is_target"), F.col("pieces"))).alias("_tp"),
            F.max(F.when(F.col("is_target"), F.col("pieces"))).alias("_gp"),
        )
    )
    one = F.lit(1).cast("bigint")
    tp, gp = F.coalesce("_tp", one), F.coalesce("_gp", one)
    spread = placed.join(cuts, [*GROUP, "bin"], "left")
    own = F.pmod(F.xxhash64("_row"), F.when(is_target, gp).otherwise(tp))
    # The grid of a bin has tp x gp cells: a row keeps its own line and is repeated over the other.
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(is_target, tp).otherwise(gp) - 1))
    celled = spread.withColumn("_own", own).withColumn("_other", others)
    cell = F.when(is_target, F.col("_other") * gp + F.col("_own")).otherwise(F.col("_own") * gp + F.col("_other"))
    celled = celled.withColumn("piece", cell)

    store = PairStore(f"{name}_typos", f"{name}_targets", window_s)
    ids = lambda side: [F.col(c).alias(f"{side}_id") for c in kept]
    sides = {
        store.typos: celled.where(~is_target).select(*KEYS, F.col("suffix").alias("typo"), F.col("ts").alias("typo_ts"), *ids("typo")),
        store.targets: celled.where(is_target).select(*KEYS, F.col("ts").alias("target_ts"), *ids("target")),
    }
    for table, side in sides.items():
        # Rows meet per bucket before writing, so a bucket is one file.
        writer = side.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).mode("overwrite")
        (writer.option("path", f"{path}/{table}") if path else writer).saveAsTable(table)
    return store
