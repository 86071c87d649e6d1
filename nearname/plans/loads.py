"""Pair statistics kept up to date load by load.

A load is any part of the log, loaded in any order. The store keeps its second counts by time
bin, the latest end of a cached answer by group and bin, and what the load changed in the
totals. Adding a load changes, per site and network, only what lies between the window before
its first second and the end of its last answer or second. That stretch is counted twice, with
the load and without; the difference is added to the totals. Rows of other times are not read:
what their answers still hide comes from the ends by bin.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearname.operators.cache import visible_counts
from nearname.operators.pairs import WINDOW_S, pair_totals
from nearname.operators.seconds import BIN_S, GROUP, add_counts, second_counts
from nearname.session import reliable_checkpoint, scratch
from nearname.sources.ledger import committed, read_folders

SECONDS = "target string, net16 string, ts long, suffix string, n long, own_n long, own_ttl long, expiry long"
ENDS = "target string, net16 string, at_bin long, expiry long"
CHANGES = "target string, typo string, pair_count long, delay_sum long, single_count long, own_ttl long"


class LoadStore:
    """Loads and their totals under ``root``. A load counts once its changes are written."""

    def __init__(self, spark: SparkSession, root: str, window_s: int = WINDOW_S, bin_s: int = BIN_S):
        self.spark, self.root, self.window_s, self.bin_s = spark, root, window_s, bin_s

    def loads(self) -> list[str]:
        return committed(self.spark, f"{self.root}/changes")

    def _read(self, table: str, ddl: str) -> DataFrame:
        return read_folders(self.spark, f"{self.root}/{table}", self.loads(), ddl)

    def add(self, site_log: DataFrame, load: str) -> None:
        """Adds the lookups of one load; one that is in already is left as it is."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", load):
            raise ValueError(f"{load!r} is no name for a folder")
        if f"load={load}" in self.loads():
            return
        with scratch(self.spark):
            new = reliable_checkpoint(second_counts(site_log))
            dotted = new.where(F.col("net16").isNotNull())
            bin_of = F.floor(F.col("ts") / self.bin_s)
            new.withColumn("bin", bin_of).hint("rebalance", "bin").write.mode("overwrite").partitionBy("bin").parquet(f"{self.root}/seconds/load={load}")
            ends = dotted.groupBy(*GROUP, bin_of.alias("at_bin")).agg(F.max("expiry").alias("expiry")).where(F.col("expiry").isNotNull())
            ends.write.mode("overwrite").parquet(f"{self.root}/ends/load={load}")
            end = F.greatest(F.max("ts") + 1, F.coalesce(F.max("expiry"), F.min("ts")))
            stretch = reliable_checkpoint(dotted.groupBy(*GROUP).agg((F.min("ts") - self.window_s).alias("lo"), end.alias("hi")))
            old = reliable_checkpoint(self._nearby(stretch))
            before = self._totals(reliable_checkpoint(old.join(stretch, GROUP))).select("target", "typo", *[(-F.col(c)).alias(c) for c in ("pair_count", "delay_sum")])
            after = self._totals(reliable_checkpoint(add_counts(old.unionByName(new)).join(stretch, GROUP)))
            facts = new.where(F.col("suffix") != F.col("target")).groupBy("target", F.col("suffix").alias("typo"))
            facts = facts.agg(F.sum("own_n").alias("single_count"), F.sum("own_ttl").alias("own_ttl"))
            moved = before.unionByName(after).unionByName(facts, allowMissingColumns=True).groupBy("target", "typo")
            sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("pair_count", "delay_sum", "single_count", "own_ttl")]
            moved.agg(*sums).write.mode("overwrite").parquet(f"{self.root}/changes/load={load}")

    def _nearby(self, stretch: DataFrame) -> DataFrame:
        """Second counts of the other loads that lie in the stretches, from the bin on in which
        each begins; and, as a second without lookups just before that
        bin, the latest end of an answer of all earlier bins."""
        first = F.floor(F.col("lo") / self.bin_s)
        wide = stretch.withColumn("bin", F.explode(F.sequence(first, F.floor((F.col("hi") + self.window_s) / self.bin_s))))
        seconds = self._read("seconds", f"{SECONDS}, load string, bin long").drop("load")
        # The bins of the stretches, a number of hours, prune the folders at run time.
        bins = F.broadcast(wide.where(F.col("bin") > -(1 << 62)).select("bin").distinct())
        inside = seconds.join(bins, "bin", "left_semi").join(wide, [*GROUP, "bin"]).where(F.col("ts") <= F.col("hi") + self.window_s)
        ends = self._read("ends", f"{ENDS}, load string").drop("load").join(stretch.withColumn("first", first), GROUP)
        held = ends.where((F.col("at_bin") < F.col("first")) & (F.col("expiry") > F.col("first") * self.bin_s)).groupBy(*GROUP, "first")
        held = held.agg(F.max("expiry").alias("expiry")).select(
            *GROUP, (F.col("first") * self.bin_s - 1).alias("ts"), F.col("target").alias("suffix"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("n", "own_n", "own_ttl")], "expiry",
        )
        return add_counts(inside.select(*held.columns).unionByName(held))

    def _totals(self, counts: DataFrame) -> DataFrame:
        """Pairs whose look-alike lies in its group's stretch."""
        seen = reliable_checkpoint(visible_counts(counts, self.bin_s))  # read several times
        asked = (F.col("suffix") == F.col("target")) | ((F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi")))
        return pair_totals(seen.where(asked & (F.col("n") > 0)), 0, self.window_s, self.bin_s)

    def typo_stats(self) -> DataFrame:
        """As ``stats.typo_stats`` over all loads, from the written changes alone."""
        changes = self._read("changes", f"{CHANGES}, load string")
        sums = changes.groupBy("target", "typo").agg(*[F.sum(c).alias(c) for c in ("pair_count", "delay_sum", "single_count", "own_ttl")])
        mean = F.try_divide(F.col("delay_sum").cast("double"), F.col("pair_count").cast("double"))
        return sums.where((F.col("pair_count") > 0) & (F.col("single_count") > 0)).select(
            "typo", "target", "single_count", "pair_count", mean.alias("mean_delay"), (F.col("own_ttl") != 0).alias("exists")
        )
