"""Incremental ingest and pairing as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nearname.operators.cache import hidden_seconds
from nearname.operators.fuzzy import match_names, with_sites
from nearname.operators.pairs import WINDOW_S, pair_rows
from nearname.operators.seconds import BIN_S, GROUP, add_counts, second_counts, with_keys
from nearname.operators.skew import MAX_BROADCAST_ROWS, broadcast_if_small
from nearname.session import reliable_checkpoint, scratch
from nearname.sources.ledger import committed, read_folders
from nearname.sources.logs import lookups_of, parse_lines

FILES_PER_ROUND = 4
GATHER_BYTES = 1 << 26


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A sibling session for a stateful stream with one state partition per core.

    The number of state partitions is fixed when a stream first starts, so it should follow
    the cluster and not the batch default of the calling session, which stays as it is.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    for key in ("spark.sql.session.timeZone", "spark.checkpoint.dir"):
        value = spark.conf.get(key, None)
        if value and session.conf.get(key, None) != value:
            session.conf.set(key, value)
    return session


def log_stream(
    spark: SparkSession, path: str, files_per_round: int = FILES_PER_ROUND, name_glob: str | None = None
) -> DataFrame:
    """Lines of new log files, a few files per round."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_round)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.text(path).select(F.col("value").alias("line"))


def ingest_by_site(
    lines: DataFrame, sites: DataFrame, out: str, checkpoint: str, max_distance: int = 2
) -> StreamingQuery:
    """Parse new log files, match names to sites and add the rows to the table at ``out``.

    The table is partitioned by round and site. A round that is run again after a failure
    replaces its own folder, so each file counts exactly once; which files are done is kept in
    the checkpoint.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        # Names come from the headers; records are parsed once, on the way out.
        with scratch(batch.sparkSession):
            headers = lookups_of(parse_lines(batch, sections=False))
            matched = with_sites(lookups_of(parse_lines(batch)), reliable_checkpoint(match_names(headers, sites, max_distance)))
            # One file per site, more only where a site's rows fill several tasks.
            matched.hint("rebalance", "target").write.mode("overwrite").partitionBy("target").parquet(f"{out}/round={batch_id}")

    return (
        lines.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_by_site(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def _by_second(rows: DataFrame, keep: Sequence[str], width: int) -> DataFrame:
    """(target, net16, ts, rows): the lookups of a site, network and second that arrive together as
    one row, with an array of their ``keep`` columns.

    A second may come in several rows: it is gathered within a round, and of a task's rows within
    ``GATHER_BYTES``.
    """
    kept = T.StructType([rows.schema[c] for c in keep])
    schema = T.StructType([*(rows.schema[c] for c in (*GROUP, "ts")), T.StructField("rows", T.ArrayType(kept))])

    def gathered(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        codes = [table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for c in GROUP]
        keys = [*codes, table["ts"].to_numpy()]
        order = np.lexsort(keys)
        new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        firsts = np.concatenate([[0], np.flatnonzero(new) + 1])
        offsets = pa.array(np.append(firsts, len(order)), pa.int32())
        table = table.take(pa.array(order))
        each = pa.StructArray.from_arrays([table[c].combine_chunks() for c in keep], fields=[table.schema.field(c) for c in keep])
        heads = table.select([*GROUP, "ts"]).take(pa.array(firsts))
        yield from heads.append_column("rows", pa.ListArray.from_arrays(offsets, each)).to_batches(max_chunksize=10_000)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) > GATHER_BYTES:
                yield from gathered(held)
                held = []
        if held:
            yield from gathered(held)

    rows = rows.where(F.col("ts").isNotNull()).select(*GROUP, "ts", *keep)
    return rows.repartition(*GROUP, F.floor(F.col("ts") / width)).mapInArrow(gather, schema)


def stream_pairs(
    typos: DataFrame,
    targets: DataFrame,
    window_s: int = WINDOW_S,
    lateness: str | None = None,
    pieces: int = 1,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Look-alike lookups with correct lookups 0..window_s seconds later, as they arrive.

    Inputs are streams with target, net16 and ts, typos also with typo. State is held per
    site, network, time bin and piece, so a site or network with a large share of the log is
    spread over many state stores; ``pieces`` repeats look-alike rows and is for bins too large
    for one. Lookups of a site, network and second go into the state as one row, so the work of the
    join follows the seconds; the pairs are listed above it. By default every pair is found however late its rows arrive, and state is kept.
    With ``lateness`` a bin's state goes once the watermark has passed it, and rows that come
    later than that find no partner. Whether a cached answer hides a pair depends on earlier
    lookups that may still arrive, so pairs are written as found; ``visible_stream_pairs``
    leaves the hidden ones out when they are read.
    """
    late = (lambda df, at: df.withWatermark(at, lateness)) if lateness else (lambda df, at: df)
    width = window_s + 1
    at = F.timestamp_seconds("ts")
    first = F.floor(F.col("ts") / width)
    last = F.floor((F.col("ts") + window_s) / width)
    left = late(
        _by_second(typos, ["typo", *keep], width)
        .select(*GROUP, F.col("rows").alias("typos"), F.col("ts").alias("typo_ts"), at.alias("typo_at"), F.explode(F.sequence(first, last)).alias("bin"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        , "typo_at",
    )
    right = late(_by_second(targets.withColumn("one", F.lit(True)), ["one"], width).select(
        *GROUP,
        F.size("rows").alias("lookups"),
        F.col("ts").alias("target_ts"),
        at.alias("target_at"),
        first.alias("bin"),
        F.pmod(F.xxhash64(*GROUP, "ts"), F.lit(pieces)).cast("int").alias("piece"),
    ), "target_at")
    right = right.select(*[F.col(c).alias(f"r_{c}" if c in (*GROUP, "bin", "piece") else c) for c in right.columns])
    same = [F.col(c) == F.col(f"r_{c}") for c in (*GROUP, "bin", "piece")]
    within = (F.col("target_at") >= F.col("typo_at")) & (
        F.col("target_at") <= F.col("typo_at") + F.expr(f"INTERVAL {window_s} SECONDS")
    )
    condition = within
    for c in same:
        condition = condition & c
    joined = left.join(right, condition)
    delay = F.col("target_ts") - F.col("typo_ts")
    each = joined.select(*GROUP, "typos", "lookups", "typo_ts", "target_ts", F.explode("typos").alias("_t"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("lookups"))))
    return each.select(*GROUP, *[F.col("_t")[c].alias(c) for c in ("typo", *keep)], "typo_ts", "target_ts", delay.alias("delay_s"))


def pair_rounds(
    site_log: DataFrame, out: str, checkpoint: str, window_s: int = WINDOW_S, bin_s: int = BIN_S, keep: Sequence[str] = ()
) -> StreamingQuery:
    """Pairs of a streamed site log whose rows come in any order, without state in the executors.

    Each round writes its rows by time bin, and pairs them with one another and with the rows of
    earlier rounds in the bins they touch. A round of recent rows reads the last bins only; a
    late row reads those of its own time, however long ago, so no pair is lost and nothing has to
    be held for it. A round that is run again replaces what it wrote; rows count as earlier ones
    once their round's pairs are written.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = with_keys(batch).where(F.col("net16").isNotNull()).select(*GROUP, "suffix", "ts", *keep, F.floor(F.col("ts") / bin_s).alias("bin"))
        ddl = f"{rows._jdf.schema().toDDL()}, round string"
        rows.hint("rebalance", "bin").write.mode("overwrite").partitionBy("bin").parquet(f"{out}/rows/round={number}")
        new = read_folders(spark, f"{out}/rows", [f"round={number}"], ddl)
        earlier = read_folders(spark, f"{out}/rows", [r for r in committed(spark, f"{out}/pairs") if r != f"round={number}"], ddl)
        # As many bins as the round's rows have hours, and their neighbours: they prune the scan.
        reach = F.sequence(F.floor((F.col("ts") - window_s) / bin_s), F.floor((F.col("ts") + window_s) / bin_s))
        bins = new.select(F.explode(reach).alias("bin")).where(F.col("bin") > -(1 << 62)).distinct()
        old = earlier.join(F.broadcast(bins), "bin", "left_semi")
        head = F.col("suffix") == F.col("target")

        def typos(df: DataFrame) -> DataFrame:
            return df.where(~head).select(*GROUP, F.col("suffix").alias("typo"), *keep, F.col("ts").alias("typo_ts"))

        def targets(df: DataFrame) -> DataFrame:
            return df.where(head).select(*GROUP, F.col("ts").alias("target_ts"))

        with scratch(spark):
            near = reliable_checkpoint(old)
            found = pair_rows(typos(new), targets(new.unionByName(near)), GROUP, 0, window_s)
            found = found.unionByName(pair_rows(typos(near), targets(new), GROUP, 0, window_s))
            found = found.select(*GROUP, "typo", *keep, "typo_ts", "target_ts", "delay_s")
            found.write.mode("overwrite").parquet(f"{out}/pairs/round={number}")

    return site_log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_pair_rounds(spark: SparkSession, out: str, keep: str = "") -> DataFrame:
    """Pairs of all rounds so far; ``keep`` are the types of the kept columns, as in a schema."""
    kept = f"{keep}, " if keep else ""
    ddl = f"target string, net16 string, typo string, {kept}typo_ts long, target_ts long, delay_s long, round string"
    return read_folders(spark, f"{out}/pairs", committed(spark, f"{out}/pairs"), ddl).drop("round")


def split_site_stream(site_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look-alike and correct lookups of a streamed site log."""
    rows = with_keys(site_log).where(F.col("net16").isNotNull())
    typos = rows.where(F.col("suffix") != F.col("target")).withColumnRenamed("suffix", "typo")
    return typos, rows.where(F.col("suffix") == F.col("target"))


def count_seconds(site_log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Condense a streamed site log to second counts, one folder per round at ``out``.

    Counts of rounds add up, so no state is kept and rows may come in any order; a round that
    is run again replaces its own folder.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        second_counts(batch).write.mode("overwrite").parquet(f"{out}/round={batch_id}")

    return (
        site_log.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_second_counts(spark: SparkSession, out: str) -> DataFrame:
    """Second counts of all rounds so far."""
    return add_counts(spark.read.parquet(out).drop("round"))


def visible_stream_pairs(found: DataFrame, counts: DataFrame, bin_s: int = BIN_S) -> DataFrame:
    """Rows of ``stream_pairs`` of which no cached answer hides either lookup.

    ``counts`` are the second counts of all rows that have arrived. However late these came,
    the result is that of the batch job over the same rows.
    """
    # 64 seconds to a row: small beside the pairs, which then stay where they are.
    page, place = lambda ts: F.floor(ts / 64).alias("_page"), lambda ts: F.pmod(ts, F.lit(64)).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(ts, 64) AS int))")
    hidden = hidden_seconds(counts, bin_s).groupBy(*GROUP, page(F.col("ts"))).agg(F.bit_or(bit).alias("_hidden"))
    pages = reliable_checkpoint(hidden)
    rows = pages.limit(MAX_BROADCAST_ROWS + 1).count()
    for at in ("typo_ts", "target_ts"):
        placed = found.withColumn("_page", page(F.col(at)))
        joined = placed.join(broadcast_if_small(pages, rows), [*GROUP, "_page"], "left")
        found = joined.where(F.coalesce(F.getbit("_hidden", place(F.col(at))), F.lit(0)) == 0).select(*found.columns)
    return found


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a Parquet table until all present input is used."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
