"""Writers: log lines and tables, split by site, look-alike or existence.

The reference layout is one file per site or per look-alike. Here that is one partition
folder each; a folder may hold several files, so a site with a third of all rows is written
by many tasks, and empty folders never appear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearname.functions.records import export_line
from nearname.operators.skew import broadcast_if_small, hot_keys
from nearname.session import reliable_checkpoint, scratch, settings

FOLDERS_PER_TASK = 256
ROWS_PER_FILE = 200_000
LISTING_TASKS_PER_CORE = 4
BYTES_PER_TASK = 1 << 25
_SOURCES = "spark.sql.sources"
# Of a local file system only; its instance with checksums stays for everything else.
_NO_SUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _gathered(df: DataFrame, by: Sequence[str], folders: int = FOLDERS_PER_TASK, most: int = ROWS_PER_FILE) -> DataFrame:
    """Rows of a folder brought together, so that one file is written per folder.

    Making a folder takes far longer than writing a few lines into it, so tasks are dealt by the
    number of folders as well as of rows: partitions joined by their bytes would leave thousands
    of folders to one task. A folder with more than ``most`` rows is cut into pieces by a hash of
    the row. The rows are materialised once, so that counting them does not make them again.
    """
    rows = reliable_checkpoint(df)
    sizes = reliable_checkpoint(rows.groupBy(*by).count())
    total = sizes.agg(F.count("*").alias("folders"), F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    spread = min(total["folders"], df.sparkSession.sparkContext.defaultParallelism)
    tasks = max(spread, -(-total["folders"] // folders) + (total["rows"] or 0) // most, 1)
    if (total["most"] or 0) <= most:
        return rows.repartition(tasks, *by)
    cut = hot_keys(sizes, by, most).select(*[F.col(c).alias(f"_of_{c}") for c in by], "pieces")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    row = F.xxhash64(*[f.name for f in rows.schema if "map<" not in f.dataType.simpleString()])
    piece = F.pmod(row, F.coalesce("pieces", F.lit(1).cast("bigint")))
    dealt = rows.join(broadcast_if_small(cut), same, "left").withColumn("_piece", piece)
    return dealt.repartition(tasks, *by, "_piece").select(*rows.columns)


def write_lines(lookups: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lookups as canonical log lines."""
    lookups.select(export_line().alias("value")).write.mode(mode).text(path)


def write_lines_by(
    lookups: DataFrame, by: Sequence[str], path: str, mode: str = "append", compression: str = "gzip"
) -> None:
    """Log lines in one folder per value of ``by``, e.g. per site or per (site, look-alike).

    Gzip checks its own content, so on local disks such files get no second file of checksums: that
    takes longer than the few lines of a small folder.
    """
    rows = lookups.select(*by, export_line().alias("value"))
    options = _NO_SUMS if compression == "gzip" else {}
    with scratch(lookups.sparkSession):
        _gathered(rows, by).write.mode(mode).options(compression=compression, **options).partitionBy(*by).text(path)


def read_lines_by(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """Lines that ``write_lines_by`` wrote, as ``value``, with the folders' values as text.

    Spark lists one folder per task up to 10,000 of them; a task of its own takes longer than
    the listing, so a task gets many folders here. Reading deals a few small files to a task, so
    such tasks are joined, to as many as the lines' bytes fill.
    """
    least = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    tasks = str(least)
    listing = {f"{_SOURCES}.parallelPartitionDiscovery.parallelism": tasks, f"{_SOURCES}.partitionColumnTypeInference.enabled": "false"}
    with settings(spark, listing):  # folders are listed here, lines are read later
        lines = spark.read.text(path)
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return lines.coalesce(max(least, size // BYTES_PER_TASK)).select(*by, "value")


def write_table_by(df: DataFrame, by: Sequence[str], path: str, mode: str = "append") -> None:
    """Typed rows in one Parquet folder per value of ``by``; later readers prune on it."""
    with scratch(df.sparkSession):
        _gathered(df, by).write.mode(mode).partitionBy(*by).parquet(path)


def write_status_pairs(pairs: DataFrame, path: str, mode: str = "overwrite", compression: str = "gzip") -> None:
    """Status pairs as CSV under ``status=existed`` and ``status=nonexisted``.

    Pairs far outnumber the lookups they are made of, so they are neither shuffled nor sorted
    by folder: each folder is written from the tasks that make its pairs, and the choice of the
    folder moves below the join. Lines of one second repeat most of their text.
    """
    existed = F.coalesce(F.col("exists"), F.lit(False))
    for status, chosen in (("existed", existed), ("nonexisted", ~existed)):
        rows = pairs.where(chosen).select("typo", "typo_ts", "target", "target_ts", "net16")
        rows.write.mode(mode).option("compression", compression).csv(f"{path}/status={status}")


def split_lists_by_first(lines: DataFrame, path: str, line: str = "line", mode: str = "overwrite") -> None:
    """A file of ``target name name ...`` lines cut into one folder per target.

    Lines without a second name give no output.
    """
    names = F.split(F.trim(F.col(line)), " +")
    rows = lines.where(F.size(names) > 1).select(
        F.get(names, F.lit(0)).alias("target"), F.trim(F.col(line)).alias("value")
    )
    with scratch(lines.sparkSession):
        _gathered(rows, ["target"]).write.mode(mode).partitionBy("target").text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path)


def pair_lines(pairs: DataFrame) -> DataFrame:
    """Text form ``look-alike;;target`` of pairs that carry both lookups as text or as structs.

    A lookup is in many pairs of a busy log: where pairs are made for this, ``lines`` of the pair
    operators makes its text before them.
    """
    halves = [
        F.col(f"{side}_line") if f"{side}_line" in pairs.columns else export_line(F.col(f"{side}_record"))
        for side in ("typo", "target")
    ]
    return pairs.select(F.concat_ws(";;", *halves).alias("line"))


def sorted_log(lookups: DataFrame, partitions: int, ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """Time order across partitions: each partition holds one time range, sorted within.

    ``ties`` order rows of the same second and let a second with very many rows be cut.
    """
    keys = [ts, *ties]
    return lookups.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
