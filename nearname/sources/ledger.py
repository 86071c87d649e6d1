"""Log files taken in from a manifest, with a ledger of what each file gave.

A manifest names files or globs. What is on it and not in the ledger is the work; it is taken
in rounds of a number of files. A round writes its rows to a folder of its own and then its
entry: one line per file with its size, rows and rejects. The entry is one folder, which counts
from the moment its job has ended (its ``_SUCCESS`` file), so a round is there as a whole or not
at all. Rows of a round without entry are never read and are replaced by the next attempt.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearname.functions.names import path_parent, path_tail
from nearname.session import small_table
from nearname.sources.logs import lookups_of, parse_lines, rejects_of

FILES_PER_ROUND = 1000
SLASHES = r"^([a-zA-Z][a-zA-Z0-9+.-]*):/+"
ENTRY = "file string, size long, rows long, rejects long"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root`` whose jobs have ended, in order."""
    at = _path(spark, root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.isDirectory()]
    return sorted(p.getName() for p in found if files.exists(_path(spark, f"{p}/_SUCCESS")))


def read_folders(spark: SparkSession, root: str, names: Iterable[str], ddl: str) -> DataFrame:
    """The given folders of a table, and no others, with the columns their names hold."""
    paths = [f"{root}/{n}" for n in names]
    if not paths:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("basePath", root).parquet(*paths)


def file_address() -> Column:
    """Address of the file a row comes from: decoded, one slash behind the scheme."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, SLASHES, "$1:/")


def _literal(path: str) -> str:
    """A path whose letters are no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def list_manifest(spark: SparkSession, entries: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """((file, size) of all files the entries name, entries that name none). An entry is a file, a
    folder or a glob; a file that several entries name comes once, and empty files come too. The
    driver holds one address per file, as it does for any table of files."""
    conf = spark._jsc.hadoopConfiguration()
    found: dict[str, int] = {}
    missing = []
    for entry in entries:
        at = _path(spark, entry)
        files = at.getFileSystem(conf)
        met = list(files.globStatus(at) or [])
        if not met:
            missing.append(entry)
        for status in met:
            for one in [status] if status.isFile() else [s for s in files.listStatus(status.getPath()) if s.isFile()]:
                if not one.getPath().getName().startswith((".", "_")):
                    found[re.sub(SLASHES, r"\1:/", one.getPath().toString())] = one.getLen()
    return small_table(spark, sorted(found.items()), "file string, size long"), missing


@dataclass
class Ledger:
    """The rows and the ledger under ``root``."""

    spark: SparkSession
    root: str

    def rounds(self) -> list[str]:
        return committed(self.spark, f"{self.root}/ledger")

    def entries(self) -> DataFrame:
        """(file, size, rows, rejects, round) of all files that are in."""
        return read_folders(self.spark, f"{self.root}/ledger", self.rounds(), f"{ENTRY}, round int")

    def pending(self, files: DataFrame) -> DataFrame:
        """The listed files that are not in."""
        return files.join(self.entries().select("file"), "file", "left_anti")

    def _parsed(self, kind: str) -> DataFrame | None:
        rounds = self.rounds()
        paths = [f"{self.root}/rows/{r}" for r in rounds]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.root}/rows").parquet(*paths).where(F.col("kind") == kind)

    def lookups(self) -> DataFrame | None:
        """Lookups of all files that are in, with ``file``; None before the first round."""
        rows = self._parsed("lookup")
        return None if rows is None else lookups_of(rows, keep=["file"])

    def rejects(self) -> DataFrame | None:
        rows = self._parsed("reject")
        return None if rows is None else rejects_of(rows, keep=["file"])

    def take(self, files: Sequence[tuple[str, int]]) -> None:
        """One round: the files' lines parsed once and written, then the round's entry."""
        spark, number = self.spark, len(self.rounds())
        rows = f"{self.root}/rows/round={number}"
        lines = spark.read.text([_literal(f) for f, _ in files]).select(F.col("value").alias("line"), file_address().alias("file"))
        parsed = parse_lines(lines, keep=["file"])
        bad = F.col("reject_reason").isNotNull()
        seen = Observation()
        kept = parsed.withColumn("line", F.when(bad, F.col("line"))).withColumn("kind", F.when(bad, "reject").otherwise("lookup"))
        counted = kept.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("rejects"))
        counted.write.mode("overwrite").partitionBy("kind").parquet(rows)
        lines_seen = seen.get["lines"]
        listed = small_table(spark, [(f, n) for f, n in files], "file string, size long")
        written = spark.read.schema("file string, kind string").parquet(rows) if lines_seen else spark.createDataFrame([], "file string, kind string")
        per_file = written.groupBy("file").agg(F.count_if(F.col("kind") == "lookup").alias("rows"), F.count_if(F.col("kind") == "reject").alias("rejects"))
        entry = listed.join(per_file, "file", "left").na.fill(0, ["rows", "rejects"]).select("file", "size", "rows", "rejects")
        total = entry.agg(F.sum(F.col("rows") + F.col("rejects"))).first()[0]
        if total != lines_seen:
            raise RuntimeError(f"round {number}: {lines_seen} lines read, {total} accounted for by file")
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/round={number}")


def ingest_manifest(spark: SparkSession, entries: Sequence[str], root: str, files_per_round: int = FILES_PER_ROUND) -> tuple[Ledger, list[str]]:
    """Takes in what the manifest names and the ledger lacks, round by round; returns the ledger
    and the entries that name no file yet. Run again after a failure, or with a longer manifest,
    it goes on where the ledger ends. The driver holds the addresses of one round."""
    ledger = Ledger(spark, root)
    files, missing = list_manifest(spark, entries)
    while todo := [tuple(r) for r in ledger.pending(files).orderBy("file").limit(files_per_round).collect()]:
        ledger.take(todo)
    return ledger, missing


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Entries of a manifest file, one a line."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def read_site_lines(spark: SparkSession, root: str, by: str = "folder") -> DataFrame:
    """(target, line) of files whose site is the name of their ``folder``, or their own name
    (``file``), written with or without the last dot. The folders need no ``column=value`` names."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    path = file_address()
    name = F.rtrim(path_parent(path) if by == "folder" else path_tail(path), F.lit("."))
    return lines.select(F.concat(F.lower(name), F.lit(".")).alias("target"), F.col("value").alias("line"))
