"""List-like inputs: watch-lists, zone files, candidate lists, pair files, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearname.functions.names import with_dot
from nearname.operators.ordered import with_place
from nearname.schema import RATIO, RATIO_STATUS, STATUS_PAIR, TYPO_STATS
from nearname.session import small_table
from nearname.sources.logs import lookups_of, parse_lines

MOST_LIST_BYTES = 64 << 20  # of a file that one task reads whole


def site_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Watch-list given as names in rank order."""
    rows = [(rank, name) for rank, name in enumerate(names, start=1)]
    return small_table(spark, rows, "rank int, name string").select("rank", with_dot(F.lower("name")).alias("site"))


def read_sites(spark: SparkSession, paths: str | Sequence[str], most_bytes: int = MOST_LIST_BYTES) -> DataFrame:
    """Watch-list from text files, one site per line; ranks follow the files by their paths and
    the lines in each. Lines without a name keep their number. The best rank of a site stays.

    ``wholetext`` makes one row of a file, so ranks follow the lines whatever the file size the
    planner would split at. A watch-list is a hand-kept file of some thousand names; one beyond
    ``most_bytes`` is an error.
    """
    files = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    # The size comes with the listing, so the check reads no text.
    listed = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    for f in listed.where(F.col("bytes") > most_bytes).take(1):
        raise ValueError(f"{f['file']} has {f['bytes']} bytes, a watch-list has {most_bytes} at most")
    # A line break that ends the file begins no line.
    text = F.regexp_replace("value", r"\r?\n\z", "")
    lines = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(text, r"\r?\n")).alias("pos", "name"))
    ranked = with_place(lines.withColumn("name", F.trim("name")), "file", "pos", name="rank")
    named = ranked.where(F.col("name") != "").select(F.col("rank").cast("int").alias("rank"), with_dot(F.lower("name")).alias("site"))
    return named.groupBy("site").agg(F.min("rank").alias("rank")).select("rank", "site")


def parse_zone(lines: DataFrame, line: str = "line") -> DataFrame:
    """First field of zone-file lines whose second field is ``NS``."""
    fields = F.split(F.col(line), " ")
    return lines.where((F.size(fields) > 1) & (F.get(fields, F.lit(1)) == "NS") & (F.get(fields, F.lit(0)) != "")).select(
        F.get(fields, F.lit(0)).alias("zone")
    )


def read_zone(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_zone(spark.read.text(paths if isinstance(paths, str) else list(paths)), "value")


def parse_candidate_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``target candidate candidate ...`` lines as (target, candidate) rows."""
    names = lines.select(F.filter(F.split(F.col(line), " "), lambda n: n != "").alias("n")).where(F.size("n") > 1)
    return names.select(
        F.get("n", F.lit(0)).alias("target"), F.explode(F.slice("n", 2, F.size("n"))).alias("candidate")
    ).where(F.col("candidate") != F.col("target"))


def read_candidates(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_candidate_lines(spark.read.text(paths if isinstance(paths, str) else list(paths)), "value")


def parse_pair_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``look-alike;;target`` lines as two lookup structs, ``typo`` and ``target``.

    Lines whose halves are no lookups are left out, as unusable log lines are. Record data may
    itself end in ``;``, so the cut is at the last ``;;`` that a new lookup follows.
    """
    cut = r"^(.*);;([+-]?[0-9]+,[+-]?[0-9]+,.*)$"
    halves = lines.select(
        F.regexp_extract(F.col(line), cut, 1).alias("a"), F.regexp_extract(F.col(line), cut, 2).alias("b")
    )
    first = parse_lines(halves, "a", keep=["b"])
    first = lookups_of(first, keep=["b"])
    names = [c for c in first.columns if c != "b"]
    first = first.select("b", F.struct(*names).alias("typo"))
    second = lookups_of(parse_lines(first, "b", keep=["typo"]), keep=["typo"])
    return second.select("typo", F.struct(*names).alias("target"))


def read_pairs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_pair_lines(spark.read.text(paths if isinstance(paths, str) else list(paths)), "value")


def _read_csv(spark: SparkSession, paths, schema) -> DataFrame:
    return spark.read.schema(schema).csv(paths if isinstance(paths, str) else list(paths))


def read_ratios(spark: SparkSession, paths: str | Sequence[str], with_status: bool = False) -> DataFrame:
    return _read_csv(spark, paths, RATIO_STATUS if with_status else RATIO)


def read_status_pairs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _read_csv(spark, paths, STATUS_PAIR)


def read_typo_stats(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _read_csv(spark, paths, TYPO_STATS)


def parse_features(rows: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, comma-separated numbers) rows as named vectors."""
    return rows.select(
        F.col(name).alias("name"), F.transform(F.split(F.col(text), ","), lambda v: v.cast("double")).alias("vec")
    )


def read_features(spark: SparkSession, paths: str | Sequence[str], sep: str = "\t") -> DataFrame:
    """Named vectors from text lines ``name<sep>v1,v2,...``."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    parts = F.split("value", sep, 2)
    return parse_features(lines.select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("text")))
