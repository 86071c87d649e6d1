"""Tables of very many small folders, and folders with very many rows."""

import re
from collections import Counter

from pyspark.sql import functions as F

from nearname.sources import sinks
from tests.test_brute_force import FIXTURE, as_log

MANY = 600


def files_of(path):
    """(folder, number of the task that wrote it) per file."""
    found = [(p.parent.name, re.match(r"part-(\d+)-", p.name)) for p in path.rglob("part-*")]
    return [(folder, int(part[1])) for folder, part in found]


def test_small_folders_are_written_and_listed_by_some_tasks(spark, tmp_path):
    log, out = as_log(spark, FIXTURE).limit(1), tmp_path / "typos"
    names = [f"1.{n}" for n in range(1, MANY + 1)]
    log = log.withColumn("typo", F.explode(F.array(*[F.lit(n) for n in names])))
    sinks.write_lines_by(log, ["target", "typo"], str(out))
    files = files_of(out)
    assert len(files) == MANY  # one file per folder
    # All these lines are few bytes, yet no task makes all the folders.
    assert max(Counter(part for _, part in files).values()) < 2 * sinks.FOLDERS_PER_TASK
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    lines = sinks.read_lines_by(spark, str(out), ["target", "typo"])
    stages = [s for j in set(tracker.getJobIdsForGroup(None)) - before for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= sinks.LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism < MANY
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    # Names that look like numbers stay as they are.
    assert {r["typo"] for r in lines.collect()} == set(names)
    assert lines.columns == ["target", "typo", "value"] and lines.select("value").distinct().count() == 1


def test_large_folders_are_cut(spark, tmp_path):
    rows = [("hot.", n, {"a": n}) for n in range(900)] + [(None, n, None) for n in range(450)] + [("cold.", 1, None)] * 3
    df = spark.createDataFrame(rows, "target string, n long, m map<string,long>")
    sinks._gathered(df, ["target"], most=100).write.partitionBy("target").parquet(str(tmp_path / "t"))
    files = Counter(folder for folder, _ in files_of(tmp_path / "t"))
    assert files["target=cold."] == 1 and 1 < files["target=hot."] <= 9
    assert 1 < files["target=__HIVE_DEFAULT_PARTITION__"] <= 5
    back = spark.read.parquet(str(tmp_path / "t")).groupBy("target").agg(F.count("*"), F.sum("n"), F.count("m"))
    assert {tuple(r) for r in back.collect()} == {("hot.", 900, 404550, 900), (None, 450, 101025, 0), ("cold.", 3, 3, 0)}


def test_no_rows_make_no_folder(spark, tmp_path):
    sinks.write_table_by(spark.createDataFrame([], "target string, n long"), ["target"], str(tmp_path / "t"))
    assert files_of(tmp_path / "t") == [] or {f for f, _ in files_of(tmp_path / "t")} == {"t"}


def test_gzip_lines_have_no_second_file_and_are_read_by_some_tasks(spark, tmp_path):
    log, out = as_log(spark, FIXTURE).limit(1), tmp_path / "typos"
    log = log.withColumn("typo", F.explode(F.array(*[F.lit(f"n{n}") for n in range(MANY)])))
    sinks.write_lines_by(log, ["typo"], str(out))
    sinks.write_lines_by(log, ["typo"], str(tmp_path / "plain"), compression="none")
    assert not list(out.rglob("typo=*/.*.crc")) and list((tmp_path / "plain").rglob("typo=*/.*.crc"))
    lines = sinks.read_lines_by(spark, str(out), ["typo"])
    assert lines.rdd.getNumPartitions() <= sinks.LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert lines.count() == lines.select("typo").distinct().count() == MANY
    sinks.write_lines_by(log, ["typo"], str(out))
    assert sinks.read_lines_by(spark, str(out), ["typo"]).count() == 2 * MANY
