"""The SQL functions give what the Column functions give."""

from pyspark.sql import functions as F

from nearname.functions import names as N
from nearname.functions.distance import keyboard_osa, osa
from nearname.functions.sql import register
from nearname.operators.candidates import typo_candidates


def test_sql_functions(spark):
    assert register(spark) == ["name_suffix", "net16", "osa_distance", "keyboard_distance", "typo_candidates"]
    words = ["google.com.", "gogle.com.", "googel.com.", "hoogle.com.", "a.www.google.com.", "ca", "abc", "j", ",", "'", "\\", ""]
    rows = spark.createDataFrame([(x, y) for x in words for y in words], "x string, y string")
    both = rows.selectExpr(
        "x", "y", "name_suffix(x, y) AS s", "osa_distance(x, y) AS o", "keyboard_distance(x, y) AS k"
    )
    wrong = (F.col("s") != N.name_suffix("x", "y")) | (F.col("o") != osa("x", "y")) | (F.col("k") != keyboard_osa("x", "y"))
    assert both.where(wrong).count() == 0
    assert spark.sql("SELECT net16('10.1.2.3'), net16('::1')").first() == ("10.1.0.0", None)


def test_table_function(spark):
    register(spark)
    rows = spark.createDataFrame([("a.b",), ("google.com",), ("x",), ("",), (None,), ("google.com",)], "site string")
    rows.createOrReplaceTempView("some_sites")
    got = spark.sql("SELECT DISTINCT site, candidate FROM some_sites, LATERAL typo_candidates(site)")
    want = typo_candidates(rows.where("site IS NOT NULL"), "site")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.groupBy("site").count().where("site = 'a.b'").first()["count"] == 214
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the names are expanded where they lie
