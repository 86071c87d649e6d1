"""Hand-worked values for reading, names, distances and candidates."""

import pytest
from pyspark.sql import functions as F

from nearname.functions import names as N
from nearname.functions import timing
from nearname.functions.distance import keyboard_osa, l2, osa
from nearname.functions.keyboard import qwerty_edges, read_key_adjacency
from nearname.functions.records import answer_ttl, export_line
from nearname.operators.candidates import typo_candidates
from nearname.sources.lists import parse_candidate_lines, parse_features, parse_zone, read_sites
from nearname.sources.logs import lookups_of, parse_lines, rejects_of

SOA = (
    "1700000500,0,192.0.2.7,198.51.100.4,mx.shop.example.,28,0,0,1,11,shop.example.,7200,IN,SOA,"
    "dns.shop.example.,admin.shop.example.,77,900,300,60000,120,0"
)
LINES = {
    "plain": "1700000001,0,192.0.2.1,198.51.100.2,blog.example.org.,1,5,0,0,0",
    "soa": SOA,
    "answer": "1700000009,0,192.0.2.1,203.0.113.9,Img.Example.NET.,1,0,1,5,img.example.net.,450,IN,A,203.0.113.80,0,0",
    "comma": "1700000040,0,192.0.2.3,198.51.100.8,Part=1,two.example.com.,1,2,0,0,0",
    "escaped": "1700000041,0,192.0.2.3,198.51.100.8,!\\009My\\009Host(X),.example.com.,1,2,0,0,0",
    "quoted": '5,0,a,b,"x,y,Z.com.",1,2,0,0,0',
    "lone_quote": '5,0,a,b,",y",1,2,0,0,0',
    "bad_count": "5,0,a,b,n.com.,1,2,x,0,0",
    "zero_row": "5,0,a,b,n.com.,1,2,1,0,0,0",
    "cut_last": "5,0,a,b,n.com.,1,2,0,0,1,5,n.com.,30,IN",
    "cut_early": "5,0,a,b,n.com.,1,2,0,0,2,5,n.com.,30,IN",
    "short_row": "5,,0,a,b,n.com.,1,2,,1,2,o.com.,30,0,0,,",
    "no_sections": "5,0,a,b,n.com.,1,2",
    "negative_rows": "5,0,a,b,n.com.,1,2,-1,0,0",
    "negative_cols": "5,0,a,b,n.com.,1,2,1,-5,0,0",
    "huge_number": "5,0,a,b,n.com.,1,2,1,5,n.com.,9999999999999999999999,IN,A,1.1.1.1,0,0",
    "spaced": "5,0,a,b,n.com.,1,2, 1,0,0",
}
REJECTS = {
    "two_commas": "5,0,a,b,n,m,o.com.,1,2,0,0,0",
    "bad_ts": "z,0,a,b,n.com.,1,2,0,0,0",
    "empty": "",
    "short": "5,0,a",
    "open_quote": '5,0,a,b,"n.com.,1,2,0,0,0',
    "decimal_ts": "5.0,0,a,b,n.com.,1,2,0,0,0",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [*LINES.items(), *REJECTS.items()]
    frame = parse_lines(spark.createDataFrame(rows, "key string, line string"), keep=["key"])
    return frame.cache()


def test_parse(parsed):
    rows = {r["key"]: r for r in lookups_of(parsed, ["key"]).withColumns({"ttl": answer_ttl(), "out": export_line()}).collect()}
    assert set(rows) == set(LINES)
    name = {k: r["qname"] for k, r in rows.items()}
    assert name["comma"] == "part=1two.example.com."
    assert name["escaped"] == "!\\009my\\009host(x).example.com."
    assert name["quoted"] == '"x,y,z.com."'
    assert name["lone_quote"] == '",y"'
    assert (rows["plain"]["qtype"], rows["plain"]["rcode"]) == (1, 5)
    assert rows["answer"]["qname"] == "img.example.net." and rows["answer"]["ttl"] == 450
    assert tuple(rows["answer"]["answer"][0]) == ("img.example.net.", "450", "IN", "A", "203.0.113.80")
    soa = rows["soa"]["authority"][0]
    assert soa["rdata"] == "dns.shop.example.;admin.shop.example.;77;900;300;60000;120"
    assert rows["soa"]["ttl"] == 0
    assert rows["soa"]["out"] == SOA.replace("1,11,", "1,5,").replace(
        "dns.shop.example.,admin.shop.example.,77,900,300,60000,120", soa["rdata"]
    )
    for key in ("plain", "bad_count", "zero_row", "cut_early", "no_sections", "negative_rows", "negative_cols", "spaced"):
        assert rows[key]["answer"] == rows[key]["authority"] == rows[key]["additional"] == [], key
    assert tuple(rows["cut_last"]["additional"][0]) == ("n.com.", "30", "IN", "", None)
    assert tuple(rows["short_row"]["answer"][0]) == ("o.com.", "30", "", None, None)
    assert rows["short_row"]["out"].endswith(",1,3,o.com.,30,,0,0")
    assert rows["huge_number"]["ttl"] == 0 and len(rows["huge_number"]["answer"]) == 1


def test_rejects(parsed):
    reasons = {r["key"]: r["reason"] for r in rejects_of(parsed, keep=["key"]).collect()}
    assert reasons == {
        "two_commas": "query type or result code is no number",
        "bad_ts": "time or type is no number",
        "empty": "too few fields",
        "short": "too few fields",
        "open_quote": "quote not closed",
        "decimal_ts": "time or type is no number",
    }


def test_name_suffix(spark):
    want = {
        "google.com.": "google.com.",
        "www.google.com.": "www.google.com.",
        "a.www.google.com.": "www.google.com.",
        "a.b.c.google.com.": "c.google.com.",
        "google.com": "google.com.",
        "a.b.google.com": "a.b.google.com",
        "com.": "com.",
        ".": ".",
    }
    rows = spark.createDataFrame([(n, "google.com.") for n in want], "n string, r string")
    got = {r["n"]: r["s"] for r in rows.select("n", N.name_suffix("n", "r").alias("s")).collect()}
    assert got == want
    one = rows.where("n = 'www.google.com.'").select(N.name_suffix("n", "r", extra_labels=0).alias("s")).first()
    assert one["s"] == "google.com."


def test_addresses(spark):
    rows = spark.createDataFrame([("10.1.2.3", "10.1.9.9"), ("::1", "::1"), ("1.2.3", "1.2.3")], "a string, b string")
    got = rows.select(N.net16("a").alias("n"), N.same_net16("a", "b").alias("s")).collect()
    assert [tuple(r) for r in got] == [("10.1.0.0", True), (None, False), (None, False)]
    servers = spark.createDataFrame([("a.gtld-servers.net.",), ("N.GTLD-SERVERS.NET.",), (None,)], "s string")
    assert [r[0] for r in servers.select(N.is_registry_server("s")).collect()] == [True, False, False]


def test_distances(spark):
    want = [
        ("google.com.", "google.com.", 0, 0.0),
        ("gogle.com.", "google.com.", 1, 1.0),
        ("googel.com.", "google.com.", 1, 1.0),
        ("hoogle.com.", "google.com.", 1, 0.5),
        ("w.google.com.", "google.com.", 2, 2.0),
        ("www.google.com.", "google.com.", 4, 4.0),
        ("ca", "abc", 3, 3.0),
        ("tsett", "testvalues", 7, 6.5),
        ("j", ",", 1, 0.5),
        ("mat.com.", "hat.com.", 1, 0.5),
        (",", "j", 1, 1.0),
        ("", "ab", 2, 2.0),
    ]
    rows = spark.createDataFrame(want, "a string, b string, o int, k double")
    assert rows.where((osa("a", "b") != F.col("o")) | (keyboard_osa("a", "b") != F.col("k"))).count() == 0


def test_l2(spark):
    rows = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    assert rows.select(l2("a", "b")).first()[0] == 5.0
    with pytest.raises(Exception, match="differ in size"):
        rows.select(l2("a", F.array(F.lit(1.0)))).collect()


def test_keyboard(spark, tmp_path):
    edges = set(qwerty_edges())
    assert len({k for k, _ in edges}) == 56 and len(edges) == 340
    assert ("m", "h") in edges and sum((b, a) not in edges for a, b in edges) == 52
    assert ("j", ",") in edges and (",", "j") not in edges
    # The bracket key touches only one other bracket: its second neighbour token starts with ";".
    assert ("[", "]") in edges and ("]", "[") not in edges
    file = tmp_path / "keys"
    file.write_text("a q w a\n] - ;[ }\nv d c \n")
    got = {tuple(r) for r in read_key_adjacency(spark, str(file)).collect()}
    assert got == {("a", "q"), ("a", "w"), ("]", "-"), ("]", ";"), ("]", "}"), ("v", "d"), ("v", "c")}


def test_candidate_counts(spark):
    want = {
        "a.b": 214,
        "google.com": 646,
        "realtor.com": 710,
        "onlylady.com": 772,
        "getbootstrap.com": 1018,
        "pboxusercontent.com": 1206,
        "all-free-download.com": 1330,
    }
    rows = typo_candidates(spark.createDataFrame([(s,) for s in want], "site string"))
    assert {r["site"]: r["count"] for r in rows.groupBy("site").count().collect()} == want


def test_buckets(spark, tmp_path):
    first, last = 1354323600, 1354324800
    rows = spark.createDataFrame([(t,) for t in (0, first, first + 149, first + 750, last + 9)], "ts long")
    got = rows.select(timing.neighbour_buckets(F.col("ts"), first, last).alias("b"), timing.bucket_stamp(F.col("ts")).alias("s"))
    got = got.collect()
    assert [list(r["b"]) for r in got] == [
        [first, first + 300],
        [first, first + 300],
        [first, first + 300],
        [first + 600, first + 900, first + 1200],
        [last - 300, last],
    ]
    assert got[1]["s"] == "20121201.0100"
    table = rows.withColumn("bucket", timing.bucket_of(F.col("ts")))
    table.write.partitionBy("bucket").parquet(str(tmp_path / "t"))
    near = timing.around(spark.read.parquet(str(tmp_path / "t")), first + 10, first, last)
    assert sorted(r["ts"] for r in near.collect()) == [first, first + 149]
    assert "PartitionFilters: [bucket" in near._jdf.queryExecution().toString()


def test_lists(spark, tmp_path):
    file = tmp_path / "sites"
    file.write_text("Google.com\nqq.com\n\nbbc.co.uk.\n")
    assert [tuple(r) for r in read_sites(spark, str(file)).orderBy("rank").collect()] == [
        (1, "google.com."), (2, "qq.com."), (4, "bbc.co.uk."),
    ]
    (tmp_path / "tail").write_text("QQ.com\r\nlast.org")  # ranks go on over files, the best one stays
    assert [tuple(r) for r in read_sites(spark, [str(tmp_path / "tail"), str(file)]).orderBy("rank").collect()] == [
        (1, "google.com."), (2, "qq.com."), (4, "bbc.co.uk."), (6, "last.org."),
    ]
    with pytest.raises(ValueError, match="bytes"):
        read_sites(spark, str(file), most_bytes=10)
    lines = spark.createDataFrame([("t. a. t. b. ",), ("u.",)], "line string")
    assert {tuple(r) for r in parse_candidate_lines(lines).collect()} == {("t.", "a."), ("t.", "b.")}
    zone = spark.createDataFrame([("GOOGLE NS ns1",), ("X A 1",), (" NS y",), ("ALONE",)], "line string")
    assert [r["zone"] for r in parse_zone(zone).collect()] == ["GOOGLE"]
    vec = parse_features(spark.createDataFrame([("n", "1,2.5,-3e1")], "name string, text string")).first()
    assert list(vec["vec"]) == [1.0, 2.5, -30.0]
