"""Lookups derived from an ``events`` table.

Test data sets hold no resolver log, so each event becomes one lookup by fixed rules: the
event type picks the kind of name (correct, letter dropped, letters swapped, sub-domain,
unrelated), ids pick site, network and letter, and the event's minute is the lookup's second.
Everything is a row-wise expression over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearname.functions.once import once
from nearname.functions.records import export_line
from nearname.sources.lists import site_table

# The watched sites in rank order, and the names that count as popular.
SITES = ["google.com", "wikipedia.org", "bbc.co.uk", "stackoverflow.com"]
POPULAR = [*SITES, "gogle.com", "wikpiedia.org", "example.org"]

_RECORDS = "array<struct<owner:string,ttl:string,rclass:string,rtype:string,rdata:string>>"


def _rr(owner: str, ttl: str, rtype: str, rdata: str) -> str:
    return (
        f"named_struct('owner', {owner}, 'ttl', string({ttl}), 'rclass', 'IN', 'rtype', '{rtype}', 'rdata', {rdata})"
    )


def _array(*records: str) -> str:
    return f"cast(array({', '.join(records)}) AS {_RECORDS})"


_OWN = _rr("qname", "v", "A", "'192.0.2.' || (u % 250)")
_ALIAS = _rr("'alias.' || qname", "30", "CNAME", "qname")
_MAIL = _rr("qname", "v", "MX", "'10 mail.' || qname")
_OWN_SERVER = _rr("target", "172800", "NS", "'ns1.' || target")
_REGISTRY_START = _rr("'com.'", "900", "SOA", "'a.gtld-servers.net.;nstld.example.net.;2024'")
_REGISTRY_SERVER = _rr("'com.'", "172800", "NS", "'b.gtld-servers.net.'")
_OTHER_SERVER = _rr("target", "172800", "NS", "'ns9.parking.example.net.'")
_GLUE = _rr("'ns1.' || target", "300", "A", "'192.0.2.1'")
_LATE = _rr("qname", "v + 1", "A", "'192.0.2.2'")

# Names by kind of event; p is the place of the letter that is dropped or swapped.
_QNAME = """CASE k
    WHEN 'click' THEN target
    WHEN 'error' THEN concat(substr(target, 1, p - 1), substr(target, p + 1))
    WHEN 'view' THEN concat(substr(target, 1, p - 1), substr(target, p + 1, 1), substr(target, p, 1), substr(target, p + 2))
    WHEN 'signup' THEN concat(CASE u % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'w.' ELSE 'a.www.' END, target)
    ELSE CASE WHEN u % 4 = 0 THEN replace(target, '.com.', '.ocm.') ELSE concat('cdn', u, '.example.net.') END
  END"""
_ANSWERED = """CASE k WHEN 'click' THEN e % 5 <> 0 WHEN 'signup' THEN e % 2 = 0 WHEN 'purchase' THEN false
    ELSE u % 2 = 0 AND e % 3 = 0 END"""
_ANSWER = f"""CASE WHEN answered AND e % 7 = 1 THEN {_array(_ALIAS, _OWN)} WHEN answered THEN {_array(_OWN)}
    WHEN k = 'view' AND u % 4 = 3 AND e % 6 = 0 THEN {_array(_MAIL)} ELSE {_array()} END"""
_AUTHORITY = f"""CASE WHEN answered AND e % 3 = 0 THEN {_array(_OWN_SERVER)} WHEN answered THEN {_array()}
    WHEN k = 'error' AND u % 4 = 1 AND e % 2 = 0 THEN {_array(_REGISTRY_START)}
    WHEN k = 'view' AND u % 4 = 1 THEN {_array(_REGISTRY_SERVER, _OTHER_SERVER)}
    WHEN e % 3 = 0 THEN {_array()} ELSE {_array(_OTHER_SERVER, _REGISTRY_SERVER)} END"""
_ADDITIONAL = f"""CASE WHEN k = 'purchase' AND e % 9 = 0 THEN {_array(_GLUE, _LATE)}
    WHEN e % 6 = 0 THEN {_array(_GLUE)} ELSE {_array()} END"""


def watched_sites(spark: SparkSession) -> DataFrame:
    return site_table(spark, SITES)


def popular_sites(spark: SparkSession) -> DataFrame:
    return site_table(spark, POPULAR)


def lookups_from_events(events: DataFrame) -> DataFrame:
    """Lookups with ``lookup_id`` and the watched site ``target`` each belongs to.

    Times come from calendar parts, which is right for zone-less timestamps under any session
    time zone.
    """
    sites = ", ".join(f"'{s}.'" for s in SITES)
    base = events.selectExpr(
        "event_id AS e",
        "user_id AS u",
        "event_type AS k",
        "bigint(floor(value)) AS v",
        "int(user_id % 4 + 2) AS p",
        "bigint(unix_date(date(ts))) * 1440 + hour(ts) * 60 + minute(ts) AS ts",
        f"array({sites})[int(event_id % {len(SITES)})] AS target",
    )
    named = once(base, "qname", F.expr(_QNAME)).selectExpr("*", f"{_ANSWERED} AS answered")
    return named.selectExpr(
        "e AS lookup_id",
        "ts",
        "0 AS typ",
        """CASE WHEN u % 11 = 0 THEN concat('2001:db8::', u)
           ELSE concat_ws('.', '10', u % 8, u % 250, e % 200) END AS src_ip""",
        "concat('192.0.2.', u % 5) AS dst_ip",
        "qname",
        "CASE WHEN e % 7 = 0 THEN 28 ELSE 1 END AS qtype",
        "CASE WHEN k = 'purchase' THEN 3 ELSE 0 END AS rcode",
        f"{_ANSWER} AS answer",
        f"{_AUTHORITY} AS authority",
        f"{_ADDITIONAL} AS additional",
        "target",
    )


def log_lines_from_events(events: DataFrame) -> DataFrame:
    """Raw lines of these lookups, some of them damaged the way real logs are.

    By ``event_id``: names in capitals, one stray comma in the name, quoted names, doubled
    separators, broken section counts, unusable times, names with two commas.
    """
    rows = lookups_from_events(events)
    e, name = F.col("lookup_id"), F.col("qname")
    damaged = (
        F.when(e % 16 == 3, F.upper(name))
        .when(e % 16 == 5, F.concat(F.lit("x="), F.col("typ").cast("string"), F.lit(","), name))
        .when(e % 16 == 7, F.concat(F.lit('"a,b,'), name, F.lit('"')))
        .when(e % 16 == 11, F.concat(F.lit("a,b,"), name))
        .otherwise(name)
    )
    line = export_line()
    head = F.concat_ws(",", "ts", "typ", "src_ip", "dst_ip")
    rows = once(rows, "clean", line).select("lookup_id", "clean", head.alias("head"), name.alias("name"), damaged.alias("damaged"))
    tail = F.substring(F.col("clean"), F.length("head") + F.length("name") + 2, F.length("clean"))
    line = (
        F.when(e % 16 == 9, F.replace(F.col("clean"), F.lit(","), F.lit(",,")))
        .when(e % 16 == 13, F.concat(F.lit("x"), F.col("clean")))
        .when(e % 16 == 15, F.concat(F.col("head"), F.lit(","), F.col("name"), F.lit(",1,0,1,5,cut.,30")))
        .otherwise(F.concat(F.col("head"), F.lit(","), F.col("damaged"), tail))
    )
    return once(rows, "line", line).select("lookup_id", "line")
