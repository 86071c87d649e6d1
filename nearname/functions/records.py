"""Expressions over resource records and the text form of a lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.schema import RR_FIELDS, SECTIONS


def answer_ttl(qname: str | Column = "qname") -> Column:
    """TTL of the first A record owned by the queried name, searched through the answer,
    authority and additional sections in that order; 0 when there is none."""
    qname = F.col(qname) if isinstance(qname, str) else qname
    records = F.concat(*[F.col(s) for s in SECTIONS])
    own = F.filter(records, lambda r: (r["owner"] == qname) & (r["rtype"] == "A"))
    return F.coalesce(F.get(own, F.lit(0))["ttl"].try_cast("bigint"), F.lit(0).cast("bigint"))


def first_answer_ttl(answer: str = "answer") -> Column:
    """TTL of the first record of the answer section, NULL when the section is empty."""
    return F.get(F.col(answer), F.lit(0))["ttl"].try_cast("bigint")


def _record_text(r: Column) -> Column:
    # A record cut short while reading has NULL in its last places: those were never there.
    values = F.array_compact(F.array(*[r[f] for f in RR_FIELDS]))
    return F.concat_ws(",", F.size(values).cast("string"), values)


def export_line(record: Column | None = None) -> Column:
    """Canonical CSV line of a lookup: the inverse of the log reader.

    Takes the lookup's fields from the row, or from the struct ``record``.
    """

    def field(name: str) -> Column:
        return F.col(name) if record is None else record[name]

    parts = [field(c).cast("string") for c in ("ts", "typ", "src_ip", "dst_ip", "qname", "qtype", "rcode")]
    for section in SECTIONS:
        parts.append(F.size(field(section)).cast("string"))
        parts.append(F.transform(field(section), _record_text))
    return F.concat_ws(",", *parts)


def explode_records(lookups: DataFrame, keep: list[str]) -> DataFrame:
    """One row per resource record with its section and 0-based position, TTL typed."""

    def tagged(section: str) -> Column:
        return F.transform(
            F.col(section), lambda r, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), r.alias("rr"))
        )

    rows = lookups.select(*keep, F.explode(F.concat(*[tagged(s) for s in SECTIONS])).alias("_r"))
    return rows.select(
        *keep,
        F.col("_r.section").alias("section"),
        F.col("_r.pos").alias("pos"),
        F.col("_r.rr.owner").alias("owner"),
        F.col("_r.rr.ttl").try_cast("bigint").alias("ttl"),
        *[F.col(f"_r.rr.{f}").alias(f) for f in ("rclass", "rtype", "rdata")],
    )
