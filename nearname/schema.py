"""Record layouts shared by the sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

# One resource record. ``ttl`` stays as logged; readers cast it when they use it.
RR = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("ttl", T.StringType()),
        T.StructField("rclass", T.StringType()),
        T.StructField("rtype", T.StringType()),
        T.StructField("rdata", T.StringType()),
    ]
)
RR_FIELDS = [f.name for f in RR.fields]
SECTIONS = ["answer", "authority", "additional"]

LOOKUP = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("typ", T.IntegerType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("qname", T.StringType()),
        T.StructField("qtype", T.IntegerType()),
        T.StructField("rcode", T.IntegerType()),
        *[T.StructField(s, T.ArrayType(RR)) for s in SECTIONS],
    ]
)

RATIO = T.StructType(
    [
        T.StructField("typo", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("join_count", T.LongType()),
        T.StructField("single_count", T.LongType()),
    ]
)
RATIO_STATUS = T.StructType([*RATIO.fields, T.StructField("status", T.StringType())])

STATUS_PAIR = T.StructType(
    [
        T.StructField("typo", T.StringType()),
        T.StructField("typo_ts", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("target_ts", T.LongType()),
        T.StructField("net16", T.StringType()),
    ]
)

TYPO_STATS = T.StructType(
    [
        T.StructField("typo", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("single_count", T.LongType()),
        T.StructField("pair_count", T.LongType()),
        T.StructField("mean_delay", T.DoubleType()),
        T.StructField("exists", T.BooleanType()),
    ]
)
