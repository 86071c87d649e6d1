"""Raw resolver logs: text lines to typed lookups with nested resource records.

A line is ``ts,type,src,dst,qname,qtype,rcode`` followed by three sections. A section is a
row count, then per row a column count and that many values. The reader works on one token
array per line and never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearname.functions.once import once
from nearname.schema import LOOKUP, RR_FIELDS, SECTIONS

HEADER_TOKENS = 4  # ts, type, src, dst come before the name


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    name_glob: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Log lines of one or many paths or globs; gzip is handled by the text source."""
    reader = spark.read
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.text(paths if isinstance(paths, str) else list(paths)).select(F.col("value").alias("line"))


def _integer(token: Column, kind: str) -> Column:
    """Value of a token that is a plain integer, else NULL. The pattern comes first because a
    failing cast costs an exception, and casts forgive blanks and decimals."""
    return F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast(kind))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, through a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _record(values: Column) -> Column:
    """A resource record from the values of one row.

    Values past the fourth are joined with ``;``. A row of fewer than four values is followed
    by one empty value and has NULL in the places after that.
    """
    count = F.size(values)
    fields = []
    for at, name in enumerate(RR_FIELDS[:4]):
        fields.append(F.when(count > at, F.get(values, F.lit(at))).when(count == at, F.lit("")).alias(name))
    rest = F.when(count == 5, F.get(values, F.lit(4))).otherwise(
        F.array_join(F.slice(values, 5, F.greatest(count, F.lit(1))), ";")
    )
    fields.append(F.when(count >= 4, rest).alias(RR_FIELDS[4]))
    return F.struct(*fields)


def _rows(tokens: Column) -> Column:
    """Where the rows of the three sections lie, found in one pass over the tokens.

    The state is a cursor: ``next`` is where the next count stands, tokens before it are
    skipped; ``section`` is the section being read (3 when all are done) and ``left`` how many
    of its rows are still to come. Any irregularity sets ``bad`` and leaves no rows at all.
    """
    kind = "array<struct<section:int,start:int,size:int>>"
    none = F.array().cast(kind)
    fields = {"next": "bigint", "section": "int", "left": "int", "bad": "boolean", "out": kind}

    def state(**values: Column) -> Column:
        return F.struct(*[values[f].cast(t).alias(f) for f, t in fields.items()])

    start = state(next=F.lit(0), section=F.lit(0), left=F.lit(0), bad=F.lit(False), out=none)

    def step(acc: Column, at: Column) -> Column:
        def moved(**changes: Column) -> Column:
            return state(**{f: changes.get(f, acc[f]) for f in fields})

        # After a row, the section moves on once its last row is read.
        left = acc["left"] - 1
        section = acc["section"] + F.when(left == 0, 1).otherwise(0)

        def read(value: Column) -> Column:
            row = F.struct(acc["section"].alias("section"), (at + 2).alias("start"), value.alias("size"))
            return (
                F.when(value.isNull(), moved(bad=F.lit(True)))
                .when((acc["left"] == 0) & (value > 0), moved(next=at + 1, left=value))
                .when(acc["left"] == 0, moved(next=at + 1, section=acc["section"] + 1))
                .when(value < 0, moved(bad=F.lit(True)))
                .when(value == 0, moved(next=at + 1, section=section, left=left))
                .otherwise(
                    moved(
                        next=at.cast("bigint") + 1 + value,
                        section=section,
                        left=left,
                        out=F.array_append(acc["out"], row),
                    )
                )
            )

        skip = (at < acc["next"]) | acc["bad"] | (acc["section"] == 3)
        return F.when(skip, acc).otherwise(_let(_integer(F.get(tokens, at), "int"), read))

    def finish(acc: Column) -> Column:
        return F.when(~acc["bad"] & (acc["section"] == 3), acc["out"]).otherwise(none)

    return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, finish)


def _section(tokens: Column, rows: Column, number: int) -> Column:
    """Records of one section."""

    def record(row: Column) -> Column:
        return _let(F.slice(tokens, row["start"], F.least(row["size"], F.size(tokens))), _record)

    return F.transform(F.filter(rows, lambda r: r["section"] == number), record)


def parse_lines(lines: DataFrame, line: str = "line", keep: Sequence[str] = (), sections: bool = True) -> DataFrame:
    """All lines with their parsed fields and, for unusable lines, a ``reject_reason``.

    Runs of commas count as one separator. A name may be quoted and then hold commas; a name
    with one stray comma is put together again without it when its type field would otherwise
    be no number. ``keep`` carries further columns of the input along. Counts, names and rejects
    need the header alone: without ``sections`` the records are neither looked for nor returned.
    """
    keep = [*keep, line]
    # Tokens, header and rows are each computed once; what follows only picks from them.
    rows = once(lines.select(*keep), "t", F.split(F.trim(F.col(line), F.lit(",")), ",+"))
    rows = once(rows, "p", _places())
    rows = once(rows, "num", F.transform(F.col("p.asked"), lambda token: _integer(token, "bigint")))
    rows = once(rows, "h", _header())
    usable = F.col("h.reason").isNull()

    def token(i: int) -> Column:
        return F.get("t", F.lit(i))

    header = [
        *keep,
        F.get("num", F.lit(0)).alias("ts"),
        F.when(usable, F.get("num", F.lit(1)).cast("int")).alias("typ"),
        token(2).alias("src_ip"),
        token(3).alias("dst_ip"),
        F.lower("h.name").alias("qname"),
        F.when(usable, F.get("num", F.col("h.number_at")).cast("int")).alias("qtype"),
        F.when(usable, F.get("num", F.col("h.number_at") + 1).cast("int")).alias("rcode"),
        F.col("h.reason").alias("reject_reason"),
    ]
    if not sections:
        return rows.select(*header)
    rows = once(rows, "body", F.when(usable, F.slice("t", F.col("h.type_at") + 3, F.size("t"))))
    # Most lookups carry no records at all, and a line may end before its sections.
    empty = (F.size("body") == 0) | (F.array_join(F.slice("body", 1, 3), ",") == "0,0,0")
    rows = once(rows, "found", F.when(usable & ~empty, _rows(F.col("body"))))
    nothing = F.array().cast(LOOKUP["answer"].dataType)
    return rows.select(
        *header,
        *[
            F.when(usable, F.coalesce(_section(F.col("body"), F.col("found"), n), nothing)).alias(s)
            for n, s in enumerate(SECTIONS)
        ],
    )


def _places() -> Column:
    """Where the name ends and the query type stands, and the tokens that should be numbers:
    time, type, query type and result code, and the two places these move to when the name
    holds one stray comma."""

    def token(i) -> Column:
        return F.get("t", i if isinstance(i, Column) else F.lit(i))

    quoted = F.coalesce(token(4).startswith('"'), F.lit(False))
    closes = F.filter(
        F.sequence(F.lit(4), F.size("t") - 1),
        lambda i: token(i).endswith('"') & ~token(i).endswith('""') & ~((i == 4) & (F.length(token(i)) == 1)),
    )
    close = F.when(quoted, F.get(closes, F.lit(0)))
    at = F.when(quoted, close + 1).otherwise(F.lit(5))
    asked = F.array(token(0), token(1), token(at), token(at + 1), token(6), token(7))
    return F.struct(quoted.alias("quoted"), close.alias("close"), at.alias("at"), asked.alias("asked"))


def _header() -> Column:
    """Name, place of the query type, and the reason to reject."""

    def given(i: int) -> Column:
        return F.get("p.asked", F.lit(i)).isNotNull()

    def is_int(i: int) -> Column:
        return F.coalesce(F.get("num", F.lit(i)).between(-(1 << 31), (1 << 31) - 1), F.lit(False))

    def token(i: int) -> Column:
        return F.get("t", F.lit(i))

    quoted, close, at = F.col("p.quoted"), F.col("p.close"), F.col("p.at")
    numbered = F.get("num", F.lit(0)).isNotNull() & is_int(1)
    plain = numbered & is_int(2) & is_int(3)
    # The repair applies where a number field was there but was no number.
    unreadable = (given(2) & ~is_int(2)) | (given(3) & is_int(2) & ~is_int(3))
    repaired = numbered & unreadable & is_int(4) & is_int(5)
    name = F.when(quoted, F.array_join(F.slice("t", 5, close - 3), ",")).otherwise(token(4))
    reason = (
        F.when(F.size("t") < 7, F.lit("too few fields"))
        .when(~numbered, F.lit("time or type is no number"))
        .when(quoted & close.isNull(), F.lit("quote not closed"))
        .otherwise(F.lit("query type or result code is no number"))
    )

    def header(name=None, type_at=None, number_at=None, reason=None) -> Column:
        values = {"name": (name, "string"), "type_at": (type_at, "int"), "number_at": (number_at, "int"), "reason": (reason, "string")}
        return F.struct(
            *[(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for n, (v, t) in values.items()]
        )

    return (
        F.when(plain, header(name, at, 2))
        .when(repaired, header(F.concat(token(4), token(5)), 6, 4))
        .otherwise(header(reason=reason))
    )


def lookups_of(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Usable lines, with the fields that ``parsed`` has."""
    fields = [f for f in LOOKUP.fieldNames() if f in parsed.columns]
    return parsed.where(F.col("reject_reason").isNull()).select(*keep, *fields)


def rejects_of(parsed: DataFrame, line: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select(
        *keep, F.col(line).alias("line"), F.col("reject_reason").alias("reason")
    )


def read_logs(spark: SparkSession, paths: str | Sequence[str], sections: bool = True, **options) -> DataFrame:
    """Typed lookups of raw log files; without ``sections`` their header fields alone."""
    return lookups_of(parse_lines(read_lines(spark, paths, **options), sections=sections))
