"""Look-alike names a site could be mistyped as, and which of them were looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.session import reliable_checkpoint

# Characters put in for another one, and the one extra replacement of a dot.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
DOT_REPLACEMENT = ","

PAGE_BITS = 32_768  # bits of one bitmap of the built-in aggregates
PAGES = 4096  # of 4 KB each: a filter of names takes 16 MB at most


def _chars(text: str) -> Column:
    return F.array(*[F.lit(c) for c in text])


def candidates_of(name: Column) -> Column:
    """Distinct one-edit variants of a name as an array.

    Letters inserted anywhere, characters dropped, characters replaced by another letter or
    digit (a dot also by a comma), unequal neighbours swapped.
    """
    size = F.length(name)
    places = F.sequence(F.lit(1), size)

    def head(i: Column) -> Column:  # characters before place i
        return F.substring(name, F.lit(1), i - 1)

    def tail(i: Column) -> Column:  # characters from place i on
        return F.substring(name, i, size)

    def at(i: Column) -> Column:
        return F.substring(name, i, F.lit(1))

    inserted = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size + 1),
            lambda i: F.transform(_chars(LETTERS), lambda c: F.concat(head(i), c, tail(i))),
        )
    )
    dropped = F.transform(places, lambda i: F.concat(head(i), tail(i + 1)))
    replaced = F.flatten(
        F.transform(
            places,
            lambda i: F.transform(
                F.filter(
                    F.concat(
                        _chars(LETTERS + DIGITS),
                        F.when(at(i) == ".", _chars(DOT_REPLACEMENT)).otherwise(F.array().cast("array<string>")),
                    ),
                    lambda c: c != at(i),
                ),
                lambda c: F.concat(head(i), c, tail(i + 1)),
            ),
        )
    )
    swapped = F.transform(
        F.filter(places, lambda i: (i < size) & (at(i) != at(i + 1))),
        lambda i: F.concat(head(i), at(i + 1), at(i), tail(i + 2)),
    )
    return F.when(size > 0, F.array_distinct(F.concat(inserted, dropped, replaced, swapped))).otherwise(
        _chars(LETTERS)
    )


def typo_candidates(names: DataFrame, name: str = "site") -> DataFrame:
    """One row per (name, candidate). Narrow: each name is expanded where it lies."""
    rows = names.select(F.col(name)).distinct()
    return rows.select(name, F.explode(candidates_of(F.col(name))).alias("candidate"))


def candidate_hits(candidates: DataFrame, lookups: DataFrame, qname: str = "qname") -> DataFrame:
    """Candidates that occur among the looked-up names, with the number of lookups."""
    seen = lookups.groupBy(F.col(qname).alias("candidate")).agg(F.count("*").alias("lookups"))
    return candidates.join(seen, "candidate")


def name_filter(names: DataFrame, name: str = "qname", pages: int = PAGES) -> DataFrame:
    """(page, bits): a filter of the names, one bit set for each. Filters of parts of a log merge
    by ``merge_filters``. However many names there are, it has at most ``pages`` rows."""
    at = F.pmod(F.xxhash64(name), F.lit(pages * PAGE_BITS))
    placed = names.select(F.floor(at / PAGE_BITS).alias("page"), F.pmod(at, F.lit(PAGE_BITS)).alias("at"))
    return placed.groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))


def merge_filters(*filters: DataFrame) -> DataFrame:
    """The filter of the names of all of them."""
    tall = filters[0]
    for other in filters[1:]:
        tall = tall.unionByName(other)
    return tall.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_in(rows: DataFrame, filter_: DataFrame, name: str, pages: int = PAGES) -> DataFrame:
    """Rows whose name may be among those of the filter: all that are, and of the others about
    the share of bits that are set. Nothing is shuffled: the filter's size is bounded by its
    pages, and it is broadcast."""
    at = F.pmod(F.xxhash64(name), F.lit(pages * PAGE_BITS))
    keyed = rows.withColumn("page", F.floor(at / PAGE_BITS)).withColumn("_at", F.pmod(at, F.lit(PAGE_BITS)))
    met = keyed.join(F.broadcast(filter_), "page")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1).select(*rows.columns)


def observed_candidate_hits(names: DataFrame, lookups: DataFrame, name: str = "site", qname: str = "qname") -> DataFrame:
    """As ``candidate_hits`` of ``typo_candidates``, for lists of many sites: candidates that
    cannot have been looked up are left out where they arise, so only about the hits are
    shuffled."""
    seen = reliable_checkpoint(lookups.groupBy(F.col(qname).alias("candidate")).agg(F.count("*").alias("lookups")))
    possible = maybe_in(typo_candidates(names, name), reliable_checkpoint(name_filter(seen, "candidate")), "candidate")
    return possible.join(seen, "candidate")
