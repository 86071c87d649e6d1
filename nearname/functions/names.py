"""Domain-name and address expressions. All built-in functions, all code-generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The thirteen registry name servers of the .com/.net zone.
REGISTRY_SERVERS = [f"{letter}.GTLD-SERVERS.NET." for letter in "ABCDEFGHIJKLM"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot_count(name: Column | str) -> Column:
    name = _col(name)
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))


def with_dot(name: Column | str) -> Column:
    """Fully qualified form: ends in exactly the dot it has, or gains one."""
    name = _col(name)
    return F.when(name.endswith("."), name).otherwise(F.concat(name, F.lit(".")))


def without_dot(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), r"\.$", "")


def first_label(name: Column | str) -> Column:
    return F.substring_index(_col(name), ".", 1)


def suffix_at(name: Column | str, dots: Column | int, extra_labels: int = 1) -> Column:
    """The part of ``name`` that is compared with a reference name having ``dots`` dots.

    A name with exactly ``dots + extra_labels`` dots is taken whole; any other is cut to its
    last ``dots + extra_labels`` labels and closed with a dot. ``extra_labels=1`` keeps one
    label more than the reference has, so ``www.site.`` does not count as ``site.``;
    ``extra_labels=0`` compares registered domains.
    """
    name = _col(name)
    n = (dots if isinstance(dots, Column) else F.lit(dots)) + F.lit(extra_labels)
    bare = F.rtrim(name, F.lit("."))
    tail = F.call_function("substring_index", bare, F.lit("."), -n)
    return F.when(dot_count(name) == n, name).otherwise(F.concat(tail, F.lit(".")))


def name_suffix(name: Column | str, reference: Column | str, extra_labels: int = 1) -> Column:
    """``suffix_at`` with the depth taken from a reference-name column."""
    return suffix_at(name, dot_count(reference), extra_labels)


def is_ipv4(ip: Column | str) -> Column:
    return F.contains(_col(ip), F.lit("."))


def is_ipv6(ip: Column | str) -> Column:
    return F.contains(_col(ip), F.lit(":"))


def net16(ip: Column | str) -> Column:
    """``a.b.0.0`` of a dotted address; NULL when it has fewer than four parts."""
    ip = _col(ip)
    return F.when(
        dot_count(F.rtrim(ip, F.lit("."))) >= 3,
        F.concat(F.substring_index(ip, ".", 2), F.lit(".0.0")),
    )


def same_net16(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(net16(a) == net16(b), F.lit(False))


def swap_tld(name: Column | str, wrong: str = ".ocm.", right: str = ".com.") -> Column:
    return F.replace(_col(name), F.lit(wrong), F.lit(right))


def is_registry_server(server: Column | str) -> Column:
    return F.coalesce(F.upper(_col(server)).isin(REGISTRY_SERVERS), F.lit(False))


def path_tail(path: Column | str) -> Column:
    """Last part of a path: the site a per-site file belongs to."""
    return F.substring_index(_col(path), "/", -1)


def path_parent(path: Column | str) -> Column:
    """Name of the folder a file lies in."""
    return F.element_at(F.split(_col(path), "/"), -2)
