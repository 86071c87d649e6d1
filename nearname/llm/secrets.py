"""Secret scans by patterns and by sliding-window entropy, in built-in functions only.

Three patterns find assigned values, access keys and hexadecimal strings. The entropy scan
takes maximal runs of each character class, cuts them at words of the allow-list, slides a window
over the parts and keeps the counts of the characters inside up to date: one comes in, one goes
out, and the entropy follows from the changed counts alone. Runs with a window that reaches the
class's threshold are reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearname.llm.common import free_names

# The base patterns. Hexadecimal and access runs are maximal, so a minimum length
# inside the pattern finds the same as dropping short matches; for assigned values it would
# not, and their length is tested after the match.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_letters")

WINDOW = 16
#: Both digits and letters.
BOTH = r"^(?=.*[0-9])(?=.*[A-Za-z])"
#: Class to (maximal runs, bits per character that a window must reach, form of a part). Letters
#: alone must also change between upper and lower case often enough: see ``CASES``.
CLASSES = {
    "entropy_hex": (r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,}(?![0-9A-Za-z])", 2.8, BOTH),
    "entropy_mixed": (r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/_-]{16,}", 3.3, BOTH),
    "entropy_letters": (r"(?<![0-9A-Za-z])[A-Za-z]{16,}(?![0-9A-Za-z])", 3.3, r"^(?=.*[A-Z])(?=.*[a-z])"),
}
#: Least changes of case per neighbouring pair of letters, and least share of upper-case letters.
#: By chance both are 0.5; names in camel case have 0.2 to 0.4 and 0.1 to 0.25, words one change.
CASES, UPPER = 0.3, 0.25
#: Words that are no secrets wherever they stand: ladders of the alphabet or digits, stated examples.
#: They cut a run, so what lies before and behind them is judged by itself.
ALLOW = r"(?i:0123456789|abcdefghij|example|placeholder|x{6,})"
#: A part is judged in stretches of this many characters, which overlap by a window less one.
STRETCH = 1024
_FIRST, _PLACES, _BITS = 43, 80, 5  # from + to z; a count of at most 17 takes 5 bits
_SLOTS = 60 // _BITS


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, order, kind, end, hit) of the leftmost non-overlapping matches.

    Splitting gives the text between the matches, extracting gives the matches, and their
    lengths in turn give the places. Texts without a match skip all of that.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "array<struct<start:bigint,order:int,kind:string,end:bigint,hit:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        added = F.concat(acc["found"], F.array(one))
        return F.struct(end.alias("at"), (F.when(keep(x["hit"]), added).otherwise(acc["found"]) if keep else added).alias("found"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.cast("bigint").alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(span).alias("found"))
    found = F.aggregate(pairs, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(span))


def _nlogn(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits per character) of any ``window`` characters (16 at most) of an
    ASCII candidate at least as long.

    The state holds the counts of the characters inside, packed into seven numbers, and the sum of
    n log n over them; a step adds one to a count, takes one from another and changes their terms.
    """
    place = lambda c: F.struct(F.floor((F.ascii(c) - _FIRST) / _SLOTS).cast("int").alias("at"), ((F.ascii(c) - _FIRST) % _SLOTS * _BITS).alias("by"))
    come = F.transform(F.split(candidate, ""), place)
    nobody = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("by"))
    gone = F.concat(F.array_repeat(nobody, window), F.slice(come, F.lit(1), F.greatest(F.length(candidate) - window, F.lit(0))))
    steps = F.zip_with(come, gone, lambda c, g: F.struct(c.alias("come"), g.alias("gone")))
    one = F.lit(1).cast("bigint")
    empty = F.array_repeat(F.lit(0).cast("bigint"), -(-_PLACES // _SLOTS))
    state = F.struct(empty.alias("n"), F.lit(0.0).alias("sum"), F.lit(float(window) * 99).alias("least"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        count = lambda p: F.call_function("shiftrightunsigned", F.get(acc["n"], p["at"]), p["by"]).bitwiseAND(31).cast("double")
        part = lambda p, j: F.when(j == p["at"], F.call_function("shiftleft", one, p["by"])).otherwise(0)
        come, gone = x["come"], x["gone"]
        up = _nlogn(count(come) + 1) - _nlogn(count(come))
        down = F.when(gone["at"] >= 0, _nlogn(count(gone) - 1) - _nlogn(count(gone))).otherwise(0.0)
        total = acc["sum"] + F.when(come == gone, 0.0).otherwise(up + down)
        counts = F.transform(acc["n"], lambda n, j: n + part(come, j) - part(gone, j))
        least = F.when(acc["i"] >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(counts.alias("n"), total.alias("sum"), least.alias("least"), (acc["i"] + 1).alias("i"))

    least = F.aggregate(steps, state, step, lambda acc: acc["least"])
    return F.lit(math.log2(window)) - least / window


def _odd(hit: Column, bits: float, form: str, letters: bool, allow: str) -> Column:
    """Some part of a run between allowed words has the form and a window of enough entropy.

    Stretches follow one another until one has such a window, so a run of any length takes the
    memory of one stretch.
    """

    def odd(part: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(part) - WINDOW + 1, F.lit(STRETCH - WINDOW + 1))
        windows = F.exists(starts, lambda p: window_entropy(F.substring(part, p, F.lit(STRETCH))) >= bits)
        fits = (F.length(part) >= WINDOW) & part.rlike(form)
        if letters:
            changes = F.length(part) - F.length(F.regexp_replace(part, "[a-z](?=[A-Z])|[A-Z](?=[a-z])", ""))
            upper = F.length(F.regexp_replace(part, "[a-z]", ""))
            fits = fits & (changes >= (F.length(part) - 1) * CASES) & (upper > F.length(part) * UPPER)
        return F.when(fits, windows).otherwise(F.lit(False))

    return F.exists(F.split(hit, allow, -1), odd)


def scan(docs: DataFrame, text: str = "text", allow: str = ALLOW) -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, order, kind, end, hit) by start, then kind.

    Places count code points, ends are exclusive. Null text counts as empty. The allow-list
    concerns entropy findings only. Texts of any length are scanned whole and where they lie:
    nothing is shuffled. Rows that repeat are each scanned. Where ``docs`` has a column ``secrets``,
    the array's name gets underscores behind it.
    """
    (name,) = free_names(docs, "secrets")
    t = F.coalesce(F.col(text), F.lit(""))
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= ASSIGN_MIN
    found = [_spans(t, ASSIGN, "assign", long_value), _spans(t, ACCESS, "access"), _spans(t, HEX, "hex")]
    for kind, (pattern, bits, form) in CLASSES.items():
        odd = lambda hit, bits=bits, form=form, kind=kind: _odd(hit, bits, form, kind == "entropy_letters", allow)
        found.append(_spans(t, pattern, kind, odd))
    return docs.withColumn(name, F.array_sort(F.concat(*found)))


def _joined(spans: Column) -> Column:
    places = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(places, ",")


def secret_table(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["order"] < 3)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"),
    )
