"""Which keys lie next to each other on a QWERTY keyboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Key rows without stagger: a letter or digit touches the up to eight keys around it.
ROWS = ["1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]

# Keys whose neighbours do not follow the grid (punctuation and shifted keys). The
# relation is not symmetric. Grid and list together have 56 keys and 340 directed pairs.
EXCEPTIONS = {
    "-": "0p[]=_",
    "=": "-[]+",
    "[": "]=-0p;'{",
    "]": "-=\\';}",
    "\\": "=]'|",
    ";": "op['/.,l:",
    "'": "][p;./\"",
    ",": "mkl.<",
    ".": ",l;'/>",
    "/": "';.?",
    "<": "mkl.,",
    ">": ",l;/.",
    "?": ".;'/",
    '"': "][;/'",
    ":": "'][pl,./;",
    "{": "-p;']=[",
    "}": "=[;'\\]",
    "|": "]='\\",
    "+": "-[]=",
    "_": "0p[=-",
}


def qwerty_edges() -> list[tuple[str, str]]:
    """Directed (key, neighbour) pairs of the default keyboard."""
    at = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row)}
    edges = []
    for key, (r, c) in at.items():
        if key.isalnum() and key not in EXCEPTIONS:
            edges += [(key, k) for k, (r2, c2) in at.items() if k != key and abs(r - r2) <= 1 and abs(c - c2) <= 1]
    for key, neighbours in EXCEPTIONS.items():
        edges += [(key, k) for k in neighbours]
    return sorted(edges)


def read_key_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Adjacency from text: per line a key, then its neighbours, separated by spaces.

    Only the first character of each token counts, and the key itself is left out.
    """
    tokens = spark.read.text(path).select(F.transform(F.split("value", " "), lambda t: F.left(t, F.lit(1))).alias("t"))
    key = F.get("t", F.lit(0))
    return (
        tokens.select(key.alias("key"), F.explode("t").alias("neighbour"))
        .where((F.col("neighbour") != F.col("key")) & (F.col("neighbour") != ""))
        .distinct()
    )


def collect_edges(adjacency: DataFrame, most: int = 10_000) -> list[tuple[str, str]]:
    """Edges as a list for use inside a distance expression; refuses tables that are no keyboard."""
    rows = adjacency.select("key", "neighbour").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"key adjacency has more than {most} rows")
    return [(r["key"], r["neighbour"]) for r in rows]
