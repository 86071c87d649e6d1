"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its letter n-grams (one to three letters, words
edged by a blank), hashed to DIMS places. Each language has several centroids, found by
spherical k-means; a text gets the language of the centroid with the largest cosine. It is
rejected when it is much farther from that centroid than the language's own texts are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearname.llm.common import free_names, sliced
from nearname.session import reliable_checkpoint

DIMS = 1 << 13
CENTROIDS = 4
SAMPLE = 800  # texts per language that k-means sees; document frequencies cover all learnable texts
ROUNDS = 10
#: A text is rejected when its cosine is below this part of the language's lowest hundredth.
REJECT = 0.45
CHUNK = 1 << 18  # characters turned into n-grams at a time


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the whole text; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="uint32")
    letter = _letters()[codes]
    if not letter.any():
        return None
    seen = letter.copy()
    seen[1:] |= letter[:-1]  # a word's letters and the first place after it
    flat = np.where(letter, codes, 32)[seen].astype("uint64")
    flat = np.concatenate([np.array([32], "uint64"), flat])
    total = np.zeros(DIMS, dtype="int64")
    for at in range(0, len(flat), CHUNK):
        a = flat[at : at + CHUNK + 2]
        own = min(CHUNK, len(a))
        two = a[:-1] << np.uint64(21) | a[1:]
        grams = [a[:own], two[:own], (two[:-1] << np.uint64(21) | a[2:])[:own]]
        for n, g in enumerate(grams):
            mixed = (g + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            places = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 13)
            total += np.bincount(places.view("int64"), minlength=DIMS)
    return total


def weigh(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit vectors; damped counts keep one frequent word from filling a text's vector."""
    rows = np.sqrt(np.stack(counts).astype("float32")) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, dtype="int64"), 0
    for batch in batches:
        for part in sliced(batch.column(0)):
            for text in part:
                if (counts := gram_counts(text)) is not None:
                    total += counts > 0
                    n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "df"])


def spherical_kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids; starts from texts far from those chosen before."""
    chosen = [0]
    best = rows @ rows[0]
    for _ in range(min(k, len(rows)) - 1):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, rows @ rows[chosen[-1]])
    centres = rows[chosen].copy()
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                mean = rows[near == c].mean(axis=0)
                centres[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centres


@dataclass
class Model:
    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]  # of each centre
    floor: np.ndarray  # of each centre: lower cosines are rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for at in range(0, len(texts), 128):
            counts = [(i, c) for i, t in enumerate(texts[at : at + 128], at) if (c := gram_counts(t)) is not None]
            if not counts or not self.langs:
                continue
            cosine = weigh([c for _, c in counts], self.idf) @ self.centres.T
            for (i, _), row in zip(counts, cosine):
                best = int(row.argmax())
                langs[i], scores[i] = self.langs[best], float(min(1.0, max(0.0, row[best])))
                rejected[i] = bool(row[best] < self.floor[best])
        return langs, scores, rejected


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def _sample(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, _h, _rn): the ``sample`` smallest text hashes of each language.

    Hashes are even, so a bound on them leaves about four times the sample of each language
    before anything is ranked, however large the table is.
    """
    # Copies go first, on an exchange by both columns, so that none of them meet by language.
    hashes = docs.select("lang", F.xxhash64("text").alias("_h")).distinct()
    numbers = hashes.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"))
    part = F.least(F.lit(1.0), 4.0 * sample / F.col("_n"))
    low = hashes.join(numbers, "lang").where(F.col("_h").cast("double") <= (2 * part - 1) * float(1 << 63))
    order = Window.partitionBy("lang").orderBy("_h")
    return low.select("lang", "_h").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= sample)


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from ``docs`` (text, lang), both not null. Document frequencies are summed over all
    rows; k-means sees ``sample`` texts per language, those with the smallest hash. The driver
    gets DIMS counts per partition and the centroids."""
    sums = docs.select("text").mapInArrow(_document_frequencies, "n long, df array<long>")
    sums = sums.select("n", F.posexplode("df").alias("pos", "df"))
    rows = sums.groupBy("pos").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()  # DIMS rows
    df = np.zeros(DIMS)
    for r in rows:
        df[r["pos"]] = r["df"]
    n = rows[0]["n"] if rows else 0
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype("float32")
    chosen = reliable_checkpoint(_sample(docs, sample))
    hashed = docs.withColumn("_h", F.xxhash64("text"))
    picked = hashed.join(chosen, ["lang", "_h"]).select("lang", "text", "_rn").dropDuplicates(["lang", "_rn"])

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        counts = [c for t in group.sort_values("_rn")["text"] if (c := gram_counts(t)) is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "floor": [], "centre": []})
        vectors = weigh(counts, idf)
        found = spherical_kmeans(vectors, centroids)
        low = float(np.quantile((vectors @ found.T).max(axis=1), 0.01)) * REJECT
        return pd.DataFrame({"lang": group["lang"].iloc[0], "floor": low, "centre": [c.tolist() for c in found]})

    learned = picked.groupBy("lang").applyInPandas(centres, "lang string, floor double, centre array<float>").collect()
    learned.sort(key=lambda r: (r["lang"], r["centre"]))
    table = np.array([r["centre"] for r in learned], dtype="float32").reshape(-1, DIMS)
    return Model(idf, table, [r["lang"] for r in learned], np.array([r["floor"] for r in learned]))


def fit_documents(docs: DataFrame) -> Model:
    """Learn from documents with a language whose remainder is not 1."""
    return fit(docs.where((remainder(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))


FOUND = "__language"


def with_language(docs: DataFrame, model: Model, name: str = FOUND) -> DataFrame:
    """``docs`` with the struct ``name`` of lang_pred, score (cosine, 0 to 1) and rejected. Text that is null
    or has no letter is ``und`` with score 0 and rejected; so is all text of a model without
    languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers per centroid

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def found(texts: pa.Array) -> pa.Array:
        rows: tuple[list, list, list] = ([], [], [])
        for part in sliced(texts):
            for column, values in zip(rows, shared.value.predict(part)):
                column += values
        types = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], ["lang_pred", "score", "rejected"])

    # Only the text goes to Python, and only the three values come back.
    return docs.withColumn(name, found(F.col("text")))


def language_table(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    found = with_language(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", held_out, f"{FOUND}.*")


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents whose language is recognised; columns and languages stay as they are."""
    (name,) = free_names(docs, FOUND)
    return with_language(docs, fit_documents(docs), name).where(~F.col(f"{name}.rejected")).select(*docs.columns)
