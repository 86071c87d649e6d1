"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is filed in the leaf that the tree
sends it to. A query walks the tree best bin first: a priority queue holds the branches not
taken, the most promising next. How many leaves it visits is calibrated: for some queries the
true neighbours are computed, and the number of leaves is widened until enough of these
neighbours lie in visited leaves.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearname.session import reliable_checkpoint

K = 20
SAMPLE = 16_384
BRANCHES = 8
LEAF_SAMPLE = 24
TRIALS = 128
RECALL = 0.97
MEMBERS, ASKERS = 8192, 512  # vectors and queries that meet in one task


@dataclass
class Tree:
    """Nodes by number: centre, children (empty for a leaf)."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)

    def file(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out = np.zeros(len(rows), dtype="int64")
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, which = todo.pop()
            kids = self.children[node]
            if not kids or not len(which):
                out[which] = node
                continue
            near = _distances(rows[which], self.centres[kids]).argmin(axis=1)
            todo += [(kid, which[near == i]) for i, kid in enumerate(kids)]
        return out

    def visit(self, query: np.ndarray, leaves: int, sizes: dict[int, int], wanted: int) -> list[int]:
        """Leaves in best-bin-first order by inner product with the centres: at least ``leaves``
        of those with vectors, and as many as hold ``wanted`` vectors."""
        found, held, heap = [], 0, [(0.0, 0)]
        while heap and (len(found) < leaves or held < wanted):
            _, node = heapq.heappop(heap)
            while self.children[node]:
                kids = self.children[node]
                scores = self.centres[kids] @ query
                best = int(scores.argmax())
                for i, kid in enumerate(kids):
                    if i != best:
                        heapq.heappush(heap, (-float(scores[i]), kid))
                node = kids[best]
            if sizes.get(node):
                found.append(node)
                held += sizes[node]
        return found


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1) - 2 * rows @ centres.T


def grow(sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, seed: int = 0) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, sample.shape[1])), [[]])
    centres, todo = [sample.mean(axis=0)], [(0, sample)]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        kids = rows[rng.choice(len(rows), min(branches, len(rows)), replace=False)]
        for _ in range(8):
            near = _distances(rows, kids).argmin(axis=1)
            kids = np.stack([rows[near == i].mean(axis=0) for i in range(len(kids)) if (near == i).any()])
        near = _distances(rows, kids).argmin(axis=1)
        parts = [(kids[i], rows[near == i]) for i in range(len(kids)) if (near == i).any()]
        if len(parts) < 2:  # all alike
            continue
        for centre, part in parts:
            tree.children[node].append(len(centres))
            todo.append((len(centres), part))
            centres.append(centre)
            tree.children.append([])
    tree.centres = np.stack(centres)
    return tree


def binned(tree: Tree, sizes: dict[int, int], members: int = MEMBERS) -> list[tuple[int, int, int]]:
    """(leaf, bin, pieces): leaves in the order of the tree, gathered until a bin holds ``members``
    vectors; a leaf with more has a bin of its own, dealt over pieces."""
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        todo += reversed(tree.children[node])
        if sizes.get(node):
            order.append(node)
    bins, number, held = [], 0, 0
    for leaf in order:
        if held and held + sizes[leaf] > members:
            number, held = number + 1, 0
        held += sizes[leaf]
        bins.append((leaf, number, -(-sizes[leaf] // members)))
    return bins


def usable(vec: Column) -> Column:
    """Not null, all components finite, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(scores: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k best per row, ties to the smaller id."""
    if scores.shape[1] > 4 * k:
        # All that reach the k-th score stay, so ties are decided by the id alone.
        bound = np.partition(scores, -k, axis=1)[:, -k]
        return [c[np.lexsort((least[c], -row[c]))][:k] for row, b in zip(scores, bound) for c in [np.flatnonzero(row >= b)]]
    return [np.lexsort((least, -row))[:k] for row in scores]


def _scored(queries: np.ndarray, reps: np.ndarray, rows: np.ndarray, columns: dict[str, np.ndarray], k: int, visited: np.ndarray | None = None) -> pa.Table:
    """The k best rows of each query, of those it visits."""
    scores = queries @ rows.T
    if visited is not None:
        scores[~visited] = -np.inf
    best = [c[scores[i, c] > -np.inf] for i, c in enumerate(_best(scores, columns["least"], k))]
    at = np.concatenate(best) if best else np.zeros(0, dtype="int64")
    which = np.repeat(np.arange(len(best)), [len(b) for b in best])
    return pa.table({"q": reps[which], **{n: c[at] for n, c in columns.items()}, "score": scores[which, at]})


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others by inner product for each query row of
    ``vectors`` (vec_id, vec array<double>), ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those
    without id. Vectors of one length are searched among themselves, a tree per length that occurs
    (one number per length reaches the driver). Equal vectors are one entry with their k + 1
    smallest ids; no others of them can be among anyone's k best. Every entry is indexed. Rows that
    repeat an id and vector count once. An empty table gives an empty table.
    """
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).select("vec_id", "vec", is_query.alias("asks"))
    lengths = sorted(r["n"] for r in vectors.select(F.size("vec").alias("n")).distinct().collect())
    parts = [_search(vectors.where(F.size("vec") == n), n, k, recall, sample) for n in lengths or [0]]
    return functools.reduce(DataFrame.unionByName, parts)


def _search(vectors: DataFrame, dims: int, k: int, recall: float, sample: int) -> DataFrame:
    """``search`` among usable vectors (vec_id, vec, asks) of one length."""
    spark = vectors.sparkSession
    alike = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.select("vec", "vec_id").distinct().withColumn("_rn", F.row_number().over(alike)).where(F.col("_rn") <= k + 1)
    entries = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    entries = reliable_checkpoint(entries.select(F.monotonically_increasing_id().alias("rep"), "vec", "ids", F.col("ids")[0].alias("least")))

    picked = entries.orderBy(F.xxhash64("vec"), "least").limit(sample).select("vec").collect()
    tree = grow(np.array([r["vec"] for r in picked], dtype="float64").reshape(-1, dims)) if picked else Tree(np.zeros((1, max(dims, 1))), [[]])
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.file(_matrix(b.column(1))))], ["rep", "vec", "least", "leaf"])

    filed = reliable_checkpoint(entries.select("rep", "vec", "least").mapInArrow(file, "rep long, vec array<double>, least long, leaf long"))
    sizes = {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}  # one row per leaf

    asked = vectors.where("asks").select("vec_id", "vec")
    asked = reliable_checkpoint(asked.join(entries.select("rep", F.col("vec").alias("_v")), F.col("vec") == F.col("_v")).select("vec_id", "rep"))
    queries = reliable_checkpoint(filed.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vec"))
    leaves = calibrated(filed, queries, tree, sizes, k, recall)

    # Neighbouring leaves are searched together, so a query sends one row to each bin it meets.
    bins = binned(tree, sizes)
    bin_of = {leaf: number for leaf, number, _ in bins}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met: list[tuple[int, int, list[int]]] = []
            for i, q in enumerate(_matrix(b.column(1)) if b.num_rows else []):
                by_bin: dict[int, list[int]] = {}
                for leaf in shared.value.visit(q, leaves, sizes, k + 1):
                    by_bin.setdefault(bin_of[leaf], []).append(leaf)
                met += [(i, number, found) for number, found in by_bin.items()]
            index = pa.array([m[0] for m in met], pa.int64())
            added = [pa.array([m[1] for m in met], pa.int64()), pa.array([m[2] for m in met], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), b.column(1).take(index), *added], ["q", "qvec", "bin", "leaves"])

    # The walk is the work, so queries are dealt evenly first.
    walks = queries.repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(walk, "q long, qvec array<double>, bin long, leaves array<long>")
    walks = reliable_checkpoint(walks)
    table = F.broadcast(spark.createDataFrame(bins, "leaf long, bin long, mp long"))  # one row per leaf, made here
    parts = table.groupBy("bin").agg(F.max("mp").alias("mp")).join(walks.groupBy("bin").agg(F.ceil(F.count("*") / ASKERS).alias("qp")), "bin")
    parts = reliable_checkpoint(parts)  # one row per bin
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    members = filed.join(table.select("leaf", "bin"), "leaf").join(parts, "bin").withColumn("m", F.pmod(F.xxhash64("rep"), "mp")).withColumn("p", every("qp"))
    askers = walks.join(parts, "bin").withColumn("p", F.pmod(F.xxhash64("q"), "qp")).withColumn("m", every("mp"))
    cell = ["bin", "m", "p"]

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("q", pa.int64()), ("rep", pa.int64()), ("least", pa.int64()), ("score", pa.float64()))})
        columns = {n: held.column(n).to_numpy() for n in ("rep", "least")}
        names, at = np.unique(held.column("leaf").to_numpy(), return_inverse=True)
        wanted = np.zeros((asking.num_rows, len(names)), dtype=bool)
        for row, found in zip(wanted, asking.column("leaves").to_pylist()):
            row[np.searchsorted(names, [x for x in found if x in names])] = True
        rows = _matrix(held.column("vec").combine_chunks())
        queries, reps = _matrix(asking.column("qvec").combine_chunks()), asking.column("q").to_numpy()
        return pa.concat_tables([_scored(queries[i : i + 128], reps[i : i + 128], rows, columns, k + 1, wanted[i : i + 128][:, at]) for i in range(0, len(reps), 128)])

    met = askers.select(*cell, "q", "qvec", "leaves").groupBy(*cell).cogroup(members.select(*cell, "rep", "least", "leaf", "vec").groupBy(*cell))
    scored = met.applyInArrow(meet, "q long, rep long, least long, score double")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    top = reliable_checkpoint(scored.withColumn("_rn", F.row_number().over(nearest)).where(F.col("_rn") <= k + 1).select("q", "rep", "score"))
    tall = top.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = tall.withColumn("_rn", F.row_number().over(by_id)).where(F.col("_rn") <= k + 1)
    lists = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_rn", "vec_id", "score"))).alias("near"))  # k + 1 at most
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")).distinct().join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    found = own.select("query_id", F.posexplode(others).alias("pos", "x"))
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def calibrated(filed: DataFrame, queries: DataFrame, tree: Tree, sizes: dict[int, int], k: int, recall: float, trials: int = TRIALS) -> int:
    """Leaves to visit so that trial queries find ``recall`` of their true neighbours.

    The true ones come from comparing ``trials`` queries with all vectors, in blocks; the place
    of a neighbour's leaf in the query's walk is the number of visits that finds it.
    """
    chosen = queries.orderBy(F.xxhash64("vec"), "rep").limit(trials).collect()
    if not chosen:
        return 1
    reps, asked = np.array([r["rep"] for r in chosen]), np.array([r["vec"] for r in chosen], dtype="float64")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = {n: b.column(i).to_numpy() for i, n in ((0, "rep"), (2, "least"), (3, "leaf"))}
                yield from _scored(asked, reps, _matrix(b.column(1)), columns, k + 1).to_batches()

    scored = filed.mapInArrow(compare, "q long, rep long, least long, leaf long, score double")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    best = scored.where("q <> rep").withColumn("_rn", F.row_number().over(nearest)).where(F.col("_rn") <= k).select("q", "leaf").collect()
    place = {}
    for rep, q in zip(reps.tolist(), asked):
        place[rep] = {leaf: i for i, leaf in enumerate(tree.visit(q, len(sizes), sizes, 0), 1)}
    needed = np.sort([place[r["q"]][r["leaf"]] for r in best]) if best else np.array([1])
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)])


def search_embeddings(table: DataFrame, k: int = K) -> DataFrame:
    vectors = table.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return search(vectors, F.col("vec_id") % 20 == 0, k)
