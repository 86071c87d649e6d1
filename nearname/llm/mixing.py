"""Mixing sources to target weights by min-cost flow.

Documents are grouped by the set of sources they belong to. Each such pattern may be used up
to ``most`` times; its first pass is free and every further pass costs more (convex costs).
The flow from patterns over their sources to the sources' targets says how many tokens of each
pattern serve each source. Documents are then taken in a seeded order until the flow is used.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.llm.common import free_names, numbered, running, seeded_hash, with_own_names, word_count
from nearname.session import reliable_checkpoint

WEIGHTS = (5, 2, 1)
MOST = 3
FEW = 10_000  # rows of a plan that are broadcast; a longer one is joined as any table


def _small(table: DataFrame, rows: list) -> DataFrame:
    return F.broadcast(table) if len(rows) <= FEW else table


def targets(sizes: dict, weights: dict, total: float, most: int = MOST) -> dict:
    """Shares of ``total`` by weight; none exceeds ``most`` times its size, and what is above
    goes to the others by weight until none is above."""
    fixed: dict = {}
    while True:
        open_ = [s for s in sizes if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / weight for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in above}


class Flow:
    """Successive shortest paths on a small graph with integer capacities."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.room, self.cost = [], [], []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        """Paths come by Dijkstra's search on costs reduced by potentials, which keeps them from
        being negative; first costs are not."""
        high = [0] * len(self.out)
        while True:
            far, via, queue, done = {source: 0}, {}, [(0, source)], set()
            while queue:
                d, node = heappop(queue)
                if node in done:
                    continue
                done.add(node)
                for e in self.out[node]:
                    to = self.to[e]
                    if self.room[e] and to not in done and (new := d + self.cost[e] + high[node] - high[to]) < far.get(to, 1 << 60):
                        far[to], via[to] = new, e
                        heappush(queue, (new, to))
            if sink not in via:
                return
            last = far[sink]
            for node in range(len(high)):
                high[node] += min(far.get(node, last), last)
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount

    def used(self, e: int) -> int:
        return self.room[e ^ 1]


@dataclass
class Plan:
    targets: dict
    sizes: dict
    taken: list[dict]  # by pattern: source to tokens


def plan_mix(patterns: list[tuple[tuple, int]], weights: dict | None = None, most: int = MOST) -> Plan:
    """Flow for (sources, size) patterns. Without ``weights``, sources in order, null last, weigh
    5, 2, 1, 5, ..."""
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    weights = weights or {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    sizes = dict.fromkeys(names, 0)
    for p, n in patterns:
        for s in p:
            sizes[s] += n
    goal = targets(sizes, weights, float(sum(n for _, n in patterns)), most) if names else {}
    taken: list[dict] = [{} for _ in patterns]
    for part in overlapping([p for p, _ in patterns]):
        members = {s for i in part for s in patterns[i][0]}
        if len(part) == len(members) == 1:  # a source of its own: its flow is one path
            (i,), (s,) = part, members
            taken[i] = {s: min(round(goal[s]), most * patterns[i][1])}
            continue
        flow = Flow(2 + len(part) + len(members))
        place = {s: 2 + len(part) + i for i, s in enumerate(members)}
        arcs = []
        for at, i in enumerate(part, 2):
            for again in range(most):
                flow.add(0, at, patterns[i][1], again * again)
            arcs.append({s: flow.add(at, place[s], most * patterns[i][1], 0) for s in patterns[i][0]})
        for s in members:
            flow.add(place[s], 1, round(goal[s]), 0)
        flow.run(0, 1)
        for i, arc in zip(part, arcs):
            taken[i] = {s: flow.used(e) for s, e in arc.items()}
    return Plan(goal, sizes, taken)


def overlapping(patterns: list[tuple]) -> list[list[int]]:
    """Places of the patterns by groups that share sources, directly or through one another:
    no flow leads from one group to another."""
    head: dict = {}

    def find(s):
        while head[s] != s:
            head[s] = head[head[s]]
            s = head[s]
        return s

    for p in patterns:
        for s in p:
            head.setdefault(s, s)
            head[find(s)] = find(p[0])
    groups: dict = {}
    for i, p in enumerate(patterns):
        if p:
            groups.setdefault(find(p[0]), []).append(i)
    return list(groups.values())


def mix(docs: DataFrame, members: str, size: str, key: list[str], weights: dict | None = None, most: int = MOST, seed: int = 0) -> DataFrame:
    """``docs`` with pattern, taken (tokens used, repeats counted) and credited (the source that
    the first of them serves; null when none is taken).

    ``members`` is an array of source names, which may hold null; repeated names count once and
    an empty array serves no source. The last document of a pattern may be taken in part. The
    driver sees one row per pattern, never documents; ``docs`` is read several times, so pass a
    narrow written table. Columns of any name stay as they are; an output whose name the input
    has gets underscores behind it.
    """
    docs, names = numbered(docs)
    members, size, key = names[members], names[size], [names[k] for k in key]
    named = docs.withColumn("_p", F.array_sort(F.array_distinct(members)))
    found = named.groupBy("_p").agg(F.sum(size).alias("size")).collect()  # one row per membership pattern
    rows = sorted(((tuple(r["_p"] or ()), r["size"] or 0) for r in found), key=lambda r: [(s is None, s or "") for s in r[0]])
    plan = plan_mix(rows, weights, most)
    table = []
    for i, ((sources, total), taken) in enumerate(zip(rows, plan.taken)):
        used = sum(taken.values())
        whole = used // total if total else 0
        table.append((i, list(sources), whole, used - whole * total, [(s, n) for s, n in taken.items() if n]))
    schema = "pattern int, _p array<string>, _whole long, _rest long, _flow array<struct<source: string, n: long>>"
    flows = docs.sparkSession.createDataFrame(table, schema)
    # Arrays with nulls compare equal inside a join only through their text.
    text = lambda c: F.to_json(F.struct(F.col(c).alias("p")), {"ignoreNullFields": "false"})
    keyed = named.withColumn("_key", text("_p")).withColumn("_h", seeded_hash(seed, *key)).drop("_p")
    ordered = running(keyed, "_key", ["_h", *key, size], size)
    joined = ordered.join(_small(flows.withColumn("_key", text("_p")).drop("_p"), table), "_key")
    part = F.greatest(F.lit(0), F.least(F.col(size), F.col("_rest") - F.col("before")))
    taken = (F.col("_whole") * F.col(size) + part).cast("bigint")
    start = F.col("_whole") * F.col("before") + F.least("before", "_rest")
    ends = F.aggregate(
        "_flow",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("found")),
        lambda a, f: F.struct(
            (a["end"] + f["n"]).alias("end"),
            F.when(a["found"] | (start >= a["end"] + f["n"]), a["source"]).otherwise(f["source"]).alias("source"),
            (a["found"] | (start < a["end"] + f["n"])).alias("found"),
        ),
    )
    credited = F.when(taken > 0, ends["source"])
    return with_own_names(joined, names, {"pattern": F.col("pattern"), "taken": taken, "credited": credited})


def source_targets(sizes: DataFrame) -> list[tuple]:
    """(source, size, target) from a table with one row per source."""
    rows = [(r["source"], r["size"] or 0) for r in sizes.collect()]
    names = sorted((s for s, _ in rows), key=lambda s: (s is None, s or ""))
    size = dict(rows)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    goal = targets(size, weight, float(sum(size.values()))) if rows else {}
    return [(s, size[s], goal[s]) for s in names]


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """How many words of each document a mix of its sources takes.

    Null text has no words, a null source is a source of its own, and sources of no words get
    nothing. Equal rows are interchangeable. Texts are read once.
    """
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    narrow = reliable_checkpoint(narrow)
    goals = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("size")))
    table = docs.sparkSession.createDataFrame(goals, "source string, source_size long, target double")
    mixed = mix(narrow.withColumn("_members", F.array("source")), "_members", "size", ["doc_id", "_text"], seed=seed)
    same = mixed["source"].eqNullSafe(table["source"])
    return mixed.join(_small(table, goals), same).select("doc_id", "size", "source_size", "target", "taken", mixed["source"].alias("source"), "credited")


def take_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix: each as often as the words taken of it come to whole passes,
    rounded to the nearest. Columns stay as they are; documents without words are not taken."""
    row, number, again = free_names(docs, "_row", "_n", "_pass")
    rows = reliable_checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = rows.select(
        F.col(row).alias("_row"), "doc_id", F.array("source").alias("_members"), word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_text")
    )
    mixed = mix(reliable_checkpoint(narrow), "_members", "_size", ["doc_id", "_text"], seed=seed)
    passes = F.floor(F.col("taken") / F.col("_size") + 0.5).cast("int")
    copies = mixed.where(F.col("taken") > 0).select(F.col("_row").alias(row), passes.alias(number)).where(F.col(number) > 0)
    found = rows.join(reliable_checkpoint(copies), row)
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(number))).alias(again)).select(*docs.columns)
