"""Mixing sources to target weights by min-cost flow.

Sources overlap where the same text occurs in several of them.  Texts are
aggregated by *membership pattern* (the set of sources a text occurs in); a
flow routes word capacity from patterns to source quotas.  The cost of a
pattern is convex in how often its distinct words are repeated over all its
sources, so texts held by several sources aren't repeated in each of them
while other texts are still unused.  Every cost sits on the arcs that leave
the flow's root, so opening these arcs in the order of their cost and
augmenting each time to a maximum flow gives the minimum cost.

The flow is solved on the driver over aggregates, one row for each pattern that
occurs and source of it; every pattern enters, and any number of sources.
Passes are opened together only as far as everything opened is used, where
their order can't matter; elsewhere one by one, so the routing has least cost
for any number of passes.  A pattern's flow into a source is then dealt to its
documents in the order of a seeded hash: whole passes first, and one more pass
up to the place where the flow is used up (the document there is taken in
part).  That order is cut into blocks of about ``BLOCK_ROWS`` rows, whose sums
are carried forward, so that no window holds a whole cell.

Edge cases: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; rows repeated as a whole are dealt each; a
source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, staged, table

WEIGHTS = (1, 2, 3)   # of the sources in order, repeating
MAX_REPEATS = 3       # times its size that a document, and so a source, gives at most
BLOCK_ROWS = 1 << 12  # of the seeded order, per block
BROADCAST_ROWS = 1 << 16
SEED = 17


def targets(sizes: list[int], weights: list[float], limit: float = MAX_REPEATS) -> list[float]:
    """Shares of all words by weight; what exceeds ``limit`` times a source's
    size is shared by weight among the others until none is above."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in free:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            total -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


class _Flow:
    """Maximum flow whose root arcs can grow between two calls (Dinic)."""

    def __init__(self, n: int):
        self.to, self.room = array("q"), array("q")
        self.arcs = [array("q") for _ in range(n)]

    def arc(self, a: int, b: int, room: int) -> int:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to.extend((b, a))
        self.room.extend((room, 0))
        return len(self.to) - 2

    def augment(self, root: int, sink: int) -> None:
        while True:
            level, queue = {root: 0}, deque([root])
            while queue:
                a = queue.popleft()
                for e in self.arcs[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return
            turn, path, a = [0] * len(self.arcs), [], root
            while True:
                if a == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, a = [], root
                elif turn[a] < len(self.arcs[a]):
                    e = self.arcs[a][turn[a]]
                    if self.room[e] and level.get(self.to[e]) == level[a] + 1:
                        path.append(e)
                        a = self.to[e]
                    else:
                        turn[a] += 1
                elif path:
                    a = self.to[path.pop() ^ 1]
                    turn[a] += 1
                else:
                    break

    def reaching(self, sink: int) -> set[int]:
        """Nodes from which more could flow into the sink."""
        seen, queue = {sink}, deque([sink])
        while queue:
            b = queue.popleft()
            for e in self.arcs[b]:
                if self.room[e ^ 1] and self.to[e] not in seen:
                    seen.add(self.to[e])
                    queue.append(self.to[e])
        return seen


def route(cells: dict[tuple[str, int], int], distinct: dict[str, int], quotas: list[int],
          limit: int = MAX_REPEATS) -> dict[tuple[str, int], int]:
    """Words that each source takes from each pattern.  cells: words of the
    rows by (pattern, source); distinct: words of a pattern's texts, each
    counted once."""
    names = sorted(distinct)
    node = {p: i for i, p in enumerate(names)}
    flow, root = _Flow(len(names) + len(quotas) + 2), len(names) + len(quotas)
    arcs = {c: flow.arc(node[c[0]], len(names) + c[1], limit * words)
            for c, words in sorted(cells.items())}
    for s, quota in enumerate(quotas):
        flow.arc(len(names) + s, root + 1, quota)
    supply = [flow.arc(root, node[p], 0) for p in names]
    left = [0] * len(names)
    for (p, _), words in cells.items():
        left[node[p]] += limit * words
    # The marginal cost of a pattern rises with each pass, so all patterns open a pass
    # at a time.  Several passes at once are the same as long as all of them is used.  A
    # pattern from which nothing more reaches the sink never does so again.
    live, step = [i for i in range(len(names)) if left[i] and distinct[names[i]]], 1
    while live:
        before = array("q", flow.room)
        opened = [min(left[i], step * distinct[names[i]]) for i in live]
        for i, more in zip(live, opened, strict=True):
            flow.room[supply[i]] += more
        flow.augment(root, root + 1)
        used = not any(flow.room[supply[i]] for i in live)
        if not used and step > 1:
            flow.room, step = before, step // 2
            continue
        for i, more in zip(live, opened, strict=True):
            left[i] -= more
        ends = None if used else flow.reaching(root + 1)
        live = [i for i in live if left[i] and (ends is None or i in ends)]
        step = 2 * step if used else 1
    return {c: flow.room[e ^ 1] for c, e in arcs.items()}


def _members(rows: DataFrame) -> DataFrame:
    """Rows with their cell: the pattern of their text (a digest of it where it
    names many sources) and their source."""
    joined = F.array_join(F.array_sort(F.collect_set("s")), ",")
    per_text = (rows.groupBy("key1", "key2").agg(joined.alias("pattern"))
                .where("instr(pattern, ',') > 0")
                .withColumn("pattern", F.when(F.length("pattern") > 64, F.sha2("pattern", 256))
                            .otherwise(F.col("pattern"))))
    # written first: the join then has an exchange of its own, which AQE can split for a hot text
    shared = staged(per_text, "mix-patterns")
    return (rows.join(shared, ["key1", "key2"], "left")
            .withColumn("pattern", F.coalesce("pattern", F.col("s").cast("string"))))


def _small(df: DataFrame, n: int) -> DataFrame:
    """Hint for a table of ``n`` rows; beyond the bound Spark shuffles the join."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def mix(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = MAX_REPEATS, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and the row's
    source and text hashes (key1, key2), by which it can be found again."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    slim = staged(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        n_words(text).alias("size"), F.xxhash64(text).alias("key1"),
        F.xxhash64(F.lit(seed), text).alias("key2")), "mix-rows")
    per_source = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    order = sorted(((r["source"], r["n"]) for r in per_source), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in order]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], limit)
    sources = spark.createDataFrame(
        [(i, name, n, t) for i, ((name, n), t) in enumerate(zip(order, wanted, strict=True))],
        "s int, source string, source_size long, target double")
    rows = slim.join(_small(sources.withColumnRenamed("source", "name"), len(order)),
                     F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = staged(_members(rows), "mix-members")

    found = rows.groupBy("pattern", "s").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    cells = {(r["pattern"], r["s"]): r["n"] for r in found}
    distinct = {r["pattern"]: r["n"] for r in
                rows.groupBy("pattern", "key1", "key2").agg(F.first("size").alias("n"))
                .groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    flows = route(cells, distinct, [round(t) for t in wanted], limit)
    plan = spark.createDataFrame(
        [(r["pattern"], r["s"], *(divmod(flows[r["pattern"], r["s"]], r["n"]) if r["n"] else (0, 0)),
          1 + r["rows"] // BLOCK_ROWS) for r in found],
        "pattern string, s int, passes long, rest long, blocks long")

    keyed = (rows.join(_small(plan, len(found)), ["pattern", "s"])
             .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "key1"))
             .withColumn("block", F.pmod("h", "blocks")))
    carried = Window.partitionBy("pattern", "s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (keyed.groupBy("pattern", "s", "block").agg(F.sum("size").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(carried), F.lit(0))).drop("n"))
    within = (Window.partitionBy("pattern", "s", "block").orderBy("h", "doc_id", "key1", "key2")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = (keyed.join(blocks, ["pattern", "s", "block"])
             .withColumn("ahead", F.col("before") + F.sum("size").over(within) - F.col("size")))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return dealt.select("doc_id", "size", "source_size", "target",
                        (F.col("passes") * F.col("size") + more).cast("long").alias("taken"),
                        "source", "key1", "key2")


def op6_mix_to_targets(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source", "key1", "key2")
