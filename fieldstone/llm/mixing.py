"""Operator 6, mixing sources to target weights: min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. In a small
network, each pattern sends word capacity to its sources: the first pass over
its words is free and each repetition costs more than the one before (convex),
up to `max_repeats`. Each source has its target as quota. The flow of least cost
says how many words each source takes from each pattern; documents are then
chosen by seeded hash until the flow is met.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldstone.llm.common import WORD, store, table

#: Hash bins of a pattern's documents; the bin at the margin alone is sorted.
BINS = 4_096


def quotas(sizes: dict[str | None, int], weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> dict[str | None, float]:
    """Targets of the sources: shares of all words by weight, at most cap times a source's words.

    Sources stand by code point, null last; weights repeat in that order. What a
    source cannot take is shared by weight among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left, whole = total - sum(capped.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        over = {s: cap * sizes[s] for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return capped | share
        capped |= over
        if len(capped) == len(names):
            return capped


def min_cost_flow(arcs: Iterable[tuple[object, object, int, int]], source: object, sink: object) -> dict[tuple[object, object, int], int]:
    """Maximum flow of least cost: arcs (u, v, capacity, cost >= 0) -> flow by (u, v, cost).

    Successive shortest paths with potentials; ties fall to the arc named first.
    """
    graph: dict[object, list[list]] = {source: [], sink: []}
    order = {source: 0, sink: 1}
    named = []
    for u, v, capacity, cost in arcs:
        for x in (u, v):
            graph.setdefault(x, [])
            order.setdefault(x, len(order))
        forth, back = [v, capacity, cost, None], [u, 0, -cost, None]
        forth[3], back[3] = back, forth
        graph[u].append(forth)
        graph[v].append(back)
        named.append((u, v, cost, back))
    potential = dict.fromkeys(graph, 0)
    while True:
        dist, via, heap = {source: 0}, {}, [(0, 0, source)]
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if e[1] > 0 and (nd := d + e[2] + potential[u] - potential[e[0]]) < dist.get(e[0], float("inf")):
                    dist[e[0]], via[e[0]] = nd, (u, e)
                    heapq.heappush(heap, (nd, order[e[0]], e[0]))
        if sink not in dist:
            break
        for x in graph:
            potential[x] += dist.get(x, dist[sink])
        amount, x = None, sink
        while x != source:
            u, e = via[x]
            amount, x = e[1] if amount is None else min(amount, e[1]), u
        x = sink
        while x != source:
            u, e = via[x]
            e[1] -= amount
            e[3][1] += amount
            x = u
    flow: dict[tuple[object, object, int], int] = {}
    for u, v, cost, back in named:
        flow[u, v, cost] = flow.get((u, v, cost), 0) + back[1]
    return flow


def plan_flows(patterns: dict[tuple, int], targets: dict[str | None, float], max_repeats: int = 3) -> dict[tuple, dict[str | None, int]]:
    """Words each source takes from each pattern. patterns: sources -> words.

    A source without overlaps has one way to fill its quota, its own pattern, so
    its flow needs no network; the network holds the sources that share documents.
    """
    shared = {s for pattern in patterns if len(pattern) > 1 for s in pattern}
    alone = {p: {p[0]: min(round(targets[p[0]]), words * max_repeats)} for p, words in patterns.items() if p[0] not in shared}
    arcs = []
    for k, (pattern, words) in enumerate(patterns.items()):
        if pattern in alone:
            continue
        for r in range(max_repeats):  # repetition r costs r * r: convex, so passes fill in turn
            arcs.append(("from", ("pattern", k), words, r * r))
        arcs += [(("pattern", k), ("source", s), words * max_repeats, 0) for s in pattern]
    arcs += [(("source", s), "to", round(t), 0) for s, t in targets.items() if s in shared]
    flow = min_cost_flow(arcs, "from", "to")
    return {p: alone.get(p) or {s: flow.get((("pattern", k), ("source", s), 0), 0) for s in p} for k, p in enumerate(patterns)}


@dataclass(frozen=True)
class MixPlan:
    """What a mix takes: per pattern whole passes, and one more of the documents whose (bin, draw) come first.

    cuts: (pattern, passes, bin, draw) of the last document with the extra pass,
    bin -1 for none. rows: the stored doc_id, text_hash, sources, size, pattern,
    bin and draw of every document.
    """

    cuts: list[tuple[str, int, int, int]]
    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    seed: int
    rows: DataFrame


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, sources_col: str) -> dict[str, Column]:
    """pattern, draw and bin of a row: all that its place in the mix depends on."""
    some = F.coalesce(F.size(sources_col), F.lit(-1)) > 0
    sources = F.when(some, F.array_sort(F.array_distinct(sources_col))).otherwise(F.array(F.lit(None).cast("string")))
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.coalesce(text_col, F.lit(""))))
    return {"sources": sources, "pattern": F.to_json(sources), "draw": draw, "bin": F.pmod(draw, F.lit(BINS)).cast("int")}


def plan_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 42, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "sources") -> MixPlan:
    """Plan a mix of `docs`; `take` and `repeated` apply it.

    `sources_col` is an array: a document may belong to several sources (null
    entries are a source of their own; an empty or null array belongs to the null
    source). A pattern's words are taken in whole passes over its documents plus
    a part of one pass, in the order of a seeded hash of id and text, up to the
    flow. Bins of that hash are summed first, and only the bin at the margin is
    sorted, so a source with a third of the rows never meets in one task; the
    plan is a row per pattern, which the driver holds as it holds the sources. Null and blank texts have size 0 and are never
    taken. Rows alike in id and text are taken alike; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = {"doc_id": F.col(id_col), "text_hash": F.xxhash64(text), "size": F.regexp_count(text, F.lit(WORD)).cast("long")}
    rows = store(docs.select(*[c.alias(n) for n, c in {**base, **_keyed(docs, seed, id_col, text_col, sources_col)}.items()]), "mix")
    bins = store(rows.groupBy("pattern", "bin").agg(F.sum("size").alias("words"), F.first("sources").alias("sources")), "mix-bins")
    found = bins.groupBy("pattern").agg(F.sum("words").alias("words"), F.first("sources").alias("sources")).orderBy("pattern").collect()
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in r["sources"]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    targets = quotas(sizes, weights, float(max_repeats)) if sizes else {}
    flows = plan_flows({tuple(r["sources"]): r["words"] for r in found}, targets, max_repeats)
    passes = {}
    for r in found:
        taken, words = sum(flows[tuple(r["sources"])].values()), r["words"]
        passes[r["pattern"]] = divmod(taken, words) if words else (0, 0)
    rest = spark.createDataFrame([(p, n) for p, (_, n) in passes.items()], "pattern string, rest long")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = bins.select("pattern", "bin", "words", before.alias("before")).join(F.broadcast(rest), "pattern")
    # The bin at the margin of each pattern: bins before it are taken whole, its documents up to the flow.
    margin = sums.where("before < rest and rest <= before + words").select("pattern", "bin", "before", "rest")
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("draw", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = rows.where("size > 0").join(F.broadcast(margin), ["pattern", "bin"]).withColumn("middle", F.col("before") + ahead + F.col("size") / 2)
    cut = inside.groupBy("pattern", "bin").agg(F.max(F.when(F.col("middle") < F.col("rest"), F.col("draw"))).alias("draw"))
    least = -(2**63)
    at = {r["pattern"]: (r["bin"], least if r["draw"] is None else r["draw"]) for r in cut.collect()}
    return MixPlan([(p, n, *at.get(p, (-1, least))) for p, (n, _) in passes.items()], sizes, targets, seed, rows)


def _repeats(spark: SparkSession, plan: MixPlan) -> tuple[DataFrame, Column]:
    cuts = spark.createDataFrame(plan.cuts, "pattern string, passes long, cut_bin int, cut_draw long")
    extra = (F.col("bin") < F.col("cut_bin")) | (F.col("bin") == F.col("cut_bin")) & (F.col("draw") <= F.col("cut_draw"))
    return F.broadcast(cuts), F.col("passes") + extra.cast("long")


def take(plan: MixPlan) -> DataFrame:
    """doc_id, text_hash, sources, size, repeats (0 to max_repeats): a row per document."""
    cuts, repeats = _repeats(plan.rows.sparkSession, plan)
    return plan.rows.join(cuts, "pattern").select("doc_id", "text_hash", "sources", "size", F.when(F.col("size") > 0, repeats).otherwise(F.lit(0)).alias("repeats"))


def repeated(docs: DataFrame, plan: MixPlan, sources: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as the plan takes it; texts stay where they lie."""
    spark = docs.sparkSession
    cuts, repeats = _repeats(spark, plan)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), sources.alias("sources"))
    keys = {k: v for k, v in _keyed(rows, plan.seed, "id", "text", "sources").items() if k != "sources"}
    taken = rows.withColumns(keys).where(F.col("text").rlike(WORD)).join(cuts, "pattern")
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), repeats.cast("int"))).alias("copy")).select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents").withColumn("sources", F.array("source")))
    quota = spark.createDataFrame([(s, plan.sizes[s], plan.targets[s]) for s in plan.sizes], "source string, source_size long, target double")
    rows = take(plan).withColumn("name", F.col("sources")[0])
    return rows.join(F.broadcast(quota), F.col("name").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))
