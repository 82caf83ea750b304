"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.common import HOT, drop_stored, new_path, store


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0))).first()
    return r[0], r[1]


def _star(pairs: DataFrame, total: int, keep) -> DataFrame:
    """pairs (u, v): every kept v of u, and u itself where keep says so, linked to u's least neighbour.

    `total` is at least the number of pairs. A node with more than one in HOT of
    them, so fewer than HOT nodes, is broadcast: its pairs stay where they lie.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hot, rest = least.where(F.col("n") * HOT > total).drop("n"), least.where(F.col("n") * HOT <= total).drop("n")
    placed = pairs.join(F.broadcast(hot), "u", "left")
    return keep(placed.where("m is not null").unionByName(placed.where("m is null").drop("m").join(rest, "u")))


def star_forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long nodes -> (a, b) with b the least node of a's component, a > b.

    Each round groups by node with map-side minima, joins them without moving a hub's pairs, and writes its edges to the
    shared folder, which cuts the lineage. Rounds end when the edges no longer
    change: about the logarithm of the largest component's diameter.
    """
    spark = edges.sparkSession
    paths = [new_path(spark, "links")]
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", paths[-1])
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, 2 * mark[0], lambda j: j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down, mark[0], lambda j: j.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b")).distinct()
        paths.append(new_path(spark, "links"))
        now = store(small, "links", paths[-1])
        drop_stored(spark, paths.pop(0))
        before, mark = mark, _mark(now)
    return now
