"""Operator 8, SimHash near-dedup: exact radius search with vantage-point trees.

A tree's inner node holds a vantage point and a radius. Fingerprints within the
radius go to the inner child, the others to the outer one. Two fingerprints at
distance r or less that part at a node differ by r at most in their distance to
its vantage point (triangle inequality), so the outer one lies within radius + r:
such boundary fingerprints go to the inner child too, and every pair still meets
in a leaf. The upper tree deals fingerprints to shards, trees inside the shards
go on to small leaves that are compared whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.common import TEXT_ROWS, batch_rows, drop_stored, new_path, store, table, workers_import
from fieldstone.llm.components import star_forest
from fieldstone.llm.tokens import LOWER

#: Distinct fingerprints that a shard holds on average, without its boundary.
SHARD_ROWS = 5_000
#: Fingerprints from which the upper tree is fitted, and at least as many for each shard (all rows are indexed).
SAMPLE_ROWS, SHARD_SAMPLE = 50_000, 12
#: Nodes of the upper tree, which every task holds; beyond it shards grow, by 8 bytes a fingerprint.
MAX_SHARDS = 65_536
LEAF_ROWS = 192
#: A node stays whole if its boundary would hold more than this share.
MAX_OVERLAP = 0.75
_STEP = 65_536


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles; 0 without words."""
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _STEP):
        part = hashes[i : i + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(shingle: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return run


def _distance(fps: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(point))


def _split(fps: np.ndarray, radius: int) -> tuple[int, int, np.ndarray] | None:
    """Vantage point, radius and distances with the smallest boundary; None if no split helps."""
    best = None
    for i in range(4):
        point = int(fps[(2 * i + 1) * len(fps) // 8])
        d = _distance(fps, point)
        upto = np.cumsum(np.bincount(d, minlength=66 + radius)) / len(fps)
        for mu in range(64):
            inner, edge = upto[mu], upto[mu + radius] - upto[mu]
            if 0 < inner < 1:
                cost = max(inner + edge, 1 - inner) + edge
                if (best is None or cost < best[0]) and inner + edge <= MAX_OVERLAP + 0.2 and edge <= MAX_OVERLAP:
                    best = (cost, point, mu, d)
    return best and best[1:]


def build_tree(sample: np.ndarray, radius: int, shards: int) -> list[tuple[int, int, int, int]]:
    """Nodes (point, mu, inner, outer); a child >= 0 is a node, below 0 shard -child-1.

    The part with most sample rows is split next, until `shards` parts exist.
    """
    nodes: list[list[int]] = []
    parts: list[tuple[int, int, np.ndarray, tuple[int, int] | None]] = [(-len(sample), 0, sample, None)]
    done: list[tuple[int, int, np.ndarray, tuple[int, int] | None]] = []
    named = 0
    while parts and len(parts) + len(done) < shards:
        part = heapq.heappop(parts)
        _, _, fps, parent = part
        cut = _split(fps, radius) if len(fps) > 8 else None
        if cut is None:
            done.append(part)
            continue
        point, mu, d = cut
        if parent:
            nodes[parent[0]][parent[1]] = len(nodes)
        for side, child in ((2, fps[d <= mu + radius]), (3, fps[d > mu])):
            named += 1
            heapq.heappush(parts, (-len(child), named, child, (len(nodes), side)))
        nodes.append([point, mu, 0, 0])
    for k, (_, _, _, parent) in enumerate([*done, *parts]):
        if parent:
            nodes[parent[0]][parent[1]] = -k - 1
    return [tuple(n) for n in nodes]


def _route(tree: list[tuple[int, int, int, int]], radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo = [(0 if tree else -1, b.column("fp").to_numpy().astype(np.int64).view(np.uint64))]
            while todo:
                at, fps = todo.pop()
                if not len(fps):
                    continue
                if at < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), -at - 1, dtype=np.int32)), pa.array(fps.view(np.int64))], names=["shard", "fp"])
                    continue
                point, mu, inner, outer = tree[at]
                d = _distance(fps, point)
                todo += [(inner, fps[d <= mu + radius]), (outer, fps[d > mu])]

    return run


def _roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """Index of the least member of each row's component among the rows, sorted ascending."""
    n = len(fps)
    root = np.arange(n)
    if n <= 512:
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root[a], root[b]
            if ra != rb:
                root[root == max(ra, rb)] = min(ra, rb)
        return root
    open_ = np.arange(n)  # breadth first; every row is compared with those not yet reached
    while len(open_):
        seed, open_ = open_[0], open_[1:]
        front = [seed]
        while front and len(open_):
            near = _distance(fps[open_], int(fps[front.pop()])) <= radius
            reached, open_ = open_[near], open_[~near]
            root[reached] = seed
            front.extend(reached.tolist())
    return root


def links_within(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join just the components of distance <= radius among distinct `fps`."""
    todo = [fps]
    while todo:
        part = todo.pop()
        cut = _split(part, radius) if len(part) > LEAF_ROWS else None
        if cut is None:
            part = np.sort(part.view(np.int64)).view(np.uint64)
            root = _roots(part, radius)
            moved = np.flatnonzero(root != np.arange(len(part)))
            if len(moved):
                yield part[moved].view(np.int64), part[root[moved]].view(np.int64)
        else:
            _, mu, d = cut
            todo += [part[d <= mu + radius], part[d > mu]]


def _shard_links(radius: int) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        fps = part.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        found = list(links_within(fps, radius))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, dtype=np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect the same rows as all pairs of `fp` at distance <= radius.

    `distinct` has each fingerprint once. The upper tree is fitted on a sample of
    those of least hash, SAMPLE_ROWS or more, which grows with the shards; every row is then dealt by it. A
    shard gives a forest of links, not all pairs, so a dense group of n rows has
    n - 1 links at most per leaf.
    """
    n = distinct.count()
    shards = min(MAX_SHARDS, max(1, -(-n // SHARD_ROWS)) * 2)
    picked = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE_ROWS, SHARD_SAMPLE * shards)).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    tree = build_tree(picked, radius, shards) if len(picked) else []
    return distinct.select("fp").mapInArrow(_route(tree, radius), "shard int, fp long").groupBy("shard").applyInArrow(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id.

    Rows link if their fingerprints differ in `radius` bits or fewer;
    component_id is the least doc_id that a row reaches over links, its own
    included. Texts without words (null, empty, blank) share fingerprint zero and
    link like any other. Repeated ids and null ids keep their own rows; a null id
    is never a component's id unless all its rows have null ids. Other columns
    are not read.
    """
    spark = docs.sparkSession
    workers_import(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with batch_rows(spark, TEXT_ROWS):
        rows = store(rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long"), "fingerprints")
    nodes_at = new_path(spark, "distinct")
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct", nodes_at)
    forest = star_forest(fingerprint_links(nodes, radius))
    member = forest.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(forest.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    least = nodes.join(member, "fp").groupBy("root").agg(F.min("first").alias("component"))
    linked = member.join(least, "root").select("fp", "component")
    classes_at = new_path(spark, "classes")
    classes = store(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "classes", classes_at)
    drop_stored(spark, nodes_at)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
