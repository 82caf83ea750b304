"""Groups of similar texts: shared bands and SimHash links give candidates, Jaccard similarity decides.

A 64-bit SimHash cannot find 0.8-similar texts by a radius: they lie about ten
bits apart, where no vantage point parts the fingerprints any more. So bands of
ROWS minima of shingle hashes give further candidates, and the texts of each
candidate cluster are compared by their whole shingle sets, in parts of bounded
size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.common import batch_rows, drop_stored, new_path, spread_join, store, workers_import
from fieldstone.llm.components import star_forest
from fieldstone.llm.simhash import near_duplicates
from fieldstone.llm.tokens import LOWER

#: Two texts of similarity s share no band with probability (1 - s ** ROWS) ** BANDS: 5e-6 at 0.8.
BANDS, ROWS = 40, 6
_STEP = 2_048
#: Texts of a cluster, and their characters, that are compared in one task at most (one text at least).
PART_TEXTS, PART_CHARS = 250, 8_000_000
#: Places of an index of hashes that are looked at together.
_PLACES = 1_000_000


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending; fewer words are one shingle, also none."""
    w = (text or "").encode().translate(LOWER).split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64))


def _factors(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, c = np.random.default_rng(seed).integers(0, 2**64, (3, BANDS * ROWS), dtype=np.uint64)
    return a | np.uint64(1), b, c | np.uint64(1)


def band_keys(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A key for each band: texts alike in a band's minima share it."""
    a, b, c = factors
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), _STEP):
        x = hashes[at : at + _STEP, None] * a
        x += b
        np.minimum(least, x.min(axis=0), out=least)
    return ((least ^ (least >> np.uint64(29))) * c).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _bands(shingle: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # what is freed goes back at once
        factors = _factors(seed)
        for b in batches:
            if b.num_rows:
                keys = np.concatenate([band_keys(shingle_hashes(t.as_py(), shingle, seed), factors) for t in b.column("text")])
                nodes = np.repeat(b.column("node").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys.view(np.int64))], names=["node", "band"])

    return run


def similar_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Index of the first member of each set's component; sets link at Jaccard >= similarity.

    Breadth first over an index of the hashes: a dense group costs one look-up.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.empty(0, dtype=np.int64)
    held = owner[np.argsort(codes, kind="stable")]
    count = np.bincount(codes)
    first = np.cumsum(count) - count
    begin = np.cumsum(sizes) - sizes
    root, open_ = np.arange(n), np.ones(n, dtype=bool)
    for seed in range(n):
        front = [seed] if open_[seed] else []
        open_[seed] = False
        while front and open_.any():
            i = front.pop()
            both = np.zeros(n, dtype=np.int64)
            step = max(1, _PLACES // n)
            for at in range(begin[i], begin[i] + sizes[i], step):
                mine = codes[at : min(at + step, begin[i] + sizes[i])]
                many = count[mine]
                places = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                both += np.bincount(held[places], minlength=n)
            near = np.flatnonzero(open_ & (both >= similarity * (sizes + sizes[i] - both) - 1e-9))
            root[near], open_[near] = seed, False
            front.extend(near.tolist())
    return root


def _verified(similarity: float, shingle: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """label: the least node of each component among a part's texts."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        nodes = part.column("node").to_numpy()
        sets = [shingle_hashes(t.as_py(), shingle, seed) for t in part.column("text")]
        return pa.table({"b": part.column("b"), "node": pa.array(nodes, pa.int64()), "label": pa.array(nodes[similar_roots(sets, similarity)], pa.int64())})

    return run


def _part(parts: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(parts)).cast("int")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def cluster_links(inside: DataFrame, verify: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Links (node, label) that connect the same texts as all links inside each cluster; inside: b, node, text.

    b is a cluster's least node. A cluster is compared in parts, each together
    with its leader b: in a group of near copies that joins nearly all. Only
    the texts that did not reach the leader are then compared with every part,
    again in parts, so no task holds more than two parts.
    """
    n, chars = F.count("*"), F.sum(F.length("text"))
    parts = F.greatest(F.ceil(n / PART_TEXTS), F.ceil(chars / PART_CHARS)).cast("int")
    sizes = store(inside.groupBy("b").agg(n.alias("n"), parts.alias("parts")), "cluster-sizes")
    placed = spread_join(inside, sizes, ["b"], "n")
    leader = (F.col("node") == F.col("b")) & (F.col("parts") > 1)
    first = placed.where(~leader).select("b", _part("parts", 0).alias("k"), "node", "text").unionByName(placed.where(leader).select("b", _every("parts").alias("k"), "node", "text"))
    result = "b long, node long, label long"
    near = store(first.groupBy("b", "k").applyInArrow(verify, result), "near")
    apart = near.where("label <> b").select("b", "node")
    left = apart.groupBy("b").agg(F.count("*").alias("n_apart")).join(sizes.where("parts > 1"), "b")
    left = store(left.withColumn("rest", F.ceil(F.col("n_apart") / PART_TEXTS).cast("int")), "apart")
    links = near.select("node", "label")
    if left.isEmpty():
        return links
    some = spread_join(apart, left.drop("n"), ["b"], "n_apart").join(inside.select("node", "text"), "node")
    some = some.select("b", _part("rest", 1).alias("i"), _every("parts").alias("k"), "node", "text")
    whole = spread_join(inside, left.drop("n_apart"), ["b"], "n").select("b", _every("rest").alias("i"), _part("parts", 0).alias("k"), "node", "text")
    second = some.unionByName(whole).groupBy("b", "i", "k").applyInArrow(verify, result)
    return links.unionByName(second.select("node", "label"))


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """Per distinct text of docs (text): node, label; texts of one label are a group.

    Texts link if the Jaccard similarity of their word shingles is `similarity`
    or more; a group is what links reach. node is the text's 64-bit hash, label
    the group's least. All pairs inside a candidate cluster count, so a pair is
    missed only if no chain of candidates joins it. Null texts count as empty.
    Copies are one text from the start, and a cluster of any size is compared in
    parts (`cluster_links`).
    """
    spark = docs.sparkSession
    workers_import(spark)
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    bands_at, inside_at = new_path(spark, "bands"), new_path(spark, "inside")
    with batch_rows(spark, 1_000):
        bands = store(texts.mapInArrow(_bands(shingle, seed), "node long, band long"), "bands", bands_at)
        close = near_duplicates(texts, shingle=shingle, seed=seed, id_col="node").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    shared = bands.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("band", "b")
    links = bands.join(shared, "band").select(F.col("node").alias("a"), "b").distinct()
    forest = star_forest(links.unionByName(close.distinct()))
    member = store(forest.select(F.col("a").alias("node"), "b").unionByName(forest.select(F.col("b").alias("node"), "b").distinct()), "clusters")
    drop_stored(spark, bands_at)
    inside = store(texts.dropDuplicates(["node"]).join(member, "node").select("b", "node", "text"), "inside", inside_at)
    found = star_forest(cluster_links(inside, _verified(similarity, shingle, seed)).select(F.col("node").alias("a"), F.col("label").alias("b")))
    drop_stored(spark, inside_at)
    return texts.select("node").distinct().join(found.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
