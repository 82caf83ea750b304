"""Operator 2, toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i is 1
if a term of bucket i occurs. The pairwise part learns interactions, such as an
insult beside a group's name, that a sum of weights misses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.common import crc_mod, table, workers_import

#: Bytes that make up terms: letters, digits and all non-ASCII; others separate.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class FMParams:
    """max_rows bounds the labelled sample the model is fitted on (rows of least hash).

    A bucket takes part if its own toxic rows differ from chance by min_strength
    standard deviations, or those of a pair do from what either bucket and chance
    lead to expect, by min_pair_strength, as there are many more pairs. Pairs are
    looked at among the pair_terms most frequent and the pair_terms strongest
    buckets, so that their counts stay a few megabytes.
    """

    buckets: int = 1 << 19
    factors: int = 4
    max_rows: int = 16_000
    min_docs: int = 4
    min_strength: float = 4.0
    min_pair_strength: float = 7.0
    pair_terms: int = 768
    epochs: int = 10
    batch: int = 256
    rate: float = 0.1
    l2: float = 1e-4
    l2_factors: float = 1e-3
    seed: int = 7


@dataclass
class FMModel:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, x: np.ndarray) -> float:
        v = self.factors[x]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[x].sum() + 0.5 * (s @ s - np.einsum("ij,ij->", v, v)))

    def score(self, x: np.ndarray) -> float:
        z = self.raw(x)
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


#: Bytes of the word beginnings and endings that count as terms beside whole words.
HEADS, TAILS = (4, 5, 6), (4, 6)


def hashed_terms(text: str | None, buckets: int) -> np.ndarray:
    """Distinct buckets of a whole text's terms, ascending.

    Terms are the words and their first and last bytes, so that an inflected or
    compounded insult shares terms with its other forms.
    """
    words = set((text or "").encode().translate(_TERM_BYTES).split())
    long_ = [w for w in words if len(w) > 4]
    found = list(map(crc32, words))
    for n in HEADS:
        found += map(crc32, {w[:n] for w in long_}, repeat(n))
    for n in TAILS:
        found += map(crc32, {w[-n:] for w in long_}, repeat(100 + n))
    return np.unique(np.array(found, dtype=np.uint32) & np.uint32(buckets - 1)).astype(np.int32)


def _strength(toxic: np.ndarray, n: np.ndarray, rate: np.ndarray | float) -> np.ndarray:
    """Standard deviations by which `toxic` of `n` rows differ from a share of `rate`, which is kept off 0 and 1."""
    rate = np.clip(rate, 0.01, 0.99)
    return np.abs(toxic - n * rate) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate))


def interacting(rows: list[np.ndarray], labels: np.ndarray, some: np.ndarray, alone: np.ndarray, p: FMParams) -> np.ndarray:
    """The buckets of `some` that tell with a partner there what neither tells alone; alone: their own toxic shares."""
    number = np.full(p.buckets, -1, dtype=np.int64)
    number[some] = np.arange(len(some))
    both, toxic = (np.zeros((len(some), len(some)), dtype=np.float32) for _ in range(2))
    for at in range(0, len(rows), 2_048):
        part, y = rows[at : at + 2_048], labels[at : at + 2_048].astype(bool)
        x = np.zeros((len(part), len(some)), dtype=np.float32)
        for i, r in enumerate(part):
            k = number[r]
            x[i, k[k >= 0]] = 1
        both += x.T @ x
        toxic += x[y].T @ x[y]
    np.fill_diagonal(both, 0)
    strength = np.minimum.reduce([_strength(toxic, both, e) for e in (labels.mean(), alone[:, None], alone[None, :])])
    return some[((both >= p.min_docs) & (strength >= p.min_pair_strength)).any(axis=1)]


def active_buckets(rows: list[np.ndarray], labels: np.ndarray, p: FMParams) -> np.ndarray:
    """The buckets that tell labels apart, alone or in pairs."""
    df = np.bincount(np.concatenate(rows), minlength=p.buckets)
    toxic = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y]), minlength=p.buckets)
    seen = np.flatnonzero(df >= p.min_docs)
    strength = _strength(toxic[seen], df[seen], labels.mean())
    most = lambda x: seen[np.argsort(-x, kind="stable")[: p.pair_terms]]
    some = np.union1d(most(df[seen]), most(strength))
    return np.union1d(seen[strength >= p.min_strength], interacting(rows, labels, some, (toxic[some] + labels.mean()) / (df[some] + 1), p))


def fit(rows: list[np.ndarray], labels: np.ndarray, p: FMParams) -> FMModel:
    """Logistic loss, AdaGrad, mini-batches in a seeded order; the same rows give the same model.

    Buckets that `active_buckets` leaves out keep weight zero. Without rows, or with one label only, the model is the smoothed share
    of that label.
    """
    weights, factors = np.zeros(p.buckets, dtype=np.float32), np.zeros((p.buckets, p.factors), dtype=np.float32)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = FMModel(float(np.log(share / (1 - share))) if len(labels) else -20.0, weights, factors)
    if len(rows) == 0 or labels.min() == labels.max():
        return model
    active = active_buckets(rows, labels, p)
    number = np.full(p.buckets, -1, dtype=np.int32)
    number[active] = np.arange(len(active))
    rows = [(n := number[r])[n >= 0] for r in rows]
    rng, size = np.random.default_rng(p.seed), len(active)
    w, v = np.zeros(size), rng.normal(0, 0.01, (p.factors, size))
    g_w, g_v, g_b = np.full(size, 1e-2), np.full((p.factors, size), 1e-2), 1e-2
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), p.batch):
            part = order[at : at + p.batch]
            flat = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            by_row = lambda x, owner=owner, n=len(part): np.bincount(owner, weights=x, minlength=n)
            by_term = lambda x, flat=flat: np.bincount(flat, weights=x, minlength=size)
            vs = [vf[flat] for vf in v]
            sums = [by_row(x) for x in vs]
            pairs = sum(s * s - by_row(x * x) for s, x in zip(sums, vs, strict=True)) / 2
            z = model.bias + by_row(w[flat]) + pairs
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / np.sqrt(len(part))
            each = err[owner]
            seen = by_term(np.ones(len(flat))) > 0
            d = by_term(each) + p.l2 * w * seen
            g_w += d * d
            w -= p.rate * d / np.sqrt(g_w)
            for f, (s, x) in enumerate(zip(sums, vs, strict=True)):
                d = by_term(each * (s[owner] - x)) + p.l2_factors * v[f] * seen
                g_v[f] += d * d
                v[f] -= p.rate * d / np.sqrt(g_v[f])
            d = float(err.sum())
            g_b += d * d
            model.bias -= p.rate * d / np.sqrt(g_b)
    weights[active], factors[active] = w, v.T
    return model


def _featurize(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([hashed_terms(t.as_py(), buckets).tobytes() for t in b.column("text")], pa.binary()), b.column("toxic")], names=["doc_id", "terms", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, p: FMParams = FMParams()) -> FMModel:
    """Fit on labelled rows; labels: doc_id, toxic. At most p.max_rows of them, those of least hash.

    Label rows without an id or a label are left out; several labels of one
    document count as toxic if any is. Terms are hashed where the rows lie, so
    the driver gets bucket numbers, not texts.
    """
    spark = docs.sparkSession
    workers_import(spark)
    picked = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = sample.mapInArrow(_featurize(p.buckets), "doc_id long, terms binary, toxic int").toPandas().sort_values(["doc_id", "terms"])
    return fit([np.frombuffer(t, dtype=np.int32) for t in rows["terms"]], rows["toxic"].to_numpy(dtype=np.int64), p)


def _score(model, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            scores = [m.score(hashed_terms(t.as_py(), buckets)) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, p: FMParams = FMParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Rows with crc32(doc_id) mod folds = 0 are held out: their labels are never
    read. The text alone is scored, whole; null and empty texts get the model's
    bias. Repeated and null ids keep their own rows; other columns are not read.
    The model broadcast has (1 + factors) * buckets floats, whatever the input.
    """
    spark = docs.sparkSession
    workers_import(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    learn = labels.where(crc_mod(F.col("doc_id"), folds) != 0)
    model = spark.sparkContext.broadcast(train(rows, learn, p))
    return rows.withColumn("held_out", crc_mod(F.col("doc_id"), folds) == 0).mapInArrow(_score(model, p.buckets), "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
