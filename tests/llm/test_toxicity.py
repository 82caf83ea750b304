import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from fieldstone.llm import toxicity as t


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def pair_rows(toxic, n=3000):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(n):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted({*([1] * a), *([2] * b), *rng.integers(10, 60, 4).tolist()}), dtype=np.int32))
        labels.append(int(toxic(a, b)))
    return rows, np.array(labels)


@pytest.mark.parametrize("toxic", [lambda a, b: a and b, lambda a, b: a != b, lambda a, b: a == b])
def test_pairs_are_learnt(toxic):
    """Terms that matter only together, at the parameters that ship but for more passes."""
    rows, labels = pair_rows(toxic)
    model = t.fit(rows, labels, t.FMParams(epochs=30))
    wrong = sum((model.score(r) >= 0.5) != bool(y) for r, y in zip(rows, labels, strict=True))
    assert wrong < 30
    linear = t.FMModel(model.bias, model.weights, np.zeros_like(model.factors))
    assert sum((linear.score(r) >= 0.5) != bool(y) for r, y in zip(rows, labels, strict=True)) > 10 * max(1, wrong)


def test_raw_is_the_sum_over_all_pairs():
    rows, labels = pair_rows(lambda a, b: a != b, 500)
    m = t.fit(rows, labels, t.FMParams(buckets=64, min_strength=0.0))
    for r in rows[:50]:
        want = m.bias + sum(float(m.weights[i]) for i in r) + sum(float(m.factors[i] @ m.factors[j]) for i, j in combinations(r, 2))
        assert m.raw(r) == pytest.approx(want, abs=1e-4)


def test_active_buckets_by_brute_force():
    """Both kinds of strength from single counts; bucket 3 is strong alone, 1 and 2 only together."""
    rows, labels = pair_rows(lambda a, b: a != b, 2000)
    rows = [np.array(sorted({*r.tolist(), *([3] if y and i % 3 else [])}), dtype=np.int32) for i, (r, y) in enumerate(zip(rows, labels, strict=True))]
    p = t.FMParams(buckets=64)
    has = [set(r.tolist()) for r in rows]
    rate = labels.mean()
    sd = lambda k, n, e: abs(k - n * e) / np.sqrt(max(n, 1) * e * (1 - e))
    own = {}
    for i in range(64):
        held = [int(y) for h, y in zip(has, labels, strict=True) if i in h]
        own[i] = (len(held), sum(held))
    want = {i for i, (n, k) in own.items() if n >= p.min_docs and sd(k, n, rate) >= p.min_strength}
    for i, j in combinations([i for i in range(64) if own[i][0] >= p.min_docs], 2):
        held = [int(y) for h, y in zip(has, labels, strict=True) if i in h and j in h]
        expect = [rate, *(min(0.99, max(0.01, (own[k][1] + rate) / (own[k][0] + 1))) for k in (i, j))]
        if len(held) >= p.min_docs and min(sd(sum(held), len(held), e) for e in expect) >= p.min_pair_strength:
            want |= {i, j}
    assert set(t.active_buckets(rows, labels, p).tolist()) == want >= {1, 2, 3}


def test_degenerate_training():
    p = t.FMParams(buckets=16)
    none = t.fit([], np.array([], dtype=int), p)
    assert 0 <= none.score(np.array([], dtype=np.int32)) < 0.5
    one = t.fit([np.array([1])] * 9, np.ones(9, dtype=int), p)
    assert one.score(np.array([], dtype=np.int32)) > 0.5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = t.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").collect()
    held = sorted((r["score"], r["toxic"]) for r in rows if r["held_out"])
    assert all(r["held_out"] == fold(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    pos = sum(y for _, y in held)
    auc = (sum(i + 1 for i, (_, y) in enumerate(held) if y) - pos * (pos + 1) / 2) / (pos * (len(held) - pos))
    assert auc > 0.97
    assert sum(1 for s, y in held if s >= 0.5 and not y) <= 0.01 * len(held)


def test_edges(spark, clashing, documents, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)] + [(1, 1, None), (None, 1, 1), (2, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = t.score_toxicity(clashing, labels).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in rows) == Counter((d[0], fold(d[0])) for d in documents)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert t.score_toxicity(empty, labels).count() == 0
    assert len({r["score"] for r in t.score_toxicity(clashing, labels.limit(0)).collect()}) == 1


def test_held_out_labels_do_not_matter(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(150)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r["doc_id"], r["score"]) for r in t.score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_terms_are_whole_text():
    assert t.hashed_terms(None, 64).size == 0
    long = "word " * 50_000 + "idiot"
    assert set(t.hashed_terms("idiot", 1 << 19)) <= set(t.hashed_terms(long, 1 << 19))
