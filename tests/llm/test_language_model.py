import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldstone.llm.language_model import ClassModel, ClassParams, exchange, score_documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), ""]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.mark.parametrize("block_tokens", [3_000, 2_000_000])
def test_base_matches_brute_force(spark, clashing, documents, block_tokens):
    p = ClassParams(classes=6, core_words=60, block_tokens=block_tokens)
    got = score_documents(clashing, p=p).collect()
    counts = Counter(w for d in documents if not fold(d[0]) for w in tokens(d[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d in documents:
        t = tokens(d[1])
        want[d[0], fold(d[0]), len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_no_rows_and_no_training(spark, docs, empty):
    assert score_documents(empty).count() == 0
    only = [r for r in docs.select("doc_id").distinct().collect() if fold(r[0]) and r[0] is not None][:3]
    rows = score_documents(docs.where(docs.doc_id.isin([r[0] for r in only]))).collect()
    assert rows and all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in rows)


def test_model_is_a_distribution():
    p = ClassParams(classes=3)
    moves = np.array([[0, 3, 1], [2, 5, 4], [2, 3, 0]])
    counts = np.array([4.0, 7, 4, 3, 2])
    own = np.array([0, 1, 1, 2, 2])
    m = ClassModel(20, 5, moves, p)
    assert list(m.moves.sum(axis=0)) == [4, 11, 5]
    for before in range(4):
        total = m.probability(counts, np.full(5, before), own).sum() + m.probability(np.zeros(1), np.array([before]), np.array([3])).sum()
        assert total == pytest.approx(1)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    n = 20
    side = (np.arange(n) * 7 % 20 < 10).astype(int)
    pairs = rng.poisson(30, (n, n)) * (side[:, None] != side[None, :]) + rng.poisson(1, (n, n))
    pairs[0] = pairs[:, 0] = 1
    cls = exchange(pairs, 3, 20, 0)
    a = cls[1:][side[1:] == 0]
    b = cls[1:][side[1:] == 1]
    assert len(set(a)) == len(set(b)) == 1 and set(a) != set(b) and list(cls).count(0) == 1


def brute_scores(documents, p):
    """The model by plain loops: counts, core, evidence of all neighbours, classes, scores."""
    from fieldstone.llm.language_model import END

    seqs = [(fold(d[0]), [w.encode() for w in tokens(d[1])]) for d in documents]
    counts = Counter(w for out, t in seqs if not out for w in t)
    core = [END, *sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[: p.core_words - 1]]
    number = {w: i for i, w in enumerate(core)}
    pairs = np.zeros((len(core), len(core)))
    for out, t in seqs:
        for a, b in [] if out else zip([END, *t], t, strict=False):
            if a in number and b in number:
                pairs[number[a], number[b]] += 1
    cls = dict(zip(core, exchange(pairs, p.classes, p.rounds, 0).tolist(), strict=True))
    between = np.full((p.classes, p.classes), p.smoothing)
    for a in core:
        for b in core:
            between[cls[a], cls[b]] += pairs[number[a], number[b]]
    given = np.rint(65_536 * np.log(between / between.sum(axis=1, keepdims=True) / (between.sum(axis=0) / between.sum())))
    speak = {}
    for out, t in seqs:
        for a, w, b in [] if out else zip([END, *t], t, [*t[1:], END], strict=False):
            if w not in number:
                s = speak.setdefault(w, np.zeros(p.classes))
                s += (given[cls[a]] if a in number else 0) + (given[:, cls[b]] if b in number else 0)
    own = cls | {w: 1 + int(s[1:].argmax()) for w, s in speak.items()}
    moves = np.zeros((p.classes, p.classes), dtype=np.int64)
    for out, t in seqs:
        for a, b in [] if out else zip([END, *t], t, strict=False):
            moves[own[a], own[b]] += 1
    m = ClassModel(sum(counts.values()), len(counts), moves, p)
    score = lambda t: sum(math.log10(m.probability(np.array([counts[w]]), np.array([own.get(a, p.classes)]), np.array([own.get(w, p.classes)]))[0]) for a, w in zip([END, *t], t, strict=False))
    return Counter((d[0], round(score(t), 4)) for d, (_, t) in zip(documents, seqs, strict=True))


@pytest.mark.parametrize(("parts", "block_tokens"), [(1, 2_000_000), (3, 20_000), (8, 3_000)])
def test_score_is_of_the_documents_alone(spark, documents, docs, parts, block_tokens):
    p = ClassParams(classes=6, core_words=60, block_tokens=block_tokens, bucket_words=4_000)
    got = score_documents(docs.repartition(parts), p=p).collect()
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in got) == brute_scores(documents, p)


def test_default_parameters_give_one_score_for_any_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [sorted((r["doc_id"], r["score"]) for r in score_documents(docs.repartition(n)).collect()) for n in (1, 5)]
    assert got[0] == got[1]


def swept_scores(documents, p):
    """The model by plain loops where every word moves by all its neighbours: scores, and how many sweeps stood."""
    seqs = [(fold(d[0]), tokens(d[1])) for d in documents]
    train = [t for out, t in seqs if not out]
    counts = Counter(w for t in train for w in t)
    core = ["", *sorted((w for w in counts if w), key=lambda w: (-counts[w], w.encode()))[: p.core_words - 1]]
    number = {w: i for i, w in enumerate(core)}
    pairs = Counter((a, b) for t in train for a, b in zip(["", *t], t, strict=False))
    own = {}

    def table(of):
        out = np.zeros((p.classes, p.classes))
        for (a, b), n in pairs.items():
            if a in of and b in of:
                out[of[a], of[b]] += n
        return out

    def step(of, words):
        between = table(of) + p.smoothing
        given = np.rint(65_536 * np.log(between / between.sum(axis=1, keepdims=True) / (between.sum(axis=0) / between.sum())))
        speak = {w: np.zeros(p.classes) for w in words}
        for (a, b), n in pairs.items():
            if b in speak and a in of:
                speak[b] += n * given[of[a]]
            if a in speak and b in of:
                speak[a] += n * given[:, of[b]]
        return of | {w: 1 + int(s[1:].argmax()) for w, s in speak.items()}

    def likelihood(of):
        log = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return log(table(of)) - log(table(of).sum(axis=0)) - log(table(of).sum(axis=1))

    square = np.array([[pairs[a, b] for b in core] for a in core])
    own = dict(zip(core, exchange(square, p.classes, p.rounds, 0).tolist(), strict=True))
    own, done = step(own, counts.keys() - number.keys()), 0
    while done < p.sweeps and likelihood(after := step(own, counts.keys() - {""})) > likelihood(own):
        own, done = after, done + 1
    m = ClassModel(sum(counts.values()), len(counts), table(own).astype(np.int64), p)
    score = lambda t: sum(math.log10(m.probability(np.array([counts[w]]), np.array([own.get(a, p.classes)]), np.array([own.get(w, p.classes)]))[0]) for a, w in zip(["", *t], t, strict=False))
    return Counter((d[0], round(score(t), 4)) for d, (_, t) in zip(documents, seqs, strict=True)), done


@pytest.mark.parametrize(("parts", "block_tokens"), [(1, 2_000_000), (3, 20_000)])
def test_sweeps_match_brute_force(spark, documents, docs, parts, block_tokens):
    p = ClassParams(classes=6, core_words=60, sweeps=3, block_tokens=block_tokens, bucket_words=4_000)
    want, done = swept_scores(documents, p)
    got = score_documents(docs.repartition(parts), p=p).collect()
    assert done and Counter((r["doc_id"], round(r["score"], 4)) for r in got) == want


def test_words_outside_the_core_teach_each_other(spark):
    """Rare words that stand beside rare words alone: which of two kinds they are tells nothing to a model of the core."""
    rng = np.random.default_rng(1)
    sides = lambda a, b, n, many: [" ".join(f"{a}{x} {b}{y}" for x, y in rng.integers(0, n, (100, 2))) for _ in range(many)]
    rows = list(enumerate(sides("f", "g", 500, 400) + sides("x", "y", 1_000, 100)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, core = ({r["doc_id"]: r["score"] for r in score_documents(df, **kw).collect() if r["held_out"]} for kw in ({}, {"p": ClassParams()}))
    rare = [i for i in whole if i >= 400]
    assert rare and all(whole[i] > core[i] + 1 for i in rare)
