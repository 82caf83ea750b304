import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as cp
from fieldstone.llm import similar
from fieldstone.llm.similar import cluster_links, shingle_hashes, similar_groups, similar_roots

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _jaccard(a, b):
    a, b = (set(shingle_hashes(t, 5, 42).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def _edited(rng, words, edits):
    out = list(words)
    for k in range(edits):
        out[(2 * k + 1) * len(out) // (2 * edits)] = f"new{rng.random()}"
    return " ".join(out)


def test_stage_drops_similar_texts(spark):
    """Copies of 0.8 similarity or more go, those below it and unlike texts stay."""
    rng = random.Random(5)
    rows, gone = [], set()
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((10 * i, " ".join(words)))
        for k, edits in enumerate((1, 3, 5, 6, 8, 12), 1):
            text = _edited(rng, words, edits)
            if _jaccard(rows[-1][1] if k == 0 else " ".join(words), text) >= 0.8:
                gone.add(10 * i + k)
            rows.append((10 * i + k, text))
    assert 40 * 3 < len(gone) < 40 * 6
    got = cp.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({i for i, _ in rows} - gone)


def test_texts_of_one_id_stay(spark):
    """Unlike texts that share an id all stay; copies under it go."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (7, texts[0] + " more"), (8, texts[1]), (None, texts[2]), (None, texts[2])]
    got = cp.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), "").collect()
    kept = [(r["doc_id"], r["text"].removesuffix(" more")) for r in got]
    assert sorted(kept, key=str) == sorted([(7, texts[0]), (7, texts[1]), (None, texts[2])], key=str)


def test_roots_match_all_pairs():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    sets = base + [np.unique(np.append(s[2:], rng.integers(60, 90, 2).astype(np.uint64))) for s in base]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.8 * (len(a) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert similar_roots(sets, 0.8).tolist() == root and len(set(root)) < len(sets)


@pytest.mark.parametrize("part", [1, 7, 10_000])
def test_clusters_in_parts_match_all_pairs(spark, monkeypatch, part):
    """Chains, near copies of one text and strays, in clusters far larger than a part: no link is lost."""
    monkeypatch.setattr(similar, "PART_TEXTS", part)
    rng = random.Random(8)
    texts = []
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(80)]
        for k in range(30):  # neighbours in the chain are alike, its ends are not
            words = [*words[2:], f"f{family}n{k}a", f"f{family}n{k}b"]
            texts.append(" ".join(words))
        texts += [_edited(rng, texts[-1].split(), 2) for _ in range(20)] + [_edited(rng, texts[-1].split(), 15) for _ in range(5)]
    rows = [(hash_, family * 1000, t) for family in range(3) for hash_, t in enumerate(texts[family * 55 : family * 55 + 55], family * 1000)]
    inside = spark.createDataFrame([(b, n, t) for n, b, t in rows], "b long, node long, text string").repartition(3)
    got = cluster_links(inside, similar._verified(0.8, 5, 42)).collect()
    ids = [n for n, _, _ in rows]

    def components(links):
        root = {n: n for n in ids}
        for a, b in links:
            if root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
        return root

    want = components([(a, b) for (a, _, s), (b, _, t) in combinations(rows, 2) if _jaccard(s, t) >= 0.8])
    assert components([(r["node"], r["label"]) for r in got]) == want and 3 < len(set(want.values())) < len(ids)


def test_edges(spark, empty):
    assert similar_groups(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (6, "a c")], "doc_id long, text string")
    assert similar_groups(odd).count() == 5 and similar_groups(odd).select("label").distinct().count() == 3
