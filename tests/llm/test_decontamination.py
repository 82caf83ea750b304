import hashlib
import re
from collections import Counter

import pytest

from fieldstone.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items, within):
    w = words(text)
    hit, found, near = [False] * len(w), set(), set()
    for item, body in items:
        v = words(body)
        for i in range(max(1, len(v) - 9) if v else 0):
            win = v[i : i + 10]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit[s : s + len(win)] = [True] * len(win)
                    found.add(str(item))
            need = set(win)
            if item not in near and need <= set(w) and any(need <= set(w[s : s + within]) for s in range(len(w)) if w[s] in need):
                near.add(item)
    ids = sorted(found)
    return (len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), any(hit), tuple(ids), len(near))


@pytest.fixture(scope="module")
def case(spark, documents):
    items = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    planted = [d for d in documents if d[0] != 10_004]
    a, b = items[0][1], items[1][1]
    mixed = words(a)[:12]
    planted += [(20_000, f"x {a} y {a.upper()}!", None, None, 0), (20_001, " ".join(words(a)[:9]) + " stop " + b, None, None, 0), (20_002, " ".join(mixed[::-1]), None, None, 0), (20_003, "tiny item", None, None, 0), (20_004, "tiny thing item", None, None, 0)]
    items += [(500, "Tiny item"), (501, ""), (502, None), (None, a), (0, "tiny item"), (503, "...")]
    return planted, items


def frames(spark, case):
    docs = spark.createDataFrame([(*d, 1, 2) for d in case[0]], "doc_id long, text string, lang string, source string, n_chars long, hits int, segment int").repartition(3)
    return docs, spark.createDataFrame(case[1], "item_id long, text string")


def want(case):
    live = [(i, t) for i, t in case[1] if i is not None and t is not None]
    return Counter((d[0], *brute(d[1], live, 20)) for d in case[0])


def as_rows(df):
    return Counter((*r[:6], tuple(r["items"]), r["n_near"]) for r in df.collect())


@pytest.mark.parametrize("block_words", [10_000_000, 400])
def test_matches_brute_force(spark, case, monkeypatch, block_words):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block_words)
    docs, items = frames(spark, case)
    assert as_rows(dc.decontaminate(docs, items)) == want(case)


def test_empty_tables(spark, case, empty):
    docs, items = frames(spark, case)
    assert dc.decontaminate(empty, items).count() == 0
    none = dc.decontaminate(docs.limit(5), items.limit(0)).collect()
    assert len(none) == 5 and not any(r["contaminated"] for r in none)


def test_segments_do_not_change_results(spark, case):
    docs, items = frames(spark, case)
    assert as_rows(dc.search_items(dc.build_index(docs, segment_words=500), items)) == want(case)


def test_one_index_serves_test_sets(spark, case):
    """The index holds terms of the documents, not of a test set."""
    docs, items = frames(spark, case)
    index = dc.build_index(docs)
    assert as_rows(dc.search_items(index, items)) == want(case)
    other = spark.createDataFrame([("z", case[0][0][1])], "item_id string, text string")
    hit = {r["doc_id"] for r in dc.search_items(index, other).collect() if r["contaminated"]}
    assert case[0][0][0] in hit


def test_near_by_brute_force(spark):
    """Random words of a small vocabulary, so that many windows have their terms close by in any order."""
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 90))) for _ in range(60)]
    items = [(str(i), " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 14)))) for i in range(25)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = dc.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert as_rows(got) == Counter((i, *brute(t, items, 20)) for i, t in enumerate(texts))
