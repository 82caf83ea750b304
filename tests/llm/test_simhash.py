import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from fieldstone.llm import simhash as sh
from fieldstone.llm.components import star_forest

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius):
    """Least index reachable of each fingerprint."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one two", "a b c", "a b c d", "A b C d a b c", "é ü ß \U0001f600", "x " * 70_000 + "y z"])
def test_fingerprint(text):
    assert sh.fingerprint(text) % 2**64 == brute_fingerprint(text)


def dense(seed, n, centres):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, centres, dtype=np.uint64)
    out = {int(x) for x in base}
    while len(out) < n:
        x = int(base[rng.integers(centres)])
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def joined(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("n", "centres"), [(1, 1), (300, 300), (1500, 200), (1500, 5), (900, 1)])
@pytest.mark.parametrize("radius", [0, 2, 3])
def test_links_keep_components(n, centres, radius):
    fps = dense(n + centres, n, centres)
    at = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fps)}
    links = [(at[int(a)], at[int(b)]) for part in sh.links_within(fps, radius) for a, b in zip(*part, strict=True)]
    assert joined(n, links) == components([int(x) for x in fps], radius)


def test_shards_keep_every_near_pair():
    fps = dense(3, 2000, 40)
    tree = sh.build_tree(fps[::3], 2, 24)
    assert len(tree) > 10
    import pyarrow as pa

    homes = {}
    for b in sh._route(tree, 2)(iter([pa.record_batch([pa.array(fps.view(np.int64))], names=["fp"])])):
        for s, f in zip(b.column("shard").to_pylist(), b.column("fp").to_pylist(), strict=True):
            homes.setdefault(f % 2**64, set()).add(s)
    assert set(homes) == {int(x) for x in fps}
    for i, x in enumerate(fps):
        near = fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 2]
        assert all(homes[int(x)] & homes[int(y)] for y in near)


def test_star_forest_with_hubs(spark):
    """A hub at the least node, one at the greatest, and a chain beside many small pairs."""
    edges = [(0, i) for i in range(1, 3_000)] + [(90_000, 10_000 + i) for i in range(3_000)] + [(20_000 + i, 20_001 + i) for i in range(40)]
    edges += [(30_000 + 2 * i, 30_001 + 2 * i) for i in range(5_000)]
    got = {r["a"]: r["b"] for r in star_forest(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 3_000)} | {10_000 + i: 10_000 for i in range(1, 3_000)} | {90_000: 10_000}
    want |= {20_001 + i: 20_000 for i in range(40)} | {30_001 + 2 * i: 30_000 + 2 * i for i in range(5_000)}
    assert got == want


def test_star_forest(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (7, 7), (60, 61), (61, 60), (-5, 60)]
    got = star_forest(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {(i, 0) for i in range(1, 41)} | {(100, 50), (60, -5), (61, -5)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert star_forest(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_match_brute_force(spark, clashing, documents, monkeypatch):
    monkeypatch.setattr(sh, "SHARD_ROWS", 30)
    got = sh.near_duplicates(clashing).collect()
    fps = [brute_fingerprint(d[1]) for d in documents]
    root = components(fps, 2)
    least = {}
    for d, r in zip(documents, root, strict=True):
        if d[0] is not None:
            least[r] = min(least.get(r, d[0]), d[0])
    want = Counter((d[0], f"{f:016x}", least.get(r)) for d, f, r in zip(documents, fps, root, strict=True))
    assert Counter(map(tuple, got)) == want


def test_empty(spark, empty):
    assert sh.near_duplicates(empty).count() == 0
