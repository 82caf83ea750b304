import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from fieldstone.llm.common import store
from fieldstone.llm.similar import shingle_hashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, docs):
    """Each stage's input and output, over the fixture with its odd rows."""
    out, now = [], store(docs, "start")
    for name, f in cp.STAGES:
        got = store(f(spark, now, SF), name.replace(" ", "-"))
        out.append((now.collect(), got.collect(), now.columns, got.columns))
        now = got
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    assert all(before == after for _, _, before, after in stages[:-1])


def test_quality_keeps_clean(stages):
    before, after, *_ = stages[0]
    assert not Counter(after) - Counter(before) and 0 < len(after) < len(before)
    assert all(len((r["text"] or "").split()) >= 50 for r in after)


def test_one_of_each_group(stages):
    """All pairs by their five-word shingles: the least id of each group stays."""
    before, after, *_ = stages[1]
    rows = sorted({(r["doc_id"] is None, r["doc_id"], r["text"]) for r in before}, key=str)
    sets = [set(shingle_hashes(t, 5, 42).tolist()) for _, _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    groups = {}
    for (null, doc_id, _), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append((null, doc_id))
    assert Counter(r["doc_id"] for r in after) == Counter(min(g)[1] for g in groups.values()) and len(groups) < len(rows)


def test_columns_of_any_name_and_reruns(spark, docs):
    """Helper columns never overwrite a table's own, and a rerun keeps the same rows."""
    extra = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("_ident", "_node", "_key", "node", "none", "id", "row", "key", "doc", "label"))])
    for _, f in cp.STAGES[:4]:
        got = [sorted(map(str, f(spark, extra, SF).collect())) for _ in range(2)]
        assert got[0] == got[1]
        assert all("_ident=0, _node=1, _key=2, node=3, none=4, id=5, row=6, key=7, doc=8, label=9" in r for r in got[0])
        assert sorted(map(str, f(spark, docs, SF).collect())) == [r.partition(", _ident=0")[0] + ")" for r in got[0]]


def test_contaminated_go(spark, stages):
    from test_decontamination import brute

    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before, after, *_ = stages[2]
    clean = [r for r in before if not brute(r["text"], items, 0)[4]]
    assert Counter(after) == Counter(clean) and len(clean) < len(before)


def test_mix_repeats_rows(stages):
    before, after, *_ = stages[3]
    times = Counter(after)
    assert set(times) <= set(before) and max(times.values()) <= 3
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(after) - words(before)) < 0.25 * words(before)


def test_tokens_of_all_rows(stages):
    before, after, *_ = stages[4]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == want
    assert sorted(r["start"] for r in after)[0] == 0


def test_empty_input(spark, empty):
    now = empty
    for name, f in cp.STAGES:
        now = store(f(spark, now, SF), name.replace(" ", "-"))
        assert now.count() == 0


def test_run(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
