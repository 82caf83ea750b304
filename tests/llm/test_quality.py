import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldstone.llm import quality as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


EXTRA = ["a b c a b c", "a b c d a b c", "x x x x", "x\nx\n\n \nx \n", "a b c " * 40, "\U0001f600 é|<> b\n" * 3, "one\x0btwo\x0cthree\rfour"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def test_base_matches_brute_force(spark, clashing, documents, labels):
    rows = [*documents, *[(30_000 + i, t, None, None, 0) for i, t in enumerate(EXTRA)]]
    more = spark.createDataFrame([r for r in rows if (r[0] or 0) >= 30_000], "doc_id long, text string, lang string, source string, n_chars long")
    got = q.assess(clashing.unionByName(more, allowMissingColumns=True), labels).collect()
    want = Counter((d[0], *brute(d[1])) for d in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def test_score_is_the_mean_weight(spark):
    import xxhash

    weights = [round(((i * 37) % 100 - 50) / 50, 2) for i in range(64)]
    p = q.QualityParams(bins=64)
    text = "The cat sat on the mat " * 3
    got = spark.createDataFrame([(text,)], "t string").select(q.quality_of(F.col("t"), weights, p)["score"]).first()[0]
    w = text.split()
    signed = lambda b, seed=42: (xxhash.xxh64_intdigest(b, seed) + 2**63) % 2**64 - 2**63
    grams = [signed(x.encode()) for x in w] + [signed(b.encode(), signed(a.encode()) % 2**64) for a, b in zip(w, w[1:], strict=False)]
    assert got == pytest.approx(sum(weights[h % 64] for h in grams) / len(grams))


def test_trusted_text_scores_above_raw(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad@@ stuff## now ") * 40) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in q.assess(docs, labels).collect()}
    assert min(v for k, v in got.items() if k % 2) > 0 > max(v for k, v in got.items() if k % 2 == 0)


def test_without_trusted_rows(spark, docs, labels, empty):
    got = q.assess(docs, labels.limit(0))
    assert {r["score"] for r in got.select("score").distinct().collect()} == {0.0}
    assert got.where("kept = base_failed").count() == 0
    assert q.assess(empty, labels).count() == 0
    kept = q.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_no_python_in_the_plan(spark, docs, labels):
    plan = q.assess(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
