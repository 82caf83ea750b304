from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldstone.llm import line_dedup as ld


BLANKS = str.maketrans("\t\x0b\x0c\r", "    ")


def brute(docs, p):
    """Texts without recurring lines, by the same tree in plain Python."""
    cells = []
    for key, text in docs:
        for pos, line in enumerate(text.split("\n")):
            tokens = [ld.ANY if any(c.isdigit() and c.isascii() for c in t) else t for t in __import__("re").findall(r"[^\x20\x09-\x0D]+", line)]
            if tokens:
                cells.append((key, pos, tokens, (len(tokens), tuple(tokens[: p.depth])), line))
    by_leaf = defaultdict(set)
    for key, _, _, leaf, _ in cells:
        by_leaf[leaf].add(key)
    live = [c for c in cells if len(by_leaf[c[3]]) >= p.min_docs]
    children = defaultdict(set)
    for _, _, tokens, leaf, _ in live:
        for i, t in enumerate(tokens[p.depth :], p.depth):
            children[leaf, i].add(t)
    shaped = []
    for key, pos, tokens, leaf, line in live:
        shape = tuple(ld.ANY if len(children[leaf, i]) > p.max_children else t for i, t in enumerate(tokens))
        constant = sum(t != ld.ANY for t in shape)
        shaped.append((key, pos, (leaf, shape if 100 * constant >= p.min_constant_percent * len(shape) else line.translate(BLANKS))))
    docs_of = defaultdict(set)
    for key, _, shape in shaped:
        docs_of[shape].add(key)
    return {(key, pos) for key, pos, shape in shaped if len(docs_of[shape]) >= p.min_docs}


@pytest.mark.parametrize("p", [ld.TemplateParams(), ld.TemplateParams(depth=2, min_docs=2, max_children=3, min_constant_percent=30)])
def test_matches_brute_force(spark, clashing, documents, p):
    logs = [(40_000 + i, f"own line {i} of this document here\nuser u{i} logged in from host{i % 20} at once {'abcdefghijkl'[i % 12]} today\nfooter: all rights reserved by us", None, None, 0) for i in range(30)]
    rows = [*documents, *logs]
    df = clashing.unionByName(spark.createDataFrame(logs, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    gone = brute(sorted({((r[0], r[1])) and ((r[0], r[1]), r[1]) for r in rows if r[1] is not None}, key=str), p)
    want = Counter()
    for r in rows:
        if r[1] is None:
            want[r[0], 0, 0, None] += 1
            continue
        lines = r[1].split("\n")
        kept = [x for i, x in enumerate(lines) if ((r[0], r[1]), i) not in gone]
        want[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = ld.drop_recurring_lines(df, p).collect()
    assert Counter(map(tuple, got)) == want
    if p.max_children == 8:
        assert all("logged" not in r["text"] for r in got if (r["doc_id"] or 0) >= 40_000)


def test_short_lines_recur_and_prose_stays(spark):
    """A short line of many texts goes; lines that share but their beginning, and rows of numbers, stay."""
    words = "abcdefghijklmnopqrstuvwxyz"
    prose = lambda i: "It was then that " + " ".join(words[(i * k) % 26] * 3 + words[i % 26] for k in range(2, 9))
    texts = [f"All rights reserved.\n{prose(i)}\n{i} {i * i} {i + 7}\n\nlast of {words[i]}" for i in range(26)]
    got = ld.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: t.partition("\n")[2] for i, t in enumerate(texts)}


def test_hot_template_is_spread(spark):
    """Half of all lines are one template: its rows are joined where they lie."""
    rows = [(i, f"same line everywhere\nown {words} line") for i, words in enumerate("abcdefgh" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ld.drop_recurring_lines(df)
    assert {r["n_dropped"] for r in got.collect()} == {2}
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_edges(spark, empty):
    assert ld.drop_recurring_lines(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f\n" * 5)] * 9, "doc_id long, text string")
    assert {r["n_dropped"] for r in ld.drop_recurring_lines(same).collect()} == {0}


def test_no_python_in_the_plan(docs):
    plan = ld.drop_recurring_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_masking(spark):
    df = spark.createDataFrame([(" a1 b  2024-01-01\tc",)], "t string")
    assert df.select(ld.masked(ld.plain(F.col("t")))).first()[0] == [ld.ANY, "b", ld.ANY, "c"]
