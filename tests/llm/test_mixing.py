import re
from collections import Counter, defaultdict

import pytest

from fieldstone.llm import mixing as m


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_quotas():
    q = m.quotas({"b": 100, "a": 10, None: 100})
    assert q["a"] == 30 and q["b"] == pytest.approx(180 * 2 / 5) and q[None] == pytest.approx(180 * 3 / 5)
    assert m.quotas({"a": 0, "b": 5}) == {"a": 0.0, "b": 5.0}
    assert sum(m.quotas({"a": 1, "b": 2, "c": 3}).values()) == pytest.approx(6)
    assert m.quotas({"a": 0}) == {"a": 0.0}


def test_flow_is_least_cost():
    flows = m.plan_flows({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15.0, "b": 15.0})
    assert sum(flows["a",].values()) == sum(flows["a", "b"].values()) == sum(flows["b",].values()) == 10
    flows = m.plan_flows({("a",): 10, ("b",): 4}, {"a": 2.0, "b": 12.0})
    assert flows == {("a",): {"a": 2}, ("b",): {"b": 12}}
    # repeating the shared pattern twice costs less than a third pass over b's own
    flows = m.plan_flows({("b",): 10, ("a", "b"): 10}, {"a": 0.0, "b": 40.0})
    assert flows["b",]["b"] == flows["a", "b"]["b"] == 20


def test_flow_against_brute_force():
    import itertools

    patterns, targets = {("a",): 3, ("a", "b"): 2, ("b",): 1}, {"a": 5.0, "b": 4.0}
    flows = m.plan_flows(patterns, targets, 3)

    def cost(total, words):
        return sum(min(words, max(0, total - r * words)) * r * r for r in range(3))

    best = min(
        sum(cost(t, w) for t, w in zip((x, y + z, v), patterns.values(), strict=True))
        for x, y, z, v in itertools.product(range(10), range(7), range(7), range(4))
        if y + z <= 6 and x + y == 5 and z + v == 4
    )
    assert sum(cost(sum(flows[p].values()), w) for p, w in patterns.items()) == best


@pytest.mark.parametrize("bins", [1, 64, 4096])
def test_mix_meets_targets(spark, clashing, documents, monkeypatch, bins):
    from pyspark.sql import functions as F

    monkeypatch.setattr(m, "BINS", bins)
    plan = m.plan_mix(clashing.withColumn("sources", F.array("source")))
    sizes, targets, rows = plan.sizes, plan.targets, m.take(plan).collect()
    assert Counter((r["doc_id"], r["size"], tuple(r["sources"])) for r in rows) == Counter((d[0], size(d[1]), (d[3],)) for d in documents)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r["repeats"] <= 3 and (r["size"] or not r["repeats"])
        s = r["sources"][0]
        taken[s] += r["size"] * r["repeats"]
        largest[s] = max(largest[s], r["size"])
    assert sizes == {s: sum(size(d[1]) for d in documents if d[3] == s) for s in {d[3] for d in documents}}
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 * (2 if s == "src1" else 1) + 2
    again = m.take(m.plan_mix(clashing.repartition(7).withColumn("sources", F.array("source")))).collect()
    assert Counter((r["doc_id"], r["text_hash"], r["repeats"]) for r in again) == Counter((r["doc_id"], r["text_hash"], r["repeats"]) for r in rows)
    copies = m.repeated(clashing, plan, F.array("source"))
    assert copies.columns == clashing.columns
    assert Counter(r["doc_id"] for r in copies.collect()) == +sum((Counter({r["doc_id"]: r["repeats"]}) for r in rows), Counter())


def test_overlap_and_empty(spark, empty):
    from pyspark.sql import functions as F

    assert m.take(m.plan_mix(empty.withColumn("sources", F.array("source")))).count() == 0
    docs = spark.createDataFrame([(i, "w " * 10, ["b", "a", "a"] if i % 2 else ([] if i == 0 else None)) for i in range(40)], "doc_id long, text string, sources array<string>")
    plan = m.plan_mix(docs)
    sizes, targets, df = plan.sizes, plan.targets, m.take(plan)
    assert sizes == {"a": 200, "b": 200, None: 200}
    rows = df.collect()
    assert {tuple(r["sources"]) for r in rows} == {("a", "b"), (None,)}
    assert abs(sum(r["size"] * r["repeats"] for r in rows if r["sources"] == ["a", "b"]) - targets["a"] - targets["b"]) <= 10


def test_sources_without_overlap_need_no_network(monkeypatch):
    """The closed form is the network's flow, for any number of sources."""
    from fieldstone.llm import mixing as m

    patterns = {(f"s{i:03d}",): 10 + i * 7 % 50 for i in range(40)} | {("a", "b"): 90, ("a",): 30, ("b",): 5}
    sizes = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    targets = m.quotas(sizes)
    arcs = []
    for k, (p, words) in enumerate(patterns.items()):
        arcs += [("from", k, words, r * r) for r in range(3)] + [(k, ("source", s), words * 3, 0) for s in p]
    flow = m.min_cost_flow(arcs + [(("source", s), "to", round(t), 0) for s, t in targets.items()], "from", "to")
    got = m.plan_flows(patterns, targets)
    for k, p in enumerate(patterns):
        assert sum(got[p].values()) == sum(flow[k, ("source", s), 0] for s in p)
    many = {(f"s{i:06d}",): 5 for i in range(250_000)}
    asked = []
    monkeypatch.setattr(m, "min_cost_flow", lambda arcs, *_: asked.extend(arcs) or {})
    assert sum(sum(f.values()) for f in m.plan_flows(many, dict.fromkeys((p[0] for p in many), 4.0)).values()) == 1_000_000 and not asked
