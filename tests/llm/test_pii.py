import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldstone.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = sum(int(c) for c in d[::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
    return total % 10 == 0


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    return {"email": True, "card": 14 <= len(d) <= 19 and luhn(d) if d else False, "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    text = text or ""
    spans = [(m.start(), k, m.end(), m[0]) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if ok(kind, m[0])]
    return sorted(spans)


def spelled(spans):
    return ",".join(f"{pii.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


CARD = "4785380592391139"
EXTRA = [
    "a@b.com_x@y.z a@b@c.d .@-.- @a.b x@y a@b..c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.1.1 1.2.3 10.0.0.1.",
    f"{CARD} {CARD[:-1]}0 {CARD[:4]}-{CARD[4:8]} {CARD[8:]}  {CARD}",
    "+1 (743) 555-3824 +1-2 ++491234567890. +(1) +1 (12345678901234567890) +44.20.7946.0958",
    "é\U0001f600x@y.zz\U0001f60010.0.0.1\n+1 743 555 3824",
    "a" * 50_000 + " @ " + "1" * 50_000 + " " + "+1" * 10_000 + " x@" + "a." * 20_000 + "b",
    f"{CARD} " * 300,
]


@pytest.fixture(scope="module")
def rows(documents):
    return [*documents, *[(30_000 + i, t, None, None, 0) for i, t in enumerate(EXTRA)]]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, base int, term int").repartition(3)


def test_base_spans_match_brute_force(frame, rows):
    got = pii.find_personal(frame).collect()
    want = Counter()
    for r in rows:
        s = brute(r[1])
        want[r[0], *[sum(x[1] == k for x in s) for k in range(4)], hashlib.sha256(spelled(s).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        mine = [(s["start"], s["kind"], s["end"], s["value"]) for s in r["all_spans"]]
        assert r["spans"] == spelled(mine) and mine == sorted(mine)


def disclosure(rows, p):
    """Disclosing (entity, term) pairs by hand."""
    word = re.compile(r"[^\W_]+")
    pairs, entities, df = defaultdict(set), defaultdict(set), defaultdict(set)
    at = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for t in set(word.findall(text.lower())):
            df[t].add(n)
        spans = brute(text)
        for s, k, e, v in spans:
            entity = f"{k}:{v.lower()}"
            entities[entity].add(n)
            for m in word.finditer(text):
                inside = max(0, s - p.reach) <= m.start() and m.end() < s or m.start() > e and m.end() <= e + p.reach
                cut = m.start() == s - p.reach and s > p.reach or m.end() == e + p.reach and e + p.reach < len(text)
                if inside and not cut and not any(a < m.end() and m.start() < b for a, _, b, _ in spans):
                    pairs[entity, m[0].lower()].add(n)
                    at[entity, m[0].lower()].add((n, m.start(), m.end()))
    n, out = len(rows), {}
    for (entity, t), docs in pairs.items():
        if len(docs) >= p.min_docs and len(entities[entity]) < n:
            share = math.log(len(docs) * n / (len(entities[entity]) * len(df[t]))) / math.log(n / len(entities[entity]))
            if share >= p.generalise:
                out[entity, t] = share, at[entity, t]
    return out


def test_disclosing_terms(spark):
    rows = [(i, f"The agent Zorro{' Blanco' if i % 2 else ''} writes from bob@mail.com today about cheese") for i in range(6)]
    rows += [(100 + i, f"The agent writes today about cheese number {i}") for i in range(40)]
    rows += [(200 + i, f"unique{i} ann{i}@mail.com writes") for i in range(10)]
    p = pii.DisclosureParams()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = disclosure(rows, p)
    assert {t for _, t in found} == {"zorro", "blanco", "from"}
    places = defaultdict(set)
    for share, at in found.values():
        for n, a, b in at:
            places[rows[n][0]].add((a, b, "reveal" if share >= p.remove else "hint"))
    for r in pii.find_personal(df, p).collect():
        assert {(s["start"], s["end"], pii.KINDS[s["kind"]]) for s in r["all_spans"] if s["kind"] > 3} == places[r["doc_id"]]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, p).collect()}
    assert clean[1] == "The agent   writes  <EMAIL> today about cheese" and clean[100] == rows[6][1]


def test_rare_entities_and_far_terms(spark):
    """Values that occur once are pooled; terms far from a repeated value count."""
    far = "plain words of no weight " * 8
    rows = [(i, f"Some dossier mailbox tom{i}@acme{i}.com is used") for i in range(8)]
    rows += [(50 + i, f"Tarantella {far} write to bob@mail.com") for i in range(4)]
    rows += [(100 + i, f"{far} Some is used to write") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {s["value"] for s in r["all_spans"] if s["kind"] > 3} for r in pii.find_personal(df).collect()}
    assert all({"dossier", "mailbox"} == got[i] for i in range(8))
    assert all(got[50 + i] == {"tarantella"} for i in range(4)) and not any(got[100 + i] for i in range(60))


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 513, 1_000])
def test_running_values(spark, n):
    values = [(i * 37) % 11 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(pii.running(F.col("v"), "int", lambda a, b: a + b), pii.running(F.col("v"), "int", lambda a, b: F.greatest(a, b))).first()
    assert got[0] == [sum(values[: i + 1]) for i in range(n)] and got[1] == [max(values[: i + 1]) for i in range(n)]


def test_one_long_text_takes_time_in_proportion(spark):
    """Four times the numbers in one text take not much over four times as long."""
    import time

    took = []
    for n in (16_000, 16_000, 64_000):
        text = " ".join(f"10.{i % 256}.{i // 256 % 256}.7 word{i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.monotonic()
        r = pii.sanitise(df).first()
        took.append(time.monotonic() - begin)
        assert r["text"].count("<IP>") == n
    assert took[2] < 8 * took[1] + 5


def test_terms_that_tell_on_the_test_table(spark):
    """The method adds spans at its own parameters, each of a word that stands beside a mention or in its text."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = [r for r in pii.find_personal(docs).collect() if any(s["kind"] > 3 for s in r["all_spans"])]
    assert got and all(any(s["kind"] < 4 for s in r["all_spans"]) for r in got)


def test_redact_overlaps(spark):
    spans = [(0, 0, 5, "x"), (3, 1, 8, "y"), (9, 5, 10, "z")]
    df = spark.createDataFrame([("0123456789ab", spans)], "t string, s array<struct<start:int,kind:int,end:int,value:string>>")
    assert df.select(pii.redact(F.col("t"), F.col("s"))).first()[0] == "<EMAIL>8ab"


def test_edges(spark, frame, empty):
    assert pii.find_personal(empty).count() == 0
    assert pii.sanitise(frame.limit(3)).count() == 3


def test_no_python_in_the_plan(frame):
    plan = pii.find_personal(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
