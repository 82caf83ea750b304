"""Operator 10, PII: patterns find protected entities, corpus co-occurrence finds terms that reveal them.

DataFrame functions only. An entity is a found value (an address, a number), or
all values of a kind or an e-mail domain, so that values which occur once count too.
Terms of the texts that mention it are counted over documents; the disclosure of
term t about entity e is PMI(e, t) / IC(e) = log(n(e,t) N / (n(e) n(t))) / log(N / n(e)),
1 where the term implies the entity. At or above a threshold the term's mentions
are generalised, and removed above a higher one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.common import parallelism, store, table
from fieldstone.llm.quality import let

#: The base patterns by kind, in the order in which kinds are listed.
#: Possessive forms and the look-behind of the e-mail's start match the same text
#: as the plain patterns without trying each start within a run again.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*_PATTERNS, "hint", "reveal")
TERM = r"[\p{L}\p{N}]+"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


@dataclass(frozen=True)
class DisclosureParams:
    """reach: characters beside a mention in which terms that tell a kind or domain go; min_docs: documents that a pair must share."""

    reach: int = 64
    min_docs: int = 3
    generalise: float = 0.8
    remove: float = 0.95


#: Elements that a running value goes over at a time.
_CHUNK = 256


def running(values: Column, kind: str, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it; kind: the elements' SQL type.

    Chunks first, then the chunks' totals, so that no array grows element by
    element beyond the number of chunks.
    """

    def along(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, x: let(combine(acc["at"], x), lambda v: F.struct(v.alias("at"), F.array_append(acc["out"], v).alias("out")))
        return F.aggregate(part, start, step)["out"]

    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(F.slice(c, 2, _CHUNK), c[0], combine))
        before = let(along(F.slice(totals, 2, F.size(totals)), totals[0]), lambda rest: F.concat(F.slice(totals, 1, 1), rest))
        rest = F.zip_with(F.slice(chunks, 2, F.size(chunks)), F.slice(before, 1, F.greatest(F.size(chunks) - 1, F.lit(0))), lambda c, b: along(c, b))
        first = F.concat(F.array(chunks[0][0]), along(F.slice(chunks[0], 2, _CHUNK), chunks[0][0]))
        return F.concat(first, F.flatten(rest))

    chunked = lambda v: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")), lambda c: F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))), over)
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast(f"array<{kind}>")).otherwise(chunked(v)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: leftmost non-overlapping matches, in code points.

    What stands between the matches and the matches themselves, in turn, make up
    the text, so running sums of their lengths are the places.
    """
    gaps = F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, v: F.length(g) + F.length(v))
        ends = running(lengths, "int", lambda a, b: a + b)
        return F.zip_with(m, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda m: m["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return lambda m: let(_digits(m["value"]), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return lambda m: F.length(_digits(m["value"])).between(10, 15)
    return lambda m: m["value"].isNotNull()


def _with_kind(k: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the four base kinds, by start, then kind."""
    none = F.array().cast(f"array<{_SPAN}>")
    parts = []
    for k, (kind, pattern) in enumerate(_PATTERNS.items()):
        valid = F.filter(matches(text, pattern), _valid(kind))
        spans = F.transform(valid, _with_kind(k))
        parts.append(F.when(F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9]"), spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def beside(terms: Column, spans: Column) -> Column:
    """array<struct<t, before, after>>: each term with the end of the spans that begin up to it, and the start of the next one.

    Terms and spans are laid in one order; running values over it give each
    term its neighbours, whatever the number of spans. Places without a span
    are far away.
    """
    far = 1 << 30
    event = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("term"), x["end"].alias("end"), x["value"].alias("value"))

    def joined(e: Column) -> Column:
        before = running(F.transform(e, lambda x: F.when(x["term"] == 0, x["end"]).otherwise(-far)), "int", lambda a, b: F.greatest(a, b))
        after = F.reverse(running(F.reverse(F.transform(e, lambda x: F.when(x["term"] == 0, x["start"]).otherwise(far))), "int", lambda a, b: F.least(a, b)))
        at = F.zip_with(e, before, lambda x, b: F.struct(x.alias("t"), b.alias("before")))
        each = F.zip_with(at, after, lambda x, a: F.struct(x["t"].alias("t"), x["before"].alias("before"), a.alias("after")))
        return F.filter(each, lambda x: x["t"]["term"] == 1)

    return let(F.sort_array(F.concat(F.transform(spans, event(0)), F.transform(terms, event(1)))), joined)


def outside_terms(text: Column, spans: Column) -> Column:
    """array<struct<start, end, value>>: a text's terms that touch none of `spans`, in lower case."""
    apart = F.filter(beside(matches(text, TERM), spans), lambda x: (x["before"] < x["t"]["start"]) & (x["after"] > x["t"]["end"]))
    return F.transform(apart, lambda x: F.struct(x["t"]["start"].alias("start"), x["t"]["end"].alias("end"), F.lower(x["t"]["value"]).alias("value")))


def _entities(span: Column) -> Column:
    """The entities of a span: its value, and as pools its kind and an e-mail's domain."""
    kind, value = span["kind"].cast("string"), F.lower(span["value"])
    domain = F.when(span["kind"] == 0, F.concat(F.lit("@"), F.substring_index(value, "@", -1)))
    return F.array_compact(F.array(F.concat_ws(":", kind, value), kind, domain))


def _pooled(entity: Column) -> Column:
    return ~F.contains(entity, F.lit(":"))


def _equals(k: int) -> Callable[[Column], Column]:
    return lambda x: x == k


def _spell(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def disclosing_terms(found: DataFrame, texts: DataFrame, p: DisclosureParams) -> tuple[DataFrame, DataFrame]:
    """Pairs (key, entity, term) of the texts, and (entity, term, disclosure) at or above p.generalise.

    found: key, entities, words, a row for each key. All counts are documents: of a pair in one text,
    of the entity, and of the term. Entities of fewer than p.min_docs documents
    share no pair that often; they count in their pools.
    """
    n_docs = texts.count()
    mentioned = found.select("key", F.explode("entities").alias("entity"), "words")
    entities = store(mentioned.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= p.min_docs), "entity-counts")
    pairs = mentioned.join(entities, "entity").select("key", "entity", "n_entity", F.explode("words").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity")).where(F.col("n_both") >= p.min_docs)
    terms = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    pmi = F.log(F.col("n_both") * F.lit(float(n_docs)) / (F.col("n_entity") * F.col("n_term")))
    known = F.log(F.lit(float(n_docs)) / F.col("n_entity"))
    scored = together.join(terms, "term").select("entity", "term", F.when(known > 0, pmi / known).otherwise(0.0).alias("disclosure"))
    return pairs, store(scored.where(F.col("disclosure") >= p.generalise), "telling")


def find_personal(docs: DataFrame, p: DisclosureParams = DisclosureParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text_hash, n_email, n_ip, n_card, n_phone, base_sha256, spans, all_spans.

    Base spans always stay. Terms that disclose an entity get spans of kind
    `hint` (generalise) or `reveal` (remove) where they touch no base span: those of a value
    anywhere in its texts, those of a kind or domain within p.reach characters of
    a mention. `spans` spells
    all spans as kind:start:end; all_spans holds them as structs. Places are code
    points, ends exclusive. A null text counts as empty; rows that agree in id
    and text get the same spans, repeated and null ids keep their own rows; an
    empty table gives none; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    hashed = F.xxhash64("text")
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), hashed)
    entities = F.array_distinct(F.flatten(F.transform("base", _entities)))
    some = F.size("base") > 0
    located = rows.withColumn("base", base_spans(F.col("text"))).select("doc_id", hashed.alias("text_hash"), key.alias("key"), "base", F.when(some, outside_terms(F.col("text"), F.col("base"))).alias("terms"))
    found = store(located, "entities")
    holding = found.where(some).dropDuplicates(["key"])
    pairs, telling = disclosing_terms(holding.select("key", entities.alias("entities"), F.array_distinct("terms.value").alias("words")), rows, p)
    pool = F.when(_pooled(F.col("entity")), F.col("entity")).otherwise("")  # a value's terms count anywhere in its texts
    told = store(pairs.join(telling, ["entity", "term"]).groupBy("key", pool.alias("pool"), "term").agg(F.max("disclosure").alias("disclosure")), "told")
    mine = F.when(F.col("pool") == "", F.col("base")).otherwise(F.filter("base", lambda s: F.array_contains(_entities(s), F.col("pool"))))
    texts = told.select("key", "pool").distinct().join(holding.select("key", "base", "terms"), "key").repartition(parallelism(docs.sparkSession), "key", "pool").withColumn("mine", mine)
    near = lambda x: ((x["after"] - p.reach <= x["t"]["start"]) & (x["t"]["end"] < x["after"])) | ((x["before"] < x["t"]["start"]) & (x["t"]["end"] <= x["before"] + p.reach))
    by_reach = F.transform(F.filter(beside(F.col("terms"), F.col("mine")), near), lambda x: F.struct(x["t"]["start"].alias("start"), x["t"]["end"].alias("end"), x["t"]["value"].alias("value")))
    placed = texts.select("key", "pool", F.explode(F.when(F.col("pool") == "", F.col("terms")).otherwise(by_reach)).alias("t"))
    scored = placed.withColumn("term", F.col("t.value")).join(told, ["key", "pool", "term"]).groupBy("key", "t").agg(F.max("disclosure").alias("disclosure"))
    kind = F.when(F.col("disclosure") >= p.remove, KINDS.index("reveal")).otherwise(KINDS.index("hint"))
    more = scored.groupBy("key").agg(F.collect_list(F.struct(F.col("t.start").alias("start"), kind.alias("kind"), F.col("t.end").alias("end"), F.col("t.value").alias("value"))).alias("more"))
    every = found.drop("terms").join(more, "key", "left").withColumn("all_spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))))
    counts = [F.size(F.filter(F.col("base.kind"), _equals(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(_PATTERNS)]
    return every.select("doc_id", "text_hash", *counts, F.sha2(_spell(F.col("base")), 256).alias("base_sha256"), _spell(F.col("all_spans")).alias("spans"), "all_spans")


def redact(text: Column, spans: Column) -> Column:
    """The text with base spans and hints replaced by <KIND>, and reveals removed.

    Of overlapping spans the one that starts first stands; an overlap's rest goes
    with it.
    """
    tags = F.array(*[F.lit("" if k == "reveal" else f"<{k.upper()}>") for k in KINDS])

    def part(some: Column) -> Column:
        """The text of a run of spans, cut out first, so that places are counted within it."""
        first, last = some[0]["at"], F.element_at(some, -1)["upto"]

        def cut(here: Column) -> Column:
            piece = lambda x: F.when(x["start"] < x["at"], F.lit("")).otherwise(F.concat(F.substr(here, x["at"] - first + 1, x["start"] - x["at"]), tags[x["kind"]]))
            return F.array_join(F.transform(some, piece), "")

        return let(F.substr(text, first + 1, last - first), cut)

    def joined(upto: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), upto)
        each = F.zip_with(F.zip_with(spans, upto, lambda s, u: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), u.alias("upto"))), F.slice(before, 1, F.size(upto)), lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["upto"].alias("upto"), at.alias("at")))
        parts = let(each, lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / _CHUNK).cast("int")), lambda c: F.slice(e, c * _CHUNK + 1, F.lit(_CHUNK))))
        return F.concat(F.array_join(F.transform(parts, part), ""), F.substr(text, F.element_at(upto, -1) + 1, F.length(text)))

    ends = running(F.transform(spans, lambda s: s["end"]), "int", lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) == 0, text).otherwise(let(ends, joined))


def sanitise(docs: DataFrame, p: DisclosureParams = DisclosureParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and sanitised text of each document; see find_personal and redact."""
    spans = find_personal(docs, p, id_col, text_col).select(F.col("doc_id").alias("id"), "text_hash", "all_spans").dropDuplicates(["id", "text_hash"])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")))
    return joined.select("doc_id", redact(F.col("text"), F.col("all_spans")).alias("text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents")).drop("text_hash", "all_spans")
