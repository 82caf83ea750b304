"""Operator 4, quality rules: hashed n-gram log-likelihood ratio, trusted target against raw corpus.

DataFrame functions only. Word and word-pair hashes fall into a fixed number of
bins. A bin's weight is log(p_trusted / p_raw), the trusted multinomial having the raw
one as its Dirichlet prior, so that bins seen seldom weigh nothing; a document's
score is the mean weight of its n-grams.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.common import SPACE, WORD, table


@dataclass(frozen=True)
class QualityParams:
    """max_trusted bounds the sample of trusted documents (those of least hash); raw counts cover every document."""

    bins: int = 16_384
    smoothing: float = 32.0
    threshold: float = -0.04
    max_trusted: int = 20_000
    min_words: int = 50
    max_repeat_percent: int = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _pairs(w: Column) -> Column:
    """Hashes of adjacent words."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _from(a: Column, k: int) -> Column:
    """Elements of `a` from the k-th on."""
    return F.slice(a, k, F.greatest(F.size(a) - (k - 1), F.lit(0)))


def _upto(a: Column, short: int) -> Column:
    """Elements of `a` without the last `short`."""
    return F.slice(a, 1, F.greatest(F.size(a) - short, F.lit(0)))


#: Different repeated windows up to which each place is looked up among them.
FEW = 24


def repeat_words(w: Column, pairs: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text, the first included.

    Windows are compared by their 64-bit hashes. Sorted, equal neighbours are
    repeats: where those are few, places are looked up among them; else windows
    are sorted with their places. The union of the places is measured.
    """
    windows = F.zip_with(_upto(pairs, 1), _from(w, 3), lambda p, c: F.xxhash64(p, c))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())

    def covered(places: Column) -> Column:
        steps = F.zip_with(_upto(places, 1), _from(places, 2), lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(steps, F.lit(3), lambda s, x: s + x).cast("long")

    def sorted_places(s: Column) -> Column:
        both = F.zip_with(_upto(s, 1), _from(s, 2), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(some(both))))

    def repeated(h: Column) -> Column:
        twice = lambda s: F.array_distinct(some(F.zip_with(_upto(s, 1), _from(s, 2), lambda a, b: F.when(a == b, a))))

        def measured(again: Column) -> Column:
            looked_up = some(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)))
            with_places = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return let(F.when(F.size(again) <= FEW, looked_up).otherwise(let(with_places, sorted_places)), covered)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(h), twice), measured))

    return let(windows, repeated)


def _counts(rows: DataFrame, p: QualityParams) -> DataFrame:
    """(bin, trusted, n): n-grams of all documents by bin; one row per bin and task before the shuffle."""
    grams = let(_split(F.col("text")), lambda w: F.concat(F.transform(w, lambda x: F.xxhash64(x)), _pairs(w)))
    return rows.select("trusted", F.explode(grams).alias("h")).groupBy(F.pmod("h", F.lit(p.bins)).cast("int").alias("bin"), "trusted").agg(F.count("*").alias("n"))


def bin_weights(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log(p_trusted / p_raw) of each bin; zeros if no document is trusted.

    Trusted: documents whose every label is quality 1, at most p.max_trusted of
    them, so their ids (8 bytes each) can be broadcast. The driver gets at most
    two rows a bin.
    """
    good = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_trusted).withColumn("trusted", F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    target, raw = [0] * p.bins, [0] * p.bins
    for r in _counts(rows, p).collect():
        raw[r["bin"]] += r["n"]
        if r["trusted"]:
            target[r["bin"]] += r["n"]
    if not sum(target):
        return [0.0] * p.bins
    share = [(b + 1.0) / (sum(raw) + p.bins) for b in raw]
    prior, total = p.smoothing * p.bins, sum(target)
    return [round(math.log((a + prior * q) / (total + prior) / q), 5) for a, q in zip(target, share, strict=True)]


def quality_of(text: Column, weights: list[float], p: QualityParams = QualityParams()) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept) of a text."""
    text = F.coalesce(text, F.lit(""))
    llr = F.from_json(F.lit(json.dumps(weights)), "array<double>")

    def measured(w: Column) -> Column:
        def by_pairs(pairs: Column) -> Column:
            add = lambda s, h: s + llr[F.pmod(h, F.lit(p.bins)).cast("int")]
            total = F.aggregate(pairs, F.aggregate(w, F.lit(0.0), lambda s, x: add(s, F.xxhash64(x))), add)
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                repeat_words(w, pairs).alias("n_repeat_words"),
                F.coalesce(total / F.nullif(F.size(w) + F.size(pairs), F.lit(0)), F.lit(0.0)).alias("score"),
            )

        return let(_pairs(w), by_pairs)

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    chars = (F.length(text) - F.length(F.regexp_replace(text, WORD, ""))).cast("long")
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < p.min_words) | (100 * m["n_repeat_words"] > p.max_repeat_percent * m["n_words"])
        return F.struct(
            m["n_words"].alias("n_words"),
            chars.alias("word_chars"),
            symbols.alias("n_symbols"),
            dup_lines.alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (m["score"] >= p.threshold)).alias("kept"),
            m["score"].alias("score"),
        )

    return let(let(_split(text), measured), verdict)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def assess(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the base measures, base_failed, kept, score.

    kept: not base_failed and score >= p.threshold, a fixed bound in nats per
    n-gram, so a document's verdict depends on its text and the two corpus
    models only. Null, empty and blank texts have no words and fail the base.
    Every row keeps its own result, repeated and null ids included; an empty
    table gives none; other columns are not read.
    """
    weights = bin_weights(docs, labels, p, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), quality_of(F.col(text_col), weights, p).alias("q"))
    return rows.select("doc_id", *[F.col(f"q.{f}").alias(f) for f in FIELDS])


def keep_good(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `assess` keeps, with all their columns."""
    weights = bin_weights(docs, labels, p, id_col, text_col)
    return docs.where(quality_of(F.col(text_col), weights, p)["kept"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
