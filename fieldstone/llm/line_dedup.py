"""Operator 3, line dedup: a log-template tree of fixed depth.

DataFrame functions only. A line goes down the tree by its token count, then by
its leading tokens, tokens with digits being variable from the start. In a leaf,
a position at which the lines hold too many different tokens is variable too.
Lines that agree in leaf and in all other tokens have one template, as long as
enough of its tokens are constant; a line of which too little would stay
constant stands for itself. Templates of at least `min_docs` documents recur,
and their lines are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.common import drop_stored, new_path, spread_join, store, table

ANY = "<*>"


@dataclass(frozen=True)
class TemplateParams:
    """depth: leading tokens that pick the leaf; max_children: different tokens of a position before it is variable.

    min_constant_percent: share of its tokens that a template has to hold constant.
    """

    depth: int = 4
    min_docs: int = 4
    max_children: int = 8
    min_constant_percent: int = 60


#: A word with a digit: from a word's start, up to its first digit without turning back.
_VARIABLE = r"(?<![^\x20\x0A])[^\x20\x0A0-9]*+[0-9][^\x20\x0A]*+"


def plain(text: Column) -> Column:
    """The text with blanks for all other white space but line ends."""
    for c in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def masked(line: Column) -> Column:
    """Tokens of a plain line, with ANY for those that hold a digit."""
    fixed = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, ANY)).otherwise(line)
    return F.array_remove(F.split(fixed, " "), "")


def _twice(*parts: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes, so that no clash is to be feared among any number of lines."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def _leaf(tokens: Column, depth: int) -> dict[str, Column]:
    return dict(zip(("leaf", "leaf2"), _twice(F.size(tokens), F.slice(tokens, 1, depth)), strict=True))


def drop_recurring_lines(docs: DataFrame, p: TemplateParams = TemplateParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, text without the lines of recurring templates.

    Lines are split at \\n; those without tokens stay, short ones are templates
    like any other. Keys of leaves and templates are pairs of 64-bit hashes.
    Only the lines of leaves that p.min_docs documents reach are taken apart
    further, so lines that occur once cost two hashes. White space within lines
    counts as blanks. Documents are counted, not
    lines: a line repeated in one text does not recur by that. Rows equal in id
    and text are one document and get the same text back; null ids differ by
    text. A null text gives n_lines 0 and a null text, an empty one a line that
    stays; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"))
    cells = rows.where(F.col("text").isNotNull()).select(key.alias("key"), F.posexplode(F.split(plain(F.col("text")), "\n")).alias("pos", "line")).withColumn("tokens", masked(F.col("line"))).where(F.size("tokens") > 0)
    leaves = cells.select("key", *[c.alias(n) for n, c in _leaf(F.col("tokens"), p.depth).items()])
    shared = store(leaves.distinct().groupBy("leaf", "leaf2").agg(F.count("*").alias("n")).where(F.col("n") >= p.min_docs).select("leaf", "leaf2"), "leaves")
    # The leaves that recur are few beside all lines, but their number is not bounded: the join's side is Spark's to choose.
    inside_at = new_path(spark, "leaf-lines")
    inside = store(cells.withColumns(_leaf(F.col("tokens"), p.depth)).join(shared, ["leaf", "leaf2"]).distinct(), "leaf-lines", inside_at)
    tokens = inside.select("leaf", "leaf2", F.posexplode("tokens").alias("at", "token")).where(F.col("at") >= p.depth)
    leaf_rows = inside.groupBy("leaf", "leaf2").agg(F.count("*").alias("n"))
    kinds = tokens.distinct().groupBy("leaf", "leaf2", "at").agg((F.count("*") > p.max_children).alias("wide"))
    wide = kinds.groupBy("leaf", "leaf2").agg(F.max("wide").alias("any"), F.transform(F.sort_array(F.collect_list(F.struct("at", "wide"))), lambda x: x["wide"]).alias("wide")).where("any").drop("any")
    rest = F.slice("tokens", p.depth + 1, F.greatest(F.size("tokens") - p.depth, F.lit(0)))
    shape = F.when(F.col("wide").isNull(), F.col("tokens")).otherwise(F.concat(F.slice("tokens", 1, p.depth), F.zip_with(rest, "wide", lambda t, w: F.when(w, F.lit(ANY)).otherwise(t))))
    holds = 100 * F.size(F.filter("shape", lambda t: t != ANY)) >= p.min_constant_percent * F.size("shape")
    body = F.when(holds, F.array_join("shape", " ")).otherwise(F.col("line"))
    template = dict(zip(("template", "template2"), _twice(F.col("leaf"), F.col("leaf2"), holds, body), strict=True))
    lines_at = new_path(spark, "templates")
    widths = store(leaf_rows.join(wide, ["leaf", "leaf2"], "left"), "widths")
    lines = store(spread_join(inside, widths, ["leaf", "leaf2"], "n").withColumn("shape", shape).select("key", "pos", *[c.alias(n) for n, c in template.items()]), "templates", lines_at)
    drop_stored(spark, inside_at)
    counts = lines.groupBy("template", "template2", "key").agg(F.count("*").alias("n")).groupBy("template", "template2").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    recurring = store(counts.where(F.col("docs") >= p.min_docs).drop("docs"), "recurring")
    dropped = spread_join(lines, recurring, ["template", "template2"], "n").groupBy("key").agg(F.collect_set("pos").alias("dropped"))
    every = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "dropped"), lambda i: F.col("every")[i])
    out = rows.withColumn("key", key).join(dropped, "key", "left").withColumn("every", every)
    changed = F.col("dropped").isNotNull()
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("every")).cast("long").alias("n_lines"),
        F.when(changed, F.size("dropped")).otherwise(0).cast("long").alias("n_dropped"),
        F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))
