"""A corpus pipeline of five stages over `documents`; counted as part of fieldstone.llm.

Each stage gets all rows that the one before it kept, as a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.bitplanes import op9_token_files
from fieldstone.llm.common import new_path, store, table
from fieldstone.llm.decontamination import decontaminate
from fieldstone.llm.mixing import plan_mix, repeated
from fieldstone.llm.quality import keep_good
from fieldstone.llm.similar import similar_groups


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject.

    Null, empty and blank texts fail the rules' base and go; every other row is
    judged by its own text, repeats and null ids included; an empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def _node() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _row_id() -> Column:
    """Orders rows by doc_id; rows without one stand after all others, by their text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", _node()).alias("id"), _node().alias("node"))


def _whole(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct `doc`, so that helper columns clash with none of its columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(n) for n, c in more.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar texts (five-word shingles, Jaccard 0.8): the one of least doc_id.

    Rows that repeat an id and its text are one document; of an id's texts in
    one group that of least hash stays. A null id stands after all others, in the
    order of its text's hash. Null and empty texts are one text; an empty table
    stays empty.
    """
    first = docs.groupBy(_node().alias("node")).agg(F.min(_row_id()).alias("row"))
    groups = first.join(similar_groups(docs), "node").groupBy("label").agg(F.min("row").alias("row"))
    kept = store(groups.select("row.*"), "kept")
    rows = _whole(docs, row=_row_id()).select("doc", "row.*")
    return rows.join(kept, ["none", "id", "node"], "left_semi").dropDuplicates(["none", "id", "node"]).select("doc.*")


def _row_key() -> Column:
    """The same for rows equal in id and text, null ids included."""
    return F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs.

    Rows alike in id and text go or stay together; null and empty texts have no
    words and stay; an empty table stays empty.
    """
    found = decontaminate(docs.select(_row_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), within=0)
    hit = store(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return _whole(docs, key=_row_key()).join(hit, "key", "left_anti").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times.

    A null source is a source of its own; null and blank texts have no words and
    are not taken; rows alike in id and text are taken alike; an empty table
    stays empty.
    """
    plan = plan_mix(docs.select("doc_id", "text", F.array("source").alias("sources")))
    return repeated(docs, plan, F.array("source"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns their documents: a row for each row, repeats and null ids included.

    A null or empty text is its end id alone; an empty table gives no rows.
    """
    return op9_token_files(spark, sf_dir, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_output),
]

#: Fingerprints, hashed draws and the tokenizer have no SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = new_path(spark, "stage-" + name.replace(" ", "-"))
        docs = store(stage(spark, docs, sf_dir), name, at)
    return STAGES[-1][1](spark, docs, sf_dir)
