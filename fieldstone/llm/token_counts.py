"""Operator 7, token counts: a digest cache in front of the tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.common import SPACE, drop_stored, new_path, spread_join, store, table, workers_import
from fieldstone.llm.tokens import encoder, space_free, tokenizer_digest

_CACHE_SCHEMA = "digest binary, n_tokens long"


def _count_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_many
        for b in batches:
            counts = [len(ids) // 4 for ids in encode(t.as_py() for t in b.column("content"))]
            yield pa.record_batch([b.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _content(text: Column, path: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, SPACE, " ")) if space_free(path) else text


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _stored(spark: SparkSession, at: str) -> DataFrame:
    """digest, n_tokens of a version's cache; two runs that append at once may store a digest twice."""
    return spark.read.schema(_CACHE_SCHEMA).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(contents: DataFrame, tokenizer: str, at: str) -> int:
    """Encode the contents (digest, content) whose digest the table `at` lacks, append their counts, and say how many they were."""
    spark = contents.sparkSession
    misses = contents.dropDuplicates(["digest"])
    if _exists(spark, at):
        misses = misses.join(spark.read.schema(_CACHE_SCHEMA).parquet(at).select("digest"), "digest", "left_anti")
    fresh = new_path(spark, "encoded")
    encoded = store(misses.mapInArrow(_count_batches(tokenizer), _CACHE_SCHEMA), "encoded", fresh)
    encoded.write.mode("append").parquet(at)
    n = encoded.count()
    drop_stored(spark, fresh)
    return n


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of every text, from a stored cache where it has the text's digest.

    `cache` is the path of a Parquet table, partitioned by tokenizer version,
    that need not exist. Each row's normalised content (white-space runs folded
    where the tokenizer drops them) gets a SHA-256 digest. Distinct digests that
    the cache lacks are encoded once and appended (`fill_cache`); counts then
    join by digest. Copies are folded before the shuffle, so a text that a third
    of the rows share is one row per map task; the rows of such a digest get
    their count where they lie.

    Returns doc_id, n_bytes, n_tokens, over_limit, a row for each row of `docs`.
    A null text counts as empty; repeated ids and null ids keep their own rows;
    other columns are not read; an empty table gives no rows. Two runs that
    append at once may both store a digest: reads take one row of each.
    """
    spark = docs.sparkSession
    workers_import(spark)
    at = f"{cache}/tokenizer={tokenizer_digest(tokenizer)}"
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        _content(F.col(text_col), tokenizer).alias("content"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("content"), 256)))
    fill_cache(rows.select("digest", "content"), tokenizer, at)
    keyed = store(rows.drop("content"), "digests")
    counts = keyed.groupBy("digest").agg(F.count("*").alias("rows")).join(_stored(spark, at), "digest")
    counted = spread_join(keyed, store(counts, "counts"), ["digest"], "rows")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: Session setting: the folder of a cache that outlives the session; without it each session has its own.
CACHE_SETTING = "fieldstone.token.cache"


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = spark.conf.get(CACHE_SETTING, None) or new_path(spark, "token-cache")
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
