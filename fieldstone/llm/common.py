"""Helpers shared by the training-data operators: tables, shared storage, worker set-up."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.sources.storage import drop_stored, new_path, shared_dir, workers_import

__all__ = ["SPACE", "TEXT_ROWS", "WORD", "batch_rows", "crc_mod", "drop_stored", "new_path", "parallelism", "shared_dir", "spread_join", "store", "table", "workers_import"]

#: ASCII white space, the separator of `[^\x20\x09-\x0D]+` words.
SPACE = "[\\x20\\x09-\\x0D]+"
#: A word between them.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone, so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and return the written table: lineage ends there."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 1_000


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows to an Arrow batch while a job runs whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n: the fold of a document (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: A key is hot if it has more than one in so many of the rows; there are fewer hot keys than that.
HOT = 2_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """The inner join of two stored tables, where no task gets all rows of a hot key.

    `right` has one row for each key, with the number of the key's rows in `left`
    in its column `rows`, which is dropped. Hot keys, fewer than HOT of them, are
    broadcast and their rows joined where they lie; the others are shuffled.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.where(F.col(rows) * HOT > total).drop(rows)
    rest = right.where(F.col(rows) * HOT <= total).drop(rows)
    spread = left.join(F.broadcast(hot), on)
    return spread.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))
