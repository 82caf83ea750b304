"""Beyond the batch reader: a stream of text files through the same token pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.api import _typed
from fieldstone.operators.expression import FIELDS, tokenize
from fieldstone.operators.sanitize import checked, field_at
from fieldstone.plans.spec import ReadSpec, SpecError
from fieldstone.sources.scan import expression_legal


def stream_delimited(spark: SparkSession, path: str, spec: ReadSpec, names: list[str], max_files: int = 100) -> DataFrame:
    """New files of a folder as typed rows; records are lines and files have no header.

    The schema and names are given, as a stream cannot look at a first file.
    Watermarks, windows and sinks are Structured Streaming's own.
    """
    d = spec.dialect
    if d.header or d.comment_rows or not expression_legal(spec):
        raise SpecError("a stream needs headerless files whose records are lines")
    lines = spark.readStream.option("lineSep", d.line_terminator).option("maxFilesPerTrigger", max_files).text(path)
    if d.comment:
        lines = lines.where(~F.startswith("value", F.lit(d.comment)))
    fields = tokenize(F.col("value"), d)
    if spec.options.mode == "failfast":
        fields = F.coalesce(fields, F.raise_error(F.concat(F.lit("Malformed record: "), F.col("value"))).cast(FIELDS))
    rows = lines.select(fields.alias("fields")).where("fields is not null")
    rows = rows.select(checked(F.col("fields"), F.lit(0), len(names), spec).alias("fields"))
    return rows.select(*[_typed(field_at(F.col("fields"), i, spec, spec.field(i, n)), None, spec.field(i, n), n, spec).alias(n) for i, n in enumerate(names)])
