"""Newline-delimited JSON: one flat object a line, labels free from line to line."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.functions.parse import parse
from fieldstone.plans.spec import FieldSpec, Schema


@dataclass(frozen=True)
class NdjsonSpec:
    """raw: values verbatim, escapes undecoded and null as the text null; else JSON's own reading.

    mode: what a line that is no object does: failfast, permissive (no labels), drop.
    """

    schema: Schema | None = None
    line_terminator: str | None = None
    encoding: str = "UTF-8"
    raw: bool = False
    mode: str = "failfast"
    parsers: Mapping = field(default_factory=dict)


#: A quoted or bare label, a colon, a quoted or bare value.
_PAIR = r'[{,]\s*+(?:"((?:[^"\\]|\\.)*+)"|([^\s":,{}]++))\s*+:\s*+("(?:[^"\\]|\\.)*+"|[^\s,{}"]++)\s*+'
_OBJECT = rf"^\s*+(?:\{{\s*+\}}|(?:{_PAIR})++\}})\s*+$"


def _raw_map(line: Column) -> Column:
    labels = F.zip_with(F.regexp_extract_all(line, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(line, F.lit(_PAIR), F.lit(2)), lambda a, b: F.concat(a, b))
    values = F.transform(F.regexp_extract_all(line, F.lit(_PAIR), F.lit(3)), lambda v: F.when(F.startswith(v, F.lit('"')), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.map_from_arrays(labels, values)


def read_lines(spark: SparkSession, paths: str | Sequence[str], spec: NdjsonSpec = NdjsonSpec()) -> DataFrame:
    """file, raw, values (map from label to text) of each line; blank lines are skipped."""
    reader = spark.read.option("encoding", spec.encoding)
    if spec.line_terminator:
        reader = reader.option("lineSep", spec.line_terminator)
    lines = reader.text(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\\x{feff}", "").alias("raw")).where(F.trim("raw") != "")
    if spec.raw:
        values = F.when(F.col("raw").rlike(_OBJECT), _raw_map(F.col("raw")))
    else:
        values = F.from_json("raw", "map<string,string>", {"mode": "PERMISSIVE", "allowUnquotedFieldNames": "true"})
        values = F.when(F.startswith(F.ltrim("raw"), F.lit("{")), values)
    if spec.mode == "failfast":
        values = F.coalesce(values, F.raise_error(F.concat(F.lit("Not a JSON object: "), F.col("raw"))).cast("map<string,string>"))
    rows = lines.select("file", "raw", values.alias("values"))
    return rows.where("values is not null") if spec.mode == "drop" else rows


def read_ndjson(spark: SparkSession, paths: str | Sequence[str], spec: NdjsonSpec = NdjsonSpec(), labels: Sequence[str] = ()) -> DataFrame:
    """Columns of the named schema's fields, or of `labels` as text; absent labels are null."""
    rows = read_lines(spark, paths, spec)
    fields = spec.schema.fields if spec.schema else tuple(FieldSpec("string", n) for n in labels)
    out = []
    for f in fields:
        text = F.try_element_at("values", F.lit(f.name))
        if f.sequences:
            chain = F
            for pattern, by in f.sequences.items():
                chain = chain.when(text == F.lit(pattern), F.lit(by).cast("string"))
            text = chain.otherwise(text)
        out.append(parse(text, dataclasses.replace(f), spec.parsers).alias(f.name))
    return rows.select(*out)


def ordinal_of(values: Column, label: str) -> Column:
    """The 0-based place of a label in its own line; null where it is absent."""
    at = F.array_position(F.map_keys(values), label)
    return F.when(at > 0, at - 1)
