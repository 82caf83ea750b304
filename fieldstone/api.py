"""The reading surface: delimited text and NDJSON as DataFrames."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.functions.parse import class_parser, parse, parse_array, spark_type, types_of
from fieldstone.operators import tokenizer as tk
from fieldstone.operators.sanitize import TOO_MANY, checked, field_at, too_many
from fieldstone.plans.spec import CustomFormat, FieldSpec, ReadSpec, SpecError
from fieldstone.sources import scan
from fieldstone.sources.resource import detect

Paths = str | Sequence[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _plan(spec: ReadSpec) -> str:
    """The physical path: what the caller asks for, else the cheapest that keeps exact semantics."""
    if spec.scan == "native" and not scan.native_legal(spec):
        raise SpecError("Spark's CSV source does not read this dialect: see native_legal")
    if spec.scan == "split" and not scan.split_legal(spec):
        raise SpecError("files of this dialect cannot be split by quotes: see split_legal")
    if spec.scan == "expression" and not scan.expression_legal(spec):
        raise SpecError("the expression path does not read this dialect: see expression_legal")
    return spec.scan if spec.scan != "auto" else "expression" if scan.expression_legal(spec) else "exact"


def _settled(spark: SparkSession, paths: list[str], spec: ReadSpec, detector: Callable = detect) -> ReadSpec:
    """The spec with the path that its files call for, where the caller leaves it open and wants no record numbers.

    Files that Spark would split are split here too, if their dialect allows it:
    the rows are those of the exact path, and text that quotes do not part
    rightly is an error. Bad records are kept or left out by the exact path alone.
    """
    open_ = spec.scan == "auto" and _plan(spec) == "exact" and spec.options.mode == "failfast" and detector is detect
    return dataclasses.replace(spec, scan="split") if open_ and scan.split_legal(spec) and scan.worth_splitting(spark, paths, spec) else spec


def _names(spark: SparkSession, paths: list[str], spec: ReadSpec, detector: Callable) -> tuple[list[str], list[str]]:
    """(field names by the first file, its path); an empty first file has the schema's names.

    Without a header a schema by position says how many fields there are, and no
    file is looked at.
    """
    if not spec.dialect.header and spec.schema and not spec.schema.named:
        return tk.header_names([], spec.dialect, len(spec.schema.fields)), []
    first = scan.files(spark, paths[:1])
    rows, width = scan.header_rows(spark, first[0], spec, detector) if first else ([], 0)
    names = tk.header_names(rows, spec.dialect, width)
    if not names and spec.schema:
        names = [f.name or f"field_{i}" for i, f in enumerate(spec.schema.fields)]
    return names, first


def _headerless(spark: SparkSession, paths: list[str], spec: ReadSpec) -> frozenset[str]:
    """Files after the first where the header does not repeat."""
    if spec.dialect.header and not spec.dialect.header_repeat:
        return frozenset(scan.files(spark, paths)[1:])
    return frozenset()


def read_records(spark: SparkSession, paths: Paths, spec: ReadSpec = ReadSpec(), detector: Callable = detect, numbered: bool = True) -> DataFrame:
    """Records as tokens: file, record_no, raw, fields, error (see `sources.scan`)."""
    paths = _paths(paths)
    spec = spec if numbered else _settled(spark, paths, spec, detector)
    if _plan(spec) == "expression":
        return scan.expression_records(spark, paths, spec, _headerless(spark, paths, spec), numbered)
    if _plan(spec) == "split":
        return scan.split_records(spark, paths, spec, _headerless(spark, paths, spec))
    return scan.exact_records(spark, paths, spec, _headerless(spark, paths, spec), detector)


def _typed(value: Column, children: Column | None, f: FieldSpec | None, name: str, spec: ReadSpec) -> Column:
    if f is None:  # a named schema that leaves this header out: reading the field is the error
        message = f"The schema has no field named {name!r}."
        return F.when(F.raise_error(F.lit(message)).cast("string").isNull(), value)
    named = dataclasses.replace(f, name=f.name or name)
    if isinstance(f.type, type):
        return _class_column(value, named)
    if f.array:
        if children is None:
            raise SpecError("array fields need the exact path")
        return parse_array(children, named, spec.parsers, {**spec.sequences(), **f.sequences} if f.item_sequences else {})
    return parse(value, named, spec.parsers)


def _class_column(value: Column, f: FieldSpec) -> Column:
    """A user's class with parse or parse_exact: its values as text, by a pandas UDF."""
    read = class_parser(f.type, f.format if isinstance(f.format, CustomFormat) else None)

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else str(read(x)))

    return run(value)


def _metadata(f: FieldSpec | None) -> dict[str, Any]:
    if f is None:
        return {}
    kept = {"source_type": f.source_type, "format": repr(f.format) if f.format else None, "sequences": repr(dict(f.sequences)) if f.sequences else None}
    return {k: v for k, v in kept.items() if v}


def read_delimited(spark: SparkSession, paths: Paths, spec: ReadSpec = ReadSpec(), columns: Sequence[str | int] | None = None, detector: Callable = detect) -> DataFrame:
    """Typed columns of delimited files.

    Names come from the first file's header, or are field_0, field_1, ...; types
    from the schema, text without one. `columns` picks fields by name or place
    (the way to pick among repeated names); others are not parsed. A record with
    more fields than the header is an error, one with fewer is padded. In mode
    permissive a malformed or overlong record is a row of nulls, and a last
    column _error says why.
    """
    paths = _paths(paths)
    spec = _settled(spark, paths, spec, detector)
    names, _ = _names(spark, paths, spec, detector)
    picked = list(range(len(names))) if columns is None else [c if isinstance(c, int) else ordinal(names, c) for c in columns]
    specs = {i: spec.field(i, names[i]) for i in picked}
    for i, f in specs.items():
        if f is None and spec.schema and not spec.schema.named:
            raise SpecError(f"the schema has no field at {i}")
    if _plan(spec) == "native":
        rows = scan.native_rows(spark, paths, spec, len(names))
        over = F.raise_error(F.lit(TOO_MANY.replace("%s", "?", 1) % ("1 or more", "s"))).cast("string")
        missing = F.lit(spec.dialect.missing_cell or "")
        value = lambda i: F.when(F.col("_more").isNull(), F.coalesce(F.col(f"_{i}"), missing)).otherwise(over)
        return rows.select(*[_typed(value(i), None, specs[i], names[i], spec).alias(names[i], metadata=_metadata(specs[i])) for i in picked])
    rows = read_records(spark, paths, spec, detector, numbered=False)
    number = F.coalesce("record_no", F.lit(0))
    lenient = spec.options.mode == "permissive"
    if lenient:
        error = F.coalesce("error", too_many(F.col("fields"), number, len(names), spec))
        fields = rows.select(error.alias("error"), F.when(error.isNull(), F.col("fields")).alias("fields"))
    else:
        fields = rows.select(checked(F.col("fields"), number, len(names), spec).alias("fields"))
    out = []
    for i in picked:
        children = F.get("fields", F.lit(i))["children"]
        value = field_at(F.col("fields"), i, spec, specs[i])
        if lenient:
            value = F.when(F.col("error").isNull(), value)
        column = _typed(value, children, specs[i], names[i], spec)
        if lenient:
            column = F.when(F.col("error").isNull(), column)
        out.append(column.alias(names[i], metadata=_metadata(specs[i])))
    return fields.select(*out, *[F.col("error").alias("_error")] * lenient)


def ordinal(names: Sequence[str], name: str) -> int:
    """The place of a name; the first of repeated ones."""
    if name not in names:
        raise IndexError(f"no field named {name!r}; fields: {', '.join(names)}")
    return list(names).index(name)


def to_table(spark: SparkSession, paths: Paths, spec: ReadSpec = ReadSpec()) -> DataFrame:
    """All fields as sanitized text, whatever the schema says."""
    return read_delimited(spark, paths, dataclasses.replace(spec, schema=None))


def to_arrays(spark: SparkSession, paths: Paths, spec: ReadSpec = ReadSpec()) -> DataFrame:
    """values: the raw text of each record's fields, neither sanitized nor padded."""
    return read_records(spark, paths, spec, numbered=False).select(F.transform("fields", lambda f: f["value"]).alias("values"))


def to_typed(spark: SparkSession, paths: Paths, types: type | Sequence[FieldSpec], spec: ReadSpec = ReadSpec()) -> DataFrame:
    """Raw fields bound by position to a dataclass's fields, or to field specs.

    A record of another number of fields, or a value that its type does not
    read, is an error that names field and value.
    """
    specs = types_of(types) if isinstance(types, type) else list(types)
    message = F.printf(F.lit(f"The record has %s field(s), the type {len(specs)}."), F.size("fields").cast("string"))
    rows = read_records(spark, paths, spec, numbered=False).select(F.when(F.size("fields") == len(specs), F.col("fields")).otherwise(F.raise_error(message).cast(scan.FIELDS)).alias("fields"))
    named = [dataclasses.replace(f, name=f.name or f"field_{i}") for i, f in enumerate(specs)]
    return rows.select(*[_typed(F.get("fields", F.lit(i))["value"], None, f, f.name, spec).alias(f.name) for i, f in enumerate(named)])


def map_records(spark: SparkSession, paths: Paths, mapper: Callable[[list[str]], dict], schema: str, spec: ReadSpec = ReadSpec()) -> DataFrame:
    """`mapper` over each record's raw fields, in Arrow batches; it returns a row as a dict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([mapper(list(v)) for v in b["values"]])

    return to_arrays(spark, paths, spec).mapInPandas(run, schema)


def count_records(spark: SparkSession, paths: Paths, spec: ReadSpec = ReadSpec()) -> DataFrame:
    """n: records of all files without headers and comments; null if the option is off.

    Whole files are counted where they lie, without building their fields; on the
    other paths Spark leaves out the fields by itself.
    """
    if not spec.options.row_count_at_start:
        return spark.range(1).select(F.lit(None).cast("long").alias("n"))
    paths = _paths(paths)
    spec = _settled(spark, paths, spec)
    if _plan(spec) == "exact":
        return scan.exact_counts(spark, paths, spec, _headerless(spark, paths, spec)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return read_records(spark, paths, spec, numbered=False).agg(F.count("*").alias("n"))


def first_record(spark: SparkSession, path: str, spec: ReadSpec = ReadSpec()) -> DataFrame:
    """raw: the text of the first file's first record, its header if it has one.

    The head of the file tells where Spark reads its charset and the record ends
    within it; else the file is tokenized up to the record, and no further.
    """
    first = scan.files(spark, [path])[:1]
    raw = scan.first_raw(spark, first[0], spec) if first else None
    return spark.createDataFrame([] if raw is None else [(raw,)], "raw string")


def raw_text(token: Column, quote: str | None) -> Column:
    """A token's text with its quotes put back."""
    return F.when(token["quoted"], F.concat(F.lit(quote or ""), token["value"], F.lit(quote or ""))).otherwise(token["value"])


def field_types(df: DataFrame) -> list[tuple[str, str, str]]:
    """(name, Spark type, declared source type) of each column."""
    return [(f.name, f.dataType.simpleString(), (f.metadata or {}).get("source_type", "")) for f in df.schema.fields]


def read_schema(spec: ReadSpec) -> list[str]:
    """Spark types of an indexed schema's fields."""
    return [spark_type(f) for f in spec.schema.fields] if spec.schema else []


def read_union(spark: SparkSession, paths: Sequence[str], spec: ReadSpec = ReadSpec(), by: str = "name") -> DataFrame:
    """Files whose headers differ, each read by its own: by name (absent columns null) or by position."""
    parts = [read_delimited(spark, p, spec) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True) if by == "name" else out.union(p)
    return out


__all__ = ["count_records", "field_types", "first_record", "map_records", "ordinal", "raw_text", "read_delimited", "read_records", "read_schema", "read_union", "to_arrays", "to_table", "to_typed"]
