"""From a record's fields to sanitized values: shape, padding, sequences, unescaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldstone.plans.spec import Dialect, FieldSpec, ReadSpec

TOO_MANY = "The record %s contains %s more field%s than expected."


def _java_set(*chars: str | None) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(chars) if c)


def unescape(value: Column, d: Dialect) -> Column:
    """Escaped escape, delimiter and quote characters, and doubled quotes, in one pass.

    Other escaped characters keep their escape.
    """
    parts = []
    if d.escape:
        parts.append(f"{_java_set(d.escape)}([{_java_set(d.escape, d.delimiter, d.quote)}])")
    if d.quote and d.double_quote:
        parts.append(f"({_java_set(d.quote)}){_java_set(d.quote)}")
    if not parts:
        return value
    return F.regexp_replace(value, "|".join(parts), "$1$2" if len(parts) == 2 else "$1")


def needs_flags(spec: ReadSpec) -> bool:
    """Whether any value of the read may be substituted or unescaped."""
    d = spec.dialect
    some = bool(spec.sequences()) or any(f.sequences for f in (spec.schema.fields if spec.schema else ()))
    return spec.options.special_values and some or spec.options.unescape and bool(d.escape or d.quote and d.double_quote)


def sanitize(token: Column, spec: ReadSpec, field: FieldSpec | None) -> Column:
    """A token struct to its text: sequences first, then unescaping.

    A sequence replaces a whole value that is empty, or neither quoted nor
    escaped. Steps that the specification cannot need are left out of the plan.
    """
    value = token["value"]
    out = value
    if spec.options.unescape and (spec.dialect.escape or spec.dialect.quote and spec.dialect.double_quote):
        out = F.when(token["escaped"], unescape(value, spec.dialect)).otherwise(value)
    sequences = {**spec.sequences(), **(field.sequences if field else {})} if spec.options.special_values else {}
    if not sequences:
        return out
    free = (F.length(value) == 0) | ~(token["quoted"] | token["escaped"])
    chain = F
    for pattern, by in sequences.items():
        chain = chain.when(free & (value == F.lit(pattern)), F.lit(by).cast("string"))
    return chain.otherwise(out)


def field_at(fields: Column, i: int, spec: ReadSpec, field: FieldSpec | None) -> Column:
    """The sanitized text of field i; a short record gives the missing cell.

    Without `extend_incomplete` a short record is an error.
    """
    missing = F.lit((spec.dialect.missing_cell if spec.options.special_values else None) or "")
    if not spec.options.extend_incomplete:
        missing = F.raise_error(F.concat(F.lit(f"The record has no field {i}: it has only "), F.size(fields).cast("string"), F.lit(" field(s).")))
        missing = missing.cast("string")
    return F.when(F.size(fields) > i, sanitize(F.get(fields, F.lit(i)), spec, field)).otherwise(missing)


def too_many(fields: Column, record_no: Column, width: int, spec: ReadSpec) -> Column:
    """The message about a record of more fields than `width`; null for others."""
    shift = max(len(spec.dialect.header_rows), 1) if spec.dialect.header else 0
    over = F.size(fields) - width
    return F.when(over > 0, F.printf(F.lit(TOO_MANY), (record_no + shift).cast("string"), over.cast("string"), F.when(over > 1, "s").otherwise("")))


def checked(fields: Column, record_no: Column, width: int, spec: ReadSpec) -> Column:
    """The fields; more of them than `width` is an error that names the record."""
    message = too_many(fields, record_no, width, spec)
    return F.when(message.isNull(), fields).otherwise(F.raise_error(message).cast(_TYPE))


_TYPE = "array<struct<value:string,quoted:boolean,escaped:boolean,children:array<string>>>"
