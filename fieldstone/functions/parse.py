"""Strict typed parsing of text Columns.

A value that its type does not read is an error inside the expression itself, so
no filter that the optimizer moves can hide or move it. NULL stays NULL.
"""

from __future__ import annotations

import dataclasses
import re
import typing
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.plans.spec import TYPES, CustomFormat, FieldSpec, Format, IntegerFormat, NumberFormat, SpecError, TemporalFormat

#: Spark types of the field types; decimal takes its precision from the field.
SPARK_TYPES = {"string": "string", "char": "string", "bool": "boolean", "byte": "smallint", "short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "date": "date", "time": "string", "datetime": "timestamp_ntz", "datetimeoffset": "timestamp", "guid": "string"}
#: Date patterns of cultures, day first or month first.
CULTURE_DATES = {"": "MM/dd/yyyy", "en-us": "M/d/yyyy", "en-gb": "dd/MM/yyyy", "fr-fr": "dd/MM/yyyy", "de-de": "dd.MM.yyyy", "es-es": "dd/MM/yyyy", "it-it": "dd/MM/yyyy", "nl-nl": "dd-MM-yyyy", "fr-be": "dd-MM-yy"}
#: Group and decimal signs of the same cultures, and short times other than HH:mm:ss.
CULTURE_NUMBERS = {"": (",", "."), "en-us": (",", "."), "en-gb": (",", "."), "fr-fr": ("\u202f", ","), "de-de": (".", ","), "es-es": (".", ","), "it-it": (".", ","), "nl-nl": (".", ","), "fr-be": ("\u202f", ",")}
CULTURE_TIMES = {"en-us": "h:mm:ss tt", "es-es": "H:mm:ss"}
_GUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def spark_type(f: FieldSpec) -> str:
    """DDL of the Column that `parse` gives for a built-in type."""
    if isinstance(f.type, T.DataType):
        return f.type.simpleString()
    if f.type == "decimal":
        return f"decimal({f.precision[0]},{f.precision[1]})"
    if f.type not in SPARK_TYPES:
        raise SpecError(f"No parser registered for type {f.type}; known: {', '.join(TYPES)}")
    return SPARK_TYPES[f.type]


def _or_error(value: Column, parsed: Column, f: FieldSpec) -> Column:
    where = f" in field {f.name}" if f.name else ""
    message = F.concat(F.lit("Cannot read '"), value, F.lit(f"' as {f.type}{where}."))
    return F.when(value.isNotNull(), F.coalesce(parsed, F.raise_error(message).cast(spark_type(f))))


def _ungrouped(v: Column, group: str | None) -> Column:
    return F.replace(v, F.lit(group), F.lit("")) if group else v


#: The whole-number types and the one range that is not a Spark type's own.
_WHOLE = ("byte", "short", "int", "long")
_BYTE = (0, 255)


def _whole(v: Column, type_: str, fmt: Format | None) -> Column:
    text = F.trim(v)
    if isinstance(fmt, (IntegerFormat, NumberFormat)):  # sign, exponent and groups
        d = _ungrouped(text, fmt.group).try_cast("decimal(38,6)")
        n = F.when(d == F.floor(d), d).try_cast(SPARK_TYPES[type_])
    else:
        n = text.try_cast(SPARK_TYPES[type_])
    return F.when(n.between(*_BYTE), n) if type_ == "byte" else n


def _real(v: Column, f: FieldSpec) -> Column:
    fmt = f.format if isinstance(f.format, (IntegerFormat, NumberFormat)) else NumberFormat()
    v = _ungrouped(F.trim(v), fmt.group)
    point = getattr(fmt, "decimal", ".")
    if point != ".":
        v = F.when(~F.contains(v, F.lit(".")), F.replace(v, F.lit(point), F.lit(".")))
    if f.type != "decimal":
        return v.try_cast(spark_type(f))
    plain = v if f.format is not None else F.when(~v.rlike("[eE]"), v)  # no exponent without a format
    return plain.try_cast(spark_type(f))


#: Custom date-format letters and the letters of Java patterns.
_LETTERS = {"yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "tt": "a", "zzz": "XXX", "zz": "X", "K": "XXX"}
_PIECE = re.compile(r"'([^']*)'|\"([^\"]*)\"|\\(.)|(y+|M+|d+|H+|h+|m+|s+|[fF]+|t+|z+|K)|([/:])|(.)", re.S)


def java_pattern(fmt: TemporalFormat) -> str:
    """A custom date-format pattern as a Java one; / and : become the separators."""
    out = []
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for m in _PIECE.finditer(fmt.pattern):
        literal, letters, mark = m[1] or m[2] or m[3], m[4], m[5]
        if letters:
            if letters[0] in "fF":
                out.append("S" * len(letters))
            elif letters not in _LETTERS:
                raise SpecError(f"unknown pattern letters {letters!r} in {fmt.pattern!r}")
            else:
                out.append(_LETTERS[letters])
        elif mark:
            out.append(quote(fmt.date_separator if mark == "/" else fmt.time_separator))
        elif literal is not None:
            out.append(quote(literal))
        elif m[6]:
            out.append(quote(m[6]) if m[6].isalpha() or m[6] in "#{}[]" else m[6])
    return "".join(out)


def _pivoted(d: Column, pattern: str, pivot: int, unit: str) -> Column:
    """Two-digit years read as 2000 to 2099: those from the pivot on fall in 1900."""
    if "yyyy" in pattern or "yy" not in pattern:
        return d
    early = F.add_months(d, -1200) if unit == "date" else d - F.expr("INTERVAL 100 YEARS")
    return F.when(F.year(d) % 100 >= pivot, early).otherwise(d)


#: Patterns that are tried in turn where no format is given.
_DEFAULTS = {
    "date": ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss"),
    "time": ("HH:mm:ss", "HH:mm:ss.SSSSSS", "HH:mm:ss.SSS", "HH:mm", "hh:mm:ss a", "h:mm a"),
    "datetime": ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "M/d/yyyy HH:mm:ss", "M/d/yyyy h:mm:ss a", "yyyy-MM-dd"),
    "datetimeoffset": ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy h:mm:ss a XXX", "M/d/yyyy HH:mm:ss XXX"),
}


def _temporal(v: Column, f: FieldSpec) -> Column:
    if isinstance(f.format, TemporalFormat):
        patterns, pivot = [java_pattern(f.format)], f.format.pivot
    elif isinstance(f.format, CustomFormat):
        patterns, pivot = [java_pattern(TemporalFormat(f.format.pattern))], 50
    else:
        patterns, pivot = list(_DEFAULTS[f.type]), 50
    v = F.trim(v)
    found = []
    for p in patterns:
        lit = F.lit(p)
        if f.type == "date":
            found.append(_pivoted(F.try_to_timestamp(v, lit).cast("date"), p, pivot, "date"))
        elif f.type == "time":
            found.append(F.date_format(F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), v), F.lit("yyyy-MM-dd " + p)).cast("timestamp_ntz"), "HH:mm:ss.SSSSSS"))
        elif f.type == "datetime":
            found.append(_pivoted(F.try_to_timestamp(v, lit).cast("timestamp_ntz"), p, pivot, "datetime"))
        else:
            found.append(F.try_to_timestamp(v, lit))
            if "XXX" in p:  # offsets without a colon
                found.append(F.try_to_timestamp(v, F.lit(p.replace("XXX", "XX"))))
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _other(v: Column, f: FieldSpec) -> Column:
    if f.type == "bool":
        low = F.lower(F.trim(v))
        return F.when(low == "true", True).when(low == "false", False)
    if f.type == "char":
        return F.when(F.length(v) > 0, F.substring(v, 1, 1))
    low = F.lower(F.trim(v))  # guid
    low = F.regexp_replace(low, "^[{(](.*)[)}]$", "$1")
    low = F.when(low.rlike("^[0-9a-f]{32}$"), F.regexp_replace(low, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(low)
    return F.when(low.rlike(_GUID), low)


def class_parser(cls: type, fmt: Format | None) -> Callable[[str], Any]:
    """The `parse_exact` or `parse` class method of a user's type, by what the format gives."""
    args = [a for a in (getattr(fmt, "pattern", None), getattr(fmt, "provider", None)) if a is not None]
    for name, some in ((n, args[:k]) for n in ("parse_exact", "parse") for k in range(len(args), -1, -1)):
        method = getattr(cls, name, None)
        if method is None or name == "parse_exact" and not some:
            continue
        if method.__code__.co_argcount - 1 == 1 + len(some):
            return lambda text, m=method, a=tuple(some): m(text, *a)
    raise SpecError(f"No parser registered for type {cls.__name__}")


def parse(value: Column, f: FieldSpec, parsers: Mapping[Any, Callable] | None = None) -> Column:
    """A text Column as the field's type.

    Order: the field's own parser, a parser registered for the type, the
    built-in type with its format. A parser is a function from Column to Column;
    a pandas UDF is one too.
    """
    if f.parser is not None:
        return f.parser(value)
    if parsers and f.type in parsers:
        return parsers[f.type](value)
    if f.type == "string":
        return value
    spark_type(f)
    if f.type in _WHOLE:
        return _or_error(value, _whole(value, f.type, f.format), f)
    if f.type in ("float", "double", "decimal"):
        return _or_error(value, _real(value, f), f)
    if f.type in _DEFAULTS:
        return _or_error(value, _temporal(value, f), f)
    return _or_error(value, _other(value, f), f)


def _culture_format(type_: str, culture: str) -> Format:
    date, (group, decimal), time = CULTURE_DATES[culture], CULTURE_NUMBERS[culture], CULTURE_TIMES.get(culture, "HH:mm:ss")
    if type_ in _WHOLE:
        return IntegerFormat(group)
    if type_ in ("float", "double", "decimal"):
        return NumberFormat(group, decimal)
    return TemporalFormat({"date": date, "time": time}.get(type_, f"{date} {time}"))


def parse_culture(value: Column, type_: str, culture: str) -> Column:
    """A number, date, time or datetime by a culture's separators and short patterns."""
    if (name := culture.lower()) not in CULTURE_DATES:
        raise SpecError(f"unknown culture {culture!r}; known: {', '.join(k or 'invariant' for k in CULTURE_DATES)}")
    return parse(value, FieldSpec(type_, format=_culture_format(type_, name)))


def parse_array(children: Column, f: FieldSpec, parsers: Mapping[Any, Callable] | None = None, sequences: Mapping[str, str | None] | None = None) -> Column:
    """Items of an array field, each as the field's type; a missing field is empty.

    sequences: whole items that are replaced before they are parsed.
    """
    item = dataclasses.replace(f, array=False)

    def one(c: Column) -> Column:
        chain = F
        for pattern, by in (sequences or {}).items():
            chain = chain.when(c == F.lit(pattern), F.lit(by).cast("string"))
        return parse(chain.otherwise(c) if sequences else c, item, parsers)

    return F.transform(F.coalesce(children, F.array().cast("array<string>")), one)


def array_item(array: Column, i: int) -> Column:
    """The item at 0-based place i; a place out of range is an error."""
    message = F.concat(F.lit(f"Array index {i} is out of range: "), F.size(array).cast("string"), F.lit(" item(s)."))
    place = F.when(F.size(array) > i, F.lit(i)).otherwise(F.raise_error(message).cast("int"))
    return F.get(array, place)


def types_of(cls: type) -> list[FieldSpec]:
    """Field specs of a dataclass, by the order of its fields."""
    names = {str: "string", bool: "bool", int: "long", float: "double"}
    hints = typing.get_type_hints(cls)
    return [FieldSpec(names.get(hints[f.name], f.metadata.get("type", hints[f.name])), f.name) for f in dataclasses.fields(cls)]
