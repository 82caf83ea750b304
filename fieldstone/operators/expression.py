"""The tokenizer as Column expressions, for text in which each record is one line.

Each token is matched with the delimiter before it, so that leading empty fields
count, and all repetitions are possessive, so that long fields need no stack. A
line is well formed just if the matches cover it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldstone.plans.spec import Dialect

#: Type of a record's fields on every scan path.
FIELDS = "array<struct<value:string,quoted:boolean,escaped:boolean,children:array<string>>>"


def _java(c: str) -> str:
    """A character as a literal of a Java pattern, inside and outside of classes."""
    return f"\\x{{{ord(c):x}}}"


def _pattern(d: Dialect) -> str:
    chars = "".join(_java(c) for c in (d.quote, d.escape) if c)
    escaped = f"|{_java(d.escape)}[\\s\\S]" if d.escape else ""
    raw = f"(?:[^{_java(d.delimiter)}{_java(d.escape) if d.escape else ''}]{escaped})*+"
    space = "\\x20*+" if d.skip_initial_space else ""
    if not d.quote:
        return f"{_java(d.delimiter)}{space}({raw})"
    q = _java(d.quote)
    doubled = f"|{q}{q}" if d.double_quote else ""
    return f"{_java(d.delimiter)}{space}({q}(?:[^{chars}]{escaped}{doubled})*+{q}(?={_java(d.delimiter)}|\\z)|(?!{q}){raw})"


def tokenize(line: Column, d: Dialect) -> Column:
    """The fields of a line as FIELDS; null for a malformed line.

    Arrays are left to the exact tokenizer.
    """
    if not d.quote and not d.escape and not d.skip_initial_space:  # nothing but delimiters: any line is well formed
        return F.transform(F.split(line, _java(d.delimiter), -1), lambda t: _token(t, d))
    whole = F.concat(F.lit(d.delimiter), line)
    found = F.regexp_extract_all(whole, F.lit(_pattern(d)), F.lit(0))
    covered = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x)) == F.length(whole)
    values = F.regexp_extract_all(whole, F.lit(_pattern(d)), F.lit(1))
    return F.when(covered, F.transform(values, lambda t: _token(t, d)))


def _token(t: Column, d: Dialect) -> Column:
    none = F.lit(None).cast("array<string>").alias("children")
    has = lambda v, c: F.contains(v, F.lit(c)) if c else F.lit(False)
    if not d.quote:
        return F.struct(t.alias("value"), F.lit(False).alias("quoted"), has(t, d.escape).alias("escaped"), none)
    quoted = F.startswith(t, F.lit(d.quote))
    inside = F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
    value = F.when(quoted, inside).otherwise(t)
    doubled = quoted & has(inside, d.quote) if d.double_quote else F.lit(False)
    return F.struct(value.alias("value"), quoted.alias("quoted"), (has(t, d.escape) | doubled).alias("escaped"), none)
