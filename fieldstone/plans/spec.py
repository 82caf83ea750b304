"""Read specifications as immutable values; `dataclasses.replace` derives new ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

#: Names for the usual characters of a dialect.
DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
TERMINATORS = {"crlf": "\r\n", "lf": "\n", "cr": "\r"}
QUOTES = {"double": '"', "single": "'"}
ESCAPES = {"backslash": "\\", "slash": "/"}
COMMENTS = {"hash": "#", "semicolon": ";", "slash": "/", "dash": "-"}
#: Field types that `functions.parse` reads.
TYPES = ("string", "char", "bool", "byte", "short", "int", "long", "float", "double", "decimal", "date", "time", "datetime", "datetimeoffset", "guid")


class SpecError(ValueError):
    """A specification that contradicts itself."""


@dataclass(frozen=True)
class ArrayDialect:
    """Array fields: `prefix item delimiter item suffix`. Without a prefix values stay scalar."""

    delimiter: str
    prefix: str | None = None
    suffix: str | None = None

    def __post_init__(self) -> None:
        if not self.delimiter:
            raise SpecError("an array needs a delimiter")
        if (self.prefix is None) != (self.suffix is None):
            raise SpecError("an array has both a prefix and a suffix, or neither")


@dataclass(frozen=True)
class Dialect:
    """The grammar of delimited text. header_rows are 1-based; none of them means no header."""

    delimiter: str = ","
    line_terminator: str = "\r\n"
    quote: str | None = '"'
    double_quote: bool = True
    escape: str | None = None
    skip_initial_space: bool = False
    comment: str | None = None
    comment_rows: tuple[int, ...] = ()
    header_rows: tuple[int, ...] = (1,)
    header_join: str = " "
    header_repeat: bool = True
    null_sequence: str | None = None
    missing_cell: str | None = None
    array: ArrayDialect | None = None

    def __post_init__(self) -> None:
        for name in ("delimiter", "quote", "escape", "comment"):
            if (v := getattr(self, name)) is not None and len(v) != 1:
                raise SpecError(f"{name} is one character, not {v!r}")
        if not self.line_terminator:
            raise SpecError("a line terminator has at least one character")
        if any(r < 1 for r in self.header_rows + self.comment_rows):
            raise SpecError("rows count from 1")

    @property
    def header(self) -> bool:
        return bool(self.header_rows)

    def without_header(self) -> Dialect:
        return replace(self, header_rows=())

    def inner(self) -> Dialect:
        """The dialect of an array's items: no arrays within."""
        return replace(self, delimiter=self.array.delimiter, array=None) if self.array else self


@dataclass(frozen=True)
class IntegerFormat:
    """Sign, exponent and group characters; group None: no groups."""

    group: str | None = ","


@dataclass(frozen=True)
class NumberFormat:
    group: str | None = ","
    decimal: str = "."


@dataclass(frozen=True)
class TemporalFormat:
    """A pattern in custom date-format letters; / and : stand for the separators.

    `pivot`: two-digit years below it are in this century's hundred from 2000,
    others in 1900.
    """

    pattern: str
    date_separator: str = "/"
    time_separator: str = ":"
    pivot: int = 50


@dataclass(frozen=True)
class CustomFormat:
    pattern: str
    provider: Any = None


Format = IntegerFormat | NumberFormat | TemporalFormat | CustomFormat
Sequences = Mapping[str, "str | None"]


@dataclass(frozen=True)
class FieldSpec:
    """One field. `parser` takes a string Column to a Column and goes before type and format.

    item_sequences: sequences replace an array's items too, which stay as they are otherwise.
    """

    type: Any = "string"
    name: str | None = None
    format: Format | None = None
    parser: Callable | None = None
    sequences: Sequences = field(default_factory=dict)
    source_type: str | None = None
    precision: tuple[int, int] = (38, 18)
    array: bool = False
    item_sequences: bool = False


def integer(type: str = "int", name: str | None = None, group: str | None = ",", **more: Any) -> FieldSpec:
    return FieldSpec(type, name, IntegerFormat(group), **more)


def number(type: str = "decimal", name: str | None = None, format: NumberFormat | None = None, **more: Any) -> FieldSpec:
    return FieldSpec(type, name, format, **more)


def temporal(type: str, name: str | None = None, pattern: str | None = None, **more: Any) -> FieldSpec:
    default = {"date": "yyyy-MM-dd", "time": "HH:mm:ss"}.get(type, "yyyy-MM-ddTHH:mm:ss")
    return FieldSpec(type, name, TemporalFormat(pattern or default), **more)


def custom(type: Any, name: str | None = None, pattern: str | None = None, provider: Any = None, **more: Any) -> FieldSpec:
    return FieldSpec(type, name, CustomFormat(pattern, provider) if pattern else None, **more)


@dataclass(frozen=True)
class Schema:
    """Fields bound by position, or by header name where `named`."""

    fields: tuple[FieldSpec, ...]
    named: bool = False

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields if f.name and f.name.strip()]
        if len(set(names)) < len(names):
            raise SpecError("field names repeat")
        if self.named and len(names) < len(self.fields):
            raise SpecError("a named schema needs a name for every field")

    def field(self, position: int, name: str) -> FieldSpec | None:
        """The field at a position under a header name; None if it is not declared."""
        if self.named:
            return next((f for f in self.fields if f.name == name), None)
        return self.fields[position] if position < len(self.fields) else None


def indexed(*fields: FieldSpec) -> Schema | None:
    return Schema(tuple(fields)) if fields else None


def named(*fields: FieldSpec) -> Schema | None:
    return Schema(tuple(fields), True) if fields else None


@dataclass(frozen=True)
class Resource:
    """encoding None: by byte-order mark, else UTF-8. compression None: none."""

    encoding: str | None = None
    compression: str | None = None
    sequences: Sequences = field(default_factory=dict)


@dataclass(frozen=True)
class Options:
    """What to leave out, and how to meet malformed records: failfast, permissive or drop."""

    unescape: bool = True
    special_values: bool = True
    extend_incomplete: bool = True
    row_count_at_start: bool = True
    mode: str = "failfast"

    def __post_init__(self) -> None:
        if self.mode not in ("failfast", "permissive", "drop"):
            raise SpecError(f"unknown mode {self.mode!r}")


@dataclass(frozen=True)
class ReadSpec:
    """All that a read needs. `multiline`: quoted fields may hold the line terminator.

    `scan` picks the physical path: exact, expression, split, native or auto. `parsers`
    maps a type to a parser for all its fields; the last registered wins.
    """

    dialect: Dialect = Dialect()
    schema: Schema | None = None
    resource: Resource = Resource()
    options: Options = Options()
    parsers: Mapping[Any, Callable] = field(default_factory=dict)
    multiline: bool = True
    scan: str = "auto"

    def __post_init__(self) -> None:
        if self.scan not in ("auto", "exact", "expression", "split", "native"):
            raise SpecError(f"unknown scan {self.scan!r}")
        for f in self.schema.fields if self.schema else ():
            if twice := set(f.sequences) & set(self.sequences()):
                raise SpecError(f"sequence {sorted(twice)[0]!r} of a field is one of the resource too")

    def sequences(self) -> dict[str, str | None]:
        """The resource's sequences with the dialect's null sequence."""
        own = dict(self.resource.sequences)
        if self.dialect.null_sequence is not None:
            if self.dialect.null_sequence in own:
                raise SpecError(f"sequence {self.dialect.null_sequence!r} stands twice")
            own[self.dialect.null_sequence] = None
        return own

    def field(self, position: int, name: str) -> FieldSpec | None:
        return self.schema.field(position, name) if self.schema else FieldSpec()


#: Presets: no header, single quote, backslash escape.
COMMA = Dialect(",", quote="'", escape="\\", header_rows=())
SEMICOLON = replace(COMMA, delimiter=";")
TAB = replace(COMMA, delimiter="\t")
PIPE = replace(COMMA, delimiter="|")


def legacy(delimiter: str = ";", quote: str | None = '"', line_terminator: str = "\r\n", header: bool = False, empty_cell: str = "", missing_cell: str = "") -> ReadSpec:
    """A specification by the older positional settings; empty cells become empty_cell."""
    d = Dialect(delimiter, line_terminator, quote, header_rows=(1,) if header else (), missing_cell=missing_cell)
    return ReadSpec(d, resource=Resource(sequences={"": empty_cell} if empty_cell else {}))
