"""Rows to delimited text: inputs for queries, tests and the benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.plans.spec import Dialect
from fieldstone.sources.storage import holds_bytes, new_path, write_bytes


def text_of_column(df: DataFrame, name: str) -> Column:
    """A column as text that the parsers read back to the same value."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else c.cast("string")


def cell(value: Column, d: Dialect, quote_all: bool = False) -> Column:
    """A field: quoted where the dialect needs it, or its special characters escaped."""
    if not d.quote:
        return value
    q = d.quote
    if d.double_quote:
        inside = F.replace(value, F.lit(q), F.lit(q + q))
    else:
        e = d.escape or "\\"
        inside = F.replace(F.replace(value, F.lit(e), F.lit(e + e)), F.lit(q), F.lit(e + q))
    special = [F.contains(value, F.lit(c)) for c in {d.delimiter, q, d.line_terminator, d.line_terminator[0]} | ({d.escape} if d.escape else set())]
    any_ = special[0]
    for s in special[1:]:
        any_ = any_ | s
    quoted = F.concat(F.lit(q), inside, F.lit(q))
    return quoted if quote_all else F.when(any_, quoted).otherwise(value)


def lines(df: DataFrame, d: Dialect, columns: Sequence[str] | None = None, null: str = "", quote_all: bool = False) -> DataFrame:
    """value: a line of each row."""
    names = list(columns or df.columns)
    cells = [cell(F.coalesce(text_of_column(df, n), F.lit(null)), d, quote_all) for n in names]
    return df.select(F.array_join(F.array(*cells), d.delimiter).alias("value"))


def write_lines(rows: DataFrame, d: Dialect, header: Sequence[str] = (), path: str | None = None, suffix: dict | None = None) -> str:
    """Write lines to a new folder, a file of each partition where it lies.

    Each file begins with the header lines. Where the dialect has them once, or
    there are no rows, they are a file of their own, the first by name.
    """
    spark = rows.sparkSession
    path = path or new_path(spark, "text")
    head = "".join(h + d.line_terminator for h in header)
    if header and d.header_repeat:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        value = F.coalesce("value", F.lit(""))
        rows = rows.select(F.when(first, F.concat(F.lit(head), value)).otherwise(value).alias("value"))
    writer = rows.write.option("lineSep", d.line_terminator)
    for k, v in (suffix or {}).items():
        writer = writer.option(k, v)
    writer.text(path)
    if header and not (d.header_repeat and holds_bytes(spark, path)):
        write_bytes(spark, f"{path}/header", head.encode((suffix or {}).get("encoding", "utf-8")))
    return path


def write_table(df: DataFrame, d: Dialect, path: str | None = None, quote_all: bool = False, null: str = "") -> str:
    """A table as text: files of which each has the header, if the dialect has one (see `write_lines`)."""
    header = [d.delimiter.join(df.columns)] if d.header else []
    return write_lines(lines(df, d, null=null, quote_all=quote_all), d, header, path)
