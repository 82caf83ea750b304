"""Scans: files to rows of (file, record_no, raw, fields, error).

Four physical paths give the same rows where each is legal:

exact       files through the Python tokenizer piece by piece, in Arrow batches; any
            dialect; larger files split where nothing but delimiters is to be found
expression  one line per record, tokenized by Column expressions; splittable
split       quoted fields may hold terminators; files are split by the parity of quotes
native      Spark's own CSV source (see `api.read_delimited`); splittable
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldstone.operators import tokenizer as tk
from fieldstone.operators.expression import FIELDS, tokenize
from fieldstone.plans.spec import Dialect, ReadSpec, SpecError
from fieldstone.sources.resource import DECOMPRESSORS, detect, pieces_of
from fieldstone.sources.storage import read_head, workers_import

RECORDS = f"file string, record_no long, raw string, fields {FIELDS}, error string"
_FIELD = pa.list_(pa.struct([("value", pa.string()), ("quoted", pa.bool_()), ("escaped", pa.bool_()), ("children", pa.list_(pa.string()))]))
_RECORDS = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("raw", pa.string()), ("fields", _FIELD), ("error", pa.string())])
_BATCH = 4_096
#: Charsets that Spark's text and CSV sources read by themselves.
_SPARK_CHARSETS = {"utf-8": "UTF-8", "iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}


def _charset(spec: ReadSpec) -> str | None:
    import codecs

    return _SPARK_CHARSETS.get(codecs.lookup(spec.resource.encoding or "utf-8").name)


def files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files of the paths: paths in their order, a folder's files by name."""
    found = []
    for p in paths:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path").orderBy("path").collect()
        found += [r["path"] for r in rows]
    return found


def from_files(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, detector: Callable, make: Callable[[str, Iterator[str]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`make` over each file's path and its text in pieces, decompressed and decoded where it lies."""
    workers_import(spark)
    decompress = DECOMPRESSORS.get(spec.resource.compression) if spec.resource.compression else None
    encoding = spec.resource.encoding

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                yield from make(path.as_py(), pieces_of(content.as_buffer(), encoding, decompress, detector))

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, schema)


def from_head(spark: SparkSession, path: str, spec: ReadSpec, detector: Callable, find: Callable[[Iterable[str]], Any], pack: Callable[[Any], pa.RecordBatch], schema: str) -> Any:
    """What `find` makes of a file's text in pieces, from no more of its first bytes than it asks for.

    The driver reads the head; a compressed file, or one of which `find` wants
    more than the driver is to hold, is read where it lies, and `pack` makes a
    row of what is found. None for an empty folder.
    """

    def pieces(data: bytes, whole: bool) -> Iterator[str]:
        yield from pieces_of(data, spec.resource.encoding, None, detector, whole)
        if not whole:
            raise _MoreNeeded

    size = _HEAD_BYTES
    while not spec.resource.compression and size <= _MOST_HEAD_BYTES:
        data = read_head(spark, path, size)
        try:
            return find(pieces(data, len(data) < size))
        except _MoreNeeded:
            size *= 16
        except (tk.MalformedError, UnicodeDecodeError):  # an error of the job that meets it
            break

    def make(_: str, text: Iterator[str]) -> Iterator[pa.RecordBatch]:
        yield pack(find(text))

    return from_files(spark, [path], spec, detector, make, schema).first()


class _MoreNeeded(Exception):
    """A file's head does not hold what is looked for."""


#: Bytes of a file that the driver looks at first, and at most.
_HEAD_BYTES, _MOST_HEAD_BYTES = 1 << 16, 1 << 24


class _Batch:
    """Records as the columns of an Arrow batch."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.numbers, self.raws, self.errors, self.ends = [], [], [], [0]
        self.values, self.quoted, self.escaped, self.children = [], [], [], []

    def add(self, r: tk.Record) -> None:
        self.numbers.append(r.number)
        self.raws.append(r.raw)
        self.errors.append(r.error)
        for t in r.tokens:
            self.values.append(t.value)
            self.quoted.append(t.quoted)
            self.escaped.append(t.escaped)
            self.children.append(None if t.children is None else [c.value for c in t.children])
        self.ends.append(len(self.values))

    def add_plain(self, number: int, raw: str, cells: list[str]) -> None:
        self.numbers.append(number)
        self.raws.append(raw)
        self.errors.append(None)
        self.values += cells
        self.ends.append(len(self.values))

    def arrow(self) -> pa.RecordBatch:
        n = len(self.values)
        flags = [pa.array(x if x else [False] * n, pa.bool_()) for x in (self.quoted, self.escaped)]
        children = pa.array(self.children, pa.list_(pa.string())) if any(c is not None for c in self.children) else pa.nulls(n, pa.list_(pa.string()))
        tokens = pa.StructArray.from_arrays([pa.array(self.values, pa.string()), *flags, children], fields=list(_FIELD.value_type))
        fields = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), tokens, type=_FIELD)
        rows = len(self.numbers)
        out = pa.RecordBatch.from_arrays([pa.array([self.path] * rows, pa.string()), pa.array(self.numbers, pa.int64()), pa.array(self.raws, pa.string()), fields, pa.array(self.errors, pa.string())], schema=_RECORDS)
        self.clear()
        return out


def _rows(path: str, found: Iterator[tk.Record], skip: frozenset[int]) -> Iterator[pa.RecordBatch]:
    batch = _Batch(path)
    for r in found:
        if r.comment or r.number in skip:
            continue
        batch.add(r)
        if len(batch.numbers) == _BATCH:
            yield batch.arrow()
    yield batch.arrow()


def _plain_rows(path: str, pieces: Iterable[str], d: Dialect, skip: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """The same for dialects of delimiters and terminators alone: nothing to match."""
    batch = _Batch(path)
    for number, line in enumerate(islice(_lines_of(pieces, d.line_terminator), max(d.header_rows, default=0), None), 1):
        if number in skip:
            continue
        batch.add_plain(number, line, line.split(d.delimiter))
        if len(batch.numbers) == _BATCH:
            yield batch.arrow()
    yield batch.arrow()


def _lines_of(pieces: Iterable[str], end: str) -> Iterator[str]:
    rest = ""
    for p in pieces:
        *lines, rest = (rest + p).split(end)
        yield from lines
    if rest:
        yield rest


def _headed(pieces: Iterable[str], d: Dialect, mode: str) -> Iterator[tk.Record]:
    """Numbered records after the header; blank trailing text gives none."""
    found = tk.records_of(pieces, d, mode)
    return tk.split_header(found, d)[1] if d.header else found


def _plain(d: Dialect) -> bool:
    return not d.quote and not d.escape and not d.comment and not d.array and not d.skip_initial_space


def exact_records(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, headerless: frozenset[str] = frozenset(), detector: Callable = detect) -> DataFrame:
    """Records by the exact tokenizer, any grammar, any encoding; one task per file.

    Larger files of a dialect without anything but delimiters are split: their
    lines are records, whatever lies before them.
    `headerless`: files without the header that the dialect names.
    """
    d, mode, skip = spec.dialect, spec.options.mode, frozenset(spec.dialect.comment_rows)
    if _plain(d) and detector is detect and expression_legal(spec) and worth_splitting(spark, paths, spec, _LARGE):
        return _plain_lines(spark, paths, spec, headerless)

    def make(path: str, pieces: Iterator[str]) -> Iterator[pa.RecordBatch]:
        own = d.without_header() if path in headerless else d
        yield from _plain_rows(path, pieces, own, skip) if _plain(d) else _rows(path, _headed(pieces, own, mode), skip)

    return from_files(spark, paths, spec, detector, make, RECORDS)


#: Bytes from which a file of a plain dialect is split.
_LARGE = 16 << 20


def _plain_lines(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, headerless: frozenset[str]) -> DataFrame:
    """`_plain_rows` of files that Spark splits."""
    workers_import(spark)
    delimiter = spec.dialect.delimiter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                b = whole.slice(at, _BATCH)
                raw = pc.cast(b.column("raw"), pa.string())
                cells = pc.split_pattern(raw, delimiter)
                n = len(cells.flatten())
                no = pa.repeat(pa.scalar(False), n)
                tokens = pa.StructArray.from_arrays([cells.flatten(), no, no, pa.nulls(n, pa.list_(pa.string()))], fields=list(_FIELD.value_type))
                ends = pc.subtract(cells.offsets, cells.offsets[0])
                fields = pa.ListArray.from_arrays(ends, tokens, type=_FIELD)
                yield pa.RecordBatch.from_arrays([pc.cast(b.column("file"), pa.string()), b.column("record_no"), raw, fields, pa.nulls(b.num_rows, pa.string())], schema=_RECORDS)

    return _lines(spark, paths, spec, headerless, True).mapInArrow(run, RECORDS)


def exact_counts(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, headerless: frozenset[str] = frozenset(), detector: Callable = detect) -> DataFrame:
    """n: each file's records after the header, comments and skipped rows left out."""
    d, mode, skip = spec.dialect, spec.options.mode, frozenset(spec.dialect.comment_rows)

    def make(path: str, pieces: Iterator[str]) -> Iterator[pa.RecordBatch]:
        own = d.without_header() if path in headerless else d
        n = sum(not r.comment and r.number not in skip for r in _headed(pieces, own, mode))
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return from_files(spark, paths, spec, detector, make, "n long")


def first_raw(spark: SparkSession, path: str, spec: ReadSpec, detector: Callable = detect) -> str | None:
    """The text of a file's first record that is no comment; None without one."""
    d, mode = spec.dialect, spec.options.mode

    def find(pieces: Iterable[str]) -> tuple[str | None]:
        return (next((r.raw for r in tk.records_of(pieces, d, mode) if not r.comment and r.number not in d.comment_rows), None),)

    found = from_head(spark, path, spec, detector, find, lambda x: pa.record_batch([pa.array(x, pa.string())], names=["raw"]), "raw string")
    return found[0] if found else None


def expression_legal(spec: ReadSpec) -> bool:
    """Whether lines are records: no terminators in quotes, no arrays, a charset of Spark's, nothing declared compressed."""
    d = spec.dialect
    lines = not (spec.multiline and d.quote) and not (d.array and d.array.prefix)
    return lines and not spec.resource.compression and _charset(spec) == "UTF-8"


def expression_records(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, headerless: frozenset[str] = frozenset(), numbered: bool = True) -> DataFrame:
    """Records by Column expressions.

    The scan splits files; record_no is null without a header, numbers or comment rows.
    """
    if not expression_legal(spec):
        raise SpecError("the expression path needs records that are lines: see expression_legal")
    return _tokenized(_lines(spark, paths, spec, headerless, numbered), spec)


def _split_lines(spark: SparkSession, paths: Sequence[str], d: Dialect) -> DataFrame:
    """(file, block, value): lines of files that Spark splits, and where their splits begin."""
    return spark.read.option("lineSep", d.line_terminator).text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _splits(sums: DataFrame) -> list:
    """A row for each split, in their order."""
    found = sums.orderBy("file", "block").limit(MAX_SPLITS + 1).collect()
    if len(found) > MAX_SPLITS:
        raise SpecError(f"more than {MAX_SPLITS} splits: read the files in parts")
    return found


def _lines(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, headerless: frozenset[str], numbered: bool) -> DataFrame:
    """(file, record_no, raw): lines without the header and comments, from files that Spark splits.

    With a header, numbers or comment rows a first pass counts each split's
    lines; the sums before a split and a line's place in it give its number,
    without a shuffle. Else record_no is null.
    """
    d = spec.dialect
    lines = _split_lines(spark, paths, d)
    comment = F.startswith(F.col("raw"), F.lit(d.comment)) if d.comment else F.lit(False)
    if not (d.header or d.comment_rows or numbered):
        lines = lines.select("file", F.lit(None).cast("long").alias("record_no"), F.col("value").alias("raw"))
        return lines.where(~comment) if d.comment else lines
    placed = lines.withColumn("at", F.monotonically_increasing_id())  # in the order of lines within a split
    starts, now, name = [], 0, None
    for r in _splits(placed.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))):
        if r["file"] != name:
            now, name = 1 - (0 if r["file"] in headerless else max(d.header_rows, default=0)), r["file"]
        starts.append((name, r["block"], now - r["first"], r["first"], r["first"] + r["n"]))
        now += r["n"]
    known = F.broadcast(spark.createDataFrame(starts, "file string, block long, shift long, low long, high long"))
    unknown = F.raise_error(F.lit("The files' splits changed between two passes.")).cast("long")
    number = F.when((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")), F.col("at") + F.col("shift")).otherwise(unknown)
    lines = placed.join(known, ["file", "block"], "left").select("file", number.alias("record_no"), F.col("value").alias("raw")).where("record_no > 0")
    if d.comment:
        lines = lines.where(~comment)
    if d.comment_rows:
        lines = lines.where(~F.col("record_no").isin(*d.comment_rows))
    return lines


def _tokenized(lines: DataFrame, spec: ReadSpec, joined: bool = False) -> DataFrame:
    """(file, record_no, raw) with the fields of each record and, by the mode, an error.

    `joined`: records of several lines, whose terminators have to be in quotes.
    """
    fields, end = tokenize(F.col("raw"), spec.dialect), F.lit(spec.dialect.line_terminator)
    if joined:
        torn = F.contains("raw", end) & F.exists(fields, lambda f: ~f["quoted"] & F.contains(_bare(f["value"], spec.dialect), end))
        fields = F.when(~F.coalesce(torn, F.lit(False)), fields)
    bad = F.concat(F.lit("Malformed record: "), F.col("raw"))
    if spec.options.mode == "failfast":
        fields = F.coalesce(fields, F.raise_error(bad).cast(FIELDS))
        return lines.select("file", "record_no", "raw", fields.alias("fields"), F.lit(None).cast("string").alias("error"))
    out = lines.select("file", "record_no", "raw", fields.alias("fields"))
    if spec.options.mode == "drop":
        return out.where("fields is not null").withColumn("error", F.lit(None).cast("string"))
    return out.withColumn("error", F.when(F.col("fields").isNull(), bad)).withColumn("fields", F.coalesce("fields", F.array().cast(FIELDS)))


def _bare(text: Column, d: Dialect) -> Column:
    """A text without its escapes and what they escape; one at the end is left."""
    return F.when(F.contains(text, F.lit(d.escape)), F.regexp_replace(text, f"\\x{{{ord(d.escape):x}}}[\\s\\S]", "")).otherwise(text) if d.escape else text


def split_legal(spec: ReadSpec) -> bool:
    """Whether the quotes before a place tell if it lies inside a quoted field.

    So it is where quotes only enclose fields, or are doubled or escaped in them;
    comments and arrays rule it out. Other quotes in the text are found out: a
    record then ends inside quotes, or one has a terminator outside of them.
    """
    d = spec.dialect
    if d.escape and (d.escape == d.quote or d.escape in d.line_terminator):
        return False
    return bool(d.quote) and not d.comment and not d.comment_rows and not d.array and not spec.resource.compression and _charset(spec) == "UTF-8"


def split_records(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, headerless: frozenset[str] = frozenset()) -> DataFrame:
    """Records whose quoted fields hold terminators, from files that Spark splits.

    A first pass sums the quotes of each split, escaped ones left out; the sums'
    parities say which splits begin inside a quoted field, and an escape at the
    end of a split's last line that its record goes on. A second pass joins lines to records
    within each split, without a shuffle. What crosses a split's border, two
    pieces a split at most, is put together by file. record_no is null.
    """
    if not split_legal(spec):
        raise SpecError("the split path needs quotes that only enclose or double: see split_legal")
    workers_import(spark)
    d = spec.dialect
    quote, end, last = d.quote, d.line_terminator, max(d.header_rows, default=0)
    lines = _split_lines(spark, paths, d)
    escape, pairs = d.escape, re.compile(f"{re.escape(d.escape)}[\\s\\S]") if d.escape else None
    bare = _bare(F.col("value"), d)
    odd = (F.sum(F.length(bare) - F.length(F.replace(bare, F.lit(quote), F.lit("")))) % 2).cast("int")
    held = F.max_by(F.contains(bare, F.lit(escape)), "at") if escape else F.lit(False)  # the last line's terminator is escaped
    inside: dict[tuple[str, int], tuple[bool, bool]] = {}
    now, goes_on, name = 0, False, None
    for r in _splits(lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file", "block").agg(odd.alias("odd"), held.alias("held"))):
        now, goes_on, name = (now, goes_on, name) if r["file"] == name else (0, False, r["file"])
        inside[name, r["block"]] = bool(now), goes_on
        now, goes_on = now ^ r["odd"], r["held"]
    begins = spark.sparkContext.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece, started, is_open, skip = None, [], True, False, 0
        out: list[tuple[str, int, int, str]] = []

        def close(kind: int) -> None:
            nonlocal piece, started, skip
            text, piece, started = end.join(piece), [], True
            if kind == WHOLE and skip:
                skip -= 1
            else:
                out.append((*at, kind, text))

        for b in batches:
            for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != at:
                    if piece:
                        close(BEGUN if started else INNER)
                    at = (file, block)
                    is_open, goes_on = begins.value[at]  # a split that the first pass did not see is an error
                    started, skip = not (is_open or goes_on), 0 if block or file in headerless else last
                    value = value if block else value.removeprefix("\ufeff")
                piece.append(value)
                if pairs and escape in value:
                    value = pairs.sub("", value)
                is_open ^= value.count(quote) % 2 == 1
                if not is_open and not (escape and escape in value):
                    close(WHOLE if started else ENDED)
            yield _pieces(out)
            out = []
        if piece:
            close(BEGUN if started else INNER)
        yield _pieces(out)

    pieces = lines.mapInArrow(run, "file string, block long, kind int, raw string")
    broken = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind")
    groups = broken.withColumn("nth", F.sum((F.col("kind") == BEGUN).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "kind", "raw")))
    mended = groups.groupBy("file", "nth").agg(F.array_join(F.transform(parts, lambda x: x["raw"]), end).alias("raw"))
    every = pieces.where(F.col("kind") == WHOLE).select("file", "raw").unionByName(mended.select("file", "raw"))
    return _tokenized(every.select("file", F.lit(None).cast("long").alias("record_no"), "raw"), spec, joined=True)


def worth_splitting(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, most: int | None = None) -> bool:
    """Whether Spark would split one of the files, or one has more than `most` bytes, and no mark says that they are in another charset.

    Sizes are those of the listing; a charset mark is looked for in the first file alone, the
    split path fails on other charsets' bytes.
    """
    largest = spark.read.format("binaryFile").load(list(paths)).agg(F.max("length")).first()[0] or 0
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    limit = int(number) << 10 * " kmgt".index(unit or " ")
    if largest <= (limit if most is None else min(limit, most)):
        return False
    if spec.resource.encoding:
        return True
    head = spark.read.option("lineSep", spec.dialect.line_terminator).text(files(spark, paths[:1])[:1]).select(F.expr("substr(value, 1, 4)").cast("binary")).first()
    return not head or detect(bytes(head[0]))[0] == "utf-8"


#: Kinds of a split's pieces, in their order within a split.
WHOLE, ENDED, INNER, BEGUN = range(4)
#: Splits whose parities the driver holds, some tens of bytes each.
MAX_SPLITS = 2_000_000


def _pieces(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = (("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("raw", pa.string()))
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def native_legal(spec: ReadSpec) -> bool:
    """Whether Spark's CSV source reads the same values.

    It drops blank lines, takes text after a closing quote, and does not say
    whether a value was quoted; so the caller has to ask for it unless quoting is
    off, and sequences, arrays, comments and escapes are left to the other paths.
    """
    d = spec.dialect
    return (
        len(d.line_terminator) <= 2
        and not d.array
        and not d.escape
        and not d.comment
        and not d.comment_rows
        and not d.skip_initial_space
        and not spec.sequences()
        and not any(f.sequences for f in (spec.schema.fields if spec.schema else ()))
        and not spec.resource.compression
        and _charset(spec) is not None
        and len(d.header_rows) <= 1
        and (not d.header or d.header_rows == (1,))
        and (d.double_quote or not d.quote)
        and not (spec.schema and any(f.array for f in spec.schema.fields))
    )


def native_rows(spark: SparkSession, paths: Sequence[str], spec: ReadSpec, width: int) -> DataFrame:
    """Text columns _0.._n of Spark's CSV source; short rows have nulls, long ones are errors."""
    d = spec.dialect
    names = [f"_{i}" for i in range(width)]
    schema = ", ".join(f"`{n}` string" for n in [*names, "_more"])
    reader = spark.read.schema(schema).option("sep", d.delimiter).option("lineSep", d.line_terminator).option("header", d.header).option("enforceSchema", "true").option("mode", "PERMISSIVE").option("emptyValue", "").option("nullValue", "\u0000\u0000").option("maxCharsPerColumn", -1).option("encoding", _charset(spec))
    reader = reader.option("quote", d.quote or "").option("escape", d.quote or "\u0000")
    if spec.multiline and d.quote:
        reader = reader.option("multiLine", "true")
    return reader.csv(list(paths))


#: Names of files that Spark decompresses by itself, and lines of their head that are looked at.
_CODECS, _HEAD_LINES = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst"), 200


def header_rows(spark: SparkSession, path: str, spec: ReadSpec, detector: Callable = detect) -> tuple[list[list[str]], int]:
    """A file's header rows and the number of fields of its first record."""
    d = spec.dialect
    if not spec.resource.compression and detector is detect and spec.scan in ("native", "expression", "split") and path.endswith(_CODECS):
        head = [r[0] for r in spark.read.option("lineSep", d.line_terminator).text(path).limit(_HEAD_LINES).collect()]
        return _first([d.line_terminator.join(head)], d)

    def pack(found: tuple[list[list[str]], int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([found[0]], pa.list_(pa.list_(pa.string()))), pa.array([found[1]], pa.int64())], names=["rows", "width"])

    found = from_head(spark, path, spec, detector, lambda pieces: _first(pieces, d), pack, "rows array<array<string>>, width long")
    return (found[0], found[1]) if found else ([], 0)


def _first(pieces: Iterable[str], d: Dialect) -> tuple[list[list[str]], int]:
    rows, rest = tk.split_header(tk.records_of(pieces, d, "permissive"), d)
    first = next((r for r in rest if not r.comment and r.number not in d.comment_rows), None)
    return rows, len(first.tokens) if first else 0
