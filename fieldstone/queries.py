"""One query for each operator group, with the SQL that gives the same rows.

Each query encodes a table as text, reads it back through the engine, and returns
what it reads.
"""

from __future__ import annotations

import bz2
import dataclasses
import gzip
import io
import zipfile
import zlib
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone import api
from fieldstone.functions.parse import array_item, parse, parse_culture
from fieldstone.operators.sanitize import sanitize
from fieldstone.plans import spec as S
from fieldstone.plans.spec import ArrayDialect, Dialect, FieldSpec, Options, ReadSpec, Resource
from fieldstone.sources import encode
from fieldstone.sources.ndjson import NdjsonSpec, ordinal_of, read_lines, read_ndjson
from fieldstone.sources.resource import DECOMPRESSORS
from fieldstone.sources.storage import new_path, write_bytes
from fieldstone.streaming.source import stream_delimited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

STAMP = "yyyy-MM-dd HH:mm:ss.ffffff"
SEMI = Dialect(";")
BARE = SEMI.without_header()


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fields_of(df: DataFrame) -> tuple[FieldSpec, ...]:
    """Field specs that read a table's own text back."""
    kinds = {"bigint": "long", "int": "int", "double": "double", "float": "float", "string": "string"}
    return tuple(S.temporal("datetime", n, STAMP) if t.startswith("timestamp") else FieldSpec(kinds[t], n) for n, t in df.dtypes)


_LINEITEM = "SELECT * FROM lineitem"
#: Path for path the same read: headerless lines, text that needs no quotes.
PLAIN = Dialect("|", "\n", quote=None, header_rows=())


def scan_lineitem(spark: SparkSession, sf_dir: str, scan: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    read = ReadSpec(PLAIN, S.indexed(*fields_of(df)), scan=scan)
    return api.read_delimited(spark, encode.write_table(df, PLAIN), read).toDF(*df.columns)


QUERIES["scan_typed_native"] = partial(scan_lineitem, scan="native")
QUERIES["scan_typed_expression"] = partial(scan_lineitem, scan="expression")
QUERIES["scan_typed_exact"] = partial(scan_lineitem, scan="exact")
for _n in ("native", "expression", "exact"):
    ORACLE_SQL[f"scan_typed_{_n}"] = _LINEITEM


@query(_LINEITEM)
def scan_typed_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return api.read_delimited(spark, encode.write_table(df, SEMI), ReadSpec(SEMI, S.indexed(*fields_of(df)), multiline=False))


FLAGSHIP_SQL = "SELECT o_orderpriority, count(*) AS n, sum(o_custkey)::BIGINT AS sum_cust, max(o_totalprice) AS max_price, min(o_orderdate) AS first_date FROM orders GROUP BY o_orderpriority"


@query(FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quoted text, scanned exactly, typed, and aggregated."""
    df = table(spark, sf_dir, "orders")
    rows = api.read_delimited(spark, encode.write_table(df, SEMI, quote_all=True), ReadSpec(SEMI, S.indexed(*fields_of(df))))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("sum_cust"), F.max("o_totalprice").alias("max_price"), F.min("o_orderdate").alias("first_date"))


@query("SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def scan_then_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = {}
    for name in ("lineitem", "orders"):
        df = table(spark, sf_dir, name)
        read[name] = api.read_delimited(spark, encode.write_table(df, PLAIN), ReadSpec(PLAIN, S.indexed(*fields_of(df)))).toDF(*df.columns)
    joined = read["lineitem"].where("l_returnflag = 'R'").join(read["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT c_name, c_acctbal, c_custkey FROM customer")
def scan_named_schema_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named schema binds by header, whatever the order; unread columns need no field."""
    df = table(spark, sf_dir, "customer")
    schema = S.named(FieldSpec("double", "c_acctbal"), FieldSpec("long", "c_custkey"), FieldSpec("string", "c_name"))
    return api.read_delimited(spark, encode.write_table(df, SEMI), ReadSpec(SEMI, schema), ["c_name", "c_acctbal", "c_custkey"])


@query("SELECT n_nationkey::VARCHAR AS field_0, n_name AS field_1, n_regionkey::VARCHAR AS field_2 FROM nation")
def scan_no_header_generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.read_delimited(spark, encode.write_table(table(spark, sf_dir, "nation"), BARE), ReadSpec(BARE))


def _headed(spark: SparkSession, sf_dir: str, name: str, header: list[str], d: Dialect) -> DataFrame:
    return api.read_delimited(spark, encode.write_lines(encode.lines(table(spark, sf_dir, name), d), d, header), ReadSpec(d))


@query('SELECT r_regionkey::VARCHAR AS "region.key", r_name AS "region.name" FROM region')
def header_multirow_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headed(spark, sf_dir, "region", ["region;region", "key;name"], Dialect(";", header_rows=(1, 2), header_join="."))


@query("SELECT r_regionkey::VARCHAR AS key, r_name AS name FROM region")
def header_skip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headed(spark, sf_dir, "region", ["a title", "key;name"], Dialect(";", header_rows=(2,)))


@query("SELECT s_suppkey::VARCHAR AS \"supplier key\", s_name AS \"supplier name\", s_nationkey::VARCHAR AS \"nation key\", s_acctbal::VARCHAR AS \"nation balance\" FROM (SELECT s_suppkey, s_name, s_nationkey, s_nationkey AS s_acctbal FROM supplier)")
def header_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank cell of a header row repeats the cell before it."""
    df = table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.col("s_nationkey"))
    d = Dialect(";", header_rows=(1, 2))
    return api.read_delimited(spark, encode.write_lines(encode.lines(df, d), d, ["supplier;;nation;", "key;name;key;balance"]), ReadSpec(d))


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _batch(spark: SparkSession, sf_dir: str, repeat: bool) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    d = dataclasses.replace(SEMI, header_repeat=repeat)
    paths = [encode.write_table(df.where(F.col("o_orderkey") % 3 == k), d if repeat or not k else BARE) for k in range(3)]  # only the first has the header, or each file
    return api.read_delimited(spark, paths, ReadSpec(d, S.indexed(*fields_of(df)), multiline=False))


QUERIES["batch_header_repeat"] = partial(_batch, repeat=True)
QUERIES["batch_header_once"] = partial(_batch, repeat=False)
ORACLE_SQL["batch_header_repeat"] = ORACLE_SQL["batch_header_once"] = _ORDERS


@query("SELECT n_nationkey::VARCHAR AS a, n_name AS b, NULL::VARCHAR AS c FROM nation WHERE n_nationkey < 10 UNION ALL SELECT NULL, n_name, n_regionkey::VARCHAR FROM nation WHERE n_nationkey >= 10")
def batch_differing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    one = df.where("n_nationkey < 10").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"))
    two = df.where("n_nationkey >= 10").select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("c"))
    return api.read_union(spark, [encode.write_table(one, SEMI), encode.write_table(two, SEMI)], ReadSpec(SEMI))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def quoted_multiline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiters, quotes and terminators inside quotes."""
    d = Dialect(",", "\n")
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return api.read_delimited(spark, encode.write_table(df, d), ReadSpec(d, S.indexed(*fields_of(df))))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def quoted_multiline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text by the path that splits files."""
    d = Dialect(",", "\n")
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return api.read_delimited(spark, encode.write_table(df, d), ReadSpec(d, S.indexed(*fields_of(df)), scan="split"))


@query("SELECT page_id, url, html FROM pages")
def doubled_quotes_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dialect(",", "\r\n")
    df = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return api.read_delimited(spark, encode.write_table(df, d, quote_all=True), ReadSpec(d, S.indexed(*fields_of(df))))


@query("SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def escape_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped delimiters and escapes in unquoted fields."""
    d = Dialect(",", "\n", quote=None, escape="\\", header_rows=())
    df = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    text = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,"))
    path = encode.write_lines(df.select(F.concat_ws(",", F.col("doc_id").cast("string"), text).alias("value")), d)
    return api.read_delimited(spark, path, ReadSpec(d, S.indexed(*fields_of(df)))).toDF("doc_id", "text")


@query("SELECT page_id, html FROM pages")
def escape_char_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dialect(";", "\n", escape="\\", double_quote=False)
    df = table(spark, sf_dir, "pages").select("page_id", "html")
    return api.read_delimited(spark, encode.write_table(df, d, quote_all=True), ReadSpec(d, S.indexed(*fields_of(df))))


_PART = "SELECT p_partkey, p_name, p_size FROM part"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")


def _terminated(spark: SparkSession, sf_dir: str, terminator: str, scan: str) -> DataFrame:
    df, d = _part(spark, sf_dir), Dialect(";", terminator)
    return api.read_delimited(spark, encode.write_table(df, d), ReadSpec(d, S.indexed(*fields_of(df)), multiline=False, scan=scan))


for _n, _t, _s in (("custom_terminator", "|@#", "exact"), ("custom_terminator_lines", "|@#", "expression"), ("terminator_cr", "\r", "exact"), ("terminator_tab_crlf", "\t\r\n", "expression")):
    QUERIES[_n] = partial(_terminated, terminator=_t, scan=_s)
    ORACLE_SQL[_n] = _PART


@query(_PART)
def skip_initial_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, d = _part(spark, sf_dir), Dialect(";", "\n", skip_initial_space=True, header_rows=())
    spaced = encode.lines(df, d).select(F.replace("value", F.lit(";"), F.lit(";   ")).alias("value"))
    return api.read_delimited(spark, encode.write_lines(spaced, d), ReadSpec(d, S.indexed(*fields_of(df)), multiline=False)).toDF(*df.columns)


def _commented(spark: SparkSession, sf_dir: str, scan: str) -> DataFrame:
    df, d = _part(spark, sf_dir), Dialect(";", "\n", comment="#")
    noted = encode.lines(df, d).select(F.explode(F.array(F.concat(F.lit("# note; "), F.col("value")), F.col("value"))).alias("value"))
    return api.read_delimited(spark, encode.write_lines(noted, d, ["# about parts", "p_partkey;p_name;p_size"]), ReadSpec(d, S.indexed(*fields_of(df)), multiline=False, scan=scan))


QUERIES["comment_char"] = partial(_commented, scan="exact")
ORACLE_SQL["comment_char"] = _PART


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 1 and 3 after the header are comments by their number."""
    d = Dialect(";", "\n", comment_rows=(1, 3))
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1)
    first = encode.lines(df.where("n_nationkey = 0"), d).first()["value"]
    return api.read_delimited(spark, encode.write_lines(encode.lines(df.where("n_nationkey <> 0"), d), d, ["k;v", "units", first, "more; notes"]), ReadSpec(d))


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN '?' ELSE p_type END AS p_type FROM part")
def short_rows_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, d = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), Dialect(";", "\n", missing_cell="?")
    full, short = encode.lines(df.where("p_partkey % 2 <> 0"), d), encode.lines(df.where("p_partkey % 2 = 0"), d, ["p_partkey", "p_name"])
    return api.read_delimited(spark, encode.write_lines(full.unionByName(short), d, [";".join(df.columns)]), ReadSpec(d, S.indexed(*fields_of(df))))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def null_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    d = Dialect(";", "\n", null_sequence="(null)")
    return api.read_delimited(spark, encode.write_table(df, d, null="(null)"), ReadSpec(d, S.indexed(*fields_of(df))))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def field_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource sequence to null, a field sequence to another text."""
    df = table(spark, sf_dir, "customer")
    rows = df.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "NaN").when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"))
    schema = S.indexed(FieldSpec("long", "c_custkey"), FieldSpec("int", "c_nationkey", sequences={"NaN": "-1"}))
    return api.read_delimited(spark, encode.write_table(rows, SEMI), ReadSpec(SEMI, schema, Resource(sequences={"": None})))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '(null)' END AS n_name FROM nation")
def quoted_null_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quoted sequence is text."""
    df, d = table(spark, sf_dir, "nation"), Dialect(";", "\n", null_sequence="(null)", header_rows=())
    lines = df.select(F.concat(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ';"(null)"').otherwise(";(null)")).alias("value"))
    return api.read_delimited(spark, encode.write_lines(lines, d), ReadSpec(d, S.indexed(FieldSpec("int"), FieldSpec("string")))).toDF("n_nationkey", "n_name")


@query("SELECT p_partkey::VARCHAR AS k, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE p_brand END AS b FROM part")
def empty_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 != 0, F.col("p_brand")).alias("b"))
    read = S.legacy(";", line_terminator="\n", header=True, empty_cell="none")
    return api.read_delimited(spark, encode.write_table(df, read.dialect), read)


def _grouped(c: Column, group: str, point: str) -> Column:
    """12345.6 as 12,345.60 with other marks."""
    return F.translate(F.format_number(c, 2), ",.", group + point)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2)::DECIMAL(18,2)::DOUBLE AS price FROM lineitem")
def numbers_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir, ",", ".")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2)::DECIMAL(18,2)::DOUBLE AS price FROM lineitem")
def numbers_decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir, ".", ",")


def _prices(spark: SparkSession, sf_dir: str, group: str, point: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _grouped(F.round("l_extendedprice", 2), group, point).alias("price"))
    schema = S.indexed(FieldSpec("long"), FieldSpec("int"), S.number("decimal", "price", S.NumberFormat(group, point), precision=(18, 2)))
    return api.read_delimited(spark, encode.write_table(df, BARE), ReadSpec(BARE, schema, multiline=False)).toDF(*df.columns).withColumn("price", F.col("price").cast("double"))


@query("SELECT o_orderkey, (o_orderkey % 1000 * 100)::INTEGER AS a, (o_orderkey % 30000)::SMALLINT AS b FROM orders")
def ints_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit("e2")).alias("a"), F.translate(F.format_number(F.col("o_orderkey") % 30000, 0), ",", " ").alias("b"))
    schema = S.indexed(FieldSpec("long"), S.integer("int"), S.integer("short", group=" "))
    return api.read_delimited(spark, encode.write_table(df, BARE), ReadSpec(BARE, schema, multiline=False)).toDF(*df.columns)


@query("SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE AS b, o_orderdate::DATE AS c FROM orders")
def dates_custom_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("a"), F.date_format("o_orderdate", "dd-MM-yy").alias("b"), F.date_format("o_orderdate", "d.M.yyyy").alias("c"))
    schema = S.indexed(FieldSpec("long"), S.temporal("date", pattern="yyyy/MM/dd"), FieldSpec("date", format=S.TemporalFormat("dd/MM/yy", date_separator="-", pivot=70)), S.temporal("date", pattern="d.M.yyyy"))
    return api.read_delimited(spark, encode.write_table(df, BARE), ReadSpec(BARE, schema, multiline=False)).toDF(*df.columns)


@query("SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) AS b, strftime(ts, '%H:%M:%S') || '.000000' AS c FROM events")
def timestamps_ampm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "MM/dd/yyyy hh:mm:ss a").alias("a"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("b"), F.date_format("ts", "hh:mm:ss a").alias("c"))
    schema = S.indexed(FieldSpec("long"), S.temporal("datetime", pattern="MM/dd/yyyy hh:mm:ss tt"), S.temporal("datetime"), S.temporal("time", pattern="hh:mm:ss tt"))
    return api.read_delimited(spark, encode.write_table(df, BARE), ReadSpec(BARE, schema, multiline=False)).toDF(*df.columns)


@query("SELECT event_id, date_trunc('second', ts) - INTERVAL 90 MINUTE AS utc FROM events")
def timestamps_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")).alias("utc"))
    rows = api.read_delimited(spark, encode.write_table(df, BARE), ReadSpec(BARE, S.indexed(FieldSpec("long"), S.temporal("datetimeoffset", pattern="yyyy-MM-ddTHH:mm:sszzz")), multiline=False)).toDF(*df.columns)
    return rows.select("event_id", F.to_timestamp_ntz(F.date_format("utc", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("utc"))


@query("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
def dates_by_culture(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    schema = S.indexed(FieldSpec("long"), FieldSpec("date", parser=lambda c: parse_culture(c, "date", "fr-fr")))
    return api.read_delimited(spark, encode.write_table(df, BARE), ReadSpec(BARE, schema, multiline=False)).toDF(*df.columns)


def _typed(spark: SparkSession, df: DataFrame, *types: FieldSpec) -> DataFrame:
    return api.read_delimited(spark, encode.write_table(df, BARE), ReadSpec(BARE, S.indexed(*types), multiline=False)).toDF(*df.columns)


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS b FROM lineitem")
def bool_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", " TRUE").otherwise("False").alias("b"))
    return _typed(spark, df, FieldSpec("long"), FieldSpec("int"), FieldSpec("bool"))


@query()
def guid_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("{00000000-0000-4000-8000-"), F.lpad(F.hex("n_nationkey"), 12, "0"), F.lit("}")).alias("g"))
    return _typed(spark, df, FieldSpec("int"), FieldSpec("guid"))


ORACLE_SQL["guid_normalise"] = "SELECT n_nationkey, '00000000-0000-4000-8000-' || lpad(lower(to_hex(n_nationkey)), 12, '0') AS g FROM nation"


@query("SELECT c_custkey, round(c_acctbal, 2)::DECIMAL(18,2)::VARCHAR AS d FROM customer")
def decimal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.format_number("c_acctbal", 2).alias("d"))
    return _typed(spark, df, FieldSpec("long"), FieldSpec("decimal", precision=(18, 2))).withColumn("d", F.col("d").cast("string"))


@query("SELECT p_partkey, left(p_name, 1) AS c, (p_size % 256)::SMALLINT AS b FROM part")
def char_and_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("c"), (F.col("p_size") % 256).alias("b"))
    return _typed(spark, df, FieldSpec("long"), FieldSpec("char"), FieldSpec("byte"))


VECTORS = Dialect(";", "\n", header_rows=(), array=ArrayDialect("|", "[", "]"))


def _vectors(spark: SparkSession, sf_dir: str, type_: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), "|"), F.lit("]")).alias("embedding"))
    lines = df.select(F.concat_ws(";", F.col("vec_id").cast("string"), "embedding").alias("value"))
    return api.read_delimited(spark, encode.write_lines(lines, VECTORS), ReadSpec(VECTORS, S.indexed(FieldSpec("long"), FieldSpec(type_, array=True)))).toDF("vec_id", "e")


_ITEMS = "SELECT vec_id, i::INTEGER AS i, embedding[i + 1] AS item FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)"


@query(_ITEMS)
def array_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, "float").select("vec_id", F.posexplode("e").alias("i", "item"))


@query("SELECT vec_id, embedding[3] AS item FROM embeddings")
def array_item_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, "float").select("vec_id", array_item(F.col("e"), 2).alias("item"))


@query(_ITEMS)
def array_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as text, which read as the same numbers."""
    return _vectors(spark, sf_dir, "string").select("vec_id", F.posexplode("e").alias("i", "item")).withColumn("item", F.col("item").cast("float"))


@query("SELECT p_partkey, i::INTEGER AS i, CASE WHEN i = 1 THEN NULL WHEN i = 2 THEN -1 ELSE p_size END AS item FROM part, (SELECT unnest(range(3)) AS i)")
def array_item_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences replace items where a field asks for it."""
    df = table(spark, sf_dir, "part")
    lines = df.select(F.concat(F.col("p_partkey").cast("string"), F.lit(";["), F.col("p_size").cast("string"), F.lit("|n/a|?]")).alias("value"))
    field = FieldSpec("int", array=True, item_sequences=True, sequences={"n/a": None, "?": "-1"})
    rows = api.read_delimited(spark, encode.write_lines(lines, VECTORS), ReadSpec(VECTORS, S.indexed(FieldSpec("long"), field))).toDF("p_partkey", "e")
    return rows.select("p_partkey", F.posexplode("e").alias("i", "item"))


@query("SELECT p_partkey, '[' || p_size || '|x' AS v FROM part")
def array_without_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array delimiter alone leaves values as they are."""
    d = dataclasses.replace(VECTORS, array=ArrayDialect("|"))
    lines = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(";["), F.col("p_size").cast("string"), F.lit("|x")).alias("value"))
    return api.read_delimited(spark, encode.write_lines(lines, d), ReadSpec(d, S.indexed(FieldSpec("long"), FieldSpec("string")))).toDF("p_partkey", "v")


@query("SELECT o_orderkey, make_date(year(o_orderdate)::INTEGER, ((quarter(o_orderdate) - 1) * 3 + 1)::INTEGER, 1) AS q FROM orders")
def custom_field_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters such as Q1.25, by a field's own parser."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit("."), F.date_format("o_orderdate", "yy")).alias("q"))
    year = lambda c: F.substring(c, 4, 2).cast("int")
    read = lambda c: F.make_date(F.when(year(c) < 70, year(c) + 2000).otherwise(year(c) + 1900), (F.substring(c, 2, 1).cast("int") - 1) * 3 + 1, F.lit(1))
    return _typed(spark, df, FieldSpec("long"), FieldSpec("quarter", parser=read))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m FROM orders")
def type_parser_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    read = ReadSpec(BARE, S.indexed(FieldSpec("long"), FieldSpec("month")), parsers={"month": lambda c: F.to_date(F.concat(c, F.lit("-01")))}, multiline=False)
    return api.read_delimited(spark, encode.write_table(df, BARE), read).toDF(*df.columns)


class YearMonth:
    """A user's type, found by its parse method."""

    def __init__(self, year: int, month: int):
        self.year, self.month = year, month

    @classmethod
    def parse(cls, text: str) -> YearMonth:
        return cls(*map(int, text.split("-")))

    def __str__(self) -> str:
        return f"{self.year}/{self.month}"


@query("SELECT o_orderkey, year(o_orderdate) || '/' || month(o_orderdate) AS m FROM orders")
def class_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    return _typed(spark, df, FieldSpec("long"), S.custom(YearMonth))


@query("SELECT upper(r_name) AS name, r_regionkey FROM region")
def vectorised_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def upper(v: pd.Series) -> pd.Series:
        return v.str.upper()

    df = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    return _typed(spark, df, FieldSpec("upper", parser=upper), FieldSpec("int"))


@query("SELECT s_suppkey::VARCHAR AS a, s_name AS b FROM supplier")
def to_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = api.to_arrays(spark, encode.write_table(table(spark, sf_dir, "supplier"), SEMI), ReadSpec(SEMI))
    return rows.select(F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").drop("s_acctbal")
    return api.to_table(spark, encode.write_table(df, SEMI), ReadSpec(SEMI, S.indexed(*fields_of(df))))


@dataclasses.dataclass
class Nation:
    key: int
    name: str


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def to_typed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return api.to_typed(spark, encode.write_table(df, SEMI), Nation, ReadSpec(SEMI))


@query("SELECT n_nationkey::BIGINT AS key, length(n_name)::BIGINT AS size FROM nation")
def map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return api.map_records(spark, encode.write_table(df, SEMI), lambda v: {"key": int(v[0]), "size": len(v[1])}, "key long, size long", ReadSpec(SEMI))


@query("SELECT count(*) AS n FROM documents")
def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dialect(",", "\n")
    return api.count_records(spark, encode.write_table(table(spark, sf_dir, "documents").select("doc_id", "text"), d), ReadSpec(d))


@query("SELECT 'r_regionkey;r_name' AS raw")
def first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.first_record(spark, encode.write_table(table(spark, sf_dir, "region"), SEMI), ReadSpec(SEMI))


@query("SELECT p_partkey::VARCHAR AS k, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 2 ELSE 3 END AS n FROM part")
def field_count_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.slice(F.array(F.col("p_partkey").cast("string"), "p_brand", "p_type"), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int")).alias("v"))
    rows = api.read_records(spark, encode.write_lines(df.select(F.array_join("v", ";").alias("value")), BARE), ReadSpec(BARE))
    return rows.select(F.col("fields")[0]["value"].alias("k"), F.size("fields").alias("n"))


@query("SELECT n_nationkey AS n, n_name AS raw, n_nationkey + 1 AS record_no FROM nation")
def raw_text_and_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes put back, and records numbered in file order."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1)
    rows = api.read_records(spark, encode.write_table(df, SEMI, quote_all=True), ReadSpec(SEMI))
    raw = api.raw_text(F.col("fields")[1], '"')
    return rows.select(F.col("fields")[0]["value"].cast("int").alias("n"), raw.alias("raw"), F.col("record_no").cast("int").alias("record_no")).withColumn("raw", F.expr("substring(raw, 2, length(raw) - 2)"))


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"


def _packed(spark: SparkSession, sf_dir: str, pack: Callable[[bytes], bytes], name: str, resource: Resource, bom: bytes = b"", charset: str = "utf-8", **how: Callable) -> DataFrame:
    """A small table in one file of some compression and encoding, written by the driver."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    text = "\r\n".join([";".join(df.columns), *(r["value"] for r in encode.lines(df, SEMI).toLocalIterator())])
    path = write_bytes(spark, f"{new_path(spark, 'file')}/{name}", pack(bom + text.encode(charset)))
    return api.read_delimited(spark, path, ReadSpec(SEMI, S.indexed(*fields_of(df)), resource), **how)


def raw_deflate(data: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


def zipped(data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.csv", data)
        z.writestr("second.csv", "not read")
    return out.getvalue()


_PLAIN_BYTES = bytes
for _n, _a in {
    "gzip_scan": (gzip.compress, "a.data", Resource(compression="gz")),
    "raw_deflate_scan": (raw_deflate, "a.zz", Resource(compression="deflate")),
    "zip_scan": (zipped, "a.zip", Resource(compression=".ZIP")),
    "utf16_bom_scan": (_PLAIN_BYTES, "a.csv", Resource(), b"\xff\xfe", "utf-16-le"),
    "utf16_declared_scan": (_PLAIN_BYTES, "a.csv", Resource("utf-16-be"), b"", "utf-16-be"),
    "latin2_scan": (_PLAIN_BYTES, "a.csv", Resource("ISO-8859-2"), b"", "iso-8859-2"),
    "utf8_bom_scan": (_PLAIN_BYTES, "a.csv", Resource(), b"\xef\xbb\xbf", "utf-8"),
}.items():
    QUERIES[_n] = lambda spark, sf_dir, a=_a: _packed(spark, sf_dir, a[0], a[1], *a[2:])
    ORACLE_SQL[_n] = _SUPPLIER


@query(_SUPPLIER)
def custom_decompressor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's decompressor under a name of its own and an alias."""
    DECOMPRESSORS.add_or_replace(".BZ2", bz2.decompress)
    DECOMPRESSORS.add_alias("bzip", "bz2")
    return _packed(spark, sf_dir, bz2.compress, "a.data", Resource(compression="bzip"))


@query(_SUPPLIER)
def custom_detector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's detector tells an encoding that no mark does."""
    return _packed(spark, sf_dir, _PLAIN_BYTES, "a.csv", Resource(), b"", "utf-16-le", detector=lambda head: ("utf-16-le", 0))


@query("SELECT n_nationkey::VARCHAR AS a, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END AS n, n_nationkey + 1 AS record_no FROM nation")
def end_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimiter at a record's end opens an empty field; a last terminator is optional and adds no record."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey").toLocalIterator()
    text = "\r\n".join(f"{r[0]};x" + ";" * (r[0] % 2 == 0) for r in rows)
    at = [write_bytes(spark, f"{new_path(spark, 'file')}/{name}", (text + tail).encode()) for name, tail in (("a.csv", ""), ("b.csv", "\r\n"))]
    read = [api.read_records(spark, p, ReadSpec(BARE)).select(F.col("fields")[0]["value"].alias("a"), F.size("fields").alias("n"), F.col("record_no").cast("int").alias("record_no")) for p in at]
    return read[0].intersectAll(read[1])


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE '' END AS a, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM nation")
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank line is a record of one empty field."""
    lines = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(";", F.col("n_nationkey").cast("string"), "n_name")).otherwise("").alias("value"))
    rows = api.read_records(spark, encode.write_lines(lines, BARE), ReadSpec(BARE))
    return rows.select(F.col("fields")[0]["value"].alias("a"), F.size("fields").alias("n"))


@query("SELECT p_partkey::VARCHAR AS k, p_partkey % 3 > 0 AS quoted, p_partkey % 3 = 2 AS escaped FROM part")
def token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, quoted, and quoted with doubled quotes."""
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.lit("plain")).when(kind == 1, F.lit('"quoted"')).otherwise(F.lit('"a ""b"" c"'))
    lines = table(spark, sf_dir, "part").select(F.concat_ws(";", F.col("p_partkey").cast("string"), name).alias("value"))
    rows = api.read_records(spark, encode.write_lines(lines, BARE), ReadSpec(BARE))
    return rows.select(F.col("fields")[0]["value"].alias("k"), F.col("fields")[1]["quoted"].alias("quoted"), F.col("fields")[1]["escaped"].alias("escaped"))


@query("SELECT * FROM (VALUES ('n_nationkey', 'int', 'INTEGER'), ('n_name', 'string', ''), ('n_regionkey', 'decimal(10,2)', 'NUMBER')) t(name, type, source)")
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S.indexed(FieldSpec("int", source_type="INTEGER"), FieldSpec(), FieldSpec("decimal", precision=(10, 2), source_type="NUMBER"))
    df = api.read_delimited(spark, encode.write_table(table(spark, sf_dir, "nation"), SEMI), ReadSpec(SEMI, schema))
    return spark.createDataFrame(api.field_types(df), "name string, type string, source string")


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END AS k, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS name, CASE WHEN n_nationkey % 3 > 0 THEN 'The record ' || (n_nationkey + 2) || ' contains ' || (n_nationkey % 3) || ' more field' || CASE WHEN n_nationkey % 3 = 1 THEN '' ELSE 's' END || ' than expected.' END AS error FROM nation")
def too_many_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlong records are rows of nulls that say why, in mode permissive."""
    d = Dialect(";", comment="#")
    df = table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1)
    lines = df.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(";"), F.col("n_name"), F.repeat(F.lit(";x"), (F.col("n_nationkey") % 3).cast("int"))).alias("value"))
    read = ReadSpec(d, S.indexed(FieldSpec("int"), FieldSpec()), options=Options(mode="permissive"))
    return api.read_delimited(spark, encode.write_lines(lines, d, ["k;name"]), read).toDF("k", "name", "error")


@query("SELECT p_partkey, '(null)' AS a, 'x\\;y' AS b FROM part")
def toggles_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither sequences nor escapes are touched."""
    d = Dialect(";", "\n", escape="\\", header_rows=(), null_sequence="(null)")
    lines = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(";(null);x\\;y")).alias("value"))
    read = ReadSpec(d, S.indexed(FieldSpec("long"), FieldSpec(), FieldSpec()), options=Options(unescape=False, special_values=False))
    return api.read_delimited(spark, encode.write_lines(lines, d), read).toDF("p_partkey", "a", "b")


@query("SELECT NULL::BIGINT AS n")
def count_switched_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.count_records(spark, encode.write_table(table(spark, sf_dir, "region"), SEMI), ReadSpec(SEMI, options=Options(row_count_at_start=False)))


@query("SELECT s_suppkey, s_name || ' |''\\ #' AS s_name FROM supplier")
def named_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialect spelt by the names of its characters."""
    d = Dialect(S.DELIMITERS["pipe"], S.TERMINATORS["lf"], S.QUOTES["single"], False, S.ESCAPES["backslash"], comment=S.COMMENTS["hash"], header_rows=())
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" |'\\ #")).alias("s_name"))
    return api.read_delimited(spark, encode.write_table(df, d), ReadSpec(d, S.indexed(FieldSpec("long"), FieldSpec()))).toDF("s_suppkey", "s_name")


@query("SELECT p AS preset, n_nationkey::INTEGER AS k, n_name || ',;|' AS name FROM nation, (SELECT unnest(['comma', 'semicolon', 'tab', 'pipe']) AS p)")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(",;|")).alias("n_name"))
    read = [api.read_delimited(spark, encode.write_table(df, d), ReadSpec(d, S.indexed(FieldSpec("int"), FieldSpec()))).toDF("k", "name").withColumn("preset", F.lit(n)) for n, d in (("comma", S.COMMA), ("semicolon", S.SEMICOLON), ("tab", S.TAB), ("pipe", S.PIPE))]
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])


class Span:
    """A user's type whose parse takes a pattern and a provider."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    @classmethod
    def parse_exact(cls, text: str, pattern: str, provider: str) -> Span:
        low, high = text.removeprefix(provider).split(pattern)
        return cls(int(low), int(high))

    def __str__(self) -> str:
        return f"{self.low}-{self.high}"


@query("SELECT p_partkey, p_size || '-' || (p_size + 3) AS span FROM part")
def class_parser_with_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.format_string("~%d..%d", "p_size", F.col("p_size") + 3).alias("span"))
    return _typed(spark, df, FieldSpec("long"), S.custom(Span, pattern="..", provider="~"))


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents, o_custkey, o_orderdate::DATE AS day FROM orders")
def values_by_culture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and dates as a culture writes them: 1.234,56 and 31.12.2025."""
    df = table(spark, sf_dir, "orders")
    german = lambda c: F.translate(c, ",.", ".,")
    text = df.select("o_orderkey", german(F.format_number("o_totalprice", 2)).alias("price"), german(F.format_number("o_custkey", 0)).alias("cust"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))
    rows = api.read_delimited(spark, encode.write_table(text, SEMI), ReadSpec(SEMI, multiline=False))
    price = parse_culture(F.col("price"), "double", "de-de")
    return rows.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.round(price * 100).cast("long").alias("cents"), parse_culture(F.col("cust"), "long", "de-DE").alias("o_custkey"), parse_culture(F.col("day"), "date", "de-de").alias("day"))


@query("SELECT event_id, user_id FROM events")
def ndjson_unquoted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ndjson")
    table(spark, sf_dir, "events").select(F.format_string("{event_id: %d, user_id:%d}", "event_id", "user_id").alias("value")).write.text(path)
    return read_ndjson(spark, path, NdjsonSpec(S.named(FieldSpec("long", "event_id"), FieldSpec("long", "user_id"))))


@query("SELECT event_id, user_id, event_id + 1 AS second FROM events")
def ndjson_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects and arrays are text of their own, which reads on."""
    path = new_path(spark, "ndjson")
    table(spark, sf_dir, "events").select(F.format_string('{"id": %d, "who": {"user": %d}, "list": [%d, %d]}', "event_id", "user_id", "event_id", F.col("event_id") + 1).alias("value")).write.text(path)
    rows = read_ndjson(spark, path, labels=["id", "who", "list"])
    return rows.select(F.col("id").cast("long").alias("event_id"), F.get_json_object("who", "$.user").cast("long").alias("user_id"), F.get_json_object("list", "$[1]").cast("long").alias("second"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def ndjson_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = new_path(spark, "ndjson")
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    return read_ndjson(spark, path, NdjsonSpec(S.named(*fields_of(df))))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS place FROM events")
def ndjson_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that come and go, and their places in each line."""
    df = table(spark, sf_dir, "events")
    path = new_path(spark, "ndjson")
    line = F.when(F.col("event_id") % 2 == 0, F.format_string('{"user": %d, "id": %d}', "user_id", "event_id")).otherwise(F.format_string('{"id":%d}', "event_id"))
    df.select(line.alias("value")).write.text(path)
    at = F.col("values")
    return read_lines(spark, path).select(F.try_element_at(at, F.lit("id")).cast("long").alias("event_id"), F.try_element_at(at, F.lit("user")).cast("long").alias("user_id"), ordinal_of(at, "id").cast("int").alias("place"))


@query("SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 3 = 0 THEN 'null' ELSE 'a\\\"b' END AS note FROM events")
def ndjson_null_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reading: null is text and escapes stay."""
    df = table(spark, sf_dir, "events")
    path = new_path(spark, "ndjson")
    note = F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(F.lit('"a\\"b"'))
    df.select(F.concat(F.lit('{ "id" : '), F.col("event_id").cast("string"), F.lit(', "note":'), note, F.lit(" }")).alias("value")).write.text(path)
    return read_ndjson(spark, path, NdjsonSpec(raw=True), ["id", "note"])


@query("SELECT event_id, regexp_extract(props, ': *([0-9]+)', 1)::INTEGER AS k FROM events")
def ndjson_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An NDJSON text inside a delimited field."""
    df = table(spark, sf_dir, "events").select("event_id", "props")
    rows = api.read_delimited(spark, encode.write_table(df, Dialect(",", "\n")), ReadSpec(Dialect(",", "\n"), S.indexed(*fields_of(df)), multiline=False))
    return rows.select("event_id", parse(F.from_json("props", "map<string,string>")["k"], FieldSpec("int")).alias("k"))


@query("SELECT p_partkey::VARCHAR AS k, p_name AS v FROM part WHERE p_partkey % 2 = 0")
def malformed_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text after a closing quote is malformed; mode drop leaves such records out."""
    df = table(spark, sf_dir, "part")
    lines = df.select(F.concat(F.col("p_partkey").cast("string"), F.lit(';"'), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, '"').otherwise('"x')).alias("value"))
    read = ReadSpec(Dialect(";", "\n", header_rows=()), options=Options(mode="drop"))
    return api.read_delimited(spark, encode.write_lines(lines, read.dialect), read).toDF("k", "v")


@query("SELECT 'a' AS path, count(*) AS bad FROM part WHERE p_partkey % 2 <> 0")
def malformed_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    lines = df.select(F.concat(F.col("p_partkey").cast("string"), F.lit(';"'), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, '"').otherwise('"x')).alias("value"))
    read = ReadSpec(Dialect(";", "\n", header_rows=()), options=Options(mode="permissive"))
    return api.read_records(spark, encode.write_lines(lines, read.dialect), read).where("error is not null").agg(F.lit("a").alias("path"), F.count("*").alias("bad"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
def stream_scan_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files to its end, aggregated; the result is the complete table."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    read = ReadSpec(PLAIN, S.indexed(*fields_of(df)))
    rows = stream_delimited(spark, encode.write_table(df, PLAIN), read, df.columns)
    counts = rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
    out = new_path(spark, "stream")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT n_nationkey, n_name FROM nation")
def tokenize_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer as a Column function on a text column."""
    from fieldstone.operators.expression import tokenize

    lines = encode.lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), SEMI, quote_all=True)
    fields = lines.select(tokenize(F.col("value"), SEMI).alias("f"))
    read = ReadSpec(SEMI)
    return fields.select(sanitize(F.col("f")[0], read, None).cast("int").alias("n_nationkey"), sanitize(F.col("f")[1], read, None).alias("n_name"))
