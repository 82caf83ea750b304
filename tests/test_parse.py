"""Typed parsing, formats, sequences, unescaping, resources and specifications."""

import dataclasses
import datetime as dt
import gzip
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldstone.functions import parse as P
from fieldstone.operators.sanitize import sanitize
from fieldstone.plans import spec as S
from fieldstone.queries import raw_deflate, zipped
from fieldstone.sources import resource as R


def one(spark, text, f, **more):
    df = spark.createDataFrame([(text,)], "v string")
    return df.select(P.parse(F.col("v"), f, **more).alias("v")).first()["v"]


NUM, INT = S.NumberFormat, S.IntegerFormat
GOOD = [
    ("TRUE", S.FieldSpec("bool"), True),
    (" false ", S.FieldSpec("bool"), False),
    ("+5", S.FieldSpec("int"), 5),
    (" -32768 ", S.FieldSpec("short"), -32768),
    ("255", S.FieldSpec("byte"), 255),
    ("9223372036854775807", S.FieldSpec("long"), 2**63 - 1),
    ("1e3", S.FieldSpec("double"), 1000.0),
    ("1,234.5", S.FieldSpec("double"), 1234.5),
    ("125,210.17", S.number(format=NUM(), precision=(18, 2)), Decimal("125210.17")),
    ("456.211,205", S.number(format=NUM(".", ","), precision=(18, 3)), Decimal("456211.205")),
    ("+12,210", S.integer(), 12210),
    ("-16 211", S.integer(group=" "), -16211),
    ("1e6", S.integer(), 1_000_000),
    ("-456 211e2", S.integer(group=" "), -45_621_100),
    ("2025/01/04", S.temporal("date", pattern="yyyy/MM/dd"), dt.date(2025, 1, 4)),
    ("04-01-25", S.FieldSpec("date", format=S.TemporalFormat("dd/MM/yy", "-")), dt.date(2025, 1, 4)),
    ("04-01-75", S.FieldSpec("date", format=S.TemporalFormat("dd/MM/yy", "-")), dt.date(1975, 1, 4)),
    ("14:35:08", S.temporal("time"), "14:35:08.000000"),
    ("02:35:08 PM", S.temporal("time", pattern="hh:mm:ss tt"), "14:35:08.000000"),
    ("2025-01-04T14:35:08", S.temporal("datetime"), dt.datetime(2025, 1, 4, 14, 35, 8)),
    ("01/04/2025 02:35:08 PM", S.temporal("datetime", pattern="MM/dd/yyyy hh:mm:ss tt"), dt.datetime(2025, 1, 4, 14, 35, 8)),
    ("2025-01-04 10:11:12.345", S.FieldSpec("datetime"), dt.datetime(2025, 1, 4, 10, 11, 12, 345000)),
    ("D3C7F3E0-4B3A-4A95-A6B9-81A519E4A8C1", S.FieldSpec("guid"), "d3c7f3e0-4b3a-4a95-a6b9-81a519e4a8c1"),
    ("{d3c7f3e04b3a4a95a6b981a519e4a8c1}", S.FieldSpec("guid"), "d3c7f3e0-4b3a-4a95-a6b9-81a519e4a8c1"),
    ("xyz", S.FieldSpec("char"), "x"),
    (None, S.FieldSpec("int"), None),
]


@pytest.mark.parametrize(("text", "f", "want"), GOOD, ids=[f"{f.type}-{t}" for t, f, _ in GOOD])
def test_good(spark, text, f, want):
    assert one(spark, text, f) == want


BAD = [("1", "bool"), ("yes", "bool"), ("1.5", "int"), ("1e6", "int"), ("1,000", "int"), ("32768", "short"), ("256", "byte"), ("-1", "byte"), ("x", "double"), ("1e5", "decimal"), ("2025-13-01", "date"), ("25:00", "time"), ("12", "guid"), ("", "char"), ("", "int")]


@pytest.mark.parametrize(("text", "type_"), BAD)
def test_bad(spark, text, type_):
    with pytest.raises(PySparkException, match=f"as {type_} in field f"):
        one(spark, text, S.FieldSpec(type_, "f"))


def test_group_off(spark):
    with pytest.raises(PySparkException):
        one(spark, "+12,210", S.integer(group=None))
    with pytest.raises(S.SpecError, match="No parser registered"):
        one(spark, "1", S.FieldSpec("colour"))


def test_offsets(spark):
    f = S.temporal("datetimeoffset", pattern="yyyy-MM-ddTHH:mm:sszzz")
    a = one(spark, "2025-01-04T14:35:08Z", f)
    b = one(spark, "01/04/2025 02:35:08 PM +0100", S.temporal("datetimeoffset", pattern="MM/dd/yyyy hh:mm:ss tt zzz"))
    assert a - b == dt.timedelta(hours=1)


def test_order_of_parsers(spark):
    own = S.FieldSpec("int", parser=lambda c: F.lit("own"))
    assert one(spark, "1", own, parsers={"int": lambda c: F.lit("type")}) == "own"
    assert one(spark, "1", S.FieldSpec("int"), parsers={"int": lambda c: F.lit("type")}) == "type"
    df = spark.createDataFrame([("26/12/2025",)], "v string")
    assert df.select(P.parse_culture(F.col("v"), "date", "fr-FR")).first()[0] == dt.date(2025, 12, 26)


def test_patterns():
    assert P.java_pattern(S.TemporalFormat("yyyy-MM-ddTHH:mm:ss.fff tt zzz")) == "yyyy-MM-dd'T'HH':'mm':'ss.SSS a XXX"
    assert P.java_pattern(S.TemporalFormat("'Q'd/M", "-")) == "'Q'd'-'M"
    with pytest.raises(S.SpecError):
        P.java_pattern(S.TemporalFormat("yyyyy"))


def test_arrays(spark):
    df = spark.createDataFrame([(["1", "25"],), (None,)], "c array<string>")
    got = df.select(P.parse_array(F.col("c"), S.FieldSpec("int", array=True)).alias("a"))
    assert [r["a"] for r in got.collect()] == [[1, 25], []]
    assert got.where("size(a) > 1").select(P.array_item(F.col("a"), 1)).first()[0] == 25
    with pytest.raises(PySparkException, match="out of range"):
        got.select(P.array_item(F.col("a"), 2)).collect()


def clean(spark, value, quoted, escaped, read, f=None):
    df = spark.createDataFrame([((value, quoted, escaped, None),)], "t struct<value:string,quoted:boolean,escaped:boolean,children:array<string>>")
    return df.select(sanitize(F.col("t"), read, f)).first()[0]


@pytest.mark.parametrize(
    ("value", "quoted", "escaped", "want"),
    [("(null)", False, False, None), ("(null)", True, False, "(null)"), ("", False, False, "-1"), ("", True, False, "-1"), ("NaN", False, False, "0"), ("a''b", True, True, "a'b"), ("a\\;b\\x", False, True, "a;b\\x"), ("a\\\\'", True, True, "a\\'"), ("plain", False, False, "plain")],
)
def test_sanitize(spark, value, quoted, escaped, want):
    read = S.ReadSpec(S.Dialect(";", quote="'", escape="\\", null_sequence="(null)"), resource=S.Resource(sequences={"": "-1"}))
    f = S.FieldSpec(sequences={"NaN": "0"})
    assert clean(spark, value, quoted, escaped, read, f) == want
    off = dataclasses.replace(read, options=S.Options(unescape=False, special_values=False))
    assert clean(spark, value, quoted, escaped, off, f) == value


def test_specs():
    with pytest.raises(S.SpecError):
        S.ReadSpec(resource=S.Resource(sequences={"x": None}), schema=S.indexed(S.FieldSpec(sequences={"x": "1"})))
    with pytest.raises(S.SpecError):
        S.named(S.FieldSpec(name="a"), S.FieldSpec(name="a"))
    with pytest.raises(S.SpecError):
        S.named(S.FieldSpec(name=" "))
    with pytest.raises(S.SpecError):
        S.ArrayDialect("|", "[")
    with pytest.raises(S.SpecError):
        S.Dialect("ab")
    with pytest.raises(S.SpecError):
        S.Dialect(header_rows=(0,))
    with pytest.raises(S.SpecError):
        S.Options(mode="maybe")
    assert S.indexed() is None and not S.Dialect().without_header().header
    assert S.PIPE.delimiter == "|" and S.PIPE.quote == "'" and S.PIPE.escape == "\\"
    assert S.indexed(S.FieldSpec(), S.FieldSpec("int")).field(1, "x").type == "int"


def test_decompressors():
    d = R.Decompressors()
    assert d.get(".GZ")(gzip.compress(b"x")) == b"x"
    assert d.get("zz")(raw_deflate(b"x")) == b"x"
    assert d.get("zip")(zipped(b"x")) == b"x"
    assert d.keys() == sorted(d.keys()) and "deflate" in d.compressions()
    d.add_or_replace("rev", lambda b: b[::-1])
    d.add_alias("back", "rev")
    assert d.get("BACK")(b"ab") == b"ba" and d.compression("back") == "rev"
    with pytest.raises(KeyError, match="lz"):
        d.get("lz")
    d.clear()
    assert d.keys() == []


@pytest.mark.parametrize(("bom", "name"), R.BOMS)
def test_boms(bom, name):
    assert R.detect(bom + "ab".encode(name)) == (name, len(bom))
    assert R.text_of(bom + "aé".encode(name), None, None) == "aé"
    assert R.text_of(bom + "aé".encode(name), name, None) == "aé"


def test_encodings():
    assert R.detect(b"") == ("utf-8", 0) and R.detect(b"a") == ("utf-8", 0)
    assert R.text_of("łó".encode("iso-8859-2"), "ISO-8859-2", None) == "łó"
    assert R.text_of("ab".encode("utf-16-be"), "UTF-16BE", None) == "ab"


class Quarter:
    @classmethod
    def parse(cls, text):
        return text

    @classmethod
    def parse_exact(cls, text, pattern):
        return (text, pattern)


def test_class_parser():
    assert P.class_parser(Quarter, None)("x") == "x"
    assert P.class_parser(Quarter, S.CustomFormat("q"))("x") == ("x", "q")
    assert P.class_parser(Quarter, S.CustomFormat("q", "fr"))("x") == ("x", "q")
    with pytest.raises(S.SpecError):
        P.class_parser(dict, None)


@pytest.mark.parametrize(
    ("text", "kind", "culture", "want"),
    [
        ("1.234.567,5", "double", "de-DE", 1234567.5),
        ("1,234.5", "double", "", 1234.5),
        ("12\u202f345", "long", "fr-fr", 12345),
        ("1:05:09 PM", "time", "en-us", "13:05:09.000000"),
        ("13:05:09", "time", "it-it", "13:05:09.000000"),
        ("31-12-2025 23:59:58", "datetime", "nl-nl", dt.datetime(2025, 12, 31, 23, 59, 58)),
    ],
)
def test_cultures_of_numbers_and_times(spark, text, kind, culture, want):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(P.parse_culture(F.col("v"), kind, culture)).first()[0] == want


def test_item_sequences(spark):
    df = spark.createDataFrame([(["1", "?", ""],)], "v array<string>")
    field = S.FieldSpec("int", array=True)
    assert df.select(P.parse_array(F.col("v"), field, None, {"?": None, "": "-1"})).first()[0] == [1, None, -1]
