"""Tokens, records and headers, on both tokenizers where lines are records."""

import pytest
from pyspark.sql import functions as F

from fieldstone.operators import tokenizer as tk
from fieldstone.operators.expression import tokenize
from fieldstone.plans.spec import ArrayDialect, Dialect

SEMI = Dialect(";", quote="'", header_rows=())
ESC = Dialect(";", quote="'", escape="\\", header_rows=())


def values(text, d=SEMI, mode="failfast"):
    return [[t.value for t in r.tokens] for r in tk.records(text, d, mode) if not r.comment]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("foo;bar", [["foo", "bar"]]),
        ("foo;bar;", [["foo", "bar", ""]]),
        (";;", [["", "", ""]]),
        ("foo\r\nbar\r\n", [["foo"], ["bar"]]),
        ("foo\r\n\r\nbar", [["foo"], [""], ["bar"]]),
        ("foo\rbar\r\n", [["foo\rbar"]]),
        ("foo\r\r\nbar", [["foo\r"], ["bar"]]),
        ("a'b;c", [["a'b", "c"]]),
        ("'a;b';'c\r\nd'", [["a;b", "c\r\nd"]]),
        ("'ab'';''c';'xyz'", [["ab'';''c", "xyz"]]),
        ("''", [[""]]),
        ("", []),
        ("\r\n", [[""]]),
        ("  a ; b", [["  a ", " b"]]),
    ],
)
def test_records(text, want):
    assert values(text) == want


def test_flags_and_raw():
    a, b, c = next(iter(tk.records("'x''y';z;'w'", SEMI))).tokens
    assert (a.quoted, a.escaped, a.raw) == (True, True, "'x''y'")
    assert (b.quoted, b.escaped, b.raw) == (False, False, "z")
    assert (c.quoted, c.escaped) == (True, False)


@pytest.mark.parametrize(
    ("text", "at"),
    [("'ab'';'c';'xyz'", "'c' at position 7"), ("'ab'x;c", "'x' at position 4"), ("'open;x", "End-of-File"), ("x;'open", "End-of-File")],
)
def test_malformed(text, at):
    with pytest.raises(tk.MalformedError, match=at):
        values(text)
    assert values(text + "\r\nfine;too", mode="drop")[-1:] == ([["fine", "too"]] if "open" not in text else []) or "open" in text
    found = list(tk.records(text, SEMI, "permissive"))
    assert found[0].error and found[0].tokens == []


def test_doubling_off_makes_doubled_quotes_malformed():
    d = Dialect(";", quote="'", double_quote=False, header_rows=())
    assert values("'a;b';c", d) == [["a;b", "c"]]
    with pytest.raises(tk.MalformedError):
        values("'a''b'", d)


@pytest.mark.parametrize("text", ["fo\\;o;x", "'fo\\'o';x", "a\\\r\nb;x"])
def test_escapes(text):
    (r,) = tk.records(text, ESC)
    assert len(r.tokens) == 2 and r.tokens[0].escaped


@pytest.mark.parametrize("t", ["\n", "\r\n", "\t\r\n", "+@", "|@#"])
def test_terminators(t):
    assert values(f"a;b{t}1;2{t}3;4{t}", Dialect(";", t, header_rows=())) == [["a", "b"], ["1", "2"], ["3", "4"]]


def test_partial_terminators():
    assert values("abc+@abc+abc+@abc", Dialect(";", "+@", header_rows=())) == [["abc"], ["abc+abc"], ["abc"]]
    assert values("foo\r;bar") == [["foo\r", "bar"]]


def test_skip_initial_space():
    d = Dialect(";", quote="'", skip_initial_space=True, header_rows=())
    assert values("a;  b;  ' c';\td ", d) == [["a", "b", " c", "\td "]]


@pytest.mark.parametrize("text", ["#x;y\r\na;b\r\n1;2", "a;b\r\n#x\r\n1;2\r\n", "a;b\r\n1;2\r\n#end"])
def test_comments(text):
    assert values(text, Dialect(";", comment="#", header_rows=())) == [["a", "b"], ["1", "2"]]


def test_no_quote():
    assert values('"a;b"', Dialect(";", quote=None, header_rows=())) == [['"a', 'b"']]


def test_arrays():
    d = Dialect(";", quote="'", header_rows=(), array=ArrayDialect("|", "[", "]"))
    a, b, c = next(iter(tk.records("[10|'2|5'|];[];x[1|2]", d))).tokens
    assert [t.value for t in a.children] == ["10", "2|5", ""] and a.value == "10|'2|5'|"
    assert b.children == [] and c.children is None and c.value == "x[1|2]"
    with pytest.raises(tk.MalformedError):
        values("[1|2", d)
    assert values("1|2", Dialect(";", header_rows=(), array=ArrayDialect("|"))) == [["1|2"]]


@pytest.mark.parametrize(
    ("rows", "d", "want"),
    [
        ([["a", "b"]], Dialect(), ["a", "b"]),
        ([["field"], ["0", "1"]], Dialect(header_rows=(1, 2), header_join="."), ["field.0", "field.1"]),
        ([["", "b", ""]], Dialect(), ["field_1", "b", "b"]),
        ([["foo", "", "bar"]], Dialect(), ["foo", "foo", "bar"]),
        ([], Dialect(header_rows=()), ["field_0", "field_1"]),
    ],
)
def test_header_names(rows, d, want):
    assert tk.header_names(rows, d, 2) == want


def test_header_rows_and_numbers():
    d = Dialect(";", header_rows=(2,), comment="#")
    rows, rest = tk.split_header(tk.records("# c\r\nskip\r\nk;v\r\n1;2\r\n# d\r\n3;4", d), d)
    assert rows == [["k", "v"]]
    assert [(r.number, r.comment) for r in rest] == [(1, False), (2, True), (3, False)]
    assert tk.split_header(tk.records("", d), d)[0] == []


@pytest.mark.parametrize(("text", "n"), [("a\r\nb\r\n", 1), ("a\r\nb", 1), ("'a\r\n';b\r\nc", 1), ("", 0), ("h\r\n", 0)])
def test_count(text, n):
    assert tk.count_records(text, Dialect(";", quote="'")) == n


LINES = ["foo;bar;", ";;", "", "''", "a'b;c", "'a;b';'c''d'", "'ab'x;c", "'open;x", "x;'open", "  a; b", "\\;x;y", "'a\\'b';c", "é;\U0001f600", "'" + "x" * 100_000 + "';y"]


@pytest.mark.parametrize("d", [SEMI, ESC, Dialect(";", quote=None, header_rows=()), Dialect(";", quote="'", skip_initial_space=True, header_rows=()), Dialect("|", quote="'", double_quote=False, header_rows=())])
def test_expression_agrees_with_exact(spark, d):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    got = {r["i"]: r["f"] for r in df.select("i", tokenize(F.col("line"), d).alias("f")).collect()}
    for i, line in enumerate(LINES):
        (want,) = list(tk.records(line or d.line_terminator, d, "permissive"))
        if want.error:
            assert got[i] is None, line
        else:
            assert [(f["value"], f["quoted"], f["escaped"]) for f in got[i]] == [(t.value, t.quoted, t.escaped) for t in want.tokens], line


@pytest.mark.parametrize("mode", ["permissive", "drop"])
@pytest.mark.parametrize("text", ["'a''b;\r\n';c\r\n# n\r\n\r\nx\r;y\r\n'z", "a;'b'x\r\nc;'d'\r\n", "\\\r\n;'\\'\r\n'\r\nz;", "'';''\r\n'"])
def test_text_in_pieces_has_the_same_records(text, mode):
    d = Dialect(";", quote="'", escape="\\", comment="#")
    for size in range(1, len(text) + 1):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        assert list(tk.records_of(pieces, d, mode)) == list(tk.records(text, d, mode))
