"""Reading files: names, shape, paths that agree, sinks, NDJSON, errors."""

import dataclasses

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldstone import api
from fieldstone.operators.tokenizer import Dialect
from fieldstone.plans import spec as S
from fieldstone.plans.spec import FieldSpec, Options, ReadSpec
from fieldstone.sources import scan
from fieldstone.sources.ndjson import NdjsonSpec, read_lines, read_ndjson


@pytest.fixture
def put(tmp_path):
    def write(text, name="a.csv", encoding="utf-8"):
        (tmp_path / name).write_bytes(text.encode(encoding))
        return str(tmp_path / name)

    return write


def rows(df):
    return [tuple(r) for r in df.collect()]


SEMI = ReadSpec(Dialect(";"))


def test_padding_and_too_many(spark, put):
    path = put("a;b;c\r\n1;2;3\r\n4\r\n")
    assert rows(api.read_delimited(spark, path, ReadSpec(Dialect(";", missing_cell="?")))) == [("1", "2", "3"), ("4", "?", "?")]
    with pytest.raises(PySparkException, match="only 1 field"):
        api.read_delimited(spark, path, dataclasses.replace(SEMI, options=Options(extend_incomplete=False))).collect()
    for read in (SEMI, dataclasses.replace(SEMI, multiline=False)):
        with pytest.raises(PySparkException, match=r"record 2 contains 1 more field than expected"):
            api.read_delimited(spark, put("a;b;c\r\nd;e;f;g\r\n"), read).collect()
    with pytest.raises(PySparkException, match=r"record 2 contains 2 more fields"):
        api.read_delimited(spark, put("a;b\r\nd;e;f;g\r\n"), SEMI).collect()


def test_malformed_is_an_error(spark, put):
    with pytest.raises(PySparkException, match="Invalid character 'x' at position"):
        api.read_delimited(spark, put('h\r\n"a"x\r\n'), SEMI).collect()
    with pytest.raises(PySparkException, match="Malformed record"):
        api.read_delimited(spark, put('h\r\n"a"x\r\n'), dataclasses.replace(SEMI, multiline=False)).collect()


def test_named_schema(spark, put):
    path = put("a;b\r\n1;x\r\n")
    read = ReadSpec(Dialect(";"), S.named(FieldSpec("int", "a", source_type="INT4")))
    df = api.read_delimited(spark, path, read, ["a"])
    assert rows(df) == [(1,)] and api.field_types(df) == [("a", "int", "INT4")]
    with pytest.raises(PySparkException, match="no field named 'b'"):
        api.read_delimited(spark, path, read).collect()
    with pytest.raises(S.SpecError):
        api.read_delimited(spark, path, ReadSpec(Dialect(";"), S.indexed(FieldSpec())))
    with pytest.raises(IndexError):
        api.read_delimited(spark, path, SEMI, ["z"])


def test_repeated_names_by_place(spark, put):
    path = put("foo;;bar\r\n1;2;3\r\n")
    df = api.read_delimited(spark, path, SEMI)
    assert df.columns == ["foo", "foo", "bar"] and rows(df) == [("1", "2", "3")]
    assert rows(api.read_delimited(spark, path, SEMI, [1])) == [("2",)]


def test_empty_inputs(spark, put):
    assert api.read_delimited(spark, put(""), SEMI).collect() == []
    df = api.read_delimited(spark, put(""), ReadSpec(Dialect(";"), S.indexed(FieldSpec("int", "k"))))
    assert df.dtypes == [("k", "int")] and df.collect() == []
    assert rows(api.read_delimited(spark, put("#c\r\n#d\r\na\r\n1\r\n"), ReadSpec(Dialect(";", comment="#")))) == [("1",)]


def test_comment_rows_count_comments(spark, put):
    d = Dialect(";", comment="#", comment_rows=(2,))
    for read in (ReadSpec(d), ReadSpec(d, multiline=False)):
        assert rows(api.read_delimited(spark, put("k\r\n#c\r\ndrop\r\nkeep\r\n"), read)) == [("keep",)]


TEXTS = ["k;v\r\n1;a\r\n2;\r\n;b\r\n", "k;v\r\n1;a\r\n2;b", "k;v\r\n", 'k;v\r\n"x;1";"say ""hi"""\r\n', "k;v\r\né;\U0001f600\r\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_paths_agree(spark, put, text):
    path = put(text)
    got = [rows(api.read_delimited(spark, path, dataclasses.replace(SEMI, scan=p, multiline=False))) for p in ("exact", "expression", "split", "native")]
    assert got[0] == got[1] == got[2] == got[3]


def test_illegal_paths_are_refused(spark, put):
    path = put("a\r\n1")
    with pytest.raises(S.SpecError):
        api.read_delimited(spark, path, ReadSpec(Dialect(escape="\\"), scan="native"))
    with pytest.raises(S.SpecError):
        api.read_delimited(spark, path, ReadSpec(scan="expression"))


@pytest.mark.parametrize("parts", [1, 7])
def test_records_do_not_depend_on_files(spark, tmp_path, parts):
    from fieldstone.sources import encode

    d = Dialect("|", "\n", quote=None, header_rows=())
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("b")).repartition(parts)
    path = encode.write_table(df, d)
    for p in ("exact", "expression", "native"):
        read = ReadSpec(d, S.indexed(FieldSpec("long"), FieldSpec("long")), scan=p)
        assert sorted(rows(api.read_delimited(spark, path, read))) == sorted(rows(df))


def test_expression_scan_splits_files(spark, put):
    d = Dialect("|", "\n", quote=None, header_rows=())
    path = put("1|2\n" * 1000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = api.read_delimited(spark, path, ReadSpec(d))
        assert df.rdd.getNumPartitions() > 3 and df.count() == 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [7, 40, 1000, 100_000])
@pytest.mark.parametrize("d", [Dialect(";", "\n"), Dialect(";", "\r\n", header_rows=())])
def test_split_path_at_any_split_size(spark, put, size, d):
    cells = [[str(i), "line one\nsecond; \"quoted\"\r\n" * (i % 4), "" if i % 3 else "\n\n", "é\U0001f600"] for i in range(60)]
    body = [";".join('"' + c.replace('"', '""') + '"' if i % 2 or "\n" in c else c for c in row) for i, row in enumerate(cells)]
    path = put("\ufeff" + d.line_terminator.join((["a;b;c;d"] if d.header else []) + body) + d.line_terminator)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = api.read_delimited(spark, path, ReadSpec(d, scan="split"))
        assert sorted(rows(df), key=lambda r: int(r[0])) == [tuple(c) for c in cells]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "1k")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


QUOTED = Dialect(";", "\n")


def test_large_quoted_files_are_split_by_themselves(spark, put, small_splits):
    path = put("k;v\n" + "".join(f'{i};"line\nof ""{i}"""\n' for i in range(500)))
    df = api.read_delimited(spark, path, ReadSpec(QUOTED))
    assert df.rdd.getNumPartitions() > 5
    assert sorted(rows(df)) == sorted(rows(api.read_delimited(spark, path, ReadSpec(QUOTED, scan="exact")))) and df.count() == 500
    assert rows(api.count_records(spark, path, ReadSpec(QUOTED))) == [(500,)]
    assert api.read_records(spark, path, ReadSpec(QUOTED)).agg(F.max("record_no")).first()[0] == 500  # numbers need whole files


@pytest.mark.parametrize("stray", ['5" nail', 'x"', 'a "b" c"'])
def test_stray_quotes_are_found_by_the_split_path(spark, put, small_splits, stray):
    path = put("v\n" + "fine\n" * 300 + f"{stray}\n" + "fine\n" * 300 + '"two\nlines"\n')
    assert api.read_delimited(spark, path, ReadSpec(QUOTED, scan="exact")).count() == 602
    for scan_ in ("auto", "split"):
        with pytest.raises(PySparkException, match="Malformed record"):
            api.read_delimited(spark, path, ReadSpec(QUOTED, scan=scan_)).collect()


def test_marked_charsets_are_not_split(spark, put, small_splits):
    path = put("\ufeffk\n" + "é\n" * 2000, encoding="utf-16-le")
    assert api.read_delimited(spark, path, ReadSpec(QUOTED)).distinct().collect() == [("é",)]


PLAIN = Dialect("|", "\n", quote=None)


@pytest.mark.parametrize("scan_", ["exact", "expression"])
@pytest.mark.parametrize("end", ["\n", "\r\n", "|@#"])
def test_large_files_of_lines_are_split_and_numbered(spark, put, small_splits, scan_, end):
    d = dataclasses.replace(PLAIN, delimiter=";", line_terminator=end, comment_rows=(2, 450))
    path = put("\ufeffk;v" + end + "".join(f"{i};{'é' * (i % 7)}" + end for i in range(1, 501)))
    read = ReadSpec(d, S.indexed(FieldSpec("int"), FieldSpec()), scan=scan_)
    df = api.read_delimited(spark, path, read)
    assert df.rdd.getNumPartitions() > 5 and df.columns == ["k", "v"]
    want = [(i, "é" * (i % 7)) for i in range(1, 501) if i not in (2, 450)]
    assert sorted(rows(df)) == want
    numbered = api.read_records(spark, path, read).select("record_no", F.col("fields")[0]["value"].cast("int"))
    assert sorted(rows(numbered)) == [(k, k) for k, _ in want]
    two = [path, put("".join(f"{i};" + end for i in range(501, 701)), "b.csv")]
    once = dataclasses.replace(read, dialect=dataclasses.replace(d, comment_rows=(), header_repeat=False))
    assert sorted(r[0] for r in rows(api.read_delimited(spark, two, once))) == list(range(1, 701))


def test_headed_lines_are_split_and_errors_keep_their_number(spark, put, small_splits):
    """No file is one row, and a header read by the dialect is cut from its file, wherever splits lie."""
    read = ReadSpec(Dialect(";", header_rows=(2,)), multiline=False)
    path = put("a title\r\nk;v\r\n" + "".join(f"{i};x\r\n" for i in range(1, 901)) + "1;2;3\r\n")
    with pytest.raises(PySparkException, match="record 902 contains 1 more field"):
        api.read_delimited(spark, path, read).collect()
    df = api.read_delimited(spark, path, dataclasses.replace(read, options=Options(mode="permissive")))
    assert df.rdd.getNumPartitions() > 5 and df.count() == 901 and df.where("_error is null").count() == 900


def test_names_need_a_files_head_alone(spark, put, monkeypatch):
    def whole(*_):
        raise AssertionError("the whole file is read")

    path = put("k;v\r\n" + "1;x\r\n" * 50_000)
    with monkeypatch.context() as m:
        m.setattr(scan, "from_files", whole)
        for read in (SEMI, dataclasses.replace(SEMI, multiline=False)):
            assert scan.header_rows(spark, path, read) == ([["k", "v"]], 2)
        assert scan.first_raw(spark, path, SEMI) == "k;v"
    long = put('"' + "k" * 200_000 + '";v\r\n1;x\r\n', "long.csv")
    assert [len(n) for n in api.read_delimited(spark, long, SEMI).columns] == [200_000, 1]


@pytest.mark.parametrize("size", [50, 1000])
@pytest.mark.parametrize("d", [Dialect(";", "\n", escape="\\", double_quote=False), Dialect(";", "\r\n", escape="\\")])
def test_escaped_text_is_split(spark, put, size, d):
    """Escaped quotes do not count, and an escaped terminator ends no record, quoted or not."""
    t = d.line_terminator
    kinds = [f'"a\\"{t};\\\\"', f"x\\{t}y", '"\\\\\\";"', "\\;\\\"z", f'"{t}{t}\\{t}"', '"é"', f"\\{t[0]}\\\\", ""]
    path = put("k;v" + t + "".join(f"{i};{kinds[i % 8]}{t}" for i in range(160)))
    exact = sorted(rows(api.to_arrays(spark, path, ReadSpec(d, scan="exact"))))
    want = sorted(rows(api.read_delimited(spark, path, ReadSpec(d, scan="exact"))))
    old = [spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = api.read_delimited(spark, path, ReadSpec(d))
        assert df.rdd.getNumPartitions() > 2 and sorted(rows(df)) == want and len(want) == 160
        assert sorted(rows(api.to_arrays(spark, path, ReadSpec(d)))) == exact
        assert rows(api.count_records(spark, path, ReadSpec(d))) == [(160,)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("repeat", [True, False])
def test_tables_with_a_header_are_written_in_parts(spark, repeat):
    """No task gathers the table: each partition is a file, with the header or after a file of it."""
    from pathlib import Path

    from fieldstone.sources import encode

    d = Dialect(";", "\n", header_repeat=repeat)
    df = spark.range(1000).select("id", F.concat(F.lit("a;\n"), "id").alias("v")).repartition(7)
    path = encode.write_table(df, d)
    sizes = [f.stat().st_size for f in Path(path).glob("part-*")]
    assert len(sizes) == 7 and max(sizes) < sum(sizes) / 4
    for p in ("exact", "split"):
        read = ReadSpec(d, S.indexed(FieldSpec("long"), FieldSpec()), scan=p)
        assert sorted(rows(api.read_delimited(spark, path, read))) == sorted(rows(df))
    assert rows(api.count_records(spark, path, ReadSpec(d))) == [(1000,)]
    none = api.read_delimited(spark, encode.write_table(df.where("id < 0"), d), ReadSpec(d))
    assert none.columns == ["id", "v"] and none.count() == 0


def test_ragged_field_counts(spark, put):
    path = put("w;x;y;z\r\n125;foo;2025-12-25\r\n256;bar\r\n304;qrz;2025-04-01;10.25\r\n")
    df = api.read_records(spark, path, SEMI)
    assert [r[0] for r in df.select(F.size("fields")).collect()] == [3, 2, 4]
    assert [r["record_no"] for r in df.collect()] == [1, 2, 3]


def test_sinks(spark, put):
    path = put('a;b\r\n"x""y";2\r\n')
    assert rows(api.to_arrays(spark, path, SEMI)) == [(['x""y', "2"],)]
    assert rows(api.to_table(spark, path, ReadSpec(Dialect(";"), S.indexed(FieldSpec(), FieldSpec("int"))))) == [('x"y', "2")]
    assert rows(api.to_typed(spark, path, [FieldSpec(), FieldSpec("int")], SEMI)) == [('x""y', 2)]
    with pytest.raises(PySparkException, match="the type 1"):
        api.to_typed(spark, path, [FieldSpec()], SEMI).collect()
    with pytest.raises(PySparkException, match="'x\"\"y' as int in field field_0"):
        api.to_typed(spark, path, [FieldSpec("int"), FieldSpec()], SEMI).collect()
    assert api.first_record(spark, path, SEMI).first()[0] == "a;b"
    assert api.count_records(spark, path, SEMI).first()[0] == 1
    assert api.count_records(spark, path, dataclasses.replace(SEMI, options=Options(row_count_at_start=False))).first()[0] is None


def test_custom_detector(spark, put):
    path = put("a\r\nł", encoding="iso-8859-2")
    assert rows(api.read_delimited(spark, path, SEMI, detector=lambda head: ("iso-8859-2", 0))) == [("ł",)]


NDJSON = '﻿{"foo":123,"bar":true}\r\n\r\n { "bar" : "x\\"y" } \r\n{"bar":null,"foo":1.50}\r\n'


def test_ndjson(spark, put):
    path = put(NDJSON, "a.ndjson")
    assert rows(read_ndjson(spark, path, labels=["foo", "bar"])) == [("123", "true"), (None, 'x"y'), ("1.5", None)]  # numbers in JSON's own spelling
    raw = NdjsonSpec(raw=True)
    assert rows(read_ndjson(spark, path, raw, ["foo", "bar"])) == [("123", "true"), (None, 'x\\"y'), ("1.50", "null")]
    assert [r[0] for r in read_lines(spark, path, raw).select(F.map_keys("values")).collect()] == [["foo", "bar"], ["bar"], ["bar", "foo"]]
    typed = NdjsonSpec(S.named(FieldSpec("decimal", "foo", precision=(9, 2)), FieldSpec("string", "bar", sequences={"true": "yes"})))
    assert [str(r[0]) for r in read_ndjson(spark, path, typed).collect()] == ["123.00", "None", "1.50"]


@pytest.mark.parametrize("line", ["[1]", '{"a":1}x', '{"a"}', "text"])
def test_ndjson_malformed(spark, put, line):
    path = put(f'{{"a":1}}\n{line}\n', "b.ndjson")
    with pytest.raises(PySparkException, match="Not a JSON object"):
        read_lines(spark, path, NdjsonSpec(raw=True)).collect()
    assert read_lines(spark, path, NdjsonSpec(raw=True, mode="drop")).count() == 1
    assert [r["values"] is None for r in read_lines(spark, path, NdjsonSpec(raw=True, mode="permissive")).collect()] == [False, True]


def test_plan_prunes_and_stays_in_the_jvm(spark, put):
    d = Dialect("|", "\n", quote=None, header_rows=())
    df = api.read_delimited(spark, put("1|2|3\n"), ReadSpec(d, S.indexed(FieldSpec("int"), FieldSpec("int"), FieldSpec("int")), scan="native"), [1])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_0" not in plan.split("ReadSchema")[1] and "Arrow" not in plan
    assert scan.native_legal(ReadSpec(d))


def test_permissive_keeps_bad_records(spark, put):
    """Malformed and overlong records are rows of nulls that say why; typed values beside them still read."""
    d = Dialect(";", "\n")
    read = ReadSpec(d, S.indexed(FieldSpec("int"), FieldSpec()), options=Options(mode="permissive"))
    path = put('k;v\n1;a\n2;"b"x\n3;c;d\n4\n')
    for spec in (read, dataclasses.replace(read, multiline=False)):
        got = sorted(rows(api.read_delimited(spark, path, spec)), key=lambda r: str(r[0]))
        assert [r[:2] for r in got] == [(1, "a"), (4, ""), (None, None), (None, None)]
        assert [r[2] is None for r in got] == [True, True, False, False]
        assert any("1 more field than expected" in r[2] for r in got[2:])


def test_first_record_and_counts(spark, put):
    long = ReadSpec(Dialect(";", "\n", comment="#"), resource=S.Resource("utf-8"))
    body = "# note\n" + '"a\nb";c\n' + "x;z\n" * 500
    for read in (long, dataclasses.replace(long, resource=S.Resource())):
        assert api.first_record(spark, put(body), read).collect() == [('"a\nb";c',)]
        assert api.count_records(spark, put(body), read).first()[0] == 500
    only = '"' + "line\n" * 400 + '";z\n'
    assert api.first_record(spark, put(only), long).first()[0] == only[:-1]
    assert api.first_record(spark, put(""), long).count() == 0 and api.first_record(spark, put("# no\n"), long).count() == 0


def test_shared_folder_is_never_one_machines(spark, monkeypatch):
    from fieldstone.sources import storage

    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
