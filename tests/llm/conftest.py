import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest test table, with nulls, blanks, repeats and ties added."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = [
        (10_000, None, None, None, None),
        (10_001, "", "en", "", 0),
        (10_002, " \t\n\x0b ", "en", None, 5),
        (None, "no id here", "en", "src0", 10),
        (10_003, rows[0][1], "en", "src1", 1),
        (10_003, rows[0][1], "en", "src1", 1),
        (10_004, "word " * 60_000 + rows[1][1], "en", "src2", 1),
        (10_005, "Aé <|endoftext|> B́  \U0001f600 x@y.zz 10.0.0.1", "en", "\U0001f600", 1),
    ]
    return rows + odd


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(1).alias(c) for c in ("fp", "digest", "content", "size", "h", "bin", "trusted", "word", "block", "line", "draw", "pattern", "score", "kept", "shard", "terms", "pos")])
