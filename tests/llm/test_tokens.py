import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fieldstone.llm import bitplanes, tokens
from fieldstone.llm.bitplanes import pack, read_token_files, unpack, write_token_files
from fieldstone.llm.common import new_path
from fieldstone.llm.token_counts import count_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> A B<|startoftext|>c", "it's don't 'S ab'c", "x́ ́y", "ǅ İ ß ẞ ΑΣ", "a1b2 12,34 5.6.", "", "  \n", "日本語 中文。", "\U0001f600 a\U0001f600", "ªº ⅷ Ⓐ", "\x00 a\x1cb", "a b"]


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("cache_words", [5, 400_000])
def test_words_encode_as_texts(library, documents, monkeypatch, cache_words):
    monkeypatch.setattr(tokens, "CACHE_WORDS", cache_words)
    texts = ODD + [d[1] for d in documents[:80] if d[1]]
    got = list(tokens._ByWord(WORDS).encode_many(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(library, t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_are_encoded_whole(name):
    assert type(tokens.encoder(public_tokenizers.path(name))) is tokens._Whole
    got = list(tokens.encoder(public_tokenizers.path(name)).encode_many(["Hello  there", ""]))
    assert len(got[0]) and not got[1]


def test_counts_match_library(spark, clashing, documents, library):
    got = count_tokens(clashing, WORDS, new_path(spark, "t")).collect()
    want = [(d[0], len((d[1] or "").encode()), n := len(ids(library, d[1])), n > 2048) for d in documents]
    assert Counter(map(tuple, got)) == Counter(want)


def test_warm_cache_encodes_nothing(spark, docs, monkeypatch):
    from fieldstone.llm import token_counts as tc

    encoded, fill = [], tc.fill_cache
    monkeypatch.setattr(tc, "fill_cache", lambda *a: encoded.append(fill(*a)) or encoded[-1])
    at = new_path(spark, "t")
    spark.conf.set(tc.CACHE_SETTING, at)
    try:
        got = [sorted(map(tuple, tc.op7_token_counts(spark, "/root/testdata/sf0.001").collect())) for _ in range(2)]
    finally:
        spark.conf.unset(tc.CACHE_SETTING)
    distinct = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(tc._content(tc.F.col("text"), WORDS)).distinct().count()
    assert encoded == [distinct, 0] and got[0] == got[1]
    count_tokens(docs, WORDS, at).count()
    assert encoded[2] < docs.select("text").distinct().count()  # only what the first table lacks


def test_cache_is_joined_and_appended(spark, docs, empty):
    at = new_path(spark, "t")
    some = docs.where("doc_id < 100")
    first = sorted(map(tuple, count_tokens(some, WORDS, at).collect()))
    stored = spark.read.parquet(at).count()
    assert sorted(map(tuple, count_tokens(some, WORDS, at).collect())) == first
    assert spark.read.parquet(at).count() == stored == some.select("text").distinct().count()
    count_tokens(docs, WORDS, at).count()
    assert spark.read.parquet(at).groupBy("digest").count().where("count > 1").isEmpty()
    assert count_tokens(empty, WORDS, new_path(spark, "t")).count() == 0


@pytest.mark.parametrize("plane_bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 1000])
def test_planes_round_trip(plane_bits, n):
    x = np.random.default_rng(n).integers(0, 2**32 if n % 2 else 50_000, n, dtype=np.uint32)
    blob = pack(x, 64, plane_bits)
    assert unpack(blob).tolist() == x.tolist()
    assert unpack(blob, n // 3, n // 2).tolist() == x[n // 3 : n // 2].tolist()


def test_files_match_library(spark, clashing, documents, library, empty):
    at = new_path(spark, "t")
    write_token_files(clashing, at, WORDS, file_ids=5_000, block=1_024)
    got = sorted(map(tuple, read_token_files(spark, at).collect()), key=lambda r: r[1])
    encoded = {}
    for d in documents:
        encoded.setdefault(d[0], []).append(np.array([*ids(library, d[1]), 1], dtype="<u4"))
    start = 0
    for doc_id, first, n, crc in got:
        one = encoded[doc_id].pop()
        assert (first, n, crc) == (start, len(one), zlib.crc32(one.tobytes()))
        start += n
    assert not any(encoded.values())
    assert [g[0] for g in got] == sorted((d[0] for d in documents), key=lambda i: (i is not None, i))
    write_token_files(empty, at + "e", WORDS)
    assert read_token_files(spark, at + "e").count() == 0


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    def count(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((0, 0, b.num_rows, [], [], b""), schema, strict=True)], schema=schema)

        return run

    schema = bitplanes._FILE_ARROW
    monkeypatch.setattr(bitplanes, "_pack_documents", count)
    at = new_path(spark, "few")
    write_token_files(spark.range(6_000).selectExpr("id AS doc_id", "'a' AS text"), at, WORDS)
    sizes = [r[0] for r in spark.read.parquet(at).select("n_ids").collect()]
    assert sum(sizes) == 6_000 and max(sizes) <= 1_000


def test_an_idle_worker_keeps_one_generation_of_words(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "GROUP_CHARS", 10)
    monkeypatch.setattr(bitplanes, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    encoder = tokens._ByWord(WORDS)
    monkeypatch.setattr(tokens, "encoder", lambda path: encoder)
    monkeypatch.setattr(bitplanes, "encoder", lambda path: encoder)
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["one two three four", "five six seven eight", "nine ten"])], names=["doc_id", "text"])
    files = list(bitplanes._pack_documents(WORDS, 1, 1 << 20, 1_024, 8)(iter([batch])))
    assert files[0].column("n_tokens")[0].as_py() == [1 + len(ids(encoder._model, t.as_py())) for t in batch.column("text")]
    assert encoder._young and not encoder._old
