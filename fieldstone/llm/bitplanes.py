"""Operator 9, token-ID output: bit- or byte-plane files of id blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldstone.llm.common import TEXT_ROWS, batch_rows, new_path, parallelism, table, workers_import
from fieldstone.llm.tokens import encoder, rest

MAGIC = b"FSBP"
#: magic, version, bits of a plane (1 or 8), ids of a block, ids in all, blocks
_HEAD = struct.Struct("<4sBBIQI")
#: offset and length of a plane; length 0: all zero
_PLANE = struct.Struct("<QI")


def pack(ids: np.ndarray, block: int = 65_536, plane_bits: int = 8, level: int = 3) -> bytes:
    """One file: header, index of every block's planes, then the compressed planes.

    Blocks have `block` ids (the last may have fewer). Plane k of a block holds
    byte k (plane_bits 8) or bit k (plane_bits 1) of each of its 32-bit ids.
    """
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n_planes, zstd = 32 // plane_bits, zstandard.ZstdCompressor(level=level)
    n_blocks = -(-len(ids) // block)
    index, body, at = [], [], _HEAD.size + n_blocks * n_planes * _PLANE.size
    for b in range(n_blocks):
        part = ids[b * block : (b + 1) * block]
        top = int(part.max())
        for k in range(n_planes):
            data = b""
            if top >> (k * plane_bits):
                plane = part.view(np.uint8).reshape(-1, 4)[:, k] if plane_bits == 8 else np.packbits((part >> np.uint32(k)).astype(np.uint8) & 1)
                data = zstd.compress(np.ascontiguousarray(plane).tobytes())
            index.append(_PLANE.pack(at, len(data)))
            body.append(data)
            at += len(data)
    return b"".join([_HEAD.pack(MAGIC, 1, plane_bits, block, len(ids), n_blocks), *index, *body])


def unpack(blob: bytes, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [first, stop) of a file; only the blocks that hold them are decompressed."""
    magic, version, plane_bits, block, n, n_blocks = _HEAD.unpack_from(blob)
    if magic != MAGIC or version != 1:
        raise ValueError("not a bit-plane file")
    stop = n if stop is None else min(stop, n)
    if first >= stop:
        return np.empty(0, dtype="<u4")
    n_planes, zstd, out = 32 // plane_bits, zstandard.ZstdDecompressor(), []
    for b in range(first // block, min(n_blocks, -(-stop // block))):
        size = min(block, n - b * block)
        part = np.zeros(size, dtype="<u4")
        for k in range(n_planes):
            at, length = _PLANE.unpack_from(blob, _HEAD.size + (b * n_planes + k) * _PLANE.size)
            if length:
                data = np.frombuffer(zstd.decompress(blob[at : at + length]), dtype=np.uint8)
                if plane_bits == 8:
                    part.view(np.uint8).reshape(-1, 4)[:, k] = data
                else:
                    part |= np.unpackbits(data, count=size).astype("<u4") << np.uint32(k)
        out.append(part)
    start = first // block * block
    return np.concatenate(out)[first - start : stop - start]


_FILE_SCHEMA = "shard int, seq int, n_ids long, doc_ids array<long>, n_tokens array<long>, data binary"
_FILE_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("data", pa.binary())])
_DOC_SCHEMA = "shard int, seq int, at long, doc_id long, n_tokens long, ids_crc32 long"
_DOC_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _pack_documents(path: str, end_id: int, file_ids: int, block: int, plane_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # what is freed goes back at once
        encode, end = encoder(path).encode_many, struct.pack("<I", end_id)
        shard, seq = TaskContext.get().partitionId(), 0
        docs, sizes, parts, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = pack(np.frombuffer(b"".join(parts), dtype="<u4"), block, plane_bits)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, seq, total, docs, sizes, data), _FILE_ARROW, strict=True)], schema=_FILE_ARROW)

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(t.as_py() for t in b.column("text")), strict=True):
                ids += end
                parts.append(ids)
                docs.append(doc_id)
                sizes.append(len(ids) // 4)
                total += sizes[-1]
                if total >= file_ids:
                    yield flush()
                    docs, sizes, parts, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()
        rest(path)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 20, block: int = 65_536, plane_bits: int = 8) -> DataFrame:
    """Encode every text and write plane files in ascending doc_id order to `path`.

    The container is a Parquet folder in the shared store, so Spark's commit
    protocol covers lost executors and any file system. Each row is one
    self-contained file (see `pack`) of whole documents: shard and seq give its
    place in the global order, doc_ids and n_tokens its documents. A file closes
    at `file_ids` ids; a longer document has its own.

    Order: doc_id, null first, then the text's hash and the text; rows that tie
    in all are alike. Range partitions split a repeated id by that hash. A null
    text is empty (its end id alone); other columns are not read.
    """
    spark = docs.sparkSession
    workers_import(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.xxhash64("text")
    rows = rows.repartitionByRange(parallelism(spark), "doc_id", key).sortWithinPartitions("doc_id", key, "text")
    with batch_rows(spark, TEXT_ROWS):
        rows.mapInArrow(_pack_documents(tokenizer, end_id, file_ids, block, plane_bits), _FILE_SCHEMA).write.parquet(path)
    return spark.read.schema(_FILE_SCHEMA).parquet(path)


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            shard, seq, docs, sizes = (b.column(k)[i].as_py() for k in ("shard", "seq", "doc_ids", "n_tokens"))
            data = memoryview(unpack(b.column("data")[i].as_buffer().to_pybytes()).tobytes())
            ends = np.cumsum(sizes)
            starts = ends - sizes
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], schema=_DOC_ARROW)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token-file folder: doc_id, start, n_tokens, ids_crc32.

    Files are decoded where they lie. `start` adds a file's offset, from the
    file index alone: running sums within each shard, then over shard totals
    (one row per shard).
    """
    workers_import(spark)
    files = spark.read.schema(_FILE_SCHEMA).parquet(path)
    sums = files.select("shard", "seq", "n_ids")
    shards = sums.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    within = sums.select("shard", "seq", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")).alias("before"))
    base = within.join(shards, "shard").select("shard", "seq", (F.col("base") + F.col("before")).alias("base"))
    docs = files.mapInArrow(_read_documents, _DOC_SCHEMA)
    return docs.join(base, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    path = new_path(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
