"""Operator 5, LM scoring: a Brown class-based bigram model over the whole vocabulary.

P(w | before) = mix * P(class(w) | class(before)) * P(w | class(w)) + (1 - mix) * P1(w)

Texts are packed into stored blocks of local word numbers. Words are dealt by
hash to buckets, and a block sends each bucket one packed row, so corpus-wide
counts cost a few bytes per block and distinct word, not a row per token, and a
frequent word is as cheap as a rare one. Exchange clustering classes the most
frequent words from their bigram counts; one distributed exchange step then
moves every other word to the class that its neighbours in all blocks speak
for. That is the start: in each sweep after it every word, of the core or not,
moves by all its neighbours, of the core or not. Counts and evidence are exact
sums, so scores depend on the documents alone, not on how they lie in partitions
and blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm import bitplanes
from fieldstone.llm.cells import loosen, pack, squeeze, unpack, words_of
from fieldstone.llm.common import batch_rows, crc_mod, drop_stored, new_path, parallelism, store, table, workers_import
from fieldstone.llm.tokens import LOWER

#: The end token: no word is empty.
END = b""


@dataclass(frozen=True)
class ClassParams:
    """core_words bounds the words of the driver's exchange clustering: their bigrams are core_words**2 counts at most.

    sweeps: passes over the whole vocabulary after it, while the likelihood of all class bigrams rises;
    without any, a word outside the core is classed by its neighbours in the core alone.
    bucket_words: pairs of block and distinct word that a bucket holds on average, at most.
    """

    classes: int = 24
    core_words: int = 1_000
    rounds: int = 8
    sweeps: int = 0
    mix: float = 0.9
    smoothing: float = 0.5
    block_tokens: int = 1_200_000
    bucket_words: int = 250_000


_BLOCK_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, order binary, counts binary, n_words long"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("order", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64())])
_DEALT_SCHEMA = "bucket int, block long, words binary, counts binary"
_TOP = pa.list_(pa.struct([("word", pa.binary()), ("id", pa.int32()), ("n", pa.int64())]))
#: A row for each bucket and block, and one with block -1 for the bucket itself.
_COUNTED_SCHEMA = "bucket int, block long, ids binary, totals binary, top array<struct<word:binary,id:int,n:long>>, n_new long, n_train long"
_COUNTED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("totals", pa.binary()), ("top", _TOP), ("n_new", pa.int64()), ("n_train", pa.int64())])
_EVIDENCE_SCHEMA = "bucket int, block long, many binary, cells binary, times binary"
_VERDICT_SCHEMA = "bucket int, block long, totals binary, classes binary"
_SWEPT_SCHEMA = "bucket int, block long, classes binary"


def _row(schema: pa.Schema, values: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))


def _block_batches(block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks: tokens by local word number; words and their training counts in the order of the words' hashes.

    order[i] is the local number of the i-th word of that order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # blocks are large: what is freed goes back at once
        numbers: dict[bytes, int] = {}
        docs, held, parts, total, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(p) for p in parts], dtype="<i4")
            tokens = np.concatenate(parts)
            train = tokens[np.repeat(~np.array(held, dtype=bool), sizes)]
            words = list(numbers)
            order = np.argsort(_hashes(words), kind="stable").astype("<i4")
            counts = np.bincount(train, minlength=len(words)).astype("<i4")[order]
            name = (TaskContext.get().partitionId() << 12) + seq
            return _row(_BLOCK_ARROW, (name, docs, held, pack(sizes.tobytes()), bitplanes.pack(tokens), pack(b" ".join([words[i] for i in order.tolist()])), squeeze(order), squeeze(counts), len(words)))

        for b in batches:
            for doc_id, out, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text"), strict=True):
                words = (text.as_py() or "").encode().translate(LOWER).split()
                words.append(END)
                for w in set(words).difference(numbers):
                    numbers[w] = len(numbers)
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                docs.append(doc_id)
                held.append(out)
                total += len(words)
                if total >= block_tokens:
                    yield flush()
                    numbers, docs, held, parts, total, seq = {}, [], [], [], 0, seq + 1
        if docs:
            yield flush()

    return run


def _ints(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(unpack(cell), dtype="<i4")


def _tokens(block: dict[str, pa.Scalar]) -> np.ndarray:
    return bitplanes.unpack(block["tokens"].as_buffer().to_pybytes()).view("<i4")


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    pa.set_memory_pool(pa.system_memory_pool())
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(n)[i] for n in b.schema.names}


def _bounds(words: list[bytes], buckets: int) -> np.ndarray:
    """Where each bucket's words begin in a list in the order of hashes, and its end."""
    of = (_hashes(words).astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1))


def _dealt(block: pa.Scalar, at: np.ndarray, columns: dict[str, Callable[[int, int], bytes]]) -> pa.RecordBatch:
    """A row for each bucket that has words of the block."""
    live = np.flatnonzero(at[1:] > at[:-1])
    spans = [(int(at[k]), int(at[k + 1])) for k in live]
    cells = [pa.array([f(lo, hi) for lo, hi in spans], pa.binary()) for f in columns.values()]
    return pa.record_batch([pa.array(live, pa.int32()), pa.array([block.as_py()] * len(live), pa.int64()), *cells], names=["bucket", "block", *columns])


def _deal(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches):
            words, counts = words_of(block["words"]), loosen(block["counts"], "<i4")
            some = {"words": lambda lo, hi, w=words: pack(b" ".join(w[lo:hi])), "counts": lambda lo, hi, c=counts: squeeze(c[lo:hi])}
            yield _dealt(block["block"], _bounds(words, buckets), some)

    return run


def _count_words(most: int) -> Callable[[pa.Table], pa.Table]:
    """One bucket: its words get numbers and corpus counts, which every block gets back in the order it sent them."""

    def run(part: pa.Table) -> pa.Table:
        blocks = part.column("block").to_pylist()
        sent = [words_of(w) for w in part.column("words")]
        n = [loosen(c, "<i4") for c in part.column("counts")]
        found = pa.concat_arrays([pa.array(w, pa.binary()) for w in sent]).dictionary_encode()
        vocabulary = found.dictionary.to_pylist()
        rank = np.empty(len(vocabulary), dtype=np.int32)
        rank[np.argsort(_hashes(vocabulary), kind="stable")] = np.arange(len(vocabulary), dtype=np.int32)
        ids = rank[found.indices.to_numpy()]
        totals = np.bincount(ids, weights=np.concatenate(n), minlength=len(vocabulary)).astype("<i8")
        ends = np.cumsum([len(x) for x in n])
        shares = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        by_word = totals[rank]  # in the order of `vocabulary`
        least = max(1, int(np.partition(by_word, -most)[-most])) if len(by_word) > most else 1
        candidates = np.flatnonzero((by_word >= least) | (found.dictionary.to_numpy(zero_copy_only=False) == END) & (by_word > 0)).tolist()
        at = sorted(candidates, key=lambda i: (vocabulary[i] != END, -by_word[i], vocabulary[i]))[: most + 1]
        top = [{"word": vocabulary[i], "id": int(rank[i]), "n": int(by_word[i])} for i in at]
        bucket = part.column("bucket")[0].as_py()
        rows = [(bucket, b, squeeze(np.diff(x, prepend=0).astype("<i4")), squeeze(totals[x]), None, None, None) for b, x in zip(blocks, shares, strict=True)]
        rows.append((bucket, -1, None, None, top, int((totals > 0).sum()), int(totals.sum())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTED_ARROW, strict=True)], schema=_COUNTED_ARROW)

    return run


def _previous(tokens: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; before a document's first stands the end token of the last."""
    return np.concatenate([[end], tokens[:-1]])


def _training(block: dict[str, pa.Scalar]) -> np.ndarray:
    sizes, held = _ints(block["sizes"]), np.array(block["held"].as_py(), dtype=bool)
    return _tokens(block)[np.repeat(~held, sizes)]


def _numbers(words: list[bytes], order: np.ndarray, core: list[bytes]) -> np.ndarray:
    """The core's number of each local word, or -1."""
    found = pc.index_in(pa.array(words, pa.binary()), value_set=pa.array(core, pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.empty(len(words), dtype=np.int32)
    out[order] = found
    return out


def _core_pairs(core: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(core)
        for block in _blocks_of(batches):
            t = _numbers(words_of(block["words"]), loosen(block["order"], "<i4"), core)[_training(block)].astype(np.int64)
            before = _previous(t, 0)
            both = (t >= 0) & (before >= 0)
            n = np.bincount(before[both] * k + t[both], minlength=0)
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int, rounds: int, fixed: int) -> np.ndarray:
    """Classes of words 0..n-1 by the exchange algorithm; pairs[i, j] counts j after i.

    Word `fixed` keeps class 0 to itself. Each word in turn moves to the class of
    the largest class-bigram likelihood until a round moves none. Ties fall to
    the lowest class, so the result depends on the counts alone.
    """
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    cls = 1 + np.arange(n) % max(1, classes - 1)
    cls[fixed] = 0
    one = np.eye(classes)[cls]
    table_ = one.T @ pairs @ one
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            if w == fixed or classes < 3:
                continue
            k = cls[w]
            left = np.bincount(cls, weights=pairs[:, w], minlength=classes)
            right = np.bincount(cls, weights=pairs[w], minlength=classes)
            own = pairs[w, w]
            left[k] -= own
            right[k] -= own
            table_[:, k] -= left
            table_[k] -= right
            table_[k, k] -= own
            grown = _xlogx(table_ + left[:, None]) - _xlogx(table_)
            wide = _xlogx(table_ + right[None, :]) - _xlogx(table_)
            diag = np.diag(table_)
            gain = grown.sum(axis=0) - np.diag(grown) + wide.sum(axis=1) - np.diag(wide) + _xlogx(diag + left + right + own) - _xlogx(diag)
            rows, cols = table_.sum(axis=1), table_.sum(axis=0)
            # adding w also lengthens other rows by `left` and columns by `right`, alike for all classes
            after_rows = _xlogx(rows + left + right.sum() + own) - _xlogx(rows + left)
            after_cols = _xlogx(cols + right + left.sum() + own) - _xlogx(cols + right)
            gain -= after_rows + after_cols
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            table_[:, best] += left
            table_[best] += right
            table_[best, best] += own
            moved += best != k
            cls[w] = best
        if not moved:
            break
    return cls


#: Cells of a block that are counted in one array.
_CELLS = 8_000_000


def _neighbours(t: np.ndarray, judged: np.ndarray, k: np.ndarray, place: np.ndarray, classes: int) -> dict[str, Callable[[int, int], bytes]]:
    """How often each class stands left (cell c) and right (classes + c) of the judged tokens' words.

    k: the tokens' classes, -1 for none, between the block's borders. many: cells
    of each word, in the order in which the block sent its words.
    """
    wide, found = 2 * classes, []
    for shift, near in ((0, k[:-2]), (classes, k[2:])):
        use = np.flatnonzero(judged & (near >= 0))
        found.append(place[t[use]] * wide + shift + near[use])
    cell = np.concatenate(found)
    if len(place) * wide <= _CELLS:
        n = np.bincount(cell, minlength=1)
        cell = np.flatnonzero(n)
        times = n[cell]
    else:
        cell, times = np.unique(cell, return_counts=True)
    many = np.bincount(cell // wide, minlength=len(place)).astype(np.uint8)
    begin = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
    cells, times = (cell % wide).astype(np.uint8), times.astype("<i4")
    return {
        "many": lambda lo, hi: pack(many[lo:hi].tobytes()),
        "cells": lambda lo, hi: pack(cells[begin[lo] : begin[hi]].tobytes()),
        "times": lambda lo, hi: squeeze(times[begin[lo] : begin[hi]]),
    }


def _places(order: np.ndarray) -> np.ndarray:
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place


def _evidence(core: list[bytes], cls: np.ndarray, classes: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The core's classes beside a block's other words, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches):
            words, order = words_of(block["words"]), loosen(block["order"], "<i4")
            own = np.append(cls, -1).astype(np.int8)[_numbers(words, order, core)]
            t = _training(block)
            k = np.concatenate([[0], own[t], [0]])  # a block's border is a document's: the end token's class
            yield _dealt(block["block"], _bounds(words, buckets), _neighbours(t, k[1:-1] < 0, k, _places(order), classes))

    return run


def _all_evidence(classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The classes of all neighbours of all words of a classed block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches):
            own, t = np.frombuffer(unpack(block["classes"]), dtype=np.uint8), _training(block)
            k = np.concatenate([[0], own[t], [0]])
            yield _dealt(block["block"], np.array(block["bounds"].as_py()), _neighbours(t, np.True_, k, _places(loosen(block["order"], "<i4")), classes))

    return run


def _judge(weights: np.ndarray, fixed: dict[int, list[tuple[int, int]]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One bucket: each word's class by the evidence of all blocks, back to the blocks with its corpus count if that is given.

    weights[cell, class] are whole numbers, so sums are exact in any order; of
    equal sums the lowest class wins, and a word without evidence gets class 1.
    fixed: words that do not move (id, class) by bucket.
    """

    def run(counted: pa.Table, evidence: pa.Table) -> pa.Table:
        wide, classes = weights.shape
        sent = {b: np.cumsum(loosen(x, "<i4")) for b, x in zip(counted.column("block").to_pylist(), counted.column("ids"), strict=True)}
        size = 1 + max((int(x[-1]) for x in sent.values()), default=-1)
        at, times = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype="<i4")]
        for b, many, cells, n in zip(*(evidence.column(c) for c in ("block", "many", "cells", "times")), strict=True):
            word = np.repeat(sent[b.as_py()], np.frombuffer(unpack(many), dtype=np.uint8)).astype(np.int64)
            at.append(word * wide + np.frombuffer(unpack(cells), dtype=np.uint8))
            times.append(loosen(n, "<i4"))
        seen = np.bincount(np.concatenate(at), weights=np.concatenate(times), minlength=size * wide)
        own = np.ones(size, dtype=np.uint8)
        for lo in range(0, size, _SOME):
            score = seen[lo * wide : (lo + _SOME) * wide].reshape(-1, wide) @ weights
            if classes > 1:
                own[lo : lo + _SOME] = 1 + score[:, 1:].argmax(axis=1)
        bucket = counted.column("bucket")[0].as_py() if counted.num_rows else -1
        for i, c in fixed.get(bucket, ()):
            own[i] = c
        return counted.drop_columns(["ids"]).append_column("classes", pa.array([pack(own[x].tobytes()) for x in sent.values()], pa.binary()))

    return run


#: Words that are scored at a time.
_SOME = 50_000

#: bounds: where each bucket's words begin in `order`, and its end.
_CLASSED_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, order binary, bounds array<long>, counts binary, classes binary, moves array<long>"
_CLASSED_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("order", pa.binary()), ("bounds", pa.list_(pa.int64())), ("counts", pa.binary()), ("classes", pa.binary()), ("moves", pa.list_(pa.int64()))])


def _classed(classes: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with corpus counts and classes of their words, by local number; moves: class bigrams of the training part.

    Counts are the shares' totals, or those that the block has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches):
            shares = block["shares"].values
            order = loosen(block["order"], "<i4")
            parts = [np.frombuffer(unpack(x), dtype=np.uint8) for x in shares.field("classes")]
            many = np.zeros(buckets + 1, dtype=np.int64)
            many[shares.field("bucket").to_numpy() + 1] = [len(x) for x in parts]
            own = np.empty(len(order), dtype=np.uint8)
            own[order] = np.concatenate(parts)
            if "counts" in block:
                counts = loosen(block["counts"], "<i8")
            else:
                counts = np.empty(len(order), dtype="<i8")
                counts[order] = np.concatenate([loosen(x, "<i8") for x in shares.field("totals")])
            own[counts == 0] = classes
            k = own[_training(block)].astype(np.int64)
            moves = np.bincount(_previous(k, 0) * classes + k, minlength=classes * classes)
            same = [block[c].as_py() for c in ("block", "doc_ids", "held", "sizes", "tokens", "order")]
            yield _row(_CLASSED_ARROW, (*same, np.cumsum(many), squeeze(counts), pack(own.tobytes()), moves))

    return run


def _store_classed(blocks: DataFrame, verdicts: DataFrame, classes: int, buckets: int) -> tuple[DataFrame, str, np.ndarray]:
    """The blocks with their words' classes, where they are stored, and the class bigrams of all."""
    spark = blocks.sparkSession
    at = new_path(spark, "lm-classed")
    parts = [c for c in verdicts.columns if c != "block"]
    shares = verdicts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("shares"))
    classed = store(blocks.join(shares, "block").mapInArrow(_classed(classes, buckets), _CLASSED_SCHEMA), "lm-classed", at)
    moves = np.zeros(classes * classes, dtype=np.int64)
    for r in classed.select(F.posexplode("moves").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        moves[r["at"]] = r["n"]
    return classed, at, moves.reshape(classes, classes)


def class_weights(between: np.ndarray) -> np.ndarray:
    """Log of a class given its left, and its right, neighbour's class: weights[cell, class] in 2 ** -16."""
    given = np.log(between / between.sum(axis=1, keepdims=True) / (between.sum(axis=0) / between.sum()))
    return np.rint(np.vstack([given, given.T]) * 65_536)


def class_likelihood(moves: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what no class changes."""
    n = moves.astype(np.float64)
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=0)).sum() - _xlogx(n.sum(axis=1)).sum())


@dataclass
class ClassModel:
    n: int
    distinct: int
    moves: np.ndarray
    p: ClassParams

    def __post_init__(self) -> None:
        c, a = self.p.classes, self.p.smoothing
        totals = self.moves.sum(axis=0).astype(np.float64)
        live = totals > 0  # classes without words get no probability
        rows = (self.moves + a * live) / np.maximum(self.moves.sum(axis=1, keepdims=True) + a * live.sum(), 1e-300)
        self.transition = np.vstack([rows, totals / max(1.0, totals.sum())])  # the last row: after an unknown word
        self.class_total = np.append(np.maximum(totals, 1.0), 1.0)
        self.transition = np.hstack([self.transition, np.zeros((c + 1, 1))])

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.n + self.distinct + 1.0)

    def probability(self, counts: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        base = self.base(counts)
        if not self.n:
            return base
        return self.p.mix * self.transition[before, own] * counts / self.class_total[own] + (1 - self.p.mix) * base


_SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = model.value
        for block in _blocks_of(batches):
            sizes, tokens = _ints(block["sizes"]).astype(np.int64), _tokens(block)
            counts = loosen(block["counts"], "<i8")
            own = np.frombuffer(unpack(block["classes"]), dtype=np.uint8)
            base = np.log10(m.base(counts))
            docs, n_known, base_score, score = block["doc_ids"].as_py(), [], [], []
            at = 0
            for n in sizes.tolist():  # documents one at a time: few megabytes at once
                t = tokens[at : at + n]
                k = own[t].astype(np.int64)
                n_known.append(int((counts[t] > 0).sum()))
                base_score.append(float(base[t].sum()))
                score.append(float(np.log10(m.probability(counts[t].astype(np.float64), _previous(k, 0), k)).sum()))
                at += n
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(block["held"].as_py(), pa.bool_()), pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base_score, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, folds: int = 7, held_fold: int = 2, p: ClassParams = ClassParams(sweeps=3), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Rows with crc32(doc_id) mod folds = held_fold are scored but not counted.
    base_score is the add-one unigram log10 probability, score the class
    model's; perplexity is 10 ** (-score / n_tokens). Every training word has a
    count and a class, which in each of the sweeps all its neighbours in training
    decide; a word training lacks has base probability only and
    leaves the next word the plain class shares. A null text is empty: its end
    token alone. Repeated and null ids keep their own rows; an empty table gives
    none; without training rows score equals base_score. Other columns are not
    read. What crosses the network is some bytes per block and distinct word, in
    a row per block and bucket; a word is one entry a block whatever its
    frequency, so no bucket is hot. The driver holds the core's bigrams and the
    class bigrams.
    """
    spark = docs.sparkSession
    workers_import(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", crc_mod(F.col("doc_id"), folds) == held_fold)
    blocks_at, counted_at = new_path(spark, "lm-blocks"), new_path(spark, "lm-counted")
    with batch_rows(spark, 1_000):
        blocks = store(rows.mapInArrow(_block_batches(p.block_tokens), _BLOCK_SCHEMA), "lm-blocks", blocks_at)
    buckets = max(parallelism(spark), (blocks.agg(F.sum("n_words")).first()[0] or 0) // p.bucket_words + 1)
    dealt = blocks.select("block", "words", "counts").mapInArrow(_deal(buckets), _DEALT_SCHEMA)
    counted = store(dealt.groupBy("bucket").applyInArrow(_count_words(p.core_words), _COUNTED_SCHEMA), "lm-counted", counted_at)
    about = counted.where("block = -1")
    totals = about.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_new"), F.lit(0)).alias("v")).first()
    ranked = about.select("bucket", F.explode("top").alias("w")).select("bucket", "w.*").orderBy(F.col("word") != F.lit(END), F.desc("n"), "word")
    top = ranked.limit(p.core_words).collect()  # the end token first, where it was seen
    core = [END, *(bytes(r["word"]) for r in top if r["word"])]
    found = blocks.select("words", "order", "tokens", "sizes", "held").mapInArrow(_core_pairs(core), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(len(core) ** 2, dtype=np.int64)
    pairs[found["pair"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    pairs = pairs.reshape(len(core), len(core))
    cls = exchange(pairs, p.classes, p.rounds, 0)
    class_of = dict(zip(core, cls.tolist(), strict=True))
    fixed: dict[int, list[tuple[int, int]]] = {}
    for r in top:
        fixed.setdefault(r["bucket"], []).append((r["id"], class_of[bytes(r["word"])]))
    one = np.eye(p.classes)[cls]
    weights = class_weights(one.T @ pairs @ one + p.smoothing)
    evidence = blocks.select("block", "words", "order", "tokens", "sizes", "held").mapInArrow(_evidence(core, cls, p.classes, buckets), _EVIDENCE_SCHEMA)
    sent = counted.where("block >= 0").select("bucket", "block", "ids", "totals")
    verdicts = sent.groupBy("bucket").cogroup(evidence.groupBy("bucket")).applyInArrow(_judge(weights, fixed), _VERDICT_SCHEMA)
    classed, classed_at, moves = _store_classed(blocks.select("block", "doc_ids", "held", "sizes", "tokens", "order"), verdicts, p.classes, buckets)
    drop_stored(spark, blocks_at)
    end = {r["bucket"]: [(r["id"], 0)] for r in top if not r["word"]}
    for _ in range(p.sweeps if totals["n"] else 0):
        evidence = classed.select("block", "bounds", "order", "tokens", "sizes", "held", "classes").mapInArrow(_all_evidence(p.classes), _EVIDENCE_SCHEMA)
        verdicts = sent.drop("totals").groupBy("bucket").cogroup(evidence.groupBy("bucket")).applyInArrow(_judge(class_weights(moves + p.smoothing), end), _SWEPT_SCHEMA)
        swept, swept_at, after = _store_classed(classed.drop("bounds", "classes", "moves"), verdicts, p.classes, buckets)
        if class_likelihood(after) <= class_likelihood(moves):
            drop_stored(spark, swept_at)
            break
        drop_stored(spark, classed_at)
        classed, classed_at, moves = swept, swept_at, after
    drop_stored(spark, counted_at)
    model = spark.sparkContext.broadcast(ClassModel(totals["n"], totals["v"], moves, p))
    out = classed.select("doc_ids", "held", "sizes", "tokens", "counts", "classes").mapInArrow(_scores(model), _SCORE_SCHEMA)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
