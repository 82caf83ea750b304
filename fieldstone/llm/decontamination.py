"""Operator 1, benchmark decontamination: a positional inverted index in segments.

Documents are packed into segments of about a million words. A segment is one
stored row: for each of its terms the sorted positions at which it stands. The
index holds all terms of the documents and serves any number of test sets. Test
phrases go to every segment; there, the lists of a phrase's terms, shifted by
their offsets, are intersected from the rarest term on, all phrases at once.
Postings are never shuffled, and a frequent term's list stays split by segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.cells import loosen, pack, squeeze, words_of
from fieldstone.llm.common import TEXT_ROWS, batch_rows, store, table, workers_import

#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text stay; all others become spaces.
_WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Positions left free between two documents of a segment, so that no match spans both.
GAP = 64
#: Widest span of a proximity match, below GAP.
MAX_WITHIN = GAP - 1
SEGMENT_WORDS = 1_000_000
#: Words of the test items that go to all executors at once, about 60 bytes each; more go in further blocks.
BLOCK_WORDS = 500_000
#: Candidate places that are looked at together in a segment.
_SOME = 500_000

_INDEX_SCHEMA = "doc_ids array<long>, n_words array<long>, terms binary, sizes binary, positions binary"
_INDEX_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("sizes", pa.binary()), ("positions", pa.binary())])
_HIT_SCHEMA = "doc_id long, n_words long, hits binary, items array<string>, near array<string>"
_HIT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def _starts(n_words: np.ndarray) -> np.ndarray:
    """Where the documents of a segment begin."""
    return np.cumsum(n_words + GAP) - n_words - GAP


def _index_batches(segment_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def segment(docs: list[int | None], parts: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        n_words = np.array([len(x) for x in parts], dtype=np.int64)
        ids = np.concatenate(parts)
        places = np.arange(len(ids)) + np.repeat(_starts(n_words) - (np.cumsum(n_words) - n_words), n_words)
        order = np.argsort(ids, kind="stable")
        sizes = np.bincount(ids, minlength=len(names)).astype("<u4")
        steps = np.diff(places[order], prepend=0).astype("<i4")  # falls where the next term's list begins
        row = (docs, n_words, pack(b" ".join(names)), squeeze(sizes), squeeze(steps))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX_ARROW, strict=True)], schema=_INDEX_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        numbers: dict[bytes, int] = {}
        docs, parts, total = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                found = split_words(text.as_py())
                for w in set(found).difference(numbers):
                    numbers[w] = len(numbers)
                docs.append(doc_id)
                parts.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
                total += len(found) + GAP
                if total >= segment_words:
                    yield segment(docs, parts, list(numbers))
                    numbers, docs, parts, total = {}, [], [], 0
        if docs:
            yield segment(docs, parts, list(numbers))

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS, label: str = "postings") -> DataFrame:
    """Stored index segments of all terms of all documents; a document is never split over segments."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        return store(rows.mapInArrow(_index_batches(segment_words), _INDEX_SCHEMA).withColumn("segment", F.expr("uuid()")), label)


class Phrases:
    """Test windows of a block of items, as arrays of term numbers.

    Windows shorter than `window` repeat their first term at offset 0.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        terms: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[int]] = {}
        numbers: dict[str, int] = {}
        for item, text in items:
            ws = [terms.setdefault(w, len(terms)) for w in split_words(text)]
            k = numbers.setdefault(item, len(numbers))
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                seen.setdefault(tuple(ws[i : i + window]), set()).add(k)
        self.terms, self.items = list(terms), list(numbers)
        self.sizes = np.array([len(w) for w in seen], dtype=np.int64)
        self.windows = np.array([[*w, *[w[0]] * (window - len(w))] for w in seen], dtype=np.int32).reshape(len(seen), window)
        self.offsets = np.where(np.arange(window) < self.sizes[:, None], np.arange(window), 0).astype(np.int32)
        owners = [sorted(k) for k in seen.values()]
        self.owners = np.array([k for ks in owners for k in ks], dtype=np.int64)
        self.owned = np.concatenate([[0], np.cumsum([len(ks) for ks in owners], dtype=np.int64)])

    def pairs(self, docs: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) of window matches, each once, ascending."""
        n = self.owned[windows + 1] - self.owned[windows]
        at = np.repeat(self.owned[windows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        code = np.unique(np.repeat(docs, n) * max(1, len(self.items)) + self.owners[at])
        return list(zip((code // max(1, len(self.items))).tolist(), (code % max(1, len(self.items))).tolist(), strict=True))


def _ranges(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, place) of each place of the ranges [low, low + size)."""
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(owner))


class _Postings:
    """The lists of a segment's test terms, and which term stands at each position."""

    def __init__(self, ph: Phrases, seg: dict[str, pa.Scalar], length: int):
        sizes = loosen(seg["sizes"], "<u4").astype(np.int64)
        positions = np.cumsum(loosen(seg["positions"], "<i4"), dtype=np.int64)
        names = pa.array(words_of(seg["terms"])[: len(sizes)], pa.binary())
        number = pc.index_in(names, value_set=pa.array(ph.terms, pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(number, sizes)
        kept = of >= 0
        self.keys = np.sort((of[kept] << 32) | positions[kept])
        self.size = np.bincount(of[kept], minlength=len(ph.terms))
        self.low = np.cumsum(self.size) - self.size
        self.at = np.full(length + GAP, -1, dtype=np.int32)
        self.at[positions[kept]] = of[kept]

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into terms, position) of all postings of the terms."""
        owner, place = _ranges(self.low[terms], self.size[terms])
        return owner, self.keys[place] & 0xFFFFFFFF

    def next(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first posting of each term at or after its place; a very large number without one."""
        i = np.searchsorted(self.keys, (terms.astype(np.int64) << 32) | np.maximum(places, 0))
        found = self.keys[np.minimum(i, len(self.keys) - 1)]
        return np.where((i < len(self.keys)) & (found >> 32 == terms), found & 0xFFFFFFFF, 1 << 40)


def _parts(size: np.ndarray) -> Iterator[slice]:
    """Slices of about _SOME in sum, at least one element each."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _SOME, "right")))
        yield slice(at, end)
        at = end


def _exact(posts: _Postings, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all exact matches; terms of a window stand rarest first, with their offsets."""
    windows, starts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for part in _parts(posts.size[terms[:, 0]]):
        t, o = terms[part], offsets[part]
        w, at = posts.of(t[:, 0])
        at = at - o[w, 0]
        w, at = w[at >= 0], at[at >= 0]
        for j in range(1, terms.shape[1]):
            place = at + o[w, j]
            same = posts.at[np.minimum(place, len(posts.at) - 1)] == t[w, j]
            w, at = w[same], at[same]
        windows.append(w + part.start)
        starts.append(at)
    return np.concatenate(windows), np.concatenate(starts)


def _near(posts: _Postings, terms: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, anchor) where all of a window's terms stand in `within` consecutive positions, in any order.

    Anchors are postings of the rarest term. Windows that share their two
    rarest terms, as overlapping ones do, share the first step.
    """
    windows, anchors = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    if terms.shape[1] < 2:
        return windows[0], anchors[0]
    pairs, pair_of = np.unique(terms[:, :2], axis=0, return_inverse=True)
    by_pair = np.argsort(pair_of.ravel(), kind="stable")
    many = np.bincount(pair_of.ravel(), minlength=len(pairs))
    first = np.cumsum(many) - many
    reach = within - 1
    for part in _parts(posts.size[pairs[:, 0]]):
        k, at = posts.of(pairs[part, 0])
        beside = posts.next(pairs[part][k, 1], at - reach) <= at + reach
        k, at = k[beside] + part.start, at[beside]
        for some in _parts(many[k]):
            i, place = _ranges(first[k[some]], many[k[some]])
            w, a = by_pair[place], at[some][i]
            for j in range(2, terms.shape[1]):
                beside = posts.next(terms[w, j], a - reach) <= a + reach
                w, a = w[beside], a[beside]
            fits = np.zeros(len(w), dtype=bool)
            for back in range(within if len(w) else 0):  # a span that begins so far before the anchor
                begin = np.maximum(a - back, 0)
                fits |= np.all([posts.next(terms[w, j], begin) < a - back + within for j in range(terms.shape[1])], axis=0)
            windows.append(w[fits])
            anchors.append(a[fits])
    return np.concatenate(windows), np.concatenate(anchors)


def _search_segment(ph: Phrases, seg: dict[str, pa.Scalar], within: int) -> pa.RecordBatch:
    n_words = np.array(seg["n_words"].as_py(), dtype=np.int64)
    starts = _starts(n_words)
    length = int(starts[-1] + n_words[-1]) + 1
    posts = _Postings(ph, seg, length)
    whole = np.flatnonzero(posts.size[ph.windows].min(axis=1) > 0) if len(ph.windows) else np.empty(0, dtype=np.int64)
    terms = ph.windows[whole]
    order = np.argsort(posts.size[terms], axis=1, kind="stable")
    terms, offsets = np.take_along_axis(terms, order, axis=1), np.take_along_axis(ph.offsets[whole], order, axis=1)
    step = np.zeros(length + 1, dtype=np.int32)
    items, near = [[] for _ in n_words], [[] for _ in n_words]
    if len(whole):
        w, at = _exact(posts, terms, offsets)
        np.add.at(step, at, 1)
        np.add.at(step, at + ph.sizes[whole[w]], -1)
        for d, k in ph.pairs(np.searchsorted(starts, at, "right") - 1, whole[w]):
            items[d].append(ph.items[k])
        if within:
            w, at = _near(posts, terms, within) if terms.shape[1] > 1 else (w, at)
            for d, k in ph.pairs(np.searchsorted(starts, at, "right") - 1, whole[w]):
                near[d].append(ph.items[k])
    hit = np.cumsum(step) > 0
    cells = [hit[s : s + m] for s, m in zip(starts.tolist(), n_words.tolist(), strict=True)]
    columns = (seg["doc_ids"].as_py(), n_words, [np.packbits(c).tobytes() if c.any() else b"" for c in cells], items, near)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HIT_ARROW, strict=True)], schema=_HIT_ARROW)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """Items with an id and a text, in blocks of at most BLOCK_WORDS words (at least one item)."""
    rows, total = [], 0
    for r in items.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        n = len(split_words(r[1]))
        if rows and total + n > BLOCK_WORDS:
            yield rows
            rows, total = [], 0
        rows.append((r[0], r[1]))
        total += n
    yield rows


_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, n_near long"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("n_near", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits = [int(np.unpackbits(np.frombuffer(h.as_buffer(), dtype=np.uint8)).sum()) for h in b.column("hits")]
        items = [sorted(i) for i in b.column("items").to_pylist()]
        sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
        columns = (b.column("doc_id"), b.column("n_words"), hits, [len(i) for i in items], sha, [h > 0 for h in hits], items, [len(i) for i in b.column("near").to_pylist()])
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _RESULT_ARROW, strict=True)], schema=_RESULT_ARROW)


def search(index: DataFrame, phrases: Phrases, within: int = 0) -> DataFrame:
    """Phrase matches in every document: segment, row, hits (a bit per word), items, near (proximity items).

    `within`: the span, in words, in which all of a window's terms must stand,
    in any order, for a proximity match; 0 leaves proximity out.
    """
    if within > MAX_WITHIN:
        raise ValueError(f"within is at most {MAX_WITHIN}")
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = _search_segment(shared.value, {n: b.column(n)[i] for n in b.schema.names}, within)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("segment")[i].as_py()] * out.num_rows, pa.string()), pa.array(range(out.num_rows), pa.int64()), *out.columns], names=["segment", "row", *out.schema.names])

    return index.mapInArrow(run, "segment string, row long, " + _HIT_SCHEMA)


def search_items(index: DataFrame, items: DataFrame, window: int = 10, within: int = 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The result of `decontaminate` from a stored index; blocks of test items are joined by document."""
    parts = [search(index, Phrases(rows, window), within) for rows in _blocks(items, item_id, item_text)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) > 1:
        found = found.groupBy("segment", "row").applyInArrow(_merge, _HIT_SCHEMA)
    return found.mapInArrow(_digest, _RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, within: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, n_near.

    `items` lists the matching item ids sorted as strings; n_near counts the
    items of which some window's terms all stand within `within` words. The
    phrases are broadcast in blocks of BLOCK_WORDS test words, each over the
    whole index; `build_index` and `search_items` do the two steps apart, for
    several test sets over one index.

    A row of `docs` gives a row, repeated and null ids included; a null text has
    no words. Items with a null id or text, or without words, have no windows;
    repeated item ids count once. Other columns are not read.
    """
    workers_import(docs.sparkSession)
    return search_items(build_index(docs, id_col, text_col), items, window, within, item_id, item_text)


def _merge(key: tuple, part: pa.Table) -> pa.Table:
    """One document's hits of all blocks of test items."""
    n = part.column("n_words")[0].as_py()
    bits = np.zeros(-(-n // 8), dtype=np.uint8)
    for h in part.column("hits").to_pylist():
        if h:
            bits |= np.frombuffer(h, dtype=np.uint8)
    union = [sorted({x for xs in part.column(c).to_pylist() for x in xs}) for c in ("items", "near")]
    row = (part.column("doc_id")[0].as_py(), n, bits.tobytes(), *union)
    return pa.table([pa.array([x], f.type) for x, f in zip(row, _HIT_ARROW, strict=True)], schema=_HIT_ARROW)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and n_near, the items matched by proximity."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")
