"""Encoders over public tokenizer files, with a bounded cache per Python worker."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np

#: A-Z to a-z on UTF-8 bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Marks that the pre-tokenizer always splits from a letter or digit before them.
TAIL = b".,!?;:&$%#*"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Cached words of one generation of a worker's cache.
CACHE_WORDS = 400_000
#: Characters that are encoded at a time, and words to a line of plain ones.
GROUP_CHARS, LINE_WORDS = 200_000, 100


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer version: its file and the library that applies it."""
    import sentencepiece
    import tokenizers

    lib = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + lib.encode()).hexdigest()


class _Whole:
    """Encodes each text whole."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._ids = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self._model = model

    def encode_some(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self._ids(texts)]

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, a few texts at a time."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > GROUP_CHARS:
                yield from self.encode_some(some)
                some, size = [], 0
        yield from self.encode_some(some)


class _ByWord(_Whole):
    """For tokenizers that drop white space and never merge over it.

    The ids of a text are then those of its words in order, so each distinct
    word is encoded once per worker and cache. The cache has two generations:
    when the younger is full it becomes the older, and words in use move back.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        size = self._model.get_vocab_size(with_added_tokens=True)
        self._ends = np.array([(self._model.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: encoded in lines, parted at the ids that end a word."""
        out: list[bytes] = []
        for at in range(0, len(words), LINE_WORDS):
            some = words[at : at + LINE_WORDS]
            ids = np.array(self._ids([" ".join(some)])[0], dtype="<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(some):
                data = ids.tobytes()
                stops = (ends * 4).tolist()
                out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            else:  # a word that the library parts after all
                out += super().encode_some(some)
        return out

    def _learn(self, missing: set[bytes]) -> None:
        young, old, split, fresh = self._young, self._old, [], set()
        for c in missing:
            if (ids := old.get(c)) is not None:
                young[c] = ids
                continue
            stem = c.rstrip(TAIL)
            if stem and len(stem) < len(c) and stem[-1] in _ALNUM and b"<|" not in c:
                split.append((c, stem, c[len(stem) :]))
                fresh.update((stem, c[len(stem) :]))
            else:
                fresh.add(c)
        texts = [c.decode() for c in fresh if c not in young]
        letters, others = [t for t in texts if t.isalpha()], [t for t in texts if not t.isalpha()]
        for some, ids in ((letters, self._plain(letters)), (others, super().encode_some(others))):
            young.update(zip([t.encode() for t in some], ids, strict=True))
        for c, stem, tail in split:
            young[c] = young[stem] + young[tail]

    def encode_some(self, texts: list[str]) -> list[bytes]:
        chunks = []
        for t in texts:
            data = t.encode()
            chunks.append((data if b"<|" in data else data.translate(LOWER)).split())  # special strings keep their case
        if len(self._young) > CACHE_WORDS:
            self._young, self._old = {}, self._young
        flat = list(chain.from_iterable(chunks))
        found = list(map(self._young.get, flat))
        if None in found:
            holes = [i for i, ids in enumerate(found) if ids is None]
            self._learn({flat[i] for i in holes})
            for i in holes:
                found[i] = self._young[flat[i]]
        ends = list(accumulate(map(len, chunks)))
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _drops_space(path: str) -> bool:
    """Whether the file lower-cases, folds white space and removes it before the merges."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    first = pre[0] if pre else {}
    return norm == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and bool(first.get("invert")) and spec.get("post_processor") is None and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])


@lru_cache(maxsize=2)
def encoder(path: str):
    """The worker's encoder of a tokenizer file; kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _ByWord(path) if _drops_space(path) else _Whole(path)


def rest(path: str) -> None:
    """At a task's end: an idle worker keeps the younger generation of its cache alone."""
    model = encoder(path)
    if isinstance(model, _ByWord):
        model._old = {}


def space_free(path: str) -> bool:
    """True if runs of white space never change the ids."""
    return _drops_space(path)
