"""Bytes to text: decompression, byte-order marks, declared encodings."""

from __future__ import annotations

import codecs
import gzip
import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

Decompressor = Callable[[bytes], bytes]

#: Byte-order marks, longest first, so that UTF-32LE goes before UTF-16LE.
BOMS = (
    (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF32_LE, "utf-32-le"),
    (codecs.BOM_UTF8, "utf-8"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"),
)
#: Names of the compressions and their other names.
_ALIASES = {"gz": "gzip", "gzip": "gzip", "deflate": "deflate", "zz": "deflate", "def": "deflate", "zip": "zip", "zipfile": "zip"}


def _inflate(data: bytes) -> bytes:
    """Raw deflate, without a zlib header."""
    return zlib.decompress(data, -15)


def _first_entry(data: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if not z.namelist():
            raise ValueError("the zip archive is empty")
        return z.read(z.namelist()[0])


def _key(name: str) -> str:
    return name.lower().lstrip(".")


class Decompressors:
    """Named functions from bytes to bytes, with aliases."""

    def __init__(self) -> None:
        self._by_name: dict[str, Decompressor] = {"gzip": gzip.decompress, "deflate": _inflate, "zip": _first_entry}
        self._aliases = dict(_ALIASES)

    def add_or_replace(self, name: str, function: Decompressor) -> None:
        self._by_name[_key(name)] = function
        self._aliases[_key(name)] = _key(name)

    def add_alias(self, alias: str, name: str) -> None:
        self._aliases[_key(alias)] = self.compression(name)

    def clear(self) -> None:
        self._by_name.clear()
        self._aliases.clear()

    def compression(self, key: str) -> str:
        if _key(key) not in self._aliases:
            raise KeyError(f"no decompressor for {key!r}; known: {', '.join(self.keys())}")
        return self._aliases[_key(key)]

    def get(self, key: str) -> Decompressor:
        return self._by_name[self.compression(key)]

    def keys(self) -> list[str]:
        return sorted(self._aliases)

    def compressions(self) -> list[str]:
        return sorted(self._by_name)


DECOMPRESSORS = Decompressors()


def detect(head: bytes) -> tuple[str, int]:
    """(encoding, length of its mark) of the first bytes; without a mark UTF-8."""
    for bom, name in BOMS:
        if head.startswith(bom):
            return name, len(bom)
    return "utf-8", 0


def text_of(data: bytes, encoding: str | None, decompress: Decompressor | None, detector: Callable[[bytes], tuple[str, int]] = detect) -> str:
    """The text of a file; a mark of the declared or detected encoding is skipped."""
    return "".join(pieces_of(data, encoding, decompress, detector))


#: Bytes that are decoded at once.
_PIECE = 1 << 20


def pieces_of(data: bytes, encoding: str | None, decompress: Decompressor | None, detector: Callable[[bytes], tuple[str, int]] = detect, whole: bool = True) -> Iterator[str]:
    """The same text in pieces; `whole`: whether the data end with the file, not within a character."""
    if decompress:
        data = decompress(bytes(data))
    data = memoryview(data)
    found, skip = detector(bytes(data[:4]))
    if encoding and codecs.lookup(encoding) != codecs.lookup(found):
        name = codecs.lookup(encoding).name
        skip = skip if skip and name.replace("-", "").startswith(found[:5].replace("-", "")) else 0
        found = encoding
    if codecs.lookup(found).incrementaldecoder is None:
        yield bytes(data[skip:]).decode(found)
        return
    decoder = codecs.getincrementaldecoder(found)()
    for at in range(skip, len(data), _PIECE):
        yield decoder.decode(bytes(data[at : at + _PIECE]))
    if whole:
        yield decoder.decode(b"", True)
