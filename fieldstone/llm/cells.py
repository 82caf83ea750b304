"""Arrays and word lists as compressed cells of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(cell: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(cell.as_buffer().to_pybytes())


def squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return pack(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def loosen(cell: pa.Scalar, kind: str) -> np.ndarray:
    """The integers of a squeezed cell."""
    planes = np.frombuffer(unpack(cell), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def words_of(cell: pa.Scalar) -> list[bytes]:
    """A packed list of words without spaces, joined by them; never the empty list."""
    return unpack(cell).split(b" ")
