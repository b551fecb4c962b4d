"""Arrays of numbers as one compressed value, for columns that travel by shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def pressed(*arrays: np.ndarray) -> bytes:
    """Each array by byte planes (all lowest bytes, then the next ...), which compress far better than whole numbers."""
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def opened(blob: bytes, *kinds: type) -> list[np.ndarray]:
    press, at, out = zstandard.ZstdDecompressor(), 0, []
    for kind in kinds:
        n, width = int.from_bytes(blob[at : at + 8], "little"), np.dtype(kind).itemsize
        planes = np.frombuffer(press.decompress(blob[at + 8 : at + 8 + n]), np.uint8).reshape(width, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 8 + n
    return out


def rising(a: np.ndarray) -> np.ndarray:
    """Sorted 64-bit numbers as their steps; `np.cumsum` in the same type gives them back."""
    return np.diff(a, prepend=a[:1] * 0)
