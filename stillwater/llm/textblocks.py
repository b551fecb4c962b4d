"""Vectorised words and hashes of a batch of texts.

A batch is one byte array with the offset of each text. Words are runs of bytes
other than space and \\t..\\r; in UTF-8 those bytes are never part of another
character, so this equals the split by code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~SPACE
SAME = np.arange(256, dtype=np.uint8)
FOLD = SAME.copy()
FOLD[ord("A") : ord("Z") + 1] += 32
IS_LEAD = (SAME & 0xC0) != 0x80  # first byte of a code point

_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(0, 2**64, (64, 256), dtype=U)
STEP = _rng.integers(0, 2**64, 1, dtype=U)[0] | U(1)
MULTS = _rng.integers(0, 2**64, 16, dtype=U) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type) or col.null_count:
        col = pc.fill_null(col.cast(pa.string()), "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `most` text bytes, one row at least."""
    for batch in batches:
        _, offs = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def tokens(data: np.ndarray, offs: np.ndarray, kinds: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word; kinds: which bytes are of a word."""
    word = kinds[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offs[1:] > offs[:-1]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    first[heads], last[tails] = word[heads], word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hash of each span data[start:end]; spans are in order and apart."""
    n = ends - starts
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    full = n > 0
    n, first = n[full], starts[full]
    if len(n):
        ahead = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(ahead, n)
        at = pos + np.repeat(first, n)
        val = TABLE[pos & 63, fold[data[at]]]
        turn = pos >> 6
        if (most := int(turn.max())) > 0:
            power = np.cumprod(np.concatenate([np.ones(1, U), np.full(most, STEP, U)]), dtype=U)
            val *= power[turn]
        out[full] = np.add.reduceat(val, ahead)
    return mix(out + (ends - starts).astype(U) * MULTS[15])


def windows(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every k-word window that lies in one text."""
    if len(words) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[: len(docs) - k + 1] == docs[k - 1 :])
    h = np.zeros(len(at), U)
    for j in range(k):
        h += words[at + j] * MULTS[j]
    return mix(h), at


def groups(docs: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each text's rows in `docs`, which is sorted."""
    return np.searchsorted(docs, np.arange(n + 1))
