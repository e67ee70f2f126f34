"""Vectorised word hashing over Arrow string batches.

Whole batches are hashed at once from the Arrow buffers, so that no Python code runs per
word. A word's hash is a polynomial over 64-bit random values of its bytes, taken modulo
2**64 from one prefix sum and mixed; equal words have equal hashes in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed)) | _U(1)


_BYTES = seeds(256, 7)
#: Bytes of words: all but the six ASCII white-space characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of alphanumeric words; those of other scripts count as letters.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {BASE: np.ones(1, _U), INVERSE: np.ones(1, _U)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        grown = np.full(max(n, 1 << 20), base, _U)
        grown[0] = 1
        have = _powers[base] = np.cumprod(grown, dtype=_U)
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    large = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, of about `limit` bytes at most unless one text is longer."""
    data, offsets = buffers(texts)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words; no word crosses from a text into the next."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[data]
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = True
    last[edges - 1] = True  # edges[0] is 0, and index -1 the last byte
    first[1:] |= ~inside[:-1]
    last[:-1] |= ~inside[1:]
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * _power(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(INVERSE, len(data) + 1)[starts])


def shingles(hashes: np.ndarray, docs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words with their text numbers; position i of a text's shingles starts at its word i."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(m, _U)
    for k in range(n):
        out = out * _U(0xC2B2AE3D27D4EB4F) + hashes[k : k + m]
    whole = docs[:m] == docs[n - 1 :]
    return mix(out[whole]), docs[:m][whole]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at its end the memory that the worker has freed goes back to the system; workers live on for later tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def counts(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n).astype(np.int64)
