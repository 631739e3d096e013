"""Vectorised text kernels shared by the text operators.

Everything works on Arrow string buffers with numpy: no per-character and no per-word Python
code.  Working memory is bounded: `slices` cuts a record batch so that one slice holds at most
`max_bytes` of text, or a single longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_POW_LEN = 4096
_rng = np.random.default_rng(20240229)
_POW = _rng.integers(1, 1 << 63, _POW_LEN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LUT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The six separators of a word, space, tab, line feed, vertical tab, form feed, return.
SPACES = [32, 9, 10, 11, 12, 13]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True
_LUT[IS_SPACE] = 0
_LUT_LOWER = _LUT.copy()
_LUT_LOWER[65:91] = _LUT[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    large = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if not len(o):
        o = np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], col: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut by the size of the text in `col`; no row is lost or split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(col))
        _, o = utf8(arr)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(o, o[a] + max_bytes, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of every word, and the index of each text's first word (length n+1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    non = ~sep[data]
    start = non.copy()
    start[1:] &= ~non[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = non[heads]
    end = non.copy()
    end[:-1] &= ~non[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[tails] = non[tails]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower folds A-Z only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    body = data[starts[0] :]
    lut = _LUT_LOWER if lower else _LUT
    seg = np.diff(np.append(starts, len(data)))
    pos = np.arange(len(body), dtype=np.int64) - np.repeat(starts - starts[0], seg)
    w = _POW[pos & (_POW_LEN - 1)]
    if seg.max() > _POW_LEN:
        w = w + (pos >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
    h = np.add.reduceat(lut[body] * w, starts - starts[0])
    return mix(h + (ends - starts).astype(np.uint64) * _MULT[0])


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each text's first shingle (length n+1).

    A text of fewer than k words but at least one gives its whole sequence as one shingle.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(count)])
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), out_first
    full = np.zeros(0, np.uint64)
    if len(h) >= k:
        full = h[: len(h) - k + 1] * _MULT[1]
        for j in range(1, k):
            full = full + h[j : len(h) - k + 1 + j] * _MULT[1 + j]
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(total) - out_first[doc] + first[doc]
    short = n[doc] < k
    out = np.zeros(total, np.uint64)
    out[~short] = full[at[~short]]
    if short.any():
        s, m = at[short], n[doc[short]]
        v = m.astype(np.uint64) * _MULT[40]
        for j in range(k - 1):
            ok = m > j
            v[ok] = v[ok] + h[s[ok] + j] * _MULT[1 + j]
        out[short] = v
    return mix(out), out_first


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and each text's offsets in code points."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(lead)])
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, upto[offsets]
