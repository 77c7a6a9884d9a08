"""Words of whole texts as 64-bit hashes, cut and hashed with array operations over the UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. Its hash is a polynomial in its bytes (prefix sums modulo 2^64, so that a word
costs one subtraction and one product), mixed with its length; equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: list[np.ndarray] = []


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds an Arrow batch by rows and, where the version knows it, by bytes: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in (BASE, INVERSE):
            row = np.full(max(n, BLOCK + 1), base, np.uint64)
            row[0] = 1
            _tables.append(np.multiply.accumulate(row))
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - (at[0] if len(at) else 0)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words and, per text, the index of its first word (n + 1 entries)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at[at <= len(data)]] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of non-overlapping spans in order, in blocks of about BLOCK bytes that never cut a span."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = ends[j - 1]
        power, inverse = _powers(int(hi - lo) + 1)
        sums = np.zeros(int(hi - lo) + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word; n + 1 entries)."""
    data, at = text_bytes(texts)
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, at)
    return hash_spans(data, starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, in order, and each text's first run.

    A text of 1 to k - 1 words has one shorter run: all of its words.
    """
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(m)])
    where = np.repeat(first[:-1] - begin[:-1], m) + np.arange(begin[-1])
    limit = np.repeat(first[1:], m)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    total = np.zeros(len(where), np.uint64)
    for j in range(k):
        part = padded[where + j]
        if j:
            part = np.where(where + j < limit, part, np.uint64(0))
        total = total * np.uint64(BASE) + part
    return mix(total), begin


def batches(array: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text has its own."""
    _, at = text_bytes(array)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
