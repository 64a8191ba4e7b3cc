"""Texts of an Arrow batch as byte arrays: words, their hashes, runs.

Everything here works on whole batches with numpy; a text is never cut. Texts are
taken in chunks of about half a megabyte, so the arrays stay small however large a
batch is (one very long text is one chunk)."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 19
BATCH_ROWS = 1000
#: Bytes of words: digits, letters, everything outside ASCII. A-Z count as a-z.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + list(range(128, 256))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finalizer of murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n. A worker keeps those of a chunk; those of a
    longer text go with it."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    both = []
    for base in (_BASE, _INVERSE):
        out = np.full(max(n, min(1 << (n - 1).bit_length(), CHUNK + 1)), base, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    if len(both[0]) <= CHUNK + 1:
        _powers[:] = both
    return both[0][:n], both[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of value(b_j) * base^j for j < i: the hash of bytes i to
    k is (P[k] - P[i]) * base^-i, the same wherever they stand."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


class Words(NamedTuple):
    counts: np.ndarray  # words of each text
    first: np.ndarray  # index of each text's first word
    start: np.ndarray  # byte where a word starts in `data`
    end: np.ndarray
    hash: np.ndarray  # of the lower-cased word
    data: np.ndarray  # the texts' bytes, lower-cased, with a separator after each
    offset: np.ndarray  # where each text starts in `data`


def small_batches(df: DataFrame) -> DataFrame:
    """Texts differ in length a thousandfold: with at most BATCH_ROWS rows in an Arrow
    batch (a setting of the session), what a worker and its executor hold stays small."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) of about `limit` bytes each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def joined(texts: list[bytes], separator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, a separator after each, and where they start."""
    data = np.frombuffer(separator.join([*texts, b""]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)


def words(texts: list[bytes], word_bytes: np.ndarray = WORD_BYTES) -> Words:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased texts, or runs of other
    bytes (without the separator, a line feed)."""
    data, offset = joined(texts)
    data = LOWER[data]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = word_bytes[data]
    edge = np.diff(inside)
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    prefix, inverse = prefix_hash(data), powers(len(data) + 1)[1]
    first = np.searchsorted(start, offset)
    return Words(np.diff(np.append(first, len(start))), first, start, end, mix((prefix[end] - prefix[start]) * inverse[start]), data, offset)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` values in a row, at the first of them."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out ^ values[k : k + n]) + np.uint64(k + 1)
    return out


def lists(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """List column of the given sizes over flat values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
