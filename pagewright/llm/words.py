"""Whole texts of an Arrow batch as one flat run of word codes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are taken in slices of about this many bytes, which bounds a worker's memory; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one stage has freed must not stay with the next."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


@dataclass
class Words:
    """codes[offsets[i]:offsets[i + 1]] are the words of text i, as indices of uniq."""

    uniq: pa.Array
    codes: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.uniq.to_pylist()), np.uint64, len(self.uniq))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)
    give_back()


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    ends = parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(full).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int64)
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), ends)


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash, mixed, of every n neighbours of values; the flat run's text borders are the caller's matter."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - n + 1, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            power = power * factor
            out += values[j : len(values) - n + 1 + j] * power
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))
