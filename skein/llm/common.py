"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import checkpointed, release, shared_folder

__all__ = ["by_size", "checkpointed", "crc_remainder", "mix64", "read_table", "release", "shared_folder", "shingles", "small_batches", "sorted_distinct", "text_bytes", "trim", "word_digests", "word_hashes"]

#: A word of the text contracts: a run without ASCII white space. ``bytes.split()`` cuts at exactly these bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Lower-cases A-Z and blanks every other ASCII byte that is neither letter nor digit.
LETTERS_DIGITS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

_CACHE_WORDS = 100_000
#: Bytes of a batch that Spark hands to a Python worker, where a pass over texts is run at once.
BATCH_BYTES = 8 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id: Column | str, modulus: int) -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def trim() -> None:
    """Gives freed memory back to the system; a Python worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, batches of ``BATCH_BYTES`` go to Python workers, for eager passes over whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_size(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each of one row or of at most ``most`` bytes in the string column ``at``."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).tolist()
    start = size = 0
    for k, own in enumerate(sizes):
        if k > start and size + own > most:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += own
    if start < len(sizes):
        yield batch.slice(start)
    trim()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class _WordDigests(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_128_digest(word)
        return value


_words, _digests = _WordHashes(), _WordDigests()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the cache is bounded."""
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def word_digests(words: list[bytes]) -> np.ndarray:
    """128-bit hashes of words, a row of two numbers for each."""
    return np.frombuffer(b"".join(map(_digests.__getitem__, words)), np.uint64).reshape(-1, 2)


def sorted_distinct(numbers: np.ndarray) -> np.ndarray:
    """As ``np.unique`` gives them, but always by sorting, which is the quicker way for 64-bit numbers."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (a public avalanche construction: xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; fewer words make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(size, n)
    out = hashes[: n - k + 1].copy()
    for j in range(1, k):
        out = out * _MULT + hashes[j : n - k + 1 + j]
    return mix64(out + np.uint64(k))
