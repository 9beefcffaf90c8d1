"""Vectorised text kernels that several operators share: words, hashes and Arrow batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 continuation bytes never fall in
that range, so words can be found on bytes. Word hashes are polynomials over a table of random 64-bit
values, taken mod 2**64 by prefix sums, so a whole chunk of documents is hashed by a few array passes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import SparkSession

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are expanded to arrays at once; one longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch; Spark's own numbers (10,000 and 64 MB) of whole texts take many times the memory.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 2**64)):
            out = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(b, done, 2**64))
                done *= 2
            made.append(out)
        have = _powers[base] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp value of every run of ``width`` values, mod 2**64 (length n - width + 1, or 0)."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(n + 1, base)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return (total[width:] - total[: n - width + 1]) * down[: n - width + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes; equal bytes have equal ones."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Words:
    """The words of some documents: hash, start and end byte of each, and the first word of each document.

    ``first`` has one entry more than there are documents; words of document i are first[i]:first[i + 1].
    """

    __slots__ = ("data", "ends", "first", "hashes", "starts")

    def __init__(self, texts: list[bytes], lower: bool):
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        self.data = joined
        inside = np.zeros(len(data) + 2, dtype=bool)
        np.logical_not(SPACE[data], out=inside[1:-1])
        self.starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        self.ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        self.hashes = span_hashes(LOWER[data] if lower else data, self.starts, self.ends)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        begins = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(sizes, out=begins[1:])
        self.first = np.searchsorted(self.starts, begins)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of the runs of ``width`` words that lie in one document, and the documents' numbers."""
        counts = np.maximum(self.counts() - width + 1, 0)
        of = np.repeat(np.arange(len(counts)), counts)
        shift = np.zeros(len(counts), dtype=np.int64)
        np.cumsum(counts[:-1], out=shift[1:])
        return np.arange(len(of)) - shift[of] + self.first[of], of


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches at BATCH_ROWS and BATCH_BYTES, unless the session has numbers of its own."""
    for name, usual, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(ours))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, with null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text, and their texts as bytes."""
    for batch in batches:
        at, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield (part := batch.slice(at, i - at)), text_bytes(part.column(column))
                at, size = i, 0
            size += n + 1
        if at < len(lengths):
            yield (part := batch.slice(at)), text_bytes(part.column(column))
    release()


def release() -> None:
    """Give freed memory back to the system: a worker keeps running between tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function, memory stays
        ctypes.CDLL(None).malloc_trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
