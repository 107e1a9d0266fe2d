"""Byte-level text helpers for tasks, and stored intermediate tables.

Tasks get Arrow batches and work on blocks of a few megabytes, so that memory
does not depend on how Spark cuts its batches. Hashes are 64 bits wide and made
from fixed seeds, so that a repeated task gives the same rows.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from milepost import session

BLOCK_BYTES = 1 << 21
_ARCHIVE = "milepost-workers.zip"
_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE_CODES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(2**50, 2**60)) * 8 + 5
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    """The library's settings, Arrow batches of bounded size, and the package for the workers."""
    session.configure(spark)
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Let Spark send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if any(name.endswith(_ARCHIVE) for name in context.listFiles):
        return
    root = Path(session.__file__).parent
    archive = Path(context._temp_dir) / _ARCHIVE
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = session.fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, with this package's settings applied."""
    return configure(spark).read.parquet(f"{sf_dir}/documents.parquet")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    got = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return got[at[0] : at[-1]] if len(at) else got[:0], at - (at[0] if len(at) else 0)


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes fit ``limit``; a longer row is a block of its own."""
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown when a longer block comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * BLOCK_BYTES)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(size, _U(base))
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def prefix_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """``n + 1`` running sums from which any substring's hash can be taken."""
    codes = _BYTE_CODES[_LOWER] if lower else _BYTE_CODES
    up, _ = _Powers.get(max(1, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``[start, end)``."""
    _, down = _Powers.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs without space, tab, line feed and the like."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, hashes, and each row's first word index (one more at the end)."""
    starts, ends = word_spans(data, offsets)
    hashes = span_hashes(prefix_hashes(data, lower), starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)
