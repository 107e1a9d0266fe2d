"""Quality rules on compression: how far zstandard shrinks a text and its chunks.

Text that shrinks very far repeats itself; text that hardly shrinks is encoded or
random. What is usual depends on the length, so each length band has its limits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from milepost.llm import text as T

WINDOW = 8
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class Bands:
    """Least and greatest ratio of compressed to plain bytes, from each length on.

    ``whole`` is for documents, ``chunk`` for chunks of ``chunk_bytes``; a text is
    rejected if its ratio is outside its band, or if chunks outside theirs hold more
    than ``bad_share`` of its bytes. The last chunk is judged by its own length.

    From 256 bytes on the upper limits stand between the greatest ratio of all test
    documents (0.805 from 256 bytes, 0.71 from 512, 0.61 from 1 KB, 0.55 from 2 KB, 0.51
    from 4 KB) and the least of base64 and of random letters and digits (0.82, 0.77, 0.75,
    0.74, 0.73 at the end of each band). Below that the two overlap. Hex digits (0.50 to
    0.65) are inside the bands.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0),
        (128, 0.42, 1.0),
        (256, 0.40, 0.81),
        (512, 0.38, 0.74),
        (1024, 0.36, 0.69),
        (2048, 0.33, 0.67),
        (4096, 0.30, 0.65),
        (8192, 0.27, 0.65),
        (32768, 0.24, 0.65),
    )
    chunk: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0),
        (128, 0.42, 1.0),
        (256, 0.40, 0.81),
        (512, 0.38, 0.74),
        (1024, 0.36, 0.69),
        (2048, 0.27, 0.67),
        (4096, 0.27, 0.65),
    )
    chunk_bytes: int = 4096
    bad_share: float = 0.34
    level: int = 3


def _outside(limits, size: int, ratio: float) -> bool:
    low, high = next((lo, hi) for at, lo, hi in reversed(limits) if size >= at)
    return not low <= ratio <= high


def _verdict(data: bytes, bands: Bands, squeeze) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks, bad chunks, and whether it passes."""
    n = len(data)
    if not n:
        return 1.0, 0, 0, True
    ratio = len(squeeze(data)) / n
    chunks = bad = bad_bytes = 0
    if n > bands.chunk_bytes:
        for k in range(0, n, bands.chunk_bytes):
            part = data[k : k + bands.chunk_bytes]
            chunks += 1
            if _outside(bands.chunk, len(part), len(squeeze(part)) / len(part)):
                bad, bad_bytes = bad + 1, bad_bytes + len(part)
    passes = not _outside(bands.whole, n, ratio) and bad_bytes <= bands.bad_share * n
    return ratio, chunks, bad, passes


def _repeated(hashes: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more."""
    n = len(hashes)
    if n <= WINDOW:
        return 0
    rolled = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        rolled = T.mix(rolled + hashes[k : n - WINDOW + 1 + k] * np.uint64(2 * k + 3))
    _, where, counts = np.unique(rolled, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[where] > 1)
    if not len(at):
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _measure(bands: Bands):
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            data, offsets = T.raw(batch.column("text"))
            out: list[list] = [[] for _ in range(10)]
            for lo, hi in T.row_blocks(offsets):
                at = offsets[lo : hi + 1]
                part, at = data[at[0] : at[-1]], at - at[0]
                _, _, hashes, first = T.words(part, at)
                space = (part == 32) | ((part >= 9) & (part <= 13))
                chars = _sums(((part & 0xC0) != 0x80) & ~space, at).tolist()
                symbols = _sums(_SYMBOLS[part], at).tolist()
                for k in range(hi - lo):
                    whole = part[at[k] : at[k + 1]].tobytes()
                    lines = [x for x in whole.split(b"\n") if x.strip()]
                    n = int(first[k + 1] - first[k])
                    repeat = _repeated(hashes[first[k] : first[k + 1]])
                    failed = n < 20 or 100 * repeat > 30 * n
                    ratio, chunks, bad, passes = _verdict(whole, bands, squeeze)
                    row = (n, chars[k], symbols[k], len(lines) - len(set(lines)), repeat, failed,
                           passes and not failed, ratio, chunks, bad)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            names = [f.split()[0] for f in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()),
                 *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]],
                names=names,
            )

    return run


_RESULT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, n_chunks bigint, "
    "n_bad_chunks bigint"
)


def compression_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Counts, the base rule and the compression verdict of each row of ``docs(doc_id, text)``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows of
    eight. ``kept``: not failed, and inside the bands. A null text counts as empty: no
    words, so it fails; its ratio is 1. Repeated rows are judged row by row, other
    columns are ignored, and an empty table gives an empty result. A text is handled
    whole, in the memory of a few copies of it.
    """
    rows = docs.select(docs.doc_id.cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_measure(bands), _RESULT)
