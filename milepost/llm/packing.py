"""Packing token sequences as a cutting-stock problem.

Documents are cut into full sequences and one remainder. The remainders' lengths,
rounded up to classes, are a cutting-stock instance on their histogram: a linear
programme over patterns (how many pieces of each class share a sequence), whose
columns are priced by a knapsack dynamic programme. Its solution is rounded down,
what is left is packed by first fit, and the patterns are given to the pieces of
each class by their rank. Only the histogram reaches the driver.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost.llm.text import stored
from milepost.operators.distributed import row_positions

CLASS = 8
_SPECIAL = "<|endoftext|>"
#: Beyond these characters the two libraries' Unicode tables might differ.
_UNUSUAL = re.compile("[^\x00-ɏ]")


def tokenizer_paths() -> tuple[str, str]:
    """The vocabulary's two files: for ``tokenizers``, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(
        "byte_bpe_50k.tiktoken"
    )


@lru_cache(maxsize=2)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def token_ids(text: str, paths: tuple[str, str]) -> list[int]:
    """The ids that ``tokenizers`` gives for the vocabulary, by a faster way where it is equal.

    Texts of ordinary European letters without the special token's string go
    through the rank table, which gives the same ids several times faster.
    """
    if (text.isascii() or not _UNUSUAL.search(text)) and _SPECIAL not in text:
        return _fast(paths[1]).encode_ordinary(text)
    return _slow(paths[0]).encode(text, add_special_tokens=False).ids


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(paths: tuple[str, str], full: int, end_id: int):
    def run(batches):
        for batch in batches:
            out: list[list[int | None]] = [[] for _ in range(5)]
            rows = zip(
                batch.column("doc_id").to_pylist(), batch.column("text"), strict=True
            )
            for doc, text in rows:
                ids = np.array([*token_ids(text.as_py() or "", paths), end_id], "<u4")
                for k in range(0, len(ids), full):
                    part = ids[k : k + full]
                    row = (doc, k, len(part), zlib.crc32(part.tobytes()), len(ids))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in out],
                names=[f.split()[0] for f in _PIECES.split(", ")],
            )

    return run


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack, by dynamic programming."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    for c in range(int(sizes.min()), room + 1):
        fits = sizes <= c
        gain = np.where(fits, best[np.where(fits, c - sizes, 0)] + values, -1.0)
        k = int(np.argmax(gain))
        best[c] = best[c - 1]
        if gain[k] > best[c] + 1e-12:
            best[c], took[c] = gain[k], k
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[room]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverse, by Gauss-Jordan steps on whole rows.

    Linear algebra libraries start threads for it, which stall in a process that also
    holds a busy JVM; element-wise operations do not.
    """
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        best = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        rows = np.flatnonzero(factors)
        both[rows] -= factors[rows, None] * both[k]
    return both[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix times vector without threads; patterns are sparse."""
    some = np.flatnonzero(vector)
    return (matrix[:, some] * vector[some]).sum(1)


def cutting_stock(
    sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4
) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every piece has its place.

    Column generation with a revised simplex: start with one class per pattern, let
    the pattern that prices best enter, until the best dual bound shows that the
    solution is within ``gap`` of the optimum. Prices are smoothed towards those of
    the best bound, which takes far fewer rounds. Demands are raised by unequal tiny
    parts, so that every step improves and the rounds end; should rounding errors of
    the inverse stop all progress for ten rounds a class, the solution at hand is
    taken. The fractional solution of the true demands is rounded down; first fit
    places what is left, the longest first.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    raised = demand * (1 + 1e-7 * np.arange(1, m + 1) / m)
    used = _times(inverse, raised)
    bound, center = 0.0, np.zeros(m)
    turn, best, since = 0, np.inf, 0
    while since < 10 * m:
        since, best = (0, used.sum()) if used.sum() < best * (1 - 1e-12) else (since + 1, best)
        prices = inverse.sum(0)
        entering = None
        for trial in (0.7 * center + 0.3 * prices, prices):
            value, pattern = best_pattern(np.maximum(trial, 0), sizes, room)
            # Prices over the value of the best pattern are feasible, hence a bound.
            if (low := float((trial * raised).sum()) / max(value, 1.0)) > bound:
                bound, center = low, trial / max(value, 1.0)
            if float((prices * pattern).sum()) > 1 + 1e-9:
                entering = pattern
                break
        if entering is None or used.sum() <= bound * (1 + gap):
            break
        step = _times(inverse, entering)
        ratio = np.full(m, np.inf)
        np.divide(used, step, out=ratio, where=step > 1e-9)
        out = int(np.argmin(ratio))
        columns[:, out] = entering
        turn += 1
        if turn % 100 == 0:
            inverse = _inverse(columns)
        else:
            row = inverse[out] / step[out]
            inverse = inverse - step[:, None] * row
            inverse[out] = row
        used = np.maximum(_times(inverse, raised), 0)
    whole = columns.astype(np.int64)
    times = np.floor(np.maximum(_times(inverse, demand), 0) + 1e-9).astype(np.int64)
    left = demand.astype(np.int64) - (whole * times).sum(1)
    for p in np.argsort(-sizes):  # rounding errors of the inverse must not overfill a class
        while left[p] < 0:
            k = int(np.argmax((whole[p] > 0) & (times > 0)))
            times[k] -= 1
            left += whole[:, k]
    rest: list[tuple[int, Counter]] = []
    for p in np.argsort(-sizes):
        for _ in range(int(left[p])):
            for k, (free, items) in enumerate(rest):
                if free >= sizes[p]:
                    items[int(p)] += 1
                    rest[k] = (free - int(sizes[p]), items)
                    break
            else:
                rest.append((room - int(sizes[p]), Counter({int(p): 1})))
    found = [(whole[:, k], int(times[k])) for k in range(m) if times[k]]
    for items, n in Counter(tuple(sorted(i.items())) for _, i in rest).items():
        pattern = np.zeros(m, np.int64)
        for p, k in items:
            pattern[p] = k
        found.append((pattern, n))
    return found


def _places(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """``(class, first rank, last rank, pieces per sequence, first sequence)`` rows."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], float)
    rows, sequence = [], 0
    taken = np.zeros(len(sizes), np.int64)
    for pattern, times in cutting_stock(sizes, demand, room):
        for p in np.flatnonzero(pattern):
            n = int(pattern[p]) * times
            lo = int(taken[p])
            rows.append((int(sizes[p]), lo, lo + n - 1, int(pattern[p]), sequence))
            taken[p] += n
        sequence += times
    return rows


def pack(
    docs: DataFrame,
    length: int = 1024,
    end_id: int = 0,
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``length`` tokens.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. A document's tokens are its ids and ``end_id``; each lies in one
    piece. A null or empty text is the end token alone. Repeated rows and rows
    without doc_id are documents of their own; other columns are ignored; an empty
    table gives an empty result. ``length`` is a multiple of 8.
    """
    paths = paths or tokenizer_paths()
    room = length // CLASS
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = stored(
        rows.mapInArrow(_cut(paths, length, end_id), _PIECES)
        .withColumn("class", F.ceil(F.col("length") / CLASS).cast("int")),
        "pieces",
    )
    # At most `room` rows, whatever the corpus.
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    spark = docs.sparkSession
    places = spark.createDataFrame(
        _places(histogram, room), "class int, lo bigint, hi bigint, each bigint, base bigint"
    )
    order = [
        F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32"),
    ]
    ranked = row_positions(pieces, order, ["class"], "rank")
    placed = (
        ranked.withColumn("rank", F.col("rank") - 1)
        .join(F.broadcast(places.withColumnRenamed("class", "of")),
              F.expr("class = of AND rank BETWEEN lo AND hi"))
        .withColumn("sequence_id", F.expr("base + (rank - lo) div each"))
    )
    columns = [f.split()[0] for f in _PIECES.split(", ")]
    alone = placed.where(F.col("class") == room)
    shared = placed.where(F.col("class") < room)
    before = (
        W.partitionBy("sequence_id").orderBy(F.col("class").desc(), "rank")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        shared.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .select(*columns, "sequence_id", "offset")
        .union(alone.select(*columns, "sequence_id", F.lit(0).cast("bigint")))
    )
