"""Target-distribution importance resampling over hashed word n-grams.

A batch's texts are joined with sentinels between them and one pass of a regular
expression finds the words of all of them. Looking their places up among the texts'
offsets tells which text a word is of, so that an n-gram across a sentinel is
masked before the buckets are counted. Two passes read the texts: the first sums the
buckets of the corpus, the second weighs every text by the gains of its buckets;
weighted draws without replacement then take the highest perturbed scores.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.llm import text as T
from milepost.operators.distributed import row_positions

BUCKETS = 10_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SENTINEL = b"\n"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Checksums of longer words are made one by one.
_LONG = 64


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _table()


def _steps() -> np.ndarray:
    """``[n, byte, value]``: what a byte of a checksum becomes when ``n`` zero bytes follow."""
    out = np.zeros((_LONG + 1, 4, 256), np.uint32)
    for byte in range(4):
        out[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for n in range(1, _LONG + 1):
        out[n] = _CRC[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_AFTER = _steps()


def _followed(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums moved past ``lengths`` further bytes; the bytes' own checksum is added by xor."""
    out = np.zeros_like(crc)
    for byte in range(4):
        out ^= _AFTER[lengths, byte, (crc >> np.uint32(8 * byte)) & 255]
    return out


def word_checksums(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of every word, one place of all words at a time."""
    body = np.frombuffer(data, np.uint8)
    length = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-length, kind="stable")
    order = order[np.searchsorted(-length[order], -_LONG) :]
    upto = np.searchsorted(-length[order], -np.arange(1, _LONG + 1), "right")
    for k in range(_LONG):
        some = order[: upto[k]]
        if not len(some):
            break
        out[some] = _CRC[(out[some] ^ body[starts[some] + k]) & 255] ^ (out[some] >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(length > _LONG):
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, bucket)`` of every word and every pair of words, and the texts' word counts."""
    data = _SENTINEL.join(texts).translate(_LOWER)
    spans = np.array([m.span() for m in _WORD.finditer(data)], np.int64).reshape(-1, 2)
    starts, ends = spans[:, 0], spans[:, 1]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    crc = word_checksums(data, starts, ends)
    # The first word and a space, moved past the second word, and the second word.
    spaced = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)
    spaced = _CRC[(spaced ^ 32) & 255] ^ (spaced >> 8) ^ np.uint32(0xFFFFFFFF)
    length = ends - starts
    inside = np.flatnonzero(owner[1:] == owner[:-1])  # no pair across a sentinel
    short = inside[length[inside + 1] <= _LONG]
    pairs = np.zeros(len(starts), np.uint32)
    pairs[short] = _followed(spaced[short], length[short + 1]) ^ crc[short + 1]
    for k in inside[length[inside + 1] > _LONG]:
        pairs[k] = zlib.crc32(data[starts[k + 1] : ends[k + 1]], int(spaced[k]))
    hashed = np.concatenate([crc, pairs[inside]]) % np.uint32(buckets)
    of = np.concatenate([owner, owner[inside]])
    return of, hashed.astype(np.int64), np.bincount(owner, minlength=len(texts))


def _blocks(column: pa.Array):
    """``(first row, texts)`` of parts of a batch whose bytes are bounded."""
    data, offsets = T.raw(column)
    for lo, hi in T.row_blocks(offsets):
        yield lo, [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(lo, hi)]


def _sums(buckets: int):
    """How often each bucket occurs in a task's texts; one row per bucket in use."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _blocks(batch.column("text")):
                total += np.bincount(features(texts, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"]
        )

    return run


def _weigh(gains: np.ndarray):
    """Words, features and weight of every text, as columns after the batch's own."""

    def run(batches):
        for batch in batches:
            found = []
            for _, texts in _blocks(batch.column("text")):
                of, hashed, words = features(texts, len(gains))
                n = np.bincount(of, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, of, gains[hashed])
                found.append((words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))
            new = [np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)]
            columns = new or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, columns)],
                names=[*batch.schema.names, "_n_words", "_n_features", "_weight"],
            )

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all ``texts(text)`` in each bucket: at most ``buckets`` numbers."""
    rows = texts.select("text").mapInArrow(_sums(buckets), "bucket int, n bigint")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Floored thousandths of the log ratio of the smoothed shares, target over raw."""
    s_all, t_all = sum(raw.values()) + buckets, sum(target.values()) + buckets
    return np.array([
        math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((raw.get(b, 0) + 1) * t_all)))
        for b in range(buckets)
    ], np.int64)


def scored(docs: DataFrame, target: DataFrame, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_features``, ``_weight`` and ``_score``.

    ``target(text)`` has the texts whose distribution is wanted. Words are runs of
    digits, letters and characters beyond ASCII, with A-Z in lower case. A null or
    empty text, or one without words, has no feature and weight 0. The score is the
    weight and a Gumbel variate drawn from ``doc_id`` (of '' if null) alone, so a
    repeated task or row draws the same. Columns of ``docs`` with these names are
    replaced.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    rows = docs.drop("_n_words", "_n_features", "_weight", "_score")
    kinds = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in rows.dtypes)
    weighed = rows.mapInArrow(
        _weigh(gains), f"{kinds}, _n_words bigint, _n_features bigint, _weight bigint"
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return weighed.withColumn("_score", (F.col("_weight") + gumbel).cast("bigint"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs(doc_id, text)``.

    Of the rows with ``min_words`` words or more, the ``percent`` per cent (rounded
    down) with the highest :func:`scored` scores are drawn; ``rank`` counts them from 1
    by score, ties by smaller ``doc_id`` (null first), features and weight, and is null
    for all others. Repeated rows are rows of their own. Empty tables give empty
    results. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = T.stored(scored(rows, target, seed, buckets).drop("text"), "scores")
    able = F.col("_n_words") >= min_words
    wanted = rows.where(able).count() * percent // 100
    order = [
        F.when(able, 0).otherwise(1), F.col("_score").desc(), F.col("doc_id").asc_nulls_first(),
        F.col("_n_features"), F.col("_weight"),
    ]
    ranked = row_positions(rows, order, name="_rank")
    return ranked.select(
        "doc_id", F.col("_n_features").alias("n_features"), F.col("_weight").alias("weight"),
        F.col("_score").alias("score"),
        F.when(F.col("_rank") <= wanted, F.col("_rank")).alias("rank"),
    )


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns.

    Only the last drawn ``(score, doc_id)`` reaches the driver. Rows that share it are
    drawn together.
    """
    report = resample(docs, target, percent, min_words)
    last = report.where(F.col("rank").isNotNull()).orderBy(F.col("rank").desc()).first()
    rows = scored(docs, target)
    if last is None:
        return rows.select(*docs.columns).limit(0)
    same = F.col("_score") == last["score"]
    before = F.col("doc_id").isNull() if last["doc_id"] is None else (
        F.col("doc_id").isNull() | (F.col("doc_id") <= last["doc_id"])
    )
    chosen = (F.col("_n_words") >= min_words) & ((F.col("_score") > last["score"]) | (same & before))
    return rows.where(chosen).select(*docs.columns)


def oracle(percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> str:
    """The report as SQL, with the checksum made bit by bit."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH texts AS (
        SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, 'S' AS side
        FROM documents
        UNION ALL
        SELECT row_number() OVER (), NULL, coalesce(text, ''), 'T' FROM benchmark),
    split AS (
        SELECT side, k, doc_id, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    grams AS (
        SELECT side, k, doc_id, len(w) AS n_words, w || CASE WHEN len(w) > 1 THEN
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
            ELSE [] END AS g FROM split),
    counted AS (
        SELECT side, k, f, count(*) AS n
        FROM (SELECT side, k, unnest(g) AS f FROM grams) GROUP BY ALL),
    steps AS (
        SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
    hashed AS (
        SELECT f, xor(list_reduce([4294967295] || flatten(list_transform(
            range(len(h) // 2), lambda i: [('0x' || substr(h, 2 * i + 1, 2))::BIGINT,
                -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda c, b: CASE WHEN b >= 0 THEN xor(c, b)
                ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % {buckets} AS b
        FROM steps),
    in_bucket AS (
        SELECT b, coalesce(sum(n) FILTER (WHERE side = 'S'), 0)::DOUBLE AS s,
               coalesce(sum(n) FILTER (WHERE side = 'T'), 0)::DOUBLE AS t
        FROM counted JOIN hashed USING (f) GROUP BY b),
    gains AS (
        SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + {buckets})
            / ((s + 1) * (sum(t) OVER () + {buckets}))))::BIGINT AS gain FROM in_bucket),
    summed AS (
        SELECT k, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total
        FROM counted JOIN hashed USING (f) JOIN gains USING (b) WHERE side = 'S' GROUP BY k),
    weighed AS (
        SELECT doc_id, n_words, coalesce(n, 0) AS n_features,
               coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
               ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                   AS h
        FROM grams LEFT JOIN summed USING (k) WHERE side = 'S'),
    scored AS (
        SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM weighed),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY n_words >= {min_words}
            ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS r,
            count(*) FILTER (WHERE n_words >= {min_words}) OVER () * {percent} // 100 AS wanted
        FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN n_words >= {min_words} AND r <= wanted THEN r END AS rank
    FROM ranked
    """
