"""Repeated byte windows, by minimizer anchors and grouping of hashes.

A suffix matters only through its first ``width`` bytes, and equal ones are the
repeated windows. No suffix is ordered, as a radix sort would; groups are made so
that almost all suffixes leave after the first of them:

1. Every window holds an anchor, the least hash among its ``digit``-byte strings, so
   equal windows have equal anchors at equal places. Suffixes of one anchor form a
   run; the first digit of all of them is the anchor's string.
2. Runs whose first digit is shared are compared by the whole string that their
   windows cover. Equal runs are repeated as a whole.
3. Runs that share the first digit and differ elsewhere are compared window by
   window; one run of each kind of pass 2 takes part.

What is covered is then cut from each text. Digits are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.llm import text as T

DIGIT = 128
_POS_BITS = np.uint64(22)
_PIECE = 1 << 21
#: Kinds of runs of one first digit that are compared inside one task, at most;
#: beyond, their windows are counted by a shuffle.
IN_TASK = 2048
#: A digit is hot beyond this part of all repeated runs; the tasks that its runs are dealt over.
HOT, SALTS = 1000, 64

_RUNS = "doc_id bigint, h bigint, q bigint, u bigint, p0 bigint, p1 bigint"


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    out, size = keys, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(data: np.ndarray, offsets: np.ndarray, width: int, digit: int) -> tuple[np.ndarray, ...]:
    """``(row, first window, last window, q, u)`` of the runs of a block of rows.

    Window numbers are places in the row. ``q`` is the hash of the anchor's string, ``u``
    that of everything the run covers and where the anchor stands in it.
    """
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    sums = T.prefix_hashes(data)
    at = np.arange(n - digit + 1)
    grams = T.span_hashes(sums, at, at + digit)
    keys = (grams >> _POS_BITS << _POS_BITS) | at.astype(np.uint64)
    anchor = (_least(keys, width - digit + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1
    valid = np.arange(len(anchor)) + width <= offsets[row + 1]
    place = np.flatnonzero(valid)
    if not len(place):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    # A window that is valid stands in one row; so does its anchor.
    new = np.ones(len(place), bool)
    new[1:] = (anchor[place][1:] != anchor[place][:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    first = place[head]
    last = place[np.append(head[1:], len(place)) - 1]
    where = anchor[first]
    covered = T.span_hashes(sums, first, last + width)
    u = T.mix(covered + (where - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    r = row[first]
    return r, first - offsets[r], last - offsets[r], grams[where], u


def _pieces(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first row, last row, start byte, end byte)``: blocks of rows, or parts of long ones.

    Parts overlap by ``width - 1`` bytes, so every window is in exactly one.
    """
    for lo, hi in T.row_blocks(offsets, _PIECE):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= _PIECE:
            yield lo, hi, a, b
        else:
            for s in range(a, b - width + 1, _PIECE - width + 1):
                yield lo, hi, s, min(b, s + _PIECE)


def _find_runs(width: int, digit: int):
    def run(batches):
        for batch in batches:
            data, offsets = T.raw(batch.column("text"))
            ids = batch.column("doc_id")
            hashes = batch.column("h")
            for lo, hi, a, b in _pieces(offsets, width):
                local = np.clip(offsets[lo : hi + 1], a, b) - a
                skipped = a - int(offsets[lo])  # of a long row, before this part
                r, p0, p1, q, u = runs(data[a:b], local, width, digit)
                rows = pa.array(r + lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), hashes.take(rows), pa.array(q.view(np.int64)),
                     pa.array(u.view(np.int64)), pa.array(p0 + skipped), pa.array(p1 + skipped)],
                    names=["doc_id", "h", "q", "u", "p0", "p1"],
                )

    return run


def _contexts(batches):
    """The bytes that each wanted run covers."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("row", "q", "u", "n", "kinds", "p0", "body")}
        texts = batch.column("text")
        wanted = batch.column("wanted").to_pylist()
        for k, runs_of_row in enumerate(wanted):
            body = texts[k].as_py().encode()
            for w in runs_of_row:
                out["row"].append(k)
                for name in ("q", "u", "n", "kinds", "p0"):
                    out[name].append(w[name])
                out["body"].append(body[w["p0"] : w["stop"]])
        rows = pa.array(out["row"], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("h").take(rows),
             *[pa.array(out[k], pa.int64()) for k in ("q", "u", "n", "kinds", "p0")],
             pa.array(out["body"], pa.binary())],
            names=["doc_id", "h", "q", "u", "n", "kinds", "p0", "body"],
        )


_CONTEXT = (
    "doc_id bigint, h bigint, q bigint, u bigint, n bigint, kinds bigint, p0 bigint, body binary"
)
_SPANS = "doc_id bigint, h bigint, start bigint, stop bigint"


def _window_hashes(body: bytes, width: int) -> np.ndarray:
    data = np.frombuffer(body, np.uint8)
    at = np.arange(len(data) - width + 1)
    return T.span_hashes(T.prefix_hashes(data), at, at + width)


def _span_batch(ids, hashes, spans) -> pa.RecordBatch:
    where = [k for k, _, _ in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[k] for k in where], pa.int64()),
         pa.array([hashes[k] for k in where], pa.int64()),
         pa.array([s for _, s, _ in spans], pa.int64()),
         pa.array([e for _, _, e in spans], pa.int64())],
        names=["doc_id", "h", "start", "stop"],
    )


def _compare(width: int):
    """Windows that two kinds of runs of one first digit share; input sorted by ``q``."""

    def group(rows: list[tuple]) -> list[tuple[int, int, int]]:
        hashes = [_window_hashes(r[5], width) for r in rows]
        whole = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in hashes])
        # A run holds a window once or its copies hold it elsewhere: count its kinds.
        _, where, counts = np.unique(whole, return_inverse=True, return_counts=True)
        shared = counts[where] > 1
        spans = []
        place = np.arange(len(whole)) - np.repeat(
            np.cumsum([0, *[len(x) for x in hashes[:-1]]]), [len(x) for x in hashes]
        )
        hit = np.flatnonzero(shared)
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit][1:] != owner[hit][:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(hit)) - 1
            for a, b in zip(hit[head], hit[tail], strict=True):
                k = int(owner[a])
                if rows[k][3] == 1:  # repeated kinds are covered as a whole already
                    p0 = rows[k][4]
                    spans.append((k, p0 + int(place[a]), p0 + int(place[b]) + width))
        return spans

    def run(batches):
        rows: list[tuple] = []
        last = None

        def flush():
            spans = group(rows) if len(rows) > 1 else []
            return _span_batch([r[0] for r in rows], [r[1] for r in rows], spans)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("doc_id", "h", "q", "n", "p0", "body")]
            for row in zip(*columns, strict=True):
                if rows and row[2] != last:
                    yield flush()
                    rows = []
                last = row[2]
                rows.append(row)
        if rows:
            yield flush()

    return run


def _single_windows(width: int):
    """Every window of the runs, for counting by a shuffle."""

    def run(batches):
        for batch in batches:
            bodies = [_window_hashes(b.as_py(), width) for b in batch.column("body")]
            rows = pa.array(np.repeat(np.arange(len(bodies)), [len(x) for x in bodies]))
            p0 = batch.column("p0").to_numpy(zero_copy_only=False)
            start = [p + np.arange(len(x)) for p, x in zip(p0, bodies, strict=True)]
            whole = np.concatenate(bodies) if bodies else np.zeros(0, np.uint64)
            places = np.concatenate(start) if start else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(rows) for k in ("doc_id", "h", "q", "n")],
                 pa.array(places.astype(np.int64)), pa.array(whole.view(np.int64))],
                names=["doc_id", "h", "q", "n", "start", "window"],
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ``spans``."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_CUT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
    "kept binary"
)


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            spans = batch.column("spans").to_pylist()
            for text, found in zip(batch.column("text"), spans, strict=True):
                body = (text.as_py() or "").encode()
                gone = merged([(s["start"], s["stop"]) for s in found or []])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(body[at:a])
                    at = b
                left = b"".join([*kept, body[at:]])
                row = (len(body), len(body) - len(left), len(gone),
                       hashlib.sha256(left).hexdigest(), left if with_text else None)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]],
                names=[c.split()[0] for c in _CUT.split(", ")],
            )

    return run


def _repeated_spans(texts: DataFrame, dealt: DataFrame, width: int, digit: int) -> DataFrame:
    """``(doc_id, h, start, stop)``: spans whose union is what repeated windows cover."""
    found = texts.where(F.octet_length("text") >= width).mapInArrow(_find_runs(width, digit), _RUNS)
    digits = found.groupBy("q").agg(
        F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi")
    )
    digits = T.stored(digits.where("n > 1"), "digits")
    total = digits.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT digits have so large a part of all runs. Their runs are dealt over
    # SALTS tasks each, so that a passage that many texts share is not one task's.
    hot = digits.where(F.col("n") > total / HOT).select("q", F.lit(True).alias("hot"))
    salts = F.array(*[F.lit(k) for k in range(SALTS)])
    shared = digits.join(F.broadcast(hot), "q", "left").select(
        "q", (F.col("lo") != F.col("hi")).alias("mixed"),
        F.explode(F.when(F.col("hot"), salts).otherwise(F.array(F.lit(0)))).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("doc_id", "h", "p0"), F.lit(SALTS)).cast("int")
    dealt_runs = found.join(F.broadcast(hot), "q", "left").withColumn(
        "salt", F.when(F.col("hot"), salt).otherwise(0)
    )
    left = T.stored(dealt_runs.drop("hot").join(shared, ["q", "salt"]).drop("salt"), "runs")
    mixed = left.where("mixed")
    one = F.struct("doc_id", "h", "p0", (F.col("p1") + width).alias("stop"))
    kinds = mixed.groupBy("q", "u").agg(F.count("*").alias("n"), F.first(one).alias("r"))
    kinds = T.stored(kinds, "kinds")
    whole = left.where("NOT mixed").select("doc_id", "h", "p0", "p1").union(
        mixed.join(kinds.where("n > 1"), ["q", "u"], "left_semi").select("doc_id", "h", "p0", "p1")
    )
    whole = whole.select("doc_id", "h", F.col("p0").alias("start"), (F.col("p1") + width).alias("stop"))
    # One run of each kind; a kind that is repeated needs no more than that.
    of_digit = kinds.groupBy("q").agg(F.count("*").alias("kinds"))
    chosen = (
        kinds.join(of_digit, "q")
        .groupBy(F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h"))
        .agg(F.collect_list(F.struct("q", "u", "n", "kinds", "r.p0", "r.stop")).alias("wanted"))
    )
    chosen = T.stored(chosen, "chosen")
    texts_of = dealt.join(chosen, ["doc_id", "h"]).select("doc_id", "h", "text", "wanted")
    bodies = texts_of.mapInArrow(_contexts, _CONTEXT)
    few = bodies.where(F.col("kinds") <= IN_TASK)
    compared = few.repartition("q").sortWithinPartitions("q").mapInArrow(_compare(width), _SPANS)
    many = bodies.where(F.col("kinds") > IN_TASK).mapInArrow(
        _single_windows(width), "doc_id bigint, h bigint, q bigint, n bigint, start bigint, window bigint"
    )
    many = T.stored(many, "windows")
    twice = many.groupBy("q", "window").agg(F.count("*").alias("k")).where("k > 1")
    counted = many.where("n = 1").join(twice, ["q", "window"], "left_semi")
    counted = counted.select("doc_id", "h", "start", (F.col("start") + width).alias("stop"))
    return whole.union(compared).union(counted)


def cut_repeats(
    docs: DataFrame, width: int = 400, digit: int = DIGIT, with_text: bool = False
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row of ``docs(doc_id, text)``.

    Every byte goes that a ``width``-byte string covers which starts at another place
    too, in the same text or another row's; matches are judged on the input. Spans
    are the maximal removed runs. ``with_text`` adds what is left as ``kept``
    (binary). A null or shorter text keeps everything. Repeated rows repeat each
    other. Other columns are ignored; an empty table gives an empty result.
    """
    # Plain keys: null-safe ones would make Spark shuffle the dealt texts once more. A row
    # without id counts as 0, and its hash tells it from the row 0.
    no_id = F.col("doc_id").isNull()
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("doc_id"),
        F.xxhash64("text", no_id).alias("h"), F.coalesce("text", F.lit("")).alias("text"),
        no_id.alias("no_id"),
    )
    dealt = texts.repartition("doc_id", "h")
    spans = T.stored(_repeated_spans(texts, dealt, width, digit), "spans")
    of_row = spans.groupBy("doc_id", "h").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")
    )
    rows = dealt.join(of_row, ["doc_id", "h"], "left").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", "spans"
    )
    done = rows.mapInArrow(_cut(with_text), _CUT)
    return done if with_text else done.drop("kept")
