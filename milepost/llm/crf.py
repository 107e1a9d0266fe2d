"""A quality classifier of lines: a linear-chain conditional random field.

Every line is good or bad; its features are those of the line and of the lines
before and after it, and neighbouring labels attract each other. Labels exist for
documents only: all lines of a good document are good, and a bad document has a
bad line somewhere, so its line labels are re-estimated while training. A
document's score is a calibrated function of its forward-backward marginals,
weighted by line length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.llm import text as T

#: Labelled documents the model is fitted on, at most.
TRAINING_DOCUMENTS = 4000
ACCEPT = 0.7
_SCORE = "_quality_score"
_KINDS = 16


def _class_table() -> np.ndarray:
    """For each byte, the kinds it counts for."""
    kinds = np.zeros((256, 7), np.uint8)
    kinds[65:91, 0] = 1  # capitals
    kinds[97:123, 1] = 1  # small letters
    kinds[48:58, 2] = 1  # digits
    kinds[list(b"#*$%&|<>"), 3] = 1  # symbols
    kinds[list(b"!?"), 4] = 1  # shouting
    kinds[list(b".,;:"), 5] = 1  # ordinary punctuation
    kinds[128:, 6] = 1  # parts of other characters
    return kinds.T.copy()


_CLASSES = _class_table()


def _line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines of a block, and each row's first line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    size = (ends - starts).astype(np.float64)
    counts = np.zeros((len(starts), len(_CLASSES)))
    for k, kind in enumerate(_CLASSES):  # one kind at a time, to keep blocks small in memory
        upto = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        counts[:, k] = upto[ends] - upto[starts]
    w_start, w_end, hashes, _ = T.words(data, offsets)
    first = np.searchsorted(w_start, starts)
    last = np.searchsorted(w_start, ends)
    n = (last - first).astype(np.float64)
    line_of = np.repeat(np.arange(len(starts)), last - first)
    # Words that occur before in their line, and words equal to the one before.
    order = np.lexsort((hashes, line_of))
    again = np.zeros(len(hashes))
    if len(hashes) > 1:
        same = (hashes[order][1:] == hashes[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
        again[order[1:][same]] = 1
    echo = np.zeros(len(hashes))
    if len(hashes) > 1:
        echo[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    long = (w_end - w_start > 12).astype(np.float64)

    def per_line(values):
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return sums[last] - sums[first]

    # A row has one line more than line feeds, so an empty row has one, and so has an empty end.
    per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
    first_line = np.concatenate([[0], np.cumsum(per_row)])
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    line_hash = T.span_hashes(T.prefix_hashes(data), starts, ends)
    order = np.lexsort((line_hash, row_of))
    copies = np.zeros(len(starts))
    same = (line_hash[order][1:] == line_hash[order][:-1]) & (row_of[order][1:] == row_of[order][:-1])
    copies[order[1:][same]] = 1
    copies[n == 0] = 0
    by, nw = np.maximum(size, 1), np.maximum(n, 1)
    letters = counts[:, 0] + counts[:, 1]
    tail = np.where(size > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    features = np.stack([
        counts[:, 0] / np.maximum(letters, 1), counts[:, 2] / by, counts[:, 3] / nw,
        counts[:, 4] / nw, counts[:, 5] / nw, counts[:, 6] / by, per_line(again) / nw,
        per_line(echo) / nw, per_line(long) / nw, np.log1p(size) / 5, np.log1p(n) / 5,
        (size / nw > 12).astype(float), copies, (n == 0).astype(float),
        np.isin(tail, list(b".!?:")).astype(float), np.minimum(size / nw, 40) / 10,
    ], axis=1)
    return features, size, first_line


def _neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines around it in its row, and a constant."""
    n = len(features)
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    heads, tails = first[:-1], first[1:] - 1
    before[heads[heads < n]] = 0
    after[tails[tails >= 0]] = 0
    return np.hstack([features, before, after, np.ones((n, 1))])


def _chains(first: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each step, the lines that stand there: of the longer rows only."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    heads, lengths = first[:-1][order], lengths[order]
    steps = []
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t, "left"))
        steps.append((t, heads[:live] + t))
    return steps


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = np.maximum(a, b)
    return high + np.log1p(np.exp(-np.abs(a - b)))


def marginals(unary: np.ndarray, links: np.ndarray, first: np.ndarray):
    """Chance of "good" per line, and the expected counts of neighbouring label pairs.

    ``unary`` is the log-odds of good; ``links[y, y']`` is the weight of label y'
    after label y (0 bad, 1 good).
    """
    n = len(unary)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack([np.zeros(n), unary], axis=1)
    steps = _chains(first)
    for t, at in steps:
        ahead[at] = score[at]
        if t:
            past = ahead[at - 1]
            for y in (0, 1):
                ahead[at, y] += _log_add(past[:, 0] + links[0, y], past[:, 1] + links[1, y])
    for t, at in reversed(steps):
        if t:
            later = score[at] + back[at]
            for y in (0, 1):
                back[at - 1, y] = _log_add(later[:, 0] + links[y, 0], later[:, 1] + links[y, 1])
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.concatenate([at for t, at in steps if t]) if len(steps) > 1 else np.zeros(0, int)
    pairs = np.zeros((2, 2))
    if len(inner):
        total = _log_add(both[inner, 0], both[inner, 1])
        for y in (0, 1):
            for z in (0, 1):
                logs = ahead[inner - 1, y] + links[y, z] + score[inner, z] + back[inner, z] - total
                pairs[y, z] = np.exp(np.minimum(logs, 0)).sum()
    return good, pairs


@dataclass(frozen=True)
class Model:
    """Line weights, label links, and the calibration of the document score."""

    weights: np.ndarray
    links: np.ndarray
    calibration: np.ndarray

    def lines(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(_neighbours(features, first) @ self.weights, self.links, first)[0]

    def score(self, features: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        facts = _document_facts(self.lines(features, first), size, first)
        return 1 / (1 + np.exp(-np.clip(facts @ self.calibration, -30, 30)))


def _document_facts(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted share of good lines, its log-odds, the worst line, and a constant."""
    weight = size + 1
    total = np.add.reduceat(weight, first[:-1])
    share = np.add.reduceat(weight * good, first[:-1]) / total
    worst = np.minimum.reduceat(good, first[:-1])
    odds = np.log((share + 0.01) / (1.01 - share))
    return np.stack([share, odds, worst, np.ones(len(share))], axis=1)


def _adam(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def _fit_chain(inputs, labels, first, start, rounds, decay=1e-4):
    """Weights and links that maximise the likelihood of the line labels."""
    n, width = inputs.shape
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1)

    def gradient(x):
        good, pairs = marginals(inputs @ x[:width], x[width:].reshape(2, 2), first)
        g = np.concatenate([inputs.T @ (good - labels) / n, ((pairs - seen) / n).ravel()])
        return g + decay * x

    return _adam(gradient, start, rounds, 0.1)


def fit(features: np.ndarray, size: np.ndarray, first: np.ndarray, good: np.ndarray) -> Model:
    """Fit on the lines of documents whose labels are ``good`` (1) or bad (0)."""
    inputs = _neighbours(features, first)
    row = np.repeat(np.arange(len(good)), np.diff(first))
    labels = good[row].astype(int)
    x = np.zeros(inputs.shape[1] + 4)
    for turn in range(4):
        x = _fit_chain(inputs, labels, first, x, 80 if turn < 3 else 150)
        chance, _ = marginals(inputs @ x[:-4], x[-4:].reshape(2, 2), first)
        # In a bad document the likelier lines turn good, but its worst line stays bad.
        worst = np.minimum.reduceat(chance, first[:-1])[row]
        labels = np.where(good[row] == 1, 1, ((chance > 0.5) & (chance > worst)).astype(int))
    model = Model(x[:-4], x[-4:].reshape(2, 2), np.zeros(4))
    facts = _document_facts(model.lines(features, first), size, first)

    def gradient(c):
        return facts.T @ (1 / (1 + np.exp(-facts @ c)) - good) / len(good) + 1e-4 * c

    return Model(model.weights, model.links, _adam(gradient, np.zeros(4), 800, 0.1))


_SAMPLE = "doc_id bigint, lines binary, size binary"


def _measure(batches):
    for batch in batches:
        data, offsets = T.raw(batch.column("text"))
        lines, sizes = [], []
        for lo, hi in T.row_blocks(offsets):
            at = offsets[lo : hi + 1]
            features, size, first = _line_features(data[at[0] : at[-1]], at - at[0])
            for a, b in zip(first[:-1], first[1:], strict=True):
                lines.append(features[a:b].astype(np.float32).tobytes())
                sizes.append(size[a:b].astype(np.float64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lines, pa.binary()), pa.array(sizes, pa.binary())],
            names=["doc_id", "lines", "size"],
        )


def _remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> Model:
    """Fit a model on at most ``most`` labelled documents outside the held-out quarter.

    The documents are the first by a hash of their doc_id, so the choice is the same
    everywhere. Rows without a usable label are left out. Without both labels on
    rows of ``docs`` the model accepts everything.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
    usable = usable.where(_remainder(F.col("doc_id")) != 2).groupBy("doc_id")
    chosen = usable.agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)
    good = {r.doc_id: r.quality for r in chosen.collect()}
    # At most `most` ids; of several texts of one id, the least.
    ids = docs.sparkSession.createDataFrame([(k,) for k in good], "doc_id bigint")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(_measure, _SAMPLE).toPandas().sort_values("doc_id")
    if len({good[k] for k in rows["doc_id"]}) < 2:
        return Model(np.zeros(3 * _KINDS + 1), np.zeros((2, 2)), np.array([0, 0, 0, 5.0]))
    parts = [np.frombuffer(b, np.float32).reshape(-1, _KINDS) for b in rows["lines"]]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    size = np.concatenate([np.frombuffer(b, np.float64) for b in rows["size"]])
    target = np.array([good[k] for k in rows["doc_id"]])
    return fit(np.vstack(parts).astype(np.float64), size, first, target)


def _apply(model: Model, name: str = "score"):
    def run(batches):
        for batch in batches:
            data, offsets = T.raw(batch.column("text"))
            scores = np.zeros(batch.num_rows)
            for lo, hi in T.row_blocks(offsets):
                at = offsets[lo : hi + 1]
                lines = _line_features(data[at[0] : at[-1]], at - at[0])
                scores[lo:hi] = model.score(*lines)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, name]
            )

    return run


def score(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text)``.

    ``held_out`` rows (crc32 of the doc_id as text, modulo 4, is 2) take no part in
    training. The score, from 0 to 1, depends on the text alone. A null or empty text
    is one empty line. Repeated rows are scored row by row; other columns are ignored;
    an empty table gives an empty result. A text is handled whole.
    """
    model = train(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = rows.mapInArrow(_apply_slim(model), "doc_id bigint, score double")
    return scored.select(
        "doc_id", (_remainder(F.col("doc_id")) == 2).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def _apply_slim(model: Model):
    whole = _apply(model)

    def run(batches):
        for batch in whole(batches):
            yield batch.select(["doc_id", "score"])

    return run


def accepted(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` whose text scores ``ACCEPT`` or more, with all their columns."""
    model = train(docs, labels, most)
    whole = docs.select("*", F.lit(0.0).alias(_SCORE)).schema
    scored = docs.mapInArrow(_apply(model, _SCORE), whole)
    return scored.where(F.col(_SCORE) >= ACCEPT).select(*docs.columns)
