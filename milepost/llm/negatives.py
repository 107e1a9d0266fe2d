"""Hard-negative mining by segment summaries.

Vectors are stored in packs with the mean and the deviation of each of their
segments. Within a segment of ``n`` components an inner product is ``n`` times the
product of the means, give or take ``n`` times the product of the deviations; summed
over segments this bounds a score from both sides. Whole vectors are one segment at
first; what these bounds do not settle is looked at in halves, quarters and eighths,
and only what is left then is scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost.llm.text import stored
from milepost.operators.distributed import top_rows

PACK_ROWS = 16_384
ANCHOR_BLOCK = 256
#: Segments per vector at each step of the refinement.
LEVELS = (1, 2, 4, 8)
_EXACT = 2.0**53

_PACKS = "width int, pack bigint, ids binary, labels binary, vectors binary, summaries binary"
_FOUND = "anchor bigint, place int, id bigint, score bigint"


def summaries(m: np.ndarray) -> np.ndarray:
    """Means and deviations of the finest segments, ``[row, 2, segment]``.

    Vectors are filled up with zeros to whole segments, which changes no product.
    Coarser segments' follow from these.
    """
    last = LEVELS[-1]
    n = -(-m.shape[1] // last)
    full = np.zeros((len(m), n * last))
    full[:, : m.shape[1]] = m
    parts = full.reshape(len(m), last, n)
    return np.stack([parts.mean(2), parts.std(2)], axis=1)


def coarser(fine: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of ``segments`` equal segments, from those of finer ones."""
    means, deviations = fine[:, 0], fine[:, 1]
    groups = means.reshape(len(fine), segments, -1)
    mean = groups.mean(2)
    squares = (deviations**2).reshape(groups.shape) + (groups - mean[:, :, None]) ** 2
    return mean, np.sqrt(squares.mean(2))


def _exact_scores(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in whole numbers."""
    top = float(np.abs(m).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, len(v))
    if top < _EXACT:
        return np.einsum("ij,j->i", m.astype(float), v.astype(float)).astype(np.int64)
    if top < 2.0**62:
        return np.einsum("ij,j->i", m, v)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, v, strict=True)) for row in m], object)


class Pack:
    """Some of the rows, with the summaries of every level."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.labels = np.frombuffer(row.labels, np.int64)
        self.m = np.frombuffer(row.vectors, np.int64).reshape(len(self.ids), -1)
        fine = np.frombuffer(row.summaries).reshape(len(self.ids), 2, LEVELS[-1])
        self.levels = {s: coarser(fine, s) for s in LEVELS}
        norms = np.sqrt((self.m.astype(float) ** 2).sum(1))
        self.slack = 1e-9 * norms  # for rounding, times the anchor's norm

    def bounds(self, rows: np.ndarray, anchor: Anchor, segments: int):
        """Least and greatest possible scores of ``rows``."""
        n = -(-self.m.shape[1] // LEVELS[-1]) * (LEVELS[-1] // segments)
        mean, deviation = self.levels[segments]
        a_mean, a_deviation = anchor.levels[segments]
        middle = n * np.einsum("ij,j->i", mean[rows], a_mean)
        reach = n * np.einsum("ij,j->i", deviation[rows], a_deviation)
        reach = reach + self.slack[rows] * anchor.norm + 1e-6
        return middle - reach, middle + reach


class Anchor:
    """The vector that others are compared with, and its summaries."""

    def __init__(self, vec_id: int, label: int, v: np.ndarray):
        self.id, self.label, self.v = vec_id, label, v
        fine = summaries(v[None].astype(float))
        self.levels = {s: tuple(x[0] for x in coarser(fine, s)) for s in LEVELS}
        self.norm = float(np.sqrt((v.astype(float) ** 2).sum()))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k and scores.dtype != object:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda j: (-int(scores[j]), ids[j]))[:k], int)


def _in_bands(pack: Pack, rows: np.ndarray, anchor: Anchor, bands, k: int):
    """``(band, id, score)``: of ``rows``, the ``k`` best inside each of ``bands``.

    At every level a band drops what cannot lie in it, and what cannot be among its
    ``k`` best, because as many others surely lie in it and above.
    """
    bands = list(enumerate(bands))
    for segments in LEVELS:
        if len(rows) <= k:
            break
        low, high = pack.bounds(rows, anchor, segments)
        wanted = np.zeros(len(rows), bool)
        for _, (least, most) in bands:
            maybe = (high >= least) & (low <= most)
            sure = low[(low >= least) & (high <= most)]
            if len(sure) >= k:
                maybe &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            wanted |= maybe
        rows = rows[wanted]
    scores, ids = _exact_scores(pack.m[rows], anchor.v), pack.ids[rows]
    out = []
    for place, (least, most) in bands:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        out += [(place, int(ids[j]), int(scores[j]))
                for j in inside[_best(ids[inside], scores[inside], k)]]
    return out


def _pack_rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["id"], ignore_index=True, kind="stable")
    m = np.array(frame["v"].tolist(), np.int64)
    return pd.DataFrame([(
        int(frame["width"].iloc[0]), int(frame["pack"].iloc[0]),
        frame["id"].to_numpy(np.int64).tobytes(), frame["label"].to_numpy(np.int64).tobytes(),
        m.tobytes(), summaries(m.astype(float)).tobytes(),
    )], columns=[c.split()[0] for c in _PACKS.split(", ")])


def whole_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """``(id, label, v)`` with ``v = floor(scale * x)``, of the usable rows.

    Rows whose vec_id, label or embedding is null or whose embedding is empty or holds a
    null or a number that is not finite are left out.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    some = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    return embeddings.where(some & ~bad).select(F.col("vec_id").alias("id"), "label", whole.alias("v"))


def index(rows: DataFrame) -> DataFrame:
    """Packs of ``rows(id, label, v)`` with their summaries, in the shared folder.

    Only vectors of one length are comparable, so packs hold one length each. ``rows``
    has no nulls and no row twice.
    """
    packs = max(1, -(-rows.count() // PACK_ROWS))
    dealt = rows.withColumn("width", F.size("v")).withColumn(
        "pack", F.pmod(F.xxhash64("id", "label", "v"), F.lit(packs)).cast("bigint")
    )
    packed = dealt.groupBy("width", "pack").applyInPandas(_pack_rows, _PACKS)
    return stored(packed, "packs")


def _compared(packs: DataFrame, anchors: DataFrame, task) -> DataFrame:
    """``task`` for every pack and block of ``anchors`` of the same length.

    Anchors are a stated set of queries. They are dealt over blocks of bounded size, so
    a task holds one pack and one block.
    """
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    last = packs.agg(F.max("pack")).first()[0] or 0
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")))
    spread = anchors.withColumn("block", F.pmod(F.col("anchor"), F.lit(blocks)).cast("int"))
    spread = spread.withColumn("width", F.size("v")).withColumn("pack", number)
    keys = ["width", "pack", "block"]
    return (
        packs.select("*", every).groupBy(*keys).cogroup(spread.groupBy(*keys))
        .applyInPandas(task, _FOUND)
    )


def _task(bands_of, same: bool, k: int):
    def run(packs: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(packs) and len(anchors):
            pack = Pack(next(packs.itertuples()))
            of_label: dict[int, np.ndarray] = {}
            for a in anchors.itertuples():
                if a.label not in of_label:
                    of_label[a.label] = pack.labels == a.label
                mine = of_label[a.label] if same else ~of_label[a.label]
                rows = np.flatnonzero(mine & (pack.ids != a.id))
                anchor = Anchor(int(a.id), int(a.label), np.asarray(a.v, np.int64))
                found = _in_bands(pack, rows, anchor, bands_of(a), k)
                out += [(int(a.anchor), *f) for f in found]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _ranked(found: DataFrame, k: int, group: list[str]) -> DataFrame:
    """The ``k`` best of the packs' best, with their ``rank``."""
    order = [F.col("score").desc(), F.col("id")]
    best = top_rows(found, order, k, group, F.col("id"))
    position = F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("int")
    return best.withColumn("rank", position)


def mine(
    rows: DataFrame,
    asked: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows(id, label, v)`` are candidates, ``asked`` the anchors; ``v`` holds whole
    numbers. An anchor's positives are the ``positives`` best of its label; for each, the
    ``negatives`` best of other labels whose score is at least ``low`` and at most
    ``high`` hundredths of the positive's. Scores are inner products, ties go to the
    smaller id. Rows with a null id, label or vector or an empty vector take no part;
    rows equal in all three count once; rows of the anchor's id are neither. Several
    vectors of one id are rows, and anchors, of their own. Only vectors of one length
    are compared. Empty tables give an empty result. Scores beyond 64 bits are an error.
    """
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    kinds = [F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "v"]
    packs = index(stored(rows.where(usable).select(*kinds).distinct(), "vectors"))
    anchors = asked.where(usable).select(*kinds).distinct()
    anchors = stored(anchors.withColumn("anchor", F.xxhash64("id", "label", "v")), "anchors")
    everything = -(2**63), 2**63 - 1
    near = stored(_compared(packs, anchors, _task(lambda a: [everything], True, positives)), "near")
    best = stored(_ranked(near, positives, ["anchor"]), "positives")
    # An anchor's few positives come as two arrays; scores below zero leave an empty band.
    lists = best.groupBy("anchor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
        .alias("scores")
    )

    def bands(a):
        return [(-(-low * int(s) // 100), high * int(s) // 100) for s in a.scores]

    found = _compared(packs, anchors.join(lists, "anchor"), _task(bands, False, negatives))
    ranked = _ranked(stored(found, "negatives"), negatives, ["anchor", "place"])
    of = best.select(
        "anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return (
        ranked.join(of, ["anchor", "place"]).join(anchors.select("anchor", "id").withColumnsRenamed(
            {"id": "anchor_id"}), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"))
    )


def oracle() -> str:
    """The registered query as SQL."""
    dot = "list_inner_product({}.v, {}.v)::BIGINT"
    return f"""
    WITH e AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, {dot.format("a", "e")} AS score
        FROM a JOIN e ON a.vec_id <> e.vec_id AND len(a.v) = len(e.v)),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY anchor_id, positive_id
                                  ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
        FROM p JOIN scored s USING (anchor_id)
        WHERE NOT s.same AND 30 * positive_score <= 100 * s.score
            AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 10
    """
