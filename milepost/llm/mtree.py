"""Exact top-k search by inner product: M-trees of paged metric nodes.

Inner product becomes a distance if every vector gets one more component that
brings it to the same norm: then a larger product is a smaller distance, and the
triangle inequality holds. Vectors are dealt over shards of bounded size; each
shard is a tree whose pages hold a pivot, a covering radius, the distance to the
parent's pivot, and, in leaves, each vector's distance to the pivot. A query
descends best first and computes a distance only if the stored ones do not
already exclude it. The best of all shards are ranked in the end.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost.llm.text import stored
from milepost.operators.distributed import top_rows

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
PAGE = 128
FANOUT = 12

_PAGES = (
    "shard bigint, page int, parent int, leaf boolean, radius double, to_parent double, "
    "pivot binary, extra double, ids binary, vectors binary, to_pivot binary"
)


def vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """``(vec_id, v)`` with ``v = floor(scale * x)`` as integers, of the usable rows.

    Rows without vec_id or embedding, with no component, or with a component that is
    null or not finite are left out.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def _distances(m: np.ndarray, extra: np.ndarray, k: int) -> np.ndarray:
    """Distances of all rows to row ``k`` in the space with the extra component."""
    square = ((m - m[k]) ** 2).sum(1) + (extra - extra[k]) ** 2
    return np.sqrt(square)


def build(shard: int, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    """The pages of one tree, the root first."""
    norms = (m * m).sum(1)
    extra = np.sqrt(np.maximum(norms.max() - norms, 0))
    rows: list[tuple] = []

    def page(members: np.ndarray, pivot: int, parent: int, to_parent: float) -> None:
        d = _distances(m[members], extra[members], int(np.flatnonzero(members == pivot)[0]))
        number = len(rows)
        leaf = len(members) <= PAGE
        rows.append((
            shard, number, parent, leaf, float(d.max()), to_parent,
            m[pivot].astype(np.int64).tobytes(), float(extra[pivot]),
            ids[members].tobytes() if leaf else b"",
            m[members].astype(np.int64).tobytes() if leaf else b"",
            d.tobytes() if leaf else b"",
        ))
        if leaf:
            return
        # Far-apart pivots; every member goes to the nearest one.
        picks = [int(np.argmax(d))]
        nearest = _distances(m[members], extra[members], picks[0])
        table = [nearest]
        while len(picks) < FANOUT and nearest.max() > 0:
            picks.append(int(np.argmax(nearest)))
            table.append(_distances(m[members], extra[members], picks[-1]))
            nearest = np.minimum(nearest, table[-1])
        home = np.argmin(np.array(table), axis=0)
        if len(set(home.tolist())) < 2:  # equal vectors only: cut them by position
            picks = list(range(0, len(members), PAGE))
            home = np.arange(len(members)) // PAGE
        for k, pick in enumerate(picks):
            mine = members[home == k]
            if len(mine):
                page(mine, int(members[pick]), number, float(d[pick]))

    everything = np.arange(len(m))
    page(everything, 0, -1, 0.0)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGES.split(", ")])


def _build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["vec_id"], ignore_index=True, kind="stable")
    m = np.array(frame["v"].tolist(), np.float64)
    return build(int(frame["shard"].iloc[0]), frame["vec_id"].to_numpy(np.int64), m)


class Tree:
    """A tree made from its pages, for searching."""

    def __init__(self, pages: pd.DataFrame):
        pages = pages.sort_values("page", ignore_index=True)
        self.leaf = pages["leaf"].to_numpy(bool)
        self.radius = pages["radius"].to_numpy()
        self.to_parent = pages["to_parent"].to_numpy()
        self.pivots = np.stack([np.frombuffer(b, np.int64) for b in pages["pivot"]]).astype(float)
        self.extra = pages["extra"].to_numpy()
        self.top = (self.pivots[0] ** 2).sum() + self.extra[0] ** 2
        self.children: dict[int, list[int]] = {}
        for k, p in enumerate(pages["parent"]):
            self.children.setdefault(int(p), []).append(k)
        width = self.pivots.shape[1]
        read = zip(pages["ids"], pages["vectors"], pages["to_pivot"], strict=True)
        self.pages = [
            (np.frombuffer(i, np.int64), np.frombuffer(v, np.int64).reshape(-1, width).astype(float),
             np.frombuffer(d)) for i, v, d in read
        ]

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The ``k`` highest ``(score, vec_id)``, ties to the smaller id, without ``own``."""
        norm = float(query @ query)
        slack = 1e-7 * (norm + self.top + 1)
        best: list[tuple[float, int]] = []  # (score, -id), the least first

        def reach() -> float:
            """Distance beyond which nothing can enter the result."""
            if len(best) < k:
                return math.inf
            return math.sqrt(max(0.0, norm + self.top - 2 * best[0][0]) + slack)

        def distance(page: int) -> float:
            return math.sqrt(max(0.0, norm + self.top - 2 * float(query @ self.pivots[page])))

        d = distance(0)
        todo = [(max(0.0, d - self.radius[0]), 0, d)]
        while todo:
            low, page, d = heapq.heappop(todo)
            limit = reach()
            if low > limit:
                break
            if self.leaf[page]:
                ids, m, to_pivot = self.pages[page]
                near = np.flatnonzero((np.abs(d - to_pivot) <= limit) & (ids != own))
                scores = m[near] @ query
                for j in np.lexsort((ids[near], -scores))[:k]:
                    entry = (float(scores[j]), -int(ids[near[j]]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
                continue
            for child in self.children.get(page, []):
                r = self.radius[child]
                if abs(d - self.to_parent[child]) - r > limit:
                    continue
                to_child = distance(child)
                if to_child - r <= limit:
                    heapq.heappush(todo, (max(0.0, to_child - r), child, to_child))
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def _search_block(k: int):
    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(pages) and len(queries):
            tree = Tree(pages)
            for query_id, v in zip(queries["query_id"], queries["v"], strict=True):
                found = tree.search(np.asarray(v, np.float64), int(query_id), k)
                out += [(int(query_id), i, s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def index(embeddings: DataFrame) -> DataFrame:
    """Pages of the trees over all usable vectors, written to the shared folder.

    Only vectors of one length are comparable, so each length has its own shards.
    """
    rows = vectors(embeddings)
    sizes = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()}
    shards = F.lit(None).cast("bigint")
    for n, count in sizes.items():
        shards = F.when(F.size("v") == n, F.lit(-(-count // SHARD_ROWS))).otherwise(shards)
    shard = F.size("v").cast("bigint") * 2**32 + F.pmod(F.xxhash64("vec_id", "v"), shards)
    return stored(
        rows.withColumn("shard", shard).groupBy("shard").applyInPandas(_build_shard, _PAGES),
        "pages",
    )


def search(pages: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of all indexed vectors per query.

    ``queries(query_id, v)``; a vector whose vec_id is the query's is no answer. With
    fewer candidates all are returned. Repeated rows of the index are candidates each;
    a repeated query is answered once. Empty tables give an empty result.
    """
    asked = queries.distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    # One row per vector length in use.
    tops = pages.groupBy(F.shiftright("shard", 32).alias("n"))
    tops = tops.agg(F.max(F.col("shard").bitwiseAND(F.lit(2**32 - 1))).alias("top")).collect()
    last = F.lit(None).cast("bigint")
    for row in tops:
        last = F.when(F.size("v") == row["n"], F.lit(row["top"])).otherwise(last)
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("bigint"))
    spread = asked.where(last.isNotNull()).withColumn("number", number).withColumn(
        "shard", F.size("v").cast("bigint") * 2**32 + F.col("number")
    )
    all_blocks = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    copies = pages.withColumn("block", F.explode(all_blocks))
    found = (
        copies.groupBy("shard", "block")
        .cogroup(spread.groupBy("shard", "block"))
        .applyInPandas(_search_block(k), "query_id bigint, vec_id bigint, score bigint")
    )
    order = [F.col("score").desc(), F.col("vec_id")]
    best = top_rows(stored(found, "found"), order, k, ["query_id"], F.col("vec_id"))
    position = F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("int")
    return best.select("query_id", position.alias("rank"), "vec_id", "score")

