"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Equal texts form a group that stays in one shard, unless it alone is more than a
shard's equal part; then its rows are dealt in pieces. Groups are packed where the dot
product of their demand with the shards' residual capacity is highest. Packing
runs in buckets of groups, one task each; the filled bins of many buckets are then
packed as whole items by the same rule, so that the buckets' remainders cancel, level
by level until one task holds all bins that are left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from milepost.llm.text import stored

#: Groups of a bucket, about.
BUCKET_GROUPS = 4096
#: So many bins are packed by one task; more of them take one level more.
TASK_BINS = 1 << 18
#: Bins of a bucket for each shard.
FINE = 4
_SIZES = ["size", "tokens", "n_rows"]


def pack(demand: np.ndarray, bins: int, start: np.ndarray | None = None) -> np.ndarray:
    """The bin of each item: the highest dot product with the residual capacity.

    Demands are scaled so that each dimension sums to one; capacity is an equal
    part of what all items need. Large items go first. An item that fits no bin
    in some dimension still goes where the product is highest.
    """
    scaled = demand / np.maximum(demand.sum(0), 1e-12)
    rest = np.full((bins, demand.shape[1]), 1.0 / bins)
    out = np.zeros(len(demand), np.int64)
    for k in np.argsort(-scaled.max(1), kind="stable"):
        out[k] = best = int(np.argmax(rest @ scaled[k]))
        rest[best] -= scaled[k]
    return out


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row of ``docs``.

    The law is ``bytes``: sizes (UTF-8 bytes of the text plus one) are near equal,
    and so are words and rows as far as groups allow. ``slot`` counts the rows of a
    shard from 0 without gaps, in order of doc_id. A null text counts as empty. A
    null doc_id comes first. Repeated rows are rows; other columns are ignored; an
    empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("tokens"),
            F.unhex(F.sha2(text, 256)).alias("blob"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size").alias("size")).first()
    most = max(1.0, (total.size or 0) / shards)
    # At most as many groups as shards are larger than that, so this side is small.
    groups = rows.groupBy("blob").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")
    )
    groups = stored(groups.withColumn("pieces", F.ceil(F.col("size") / most)), "groups")
    large = groups.where("pieces > 1").select("blob", "pieces")
    buckets = max(1, math.ceil(groups.count() / BUCKET_GROUPS))
    # The pieces of a large group are dealt over its rows, by their number within
    # small cells; nothing counts the group in one place.
    cells = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4096))
    dealt = rows.join(F.broadcast(large), "blob", "left").withColumn(
        "piece", F.when(F.col("pieces") > 1, F.pmod(cells, "pieces")).otherwise(0).cast("bigint")
    )
    items = dealt.groupBy("blob", "piece").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")
    )
    items = items.withColumn(
        "bucket", F.pmod(F.xxhash64("blob", "piece"), F.lit(buckets)).cast("int")
    )

    def one_bucket(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["blob", "piece"], ignore_index=True)
        frame["bin"] = pack(frame[_SIZES].to_numpy(float), shards * FINE)
        return frame

    kinds = "blob binary, piece bigint, size bigint, tokens bigint, n_rows bigint, bucket int"
    filled = stored(items.groupBy("bucket").applyInPandas(one_bucket, f"{kinds}, bin int"), "bins")
    bins = _merged(_totals(filled), buckets, shards)
    homes = filled.select("blob", "piece", "bucket", "bin").join(bins, ["bucket", "bin"])
    placed = dealt.join(homes.select("blob", "piece", "shard"), ["blob", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard"
    )
    return _slots(stored(placed, "placed"))


def _totals(filled: DataFrame) -> DataFrame:
    return filled.groupBy("bucket", "bin").agg(*[F.sum(c).alias(c) for c in _SIZES])


def _bins_into(size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bucket", "bin"], ignore_index=True)
        frame["up_bin"] = pack(frame[_SIZES].to_numpy(float), size)
        return frame

    return run


def _merged(bins: DataFrame, buckets: int, shards: int) -> DataFrame:
    """``(bucket, bin, shard)`` of every bin: bins of many buckets become bins of one.

    A level leaves one bucket of a task's bins, at least two, so the levels are few:
    one for 33 million groups in eight shards, two for 270 thousand million.
    """
    merge = max(2, TASK_BINS // (shards * FINE))
    levels = []
    while True:
        last = buckets <= merge
        buckets = 1 if last else math.ceil(buckets / merge)
        moved = bins.withColumn("up", F.pmod("bucket", F.lit(buckets))).groupBy("up").applyInPandas(
            _bins_into(shards if last else shards * FINE),
            "bucket int, bin int, size bigint, tokens bigint, n_rows bigint, up int, up_bin int",
        )
        if last:
            break
        moved = stored(moved, "level")
        levels.append(moved.select("bucket", "bin", "up", "up_bin"))
        bins = _totals(moved.select(F.col("up").alias("bucket"), F.col("up_bin").alias("bin"), *_SIZES))
    homes = moved.select("bucket", "bin", F.col("up_bin").alias("shard"))
    for level in reversed(levels):
        above = homes.select(F.col("bucket").alias("up"), F.col("bin").alias("up_bin"), "shard")
        homes = level.join(above, ["up", "up_bin"]).select("bucket", "bin", "shard")
    return homes


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard in ranges of doc_id, one task each."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranged = stored(
        placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    inside = F.row_number().over(W.partitionBy("shard", "part").orderBy(*order))
    return ranged.withColumn("k", inside).join(counts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("o") + F.col("k") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
