"""Ordered computations over groups of any size.

A plain window puts one group into one task. The functions here split a group
into ordered slices first, so that no task ever holds a whole hot group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost.session import durable

_SLICE = "_slice"


def _matched(right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` with prefixed keys, and the null-safe condition to join it."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return renamed, cond


def known_bytes(df: DataFrame) -> int:
    """The size that the optimizer knows of ``df``: of its files, if it is a stored table.

    A table that is still to be computed is as large as the product of its inputs there, so
    what passes a limit by this figure is small.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    totals: Mapping[str, Column],
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums in ``order_by`` order within each group.

    The rows are range-partitioned by group and order, each slice gets its own
    running sums, and the totals of the slices before it (one row per slice and
    group) are added. ``order_by`` must be a total order within the group.

    The slice number must not change if a task is run again, so the ranged
    rows are materialised once in the shared folder.
    """
    groups = list(group_by)
    inputs = {f"_in_{name}": col for name, col in totals.items()}
    ranged = durable(
        df.withColumns(inputs)
        .repartitionByRange(*[F.col(g).asc_nulls_first() for g in groups], *order_by)
        .withColumn(_SLICE, F.spark_partition_id())
    )
    before = W.partitionBy(*groups, F.lit(0)).orderBy(_SLICE).rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*groups, _SLICE)
        .agg(*[F.sum(c).alias(f"_sum{c}") for c in inputs])
        .withColumns({f"_off{c}": F.coalesce(F.sum(f"_sum{c}").over(before), F.lit(0))
                      for c in inputs})
        .drop(*[f"_sum{c}" for c in inputs])
    )
    inside = (
        W.partitionBy(*groups, _SLICE).orderBy(*order_by)
        .rowsBetween(W.unboundedPreceding, 0)
    )
    local = ranged.withColumns({f"_run{c}": F.sum(c).over(inside) for c in inputs})
    offsets, cond = _matched(offsets, [*groups, _SLICE])
    return local.join(offsets, cond, "left").select(
        *df.columns,
        *[(F.col(f"_run_in_{n}") + F.col(f"_off_in_{n}")).alias(n) for n in totals],
    )


def row_positions(
    df: DataFrame, order_by: Sequence[Column], group_by: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """``row_number()`` over groups of any size."""
    return running_totals(df, order_by, {name: F.lit(1).cast("bigint")}, group_by)


def dense_ranks(
    df: DataFrame,
    order_by: Mapping[str, Column],
    group_by: Sequence[str],
    name: str,
) -> DataFrame:
    """``dense_rank()`` over groups of any size.

    ``order_by`` maps column names to their sort expression. Ties are one rank,
    so the distinct order values are numbered and joined back.
    """
    columns = list(order_by)
    distinct = df.select(*group_by, *columns).distinct()
    ranked = row_positions(distinct, list(order_by.values()), group_by, name)
    ranked, cond = _matched(ranked, [*group_by, *columns])
    return df.join(ranked, cond, "left").select(*df.columns, name)


def top_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    limit: int,
    group_by: Sequence[str],
    spread: Column,
    buckets: int = 64,
) -> DataFrame:
    """First ``limit`` rows per group, ranked in two steps.

    ``spread`` is hashed into buckets; each (group, bucket) keeps its own first
    rows, then at most ``buckets * limit`` rows per group are ranked again.
    """
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    for keys in ([*group_by, "_bucket"], list(group_by)):
        ranked = W.partitionBy(*keys).orderBy(*order_by)
        salted = (
            salted.withColumn("_rank", F.row_number().over(ranked))
            .where(F.col("_rank") <= limit).drop("_rank")
        )
    return salted.drop("_bucket")


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(name, median)`` per column: the exact median of its non-null values.

    Values are counted first, then ranked by running totals, so neither a hot
    value nor a column with very many values ends in one task.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
          for c in columns]
    )
    counted = (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("name", "value").agg(F.count("*").alias("n"))
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    return names.join(counted_medians(counted), "name", "left")


def counted_medians(counted: DataFrame) -> DataFrame:
    """``(name, median)`` from distinct ``(name, value, n)`` counts; averages the middle two."""
    ranked = running_totals(counted, [F.col("value").asc()], {"upto": F.col("n")}, ["name"])
    sizes = ranked.groupBy("name").agg(F.max("upto").alias("rows"))
    low, high = F.expr("(rows - 1) div 2"), F.expr("rows div 2")
    middle = ranked.join(sizes, "name").where(
        (F.col("upto") - F.col("n") <= high) & (F.col("upto") - 1 >= low)
    )
    return middle.groupBy("name").agg(
        ((F.min("value") + F.max("value")) / 2).alias("median")
    )
