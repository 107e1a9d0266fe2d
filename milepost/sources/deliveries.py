"""Raw deliveries derived from an orders / customer / nation / region star schema.

Integer arithmetic only, so that any engine computes the same rows. Every
branch of the quality rules occurs: zero ids, missing and near-zero positions,
zero, long and rolled-over durations, and days that disagree with ``ds``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost import schemas as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_deliveries(spark: SparkSession, sf_dir: str, with_row: bool = False) -> DataFrame:
    """The 17 raw columns; ``with_row`` adds the position in the source file."""
    orders = table(spark, sf_dir, "orders")
    base = (
        orders.select(
            F.col("o_orderkey").alias("k"),
            F.col("o_custkey").alias("cu"),
            F.col("o_orderdate").cast("timestamp").alias("day"),
            *([F.expr("_metadata.row_index + 2").alias("_source_row_number")] if with_row else []),
        )
        .join(table(spark, sf_dir, "customer"), F.col("cu") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    minute = F.expr("k * 137 % 1440")
    lasting = F.expr(
        """CASE WHEN k % 29 = 0 THEN 0L
                WHEN k % 31 = 0 THEN 1441L + k % 500
                ELSE 15L + (k * 7919 % 20) * (k * 104729 % 20) + (cu % 8) * 6 END"""
    )
    # Every 37th order ends earlier on the same calendar day than it began.
    end_minute = F.when(F.expr("k % 37 = 0"), F.expr("(k * 137 % 1440) div 2")).otherwise(
        minute + lasting
    )
    hidden = F.expr("k % 11 = 0")
    near = F.expr("k % 13 = 0")

    def at(minutes):
        return F.timestamp_seconds(F.unix_seconds("day") + minutes * 60)

    def text(moment):
        return F.date_format(moment, "MM-dd HH:mm:ss")

    columns = {
        "order_id": F.col("k"),
        "region_id": F.col("r_regionkey").cast("bigint"),
        "city": F.when(F.expr("k % 17 = 0"), F.concat(F.lit("  "), "r_name", F.lit(" ")))
        .otherwise(F.col("r_name")),
        "courier_id": F.expr("cu % 8"),
        "lng": F.expr("100 + (k % 2000) / 100.0D"),
        "lat": F.expr("20 + (k % 3000) / 100.0D"),
        "aoi_id": F.expr("cu % 40"),
        "aoi_type": F.expr("cu % 4"),
        "accept_time": text(at(minute)),
        "accept_gps_time": text(at(minute)),
        "accept_gps_lng": F.when(hidden, None).when(near, F.lit(0.00003))
        .otherwise(F.expr("100 + (cu % 2000) / 100.0D")),
        "accept_gps_lat": F.when(hidden, None).when(near, F.lit(0.00004))
        .otherwise(F.expr("20 + (cu % 3000) / 100.0D")),
        "delivery_time": text(at(end_minute)),
        "delivery_gps_time": text(at(end_minute)),
        "delivery_gps_lng": F.when(F.expr("k % 19 = 0"), F.lit(0.00004))
        .otherwise(F.expr("100 + (k % 2000) / 100.0D")),
        "delivery_gps_lat": F.when(F.expr("k % 19 = 0"), F.lit(0.00003))
        .otherwise(F.expr("20 + (k % 3000) / 100.0D")),
        "ds": F.date_format(
            F.when(F.expr("k % 23 = 0"), F.col("day") + F.expr("INTERVAL 1 DAY"))
            .otherwise(F.col("day")), "MMdd",
        ),
    }
    kept = ["_source_row_number"] if with_row else []
    return base.select(*[columns[c].alias(c) for c in S.RAW_COLUMNS], *kept)


def duplicated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as deliveries: the order key repeats, so key rules fail."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.expr("l_partkey % 50").alias("aoi_id"),
        F.expr("l_suppkey % 10").alias("courier_id"),
        F.col("l_quantity").alias("quantity"),
    )
