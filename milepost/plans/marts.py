"""Staging views, the three marts and their declared checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.functions import expressions as X
from milepost.operators.distributed import dense_ranks


def _city_text() -> Column:
    return F.coalesce(F.trim("city"), F.lit(""))


def stage_fact(fact: DataFrame) -> DataFrame:
    return fact.withColumn("city", F.trim("city"))


def stage_courier_daily(daily: DataFrame) -> DataFrame:
    key = X.key_hash(
        X.utc_text("delivery_date"), F.col("region_id").cast("string"), _city_text(),
        F.col("courier_id").cast("string"),
    )
    return daily.withColumns({"courier_daily_key": key, "city": F.trim("city")})


def stage_city_daily(daily: DataFrame) -> DataFrame:
    key = X.key_hash(
        X.utc_text("delivery_date"), F.col("region_id").cast("string"), _city_text()
    )
    return daily.withColumns({"city_daily_key": key, "city": F.trim("city")})


def _rates(orders: str = "orders_total") -> dict[str, Column]:
    return {
        "sla_compliance_rate": X.mart_rate("orders_within_sla", "orders_valid_duration"),
        "gps_completeness_rate": X.mart_rate("orders_gps_complete", orders),
        "quality_warning_rate": X.mart_rate("orders_quality_warning", orders),
    }


def delivery_overview(staged_fact: DataFrame) -> DataFrame:
    """Daily counts, mean duration and rates by city, straight from the fact."""
    valid = F.col("is_valid_duration")
    grouped = staged_fact.groupBy("delivery_date", "region_id", "city").agg(
        F.sum("delivery_count").alias("orders_total"),
        F.count("*").alias("_rows"),
        F.count_if(valid).alias("orders_valid_duration"),
        F.count_if("is_within_sla").alias("orders_within_sla"),
        F.count_if("is_late_delivery").alias("orders_late"),
        F.count_if("has_complete_gps").alias("orders_gps_complete"),
        F.count_if("is_quality_warning").alias("orders_quality_warning"),
        F.sum(F.when(valid, F.col("delivery_duration_minutes"))).alias("_minutes"),
    )
    key = X.key_hash(
        X.utc_text("delivery_date"), F.col("region_id").cast("string"), F.col("city")
    )
    return grouped.withColumns(
        {
            "delivery_overview_key": key,
            "avg_duration_minutes": X.mart_mean("_minutes", "orders_valid_duration"),
            **_rates("_rows"),
        }
    ).drop("_minutes", "_rows")


_SUMS = (
    "orders_total", "orders_valid_duration", "orders_within_sla", "orders_late",
    "orders_gps_complete", "orders_quality_warning",
)


def _weighted() -> Column:
    weighted = F.sum(F.col("avg_duration_minutes") * F.col("orders_valid_duration"))
    return weighted.alias("_minutes")


def city_performance(staged_city: DataFrame) -> DataFrame:
    """All days of a city: sums, active days, busiest day, weighted mean and rates."""
    grouped = staged_city.groupBy("region_id", "city").agg(
        F.min("delivery_date").alias("first_delivery_date"),
        F.max("delivery_date").alias("last_delivery_date"),
        F.count_distinct("delivery_date").alias("active_days"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.max("unique_couriers").alias("max_daily_couriers"),
        _weighted(),
    )
    return grouped.withColumns(
        {
            "city_performance_key": X.key_hash(F.col("region_id").cast("string"), F.col("city")),
            "avg_duration_minutes": X.mart_mean("_minutes", "orders_valid_duration"),
            **_rates(),
        }
    ).drop("_minutes")


def courier_performance(staged_courier: DataFrame) -> DataFrame:
    """All days of a courier in a city."""
    grouped = staged_courier.groupBy("region_id", "city", "courier_id").agg(
        *[F.sum(c).alias(c) for c in _SUMS], _weighted()
    )
    return grouped.withColumns(
        {"avg_duration_minutes": X.mart_mean("_minutes", "orders_valid_duration"), **_rates()}
    ).drop("_minutes")


def courier_ranking(staged_courier: DataFrame) -> DataFrame:
    """Couriers ranked in their city; a missing rate ranks first, a missing mean last."""
    ranked = dense_ranks(
        courier_performance(staged_courier),
        {
            "sla_compliance_rate": F.col("sla_compliance_rate").desc_nulls_first(),
            "orders_total": F.col("orders_total").desc_nulls_first(),
            "avg_duration_minutes": F.col("avg_duration_minutes").asc_nulls_last(),
        },
        ["region_id", "city"],
        "city_rank",
    )
    key = X.key_hash(
        F.col("region_id").cast("string"), F.col("city"), F.col("courier_id").cast("string")
    )
    return ranked.withColumn("courier_ranking_key", key)


# ---------------------------------------------------------------------------
# The declared checks of the published and derived tables.
# ---------------------------------------------------------------------------
DURATION_STATUSES = ("normal", "zero_or_negative", "long", "missing")
GPS_STATUSES = (
    "complete", "missing_or_invalid_accept", "missing_or_invalid_delivery",
    "missing_or_invalid_both",
)


def _not_null(*columns: str) -> list[dict]:
    return [{"kind": "not_null", "column": c} for c in columns]


def _unique(column: str) -> list[dict]:
    return [{"kind": "unique", "column": column}]


_FACT_CHECKS = [
    *_not_null("order_id", "delivery_date", "city", "courier_id", "delivery_duration_status",
               "gps_quality_status", "delivery_count"),
    *_unique("order_id"),
    {"kind": "accepted_values", "column": "delivery_duration_status",
     "values": DURATION_STATUSES},
    {"kind": "accepted_values", "column": "gps_quality_status", "values": GPS_STATUSES},
    {"kind": "accepted_values", "column": "delivery_count", "values": (1,)},
]

DECLARED_CHECKS = {
    "delivery_fact": _FACT_CHECKS + _not_null("_gold_processed_at"),
    "courier_daily_performance": _not_null(
        "delivery_date", "region_id", "city", "courier_id", "orders_total",
        "sla_compliance_rate", "_gold_processed_at",
    ),
    "city_daily_performance": _not_null(
        "delivery_date", "region_id", "city", "orders_total", "unique_couriers",
        "sla_compliance_rate", "_gold_processed_at",
    ),
    "stg_delivery_fact": _FACT_CHECKS,
    "stg_courier_daily_performance": _unique("courier_daily_key") + _not_null(
        "courier_daily_key", "delivery_date", "city", "courier_id", "orders_total",
        "sla_compliance_rate",
    ),
    "stg_city_daily_performance": _unique("city_daily_key") + _not_null(
        "city_daily_key", "delivery_date", "city", "orders_total", "unique_couriers",
        "sla_compliance_rate",
    ),
    "mart_delivery_overview": _unique("delivery_overview_key") + _not_null(
        "delivery_overview_key", "delivery_date", "city", "orders_total",
    ) + [{"kind": "not_null", "column": "sla_compliance_rate",
          "where": "orders_valid_duration > 0"}],
    "mart_courier_ranking": _unique("courier_ranking_key") + _not_null(
        "courier_ranking_key", "courier_id", "city", "orders_total", "city_rank",
    ),
    "mart_city_performance": _unique("city_performance_key") + _not_null(
        "city_performance_key", "city", "orders_total", "active_days", "sla_compliance_rate",
    ),
}
