"""Column contracts, stream schemas and fixed thresholds."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Limits, versions and cut-off dates of the delivery data model.
# ---------------------------------------------------------------------------
TECHNICAL_YEAR = "2000"
PROFILE_YEAR = "1900"
DAY_MINUTES = 1440.0
LONG_DURATION_MINUTES = 1440.0
NEAR_ZERO_DEGREES = 1.0
DEFAULT_SLA_MINUTES = 240.0
SAMPLE_LIMIT = 20
SILVER_VERSION = "1.0"
GOLD_VERSION = "1.0"
FINAL_THRESHOLD = 0.246906
TRAIN_END = "2000-10-01 00:00:00"
VALIDATION_END = "2000-10-15 00:00:00"
TEST_END = "2000-11-01 00:00:00"
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "NAN",
)

# ---------------------------------------------------------------------------
# Column names and their order per table.
# ---------------------------------------------------------------------------
RAW_FIELDS = (
    ("order_id", "bigint"),
    ("region_id", "bigint"),
    ("city", "string"),
    ("courier_id", "bigint"),
    ("lng", "double"),
    ("lat", "double"),
    ("aoi_id", "bigint"),
    ("aoi_type", "bigint"),
    ("accept_time", "string"),
    ("accept_gps_time", "string"),
    ("accept_gps_lng", "double"),
    ("accept_gps_lat", "double"),
    ("delivery_time", "string"),
    ("delivery_gps_time", "string"),
    ("delivery_gps_lng", "double"),
    ("delivery_gps_lat", "double"),
    ("ds", "string"),
)
RAW_COLUMNS = tuple(name for name, _ in RAW_FIELDS)
COORDINATE_COLUMNS = (
    "lng", "lat", "accept_gps_lng", "accept_gps_lat", "delivery_gps_lng", "delivery_gps_lat",
)

WARNING_FLAGS = {
    "zero_order_id": "_warning_zero_order_id",
    "zero_courier_id": "_warning_zero_courier_id",
    "missing_accept_gps": "_warning_missing_accept_gps",
    "near_zero_accept_gps": "_warning_near_zero_accept_gps",
    "near_zero_delivery_gps": "_warning_near_zero_delivery_gps",
    "zero_or_negative_duration": "_warning_zero_or_negative_duration",
    "long_delivery_duration": "_warning_long_delivery_duration",
    "partition_accept_date_mismatch": "_warning_partition_mismatch",
}

BRONZE_REQUIRED = RAW_COLUMNS + (
    "accept_timestamp", "delivery_timestamp", "delivery_duration_minutes", "_source_row_number",
    "_source_file", "_source_sha256", "_dataset_revision", "_ingested_at", "_quality_status",
    "_quality_contract_passed",
)

SILVER_REQUIRED = (
    "order_id", "region_id", "city", "courier_id", "aoi_id", "aoi_type", "partition_timestamp",
    "accept_timestamp", "delivery_timestamp", "delivery_duration_minutes",
    "delivery_duration_status", "accept_gps_lng_clean", "accept_gps_lat_clean",
    "delivery_gps_lng_clean", "delivery_gps_lat_clean", "accept_gps_valid", "delivery_gps_valid",
    "gps_quality_status", "is_quality_warning", "_quality_warning_count", "_source_file",
    "_source_sha256", "_dataset_revision", "_silver_processed_at", "_silver_version",
)

FACT_COLUMNS = (
    "order_id", "delivery_date", "delivery_year", "delivery_month", "delivery_day",
    "delivery_weekday", "is_weekend", "region_id", "city", "courier_id", "aoi_id", "aoi_type",
    "accept_timestamp", "delivery_timestamp", "accept_hour", "delivery_hour",
    "delivery_duration_minutes", "delivery_duration_hours", "kpi_duration_minutes",
    "delivery_duration_status", "is_valid_duration", "is_within_sla", "is_late_delivery",
    "sla_minutes", "accept_gps_lng", "accept_gps_lat", "delivery_gps_lng", "delivery_gps_lat",
    "accept_gps_valid", "delivery_gps_valid", "has_complete_gps", "gps_quality_status",
    "is_quality_warning", "quality_warning_count", "delivery_count", "source_file",
    "source_sha256", "dataset_revision", "source_silver_version", "_gold_processed_at",
    "_gold_version",
)

CITY_DAY_KEYS = ("delivery_date", "region_id", "city")
COURIER_DAY_KEYS = CITY_DAY_KEYS + ("courier_id",)

PUBLISHED_TABLES = {
    "delivery_fact": {
        "required": (
            "order_id", "delivery_date", "region_id", "city", "courier_id",
            "delivery_duration_minutes", "is_valid_duration", "is_within_sla", "is_late_delivery",
            "has_complete_gps", "is_quality_warning", "delivery_count",
        ),
        "key": ("order_id",),
    },
    "courier_daily_performance": {
        "required": (
            "delivery_date", "region_id", "city", "courier_id", "orders_total",
            "orders_valid_duration", "orders_within_sla", "orders_late", "avg_duration_minutes",
            "sla_compliance_rate", "gps_completeness_rate", "quality_warning_rate",
        ),
        "key": COURIER_DAY_KEYS,
    },
    "city_daily_performance": {
        "required": (
            "delivery_date", "region_id", "city", "orders_total", "orders_valid_duration",
            "orders_within_sla", "orders_late", "unique_couriers", "avg_duration_minutes",
            "sla_compliance_rate", "gps_completeness_rate", "quality_warning_rate",
        ),
        "key": CITY_DAY_KEYS,
    },
}

# Known only after acceptance, never a model input.
POST_ACCEPT_COLUMNS = frozenset(
    (
        "delivery_timestamp", "delivery_hour", "delivery_duration_minutes",
        "delivery_duration_hours", "kpi_duration_minutes", "delivery_duration_status",
        "is_valid_duration", "is_within_sla", "is_late_delivery", "delivery_gps_lng",
        "delivery_gps_lat", "delivery_gps_valid", "has_complete_gps", "gps_quality_status",
        "is_quality_warning", "quality_warning_count",
    )
)

# History columns and model inputs, in order.
COURIER_HISTORY = {
    "courier_prev_day_orders_total": "orders_total",
    "courier_prev_day_orders_late": "orders_late",
    "courier_prev_day_avg_duration_minutes": "avg_duration_minutes",
    "courier_prev_day_sla_compliance_rate": "sla_compliance_rate",
    "courier_prev_day_quality_warning_rate": "quality_warning_rate",
}
CITY_HISTORY = {
    "city_prev_day_orders_total": "orders_total",
    "city_prev_day_orders_late": "orders_late",
    "city_prev_day_unique_couriers": "unique_couriers",
    "city_prev_day_avg_duration_minutes": "avg_duration_minutes",
    "city_prev_day_sla_compliance_rate": "sla_compliance_rate",
    "city_prev_day_quality_warning_rate": "quality_warning_rate",
}

BASE_FEATURES = (
    "region_id", "city", "courier_id", "aoi_id", "aoi_type", "sla_minutes", "accept_gps_lng",
    "accept_gps_lat", "accept_gps_valid", "accept_hour", "accept_weekday", "accept_month",
    "accept_day", "accept_is_weekend", "accept_period",
)
HISTORY_FEATURES = (
    *COURIER_HISTORY, "courier_prev_day_available", *CITY_HISTORY, "city_prev_day_available",
)

CATEGORICAL_INPUTS = ("region_id", "city", "aoi_type", "accept_period")
BOOLEAN_INPUTS = (
    "accept_gps_valid", "accept_is_weekend", "courier_prev_day_available",
    "city_prev_day_available",
)
NUMERIC_INPUTS = (
    "sla_minutes", "accept_gps_lng", "accept_gps_lat", "accept_hour", "accept_weekday",
    "accept_month", "accept_day", *COURIER_HISTORY, *CITY_HISTORY,
)
MODEL_INPUTS = NUMERIC_INPUTS + CATEGORICAL_INPUTS + BOOLEAN_INPUTS
FEATURE_METADATA = (
    "event_id", "event_type", "event_time", "source_event_time", "order_id", "courier_id",
    "aoi_id",
)

REPLAY_COLUMNS = (
    "order_id", "region_id", "city", "courier_id", "aoi_id", "aoi_type", "delivery_timestamp",
    "delivery_duration_minutes", "sla_minutes", "is_within_sla", "is_late_delivery",
    "is_quality_warning", "accept_gps_lng", "accept_gps_lat", "delivery_gps_lng",
    "delivery_gps_lat",
)


_TYPES = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "bigint": T.LongType(),
    "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def _struct(fields: str) -> T.StructType:
    pairs = (f.split() for f in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_TEXT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in RAW_COLUMNS])

# Event fields, their order and types.
DELIVERY_EVENT_SCHEMA = _struct(
    "event_id string, event_type string, event_time timestamp, source_event_time timestamp, "
    "order_id bigint, region_id bigint, city string, courier_id bigint, aoi_id bigint, "
    "aoi_type int, delivery_duration_minutes double, sla_minutes double, is_within_sla boolean, "
    "is_late_delivery boolean, is_quality_warning boolean, accept_gps_lng double, "
    "accept_gps_lat double, delivery_gps_lng double, delivery_gps_lat double"
)
ACCEPTED_EVENT_SCHEMA = _struct(
    "event_id string, event_type string, event_time timestamp, source_event_time timestamp, "
    "order_id bigint, region_id bigint, city string, courier_id bigint, aoi_id bigint, "
    "aoi_type int, sla_minutes double, accept_gps_lng double, accept_gps_lat double, "
    "accept_gps_valid boolean"
)
# The message envelope of a Kafka source.
MESSAGE_SCHEMA = _struct(
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
)
# Prediction and alert fields, their order and types.
PREDICTION_SCHEMA = _struct(
    "prediction_id string, source_event_id string, event_type string, event_time timestamp, "
    "source_event_time timestamp, order_id bigint, region_id bigint, city string, "
    "courier_id bigint, aoi_id bigint, delay_probability double, predicted_late boolean, "
    "threshold double, model_name string, model_version string, "
    "courier_prev_day_available boolean, city_prev_day_available boolean"
)
ALERT_SCHEMA = _struct(
    "alert_id string, prediction_id string, source_event_id string, event_type string, "
    "event_time timestamp, source_event_time timestamp, order_id bigint, region_id bigint, "
    "city string, courier_id bigint, aoi_id bigint, alert_type string, severity string, "
    "delay_probability double, threshold double, model_version string"
)
# Fields of the observed part of a snapshot row.
OBSERVED_FIELDS = (
    "event_id", "event_type", "event_time", "source_event_time", "aoi_type",
    "delivery_duration_minutes", "sla_minutes", "is_within_sla", "is_late_delivery",
    "is_quality_warning", "accept_gps_lng", "accept_gps_lat", "delivery_gps_lng",
    "delivery_gps_lat", "kafka_partition", "kafka_offset", "kafka_timestamp", "updated_at",
)


def require_columns(df, names, what: str = "table") -> None:
    """Fail at plan time if a needed column is absent."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
