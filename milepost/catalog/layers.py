"""The layers every registered query starts from, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.operators import quality as Q
from milepost.plans import medallion
from milepost.session import configure, fresh_path, path_exists
from milepost.sources.deliveries import raw_deliveries

REVISION = "rev-1"
SHA256 = "0" * 64
SOURCE = "raw/orders.parquet"
PROCESSED = "2001-01-01 00:00:00"
# Ids of one raw CSV file.
SLICE = 1 << 14


# -- Spark ---------------------------------------------------------------------------
def shared_plan(build):
    """Keep the plan (not the rows) per session and input, so it is analysed once."""
    plans: dict[tuple, DataFrame] = {}

    def get(spark: SparkSession, sf: str, *args, **kwargs) -> DataFrame:
        key = (id(spark), spark.sparkContext.applicationId, sf, args, *kwargs.items())
        configure(spark)
        if key not in plans:
            plans[key] = build(spark, sf, *args, **kwargs)
        return plans[key]

    return get


@shared_plan
def raw(spark: SparkSession, sf: str, with_row: bool = False) -> DataFrame:
    return raw_deliveries(configure(spark), sf, with_row)


def sliced_csv(spark: SparkSession, sf: str) -> str:
    """The raw deliveries as sorted CSV files, one for each city and slice of order ids.

    A city's rows lie in as many files as its ids need slices, so no task writes a whole city.
    """
    path = fresh_path(spark, "sliced-csv")
    parts = raw(spark, sf).withColumns(
        {"part": F.trim("city"), "slice": F.expr(f"order_id div {SLICE}")}
    )
    (
        parts.repartition("part", "slice").sortWithinPartitions("part", "slice", "order_id")
        .write.partitionBy("part", "slice")
        .options(header=True, nullValue="nan", ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
    return path


@shared_plan
def bronze(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.add_bronze_columns(
        raw(spark, sf, with_row=True), SHA256, REVISION, PROCESSED, SOURCE
    )


@shared_plan
def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return Q.add_warning_flags(raw(spark, sf))


@shared_plan
def silver(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.build_silver(bronze(spark, sf), PROCESSED)


@shared_plan
def fact(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.build_fact(silver(spark, sf), PROCESSED)


_roots: dict[tuple, str] = {}


def gold_root(spark: SparkSession, sf: str) -> str:
    """Where the gold tables of this input are stored; they are written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _roots or not path_exists(spark, _roots[key]):
        root = fresh_path(configure(spark), "gold")
        medallion.write_gold(fact(spark, sf), root, PROCESSED)
        _roots[key] = root
    return _roots[key]


def stored_fact(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.read_fact(spark, gold_root(spark, sf))


def stored_courier_daily(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{gold_root(spark, sf)}/courier_daily_performance")


def stored_city_daily(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{gold_root(spark, sf)}/city_daily_performance")


@shared_plan
def courier_daily(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.courier_daily(fact(spark, sf), PROCESSED)


@shared_plan
def city_daily(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.city_daily(fact(spark, sf), PROCESSED)


def day_columns_as_text(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that any client shows the same value."""
    return df.withColumns(
        {
            f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
            for f in df.schema
            if f.dataType.typeName() in ("timestamp", "timestamp_ntz")
        }
    )


# -- SQL text --------------------------------------------------------------------------
_RAW = """
raw0 AS (
  SELECT o_orderkey AS k, o_custkey AS cu, o_orderdate AS d0, r_regionkey, r_name,
    o_orderkey * 137 % 1440 AS m0,
    CASE WHEN o_orderkey % 29 = 0 THEN 0
         WHEN o_orderkey % 31 = 0 THEN 1441 + o_orderkey % 500
         ELSE 15 + (o_orderkey * 7919 % 20) * (o_orderkey * 104729 % 20) + (o_custkey % 8) * 6
    END AS lasting
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT k AS order_id, CAST(r_regionkey AS BIGINT) AS region_id,
    CASE WHEN k % 17 = 0 THEN '  ' || r_name || ' ' ELSE r_name END AS city,
    cu % 8 AS courier_id, 100 + (k % 2000) / 100.0::DOUBLE AS lng,
    20 + (k % 3000) / 100.0::DOUBLE AS lat, cu % 40 AS aoi_id, cu % 4 AS aoi_type,
    strftime(d0 + to_minutes(m0), '%m-%d %H:%M:%S') AS accept_time,
    strftime(d0 + to_minutes(m0), '%m-%d %H:%M:%S') AS accept_gps_time,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 0.00003::DOUBLE
         ELSE 100 + (cu % 2000) / 100.0::DOUBLE END AS accept_gps_lng,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 0.00004::DOUBLE
         ELSE 20 + (cu % 3000) / 100.0::DOUBLE END AS accept_gps_lat,
    strftime(d0 + to_minutes(CASE WHEN k % 37 = 0 THEN m0 // 2 ELSE m0 + lasting END),
             '%m-%d %H:%M:%S') AS delivery_time,
    strftime(d0 + to_minutes(CASE WHEN k % 37 = 0 THEN m0 // 2 ELSE m0 + lasting END),
             '%m-%d %H:%M:%S') AS delivery_gps_time,
    CASE WHEN k % 19 = 0 THEN 0.00004::DOUBLE ELSE 100 + (k % 2000) / 100.0::DOUBLE END
      AS delivery_gps_lng,
    CASE WHEN k % 19 = 0 THEN 0.00003::DOUBLE ELSE 20 + (k % 3000) / 100.0::DOUBLE END
      AS delivery_gps_lat,
    strftime(CASE WHEN k % 23 = 0 THEN d0 + INTERVAL 1 DAY ELSE d0 END, '%m%d') AS ds,
    k + 2 AS _source_row_number
  FROM raw0)"""

_FLAGGED = """
timed AS (
  SELECT *, try_strptime('2000-' || accept_time, '%Y-%m-%d %H:%M:%S') AS accept_timestamp,
    try_strptime('2000-' || accept_gps_time, '%Y-%m-%d %H:%M:%S') AS accept_gps_timestamp,
    try_strptime('2000-' || delivery_time, '%Y-%m-%d %H:%M:%S') AS delivery_timestamp,
    try_strptime('2000-' || delivery_gps_time, '%Y-%m-%d %H:%M:%S') AS delivery_gps_timestamp
  FROM raw),
lasted AS (
  SELECT *, CASE WHEN delivery_timestamp < accept_timestamp
      THEN date_diff('second', accept_timestamp, delivery_timestamp) / 60.0::DOUBLE + 1440
      ELSE date_diff('second', accept_timestamp, delivery_timestamp) / 60.0::DOUBLE END
    AS delivery_duration_minutes
  FROM timed),
flagged0 AS (
  SELECT *,
    coalesce(order_id = 0, false) AS _warning_zero_order_id,
    coalesce(courier_id = 0, false) AS _warning_zero_courier_id,
    accept_gps_lng IS NULL AND accept_gps_lat IS NULL AS _warning_missing_accept_gps,
    accept_gps_lng IS NOT NULL AND accept_gps_lat IS NOT NULL
      AND (abs(accept_gps_lng) < 1 OR abs(accept_gps_lat) < 1) AS _warning_near_zero_accept_gps,
    coalesce(abs(delivery_gps_lng) < 1, false) OR coalesce(abs(delivery_gps_lat) < 1, false)
      AS _warning_near_zero_delivery_gps,
    coalesce(delivery_duration_minutes <= 0, false) AS _warning_zero_or_negative_duration,
    coalesce(delivery_duration_minutes > 1440, false) AS _warning_long_delivery_duration,
    coalesce(ds <> substr(accept_time, 1, 2) || substr(accept_time, 4, 2), false)
      AS _warning_partition_mismatch
  FROM lasted),
flagged1 AS (
  SELECT *, _warning_zero_order_id::INT + _warning_zero_courier_id::INT
    + _warning_missing_accept_gps::INT + _warning_near_zero_accept_gps::INT
    + _warning_near_zero_delivery_gps::INT + _warning_zero_or_negative_duration::INT
    + _warning_long_delivery_duration::INT + _warning_partition_mismatch::INT
    AS _quality_warning_count FROM flagged0),
flagged AS (
  SELECT *, CASE WHEN _quality_warning_count > 0 THEN 'warning' ELSE 'valid' END
    AS _quality_status FROM flagged1)"""

_SILVER = f"""
silver0 AS (
  SELECT * REPLACE (trim(city) AS city),
    try_strptime('2000' || ds, '%Y%m%d') AS partition_timestamp,
    coalesce(abs(accept_gps_lng) >= 1 AND abs(accept_gps_lat) >= 1
      AND accept_gps_lng BETWEEN -180 AND 180 AND accept_gps_lat BETWEEN -90 AND 90, false)
      AS accept_gps_valid,
    coalesce(abs(delivery_gps_lng) >= 1 AND abs(delivery_gps_lat) >= 1
      AND delivery_gps_lng BETWEEN -180 AND 180 AND delivery_gps_lat BETWEEN -90 AND 90, false)
      AS delivery_gps_valid
  FROM flagged),
silver AS (
  SELECT *,
    CASE WHEN accept_gps_valid THEN accept_gps_lng END AS accept_gps_lng_clean,
    CASE WHEN accept_gps_valid THEN accept_gps_lat END AS accept_gps_lat_clean,
    CASE WHEN delivery_gps_valid THEN delivery_gps_lng END AS delivery_gps_lng_clean,
    CASE WHEN delivery_gps_valid THEN delivery_gps_lat END AS delivery_gps_lat_clean,
    CASE WHEN accept_gps_valid AND delivery_gps_valid THEN 'complete'
         WHEN delivery_gps_valid THEN 'missing_or_invalid_accept'
         WHEN accept_gps_valid THEN 'missing_or_invalid_delivery'
         ELSE 'missing_or_invalid_both' END AS gps_quality_status,
    round_even(delivery_duration_minutes / 60 * 1000, 0) / 1000 AS delivery_duration_hours,
    CASE WHEN delivery_duration_minutes IS NULL THEN 'missing'
         WHEN delivery_duration_minutes <= 0 THEN 'zero_or_negative'
         WHEN delivery_duration_minutes > 1440 THEN 'long' ELSE 'normal' END
      AS delivery_duration_status,
    CAST(hour(accept_timestamp) AS INT) AS accept_hour,
    CAST(hour(delivery_timestamp) AS INT) AS delivery_hour,
    _quality_status = 'warning' AS is_quality_warning
  FROM silver0),
fact0 AS (
  SELECT *, delivery_duration_status = 'normal' AND delivery_duration_minutes > 0
    AS is_valid_duration, date_trunc('day', partition_timestamp)::TIMESTAMP AS delivery_date
  FROM silver),
fact AS (
  SELECT order_id, delivery_date, CAST(year(delivery_date) AS INT) AS delivery_year,
    CAST(month(delivery_date) AS INT) AS delivery_month,
    CAST(day(delivery_date) AS INT) AS delivery_day,
    CAST(isodow(delivery_date) - 1 AS INT) AS delivery_weekday,
    isodow(delivery_date) >= 6 AS is_weekend, region_id, city, courier_id, aoi_id, aoi_type,
    accept_timestamp, delivery_timestamp, accept_hour, delivery_hour,
    delivery_duration_minutes, delivery_duration_hours,
    CASE WHEN is_valid_duration THEN delivery_duration_minutes END AS kpi_duration_minutes,
    delivery_duration_status, is_valid_duration,
    is_valid_duration AND delivery_duration_minutes <= 240 AS is_within_sla,
    is_valid_duration AND delivery_duration_minutes > 240 AS is_late_delivery,
    240.0::DOUBLE AS sla_minutes, accept_gps_lng_clean AS accept_gps_lng,
    accept_gps_lat_clean AS accept_gps_lat, delivery_gps_lng_clean AS delivery_gps_lng,
    delivery_gps_lat_clean AS delivery_gps_lat, accept_gps_valid, delivery_gps_valid,
    accept_gps_valid AND delivery_gps_valid AS has_complete_gps, gps_quality_status,
    is_quality_warning, _quality_warning_count AS quality_warning_count, 1 AS delivery_count,
    'orders.parquet' AS source_file, '{SHA256}' AS source_sha256,
    '{REVISION}' AS dataset_revision, '1.0' AS source_silver_version,
    TIMESTAMP '{PROCESSED}' AS _gold_processed_at, '1.0' AS _gold_version
  FROM fact0)"""

_MEASURES = f"""
    count(*) AS orders_total,
    count(*) FILTER (WHERE is_valid_duration) AS orders_valid_duration,
    count(*) FILTER (WHERE is_within_sla) AS orders_within_sla,
    count(*) FILTER (WHERE is_late_delivery) AS orders_late,
    count(*) FILTER (WHERE is_quality_warning) AS orders_quality_warning,
    count(*) FILTER (WHERE has_complete_gps) AS orders_gps_complete,
    count(DISTINCT aoi_id) AS unique_aois,
    round_even(avg(kpi_duration_minutes) * 1000, 0) / 1000 AS avg_duration_minutes,
    round_even(median(kpi_duration_minutes) * 1000, 0) / 1000 AS median_duration_minutes,
    round_even(min(kpi_duration_minutes) * 1000, 0) / 1000 AS min_duration_minutes,
    round_even(max(kpi_duration_minutes) * 1000, 0) / 1000 AS max_duration_minutes,
    min(accept_timestamp) AS first_accept_timestamp,
    max(delivery_timestamp) AS last_delivery_timestamp,
    CASE WHEN count(*) FILTER (WHERE is_valid_duration) > 0 THEN round_even(
      count(*) FILTER (WHERE is_within_sla)::DOUBLE
      / count(*) FILTER (WHERE is_valid_duration) * 100 * 100, 0) / 100 ELSE 0 END
      AS sla_compliance_rate,
    round_even(count(*) FILTER (WHERE has_complete_gps)::DOUBLE / count(*) * 100 * 100, 0) / 100
      AS gps_completeness_rate,
    round_even(count(*) FILTER (WHERE is_quality_warning)::DOUBLE / count(*) * 100 * 100, 0)
      / 100 AS quality_warning_rate,
    240.0::DOUBLE AS sla_minutes, TIMESTAMP '{PROCESSED}' AS _gold_processed_at,
    '1.0' AS _gold_version"""

_DAILY = f"""
courier_daily AS (
  SELECT delivery_date, region_id, city, courier_id, {_MEASURES}
  FROM fact WHERE courier_id > 0 GROUP BY ALL),
city_daily AS (
  SELECT delivery_date, region_id, city,
    count(DISTINCT CASE WHEN courier_id > 0 THEN courier_id END) AS unique_couriers, {_MEASURES}
  FROM fact GROUP BY ALL)"""

# exact decimal rounding, half away from zero, by integer arithmetic
RATE = "(20000 * ({n}) + ({d})) // nullif(2 * ({d}), 0) / 100.0::DOUBLE"
MEAN = "round(CAST(({n}) / nullif(({d}), 0) AS DECIMAL(30,12)), 2)::DOUBLE"


def _rates(orders: str = "orders_total") -> str:
    pairs = {
        "sla_compliance_rate": ("orders_within_sla", "orders_valid_duration"),
        "gps_completeness_rate": ("orders_gps_complete", orders),
        "quality_warning_rate": ("orders_quality_warning", orders),
    }
    return ", ".join(f"{RATE.format(n=n, d=d)} AS {k}" for k, (n, d) in pairs.items())


_SUMS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}"
    for c in ("orders_total", "orders_valid_duration", "orders_within_sla", "orders_late",
              "orders_gps_complete", "orders_quality_warning")
)
_DATE_TEXT = "strftime(delivery_date, '%Y-%m-%d %H:%M:%S') || '+00'"

_MARTS = f"""
stg_courier AS (
  SELECT md5({_DATE_TEXT} || '||' || region_id || '||' || coalesce(city, '') || '||'
    || courier_id) AS courier_daily_key, * FROM courier_daily),
stg_city AS (
  SELECT md5({_DATE_TEXT} || '||' || region_id || '||' || coalesce(city, ''))
    AS city_daily_key, * FROM city_daily),
overview0 AS (
  SELECT delivery_date, region_id, city, count(*) AS orders_total,
    count(*) FILTER (WHERE is_valid_duration) AS orders_valid_duration,
    count(*) FILTER (WHERE is_within_sla) AS orders_within_sla,
    count(*) FILTER (WHERE is_late_delivery) AS orders_late,
    count(*) FILTER (WHERE has_complete_gps) AS orders_gps_complete,
    count(*) FILTER (WHERE is_quality_warning) AS orders_quality_warning,
    sum(delivery_duration_minutes) FILTER (WHERE is_valid_duration) AS mins
  FROM fact GROUP BY ALL),
mart_overview AS (
  SELECT md5({_DATE_TEXT} || '||' || region_id || '||' || city) AS delivery_overview_key,
    * EXCLUDE (mins), {MEAN.format(n="mins", d="orders_valid_duration")} AS avg_duration_minutes,
    {_rates()} FROM overview0),
city0 AS (
  SELECT region_id, city, min(delivery_date) AS first_delivery_date,
    max(delivery_date) AS last_delivery_date, count(DISTINCT delivery_date) AS active_days,
    {_SUMS}, max(unique_couriers) AS max_daily_couriers,
    sum(city_daily.avg_duration_minutes * city_daily.orders_valid_duration) AS mins
  FROM city_daily GROUP BY region_id, city),
mart_city AS (
  SELECT md5(region_id || '||' || city) AS city_performance_key, * EXCLUDE (mins),
    {MEAN.format(n="mins", d="orders_valid_duration")} AS avg_duration_minutes, {_rates()}
  FROM city0),
courier0 AS (
  SELECT region_id, city, courier_id, {_SUMS},
    sum(courier_daily.avg_duration_minutes * courier_daily.orders_valid_duration) AS mins
  FROM courier_daily GROUP BY region_id, city, courier_id),
courier_performance AS (
  SELECT * EXCLUDE (mins), {MEAN.format(n="mins", d="orders_valid_duration")}
    AS avg_duration_minutes, {_rates()} FROM courier0),
mart_courier AS (
  SELECT md5(region_id || '||' || city || '||' || courier_id) AS courier_ranking_key, *,
    dense_rank() OVER (PARTITION BY region_id, city ORDER BY sla_compliance_rate DESC NULLS FIRST,
      orders_total DESC NULLS FIRST, avg_duration_minutes ASC NULLS LAST) AS city_rank
  FROM courier_performance)"""


def _csv_cell(name: str, kind: str) -> str:
    """A value as the CSV writer shows it: small fractions in its own notation."""
    text = f"CAST({name} AS VARCHAR)"
    if kind == "double":
        text = f"replace(replace({text}, '3e-05', '3.0E-5'), '4e-05', '4.0E-5')"
    return f"coalesce({text}, 'nan')"


# Lines and contents of the files of sliced_csv.
SLICED_SQL = f"""
csv_lines AS (
  SELECT trim(city) AS part, order_id // {SLICE} AS slice, order_id,
    row_number() OVER (PARTITION BY trim(city), order_id // {SLICE} ORDER BY order_id) + 1
      AS _source_row_number,
    {" || ',' || ".join(_csv_cell(c, k) for c, k in S.RAW_FIELDS)} AS line FROM raw),
csv_files AS (
  SELECT part, slice, '{",".join(S.RAW_COLUMNS)}' || chr(10)
    || string_agg(line, chr(10) ORDER BY order_id) || chr(10) AS body
  FROM csv_lines GROUP BY part, slice)"""


def over(layer: str, body: str, *extra: str) -> str:
    """``body`` after the common table expressions up to ``layer``."""
    chain = [_RAW, _FLAGGED, _SILVER, _DAILY, _MARTS]
    depth = {"raw": 1, "flagged": 2, "fact": 3, "daily": 4, "marts": 5}[layer]
    return "WITH " + ",".join([*chain[:depth], *extra]) + "\n" + body


_TS = ("delivery_date", "accept_timestamp", "delivery_timestamp", "first_accept_timestamp",
       "last_delivery_timestamp", "_gold_processed_at", "first_delivery_date",
       "last_delivery_date", "partition_timestamp", "accept_gps_timestamp",
       "delivery_gps_timestamp", "_ingested_at", "_silver_processed_at", "source_event_time",
       "event_time", "kafka_timestamp")


def text_dates(*columns: str) -> str:
    """A ``REPLACE`` list that shows timestamps as text."""
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in columns)
