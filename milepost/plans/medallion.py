"""Bronze, silver, fact and daily tables as one lazy plan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.functions import expressions as X
from milepost.operators import quality as Q
from milepost.sources.files import read_layer, write_layer


def add_bronze_columns(
    raw: DataFrame,
    source_sha256: Column | str,
    dataset_revision: str,
    ingested_at: str,
    source_path: Column | str = "",
) -> DataFrame:
    """Flags, parsed times, duration and lineage. ``raw`` has ``_source_row_number``.

    ``source_sha256`` is the digest of the one source file, or the column that
    :func:`milepost.sources.files.with_digests` adds.
    """
    if isinstance(source_sha256, str):
        if not re.fullmatch(r"[0-9a-fA-F]{64}", source_sha256):
            raise ValueError("source_sha256 must be 64 hexadecimal characters")
        source_sha256 = F.lit(source_sha256)
    if not dataset_revision.strip():
        raise ValueError("dataset_revision is required")
    path = F.lit(source_path) if isinstance(source_path, str) else source_path
    return (
        Q.add_warning_flags(raw)
        .withColumns(
            {
                "_source_row_number": F.col("_source_row_number").cast("bigint"),
                "_source_file": F.element_at(F.split(path, "/"), -1),
                "_source_path": path,
                "_source_sha256": F.lower(source_sha256),
                "_dataset_revision": F.lit(dataset_revision),
                "_ingested_at": F.lit(ingested_at).cast("timestamp"),
                "_quality_contract_passed": F.lit(True),
            }
        )
    )


def build_silver(
    bronze: DataFrame,
    processed_at: str,
    near_zero: float = S.NEAR_ZERO_DEGREES,
    long_minutes: float = S.LONG_DURATION_MINUTES,
) -> DataFrame:
    """Typed ids, clean positions, statuses and hours."""
    S.require_columns(bronze, S.BRONZE_REQUIRED, "bronze")
    if near_zero <= 0 or long_minutes <= 0:
        raise ValueError("thresholds must be positive")
    ids = ("order_id", "region_id", "courier_id", "aoi_id", "aoi_type", "_source_row_number")
    out = bronze.withColumns(
        {
            **{c: F.col(c).cast("bigint") for c in ids},
            "city": F.trim("city"),
            "partition_timestamp": X.parse_day_partition("ds"),
            "delivery_duration_minutes": F.col("delivery_duration_minutes").try_cast("double"),
            **{
                f"{side}_gps_valid": X.gps_usable(
                    F.col(f"{side}_gps_lng").try_cast("double"),
                    F.col(f"{side}_gps_lat").try_cast("double"),
                    near_zero,
                )
                for side in ("accept", "delivery")
            },
        }
    )
    clean = {
        f"{side}_gps_{axis}_clean": F.when(
            F.col(f"{side}_gps_valid"), F.col(f"{side}_gps_{axis}").try_cast("double")
        )
        for side in ("accept", "delivery")
        for axis in ("lng", "lat")
    }
    minutes = F.col("delivery_duration_minutes")
    status = F.col("delivery_duration_status")
    return (
        out.withColumns(clean)
        .withColumns(
            {
                "gps_quality_status": X.gps_status("accept_gps_valid", "delivery_gps_valid"),
                "delivery_duration_hours": X.half_even(minutes / 60, 3),
                "delivery_duration_status": X.duration_status(minutes, long_minutes),
                "accept_hour": F.hour("accept_timestamp"),
                "delivery_hour": F.hour("delivery_timestamp"),
                "is_quality_warning": F.coalesce(
                    F.col("_quality_status") == "warning", F.lit(False)
                ),
                "_silver_processed_at": F.lit(processed_at).cast("timestamp"),
                "_silver_version": F.lit(S.SILVER_VERSION),
            }
        )
        .withColumns(
            {
                "is_zero_or_negative_duration": status == "zero_or_negative",
                "is_long_delivery": status == "long",
            }
        )
    )


def build_fact(
    silver: DataFrame, processed_at: str, sla_minutes: float = S.DEFAULT_SLA_MINUTES
) -> DataFrame:
    """One row per delivery, 41 columns in fixed order."""
    S.require_columns(silver, S.SILVER_REQUIRED, "silver")
    if sla_minutes <= 0:
        raise ValueError("sla_minutes must be positive")
    minutes = F.col("delivery_duration_minutes")
    valid = F.coalesce(
        (F.col("delivery_duration_status") == "normal") & (minutes > 0), F.lit(False)
    )
    day = F.date_trunc("day", "partition_timestamp")
    columns = {
        "order_id": F.col("order_id").cast("bigint"),
        "delivery_date": day,
        "delivery_year": F.year(day),
        "delivery_month": F.month(day),
        "delivery_day": F.dayofmonth(day),
        "delivery_weekday": F.weekday(day),
        "is_weekend": F.weekday(day) >= 5,
        **{c: F.col(c).cast("bigint") for c in ("region_id", "courier_id", "aoi_id", "aoi_type")},
        "city": F.trim("city"),
        "accept_timestamp": F.col("accept_timestamp"),
        "delivery_timestamp": F.col("delivery_timestamp"),
        "accept_hour": F.hour("accept_timestamp"),
        "delivery_hour": F.hour("delivery_timestamp"),
        "delivery_duration_minutes": minutes,
        "delivery_duration_hours": X.half_even(minutes / 60, 3),
        "kpi_duration_minutes": F.when(valid, minutes),
        "delivery_duration_status": F.col("delivery_duration_status"),
        "is_valid_duration": valid,
        "is_within_sla": F.coalesce(valid & (minutes <= sla_minutes), F.lit(False)),
        "is_late_delivery": F.coalesce(valid & (minutes > sla_minutes), F.lit(False)),
        "sla_minutes": F.lit(float(sla_minutes)),
        **{
            f"{side}_gps_{axis}": F.col(f"{side}_gps_{axis}_clean").try_cast("double")
            for side in ("accept", "delivery")
            for axis in ("lng", "lat")
        },
        "accept_gps_valid": F.coalesce("accept_gps_valid", F.lit(False)),
        "delivery_gps_valid": F.coalesce("delivery_gps_valid", F.lit(False)),
        "has_complete_gps": F.coalesce("accept_gps_valid", F.lit(False))
        & F.coalesce("delivery_gps_valid", F.lit(False)),
        "gps_quality_status": F.col("gps_quality_status"),
        "is_quality_warning": F.coalesce("is_quality_warning", F.lit(False)),
        "quality_warning_count": F.coalesce(
            F.col("_quality_warning_count").cast("int"), F.lit(0)
        ),
        "delivery_count": F.lit(1),
        "source_file": F.col("_source_file"),
        "source_sha256": F.col("_source_sha256"),
        "dataset_revision": F.col("_dataset_revision"),
        "source_silver_version": F.col("_silver_version"),
        "_gold_processed_at": F.lit(processed_at).cast("timestamp"),
        "_gold_version": F.lit(S.GOLD_VERSION),
    }
    return silver.select(*[columns[c].alias(c) for c in S.FACT_COLUMNS])


FACT_ORDER = ("delivery_date", "city", "courier_id", "order_id")


def in_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in ranges of ``keys`` and sorted inside, so files hold narrow ranges of values."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def fact_order(fact: DataFrame) -> DataFrame:
    """The fact in (date, city, courier, order) order: range partitions, sorted inside."""
    return in_order(fact, FACT_ORDER)


_FLAG_SUMS = {
    "orders_valid_duration": "is_valid_duration",
    "orders_within_sla": "is_within_sla",
    "orders_late": "is_late_delivery",
    "orders_quality_warning": "is_quality_warning",
    "orders_gps_complete": "has_complete_gps",
}


def _daily(
    fact: DataFrame, keys: Sequence[str], distinct: dict[str, Column], sla_minutes: float
) -> DataFrame:
    """Daily measures by ``keys`` in two hash aggregations over one scan.

    Each delivery gives one plain row, one row per distinct-counted column, and
    one row for its duration. The first aggregation runs by key *and* that
    value, so a day that holds a third of all rows is spread over all tasks;
    the second sees every distinct value once per key. Valid durations lie in
    (0, 1440] minutes at second resolution, so the exact median needs at most
    86 400 weighted values per key.
    """
    none_id, none_minutes = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def part(tag, value=none_id, minutes=none_minutes):
        return F.struct(
            F.lit(tag).alias("_part"), value.alias("_id"), minutes.alias("_minutes")
        )

    parts = [part("rows")]
    parts += [part(name, value) for name, value in distinct.items()]
    parts.append(part("minutes", minutes=F.col("kpi_duration_minutes")))
    needed = [
        *keys, *_FLAG_SUMS.values(), "delivery_count", "kpi_duration_minutes",
        "accept_timestamp", "delivery_timestamp",
    ]
    plain = F.col("_part") == "rows"

    def once(c):
        return F.when(plain, c)

    spread = (
        fact.select(*needed, F.inline(F.array(*parts)))
        .groupBy(*keys, "_part", "_id", "_minutes")
        .agg(
            F.count("*").alias("_n"),
            F.sum(once(F.col("delivery_count"))).alias("orders_total"),
            *[F.count_if(plain & F.col(c)).alias(n) for n, c in _FLAG_SUMS.items()],
            F.sum(once(F.col("kpi_duration_minutes"))).alias("_total_minutes"),
            F.min(once(F.col("accept_timestamp"))).alias("first_accept_timestamp"),
            F.max(once(F.col("delivery_timestamp"))).alias("last_delivery_timestamp"),
        )
    )
    in_minutes = F.when(F.col("_part") == "minutes", F.col("_minutes"))
    valid = F.sum("orders_valid_duration")
    return (
        spread.groupBy(*keys)
        .agg(
            F.coalesce(F.sum("orders_total"), F.lit(0)).alias("orders_total"),
            *[F.sum(n).alias(n) for n in _FLAG_SUMS],
            *[F.count_if((F.col("_part") == n) & F.col("_id").isNotNull()).alias(n)
              for n in distinct],
            X.half_even(F.sum("_total_minutes") / F.nullif(valid, F.lit(0)), 3)
            .alias("avg_duration_minutes"),
            X.half_even(F.percentile(in_minutes, F.lit(0.5), F.col("_n")), 3)
            .alias("median_duration_minutes"),
            X.half_even(F.min(in_minutes), 3).alias("min_duration_minutes"),
            X.half_even(F.max(in_minutes), 3).alias("max_duration_minutes"),
            F.min("first_accept_timestamp").alias("first_accept_timestamp"),
            F.max("last_delivery_timestamp").alias("last_delivery_timestamp"),
        )
        .withColumns(
            {
                "sla_compliance_rate": X.safe_rate("orders_within_sla", "orders_valid_duration"),
                "gps_completeness_rate": X.safe_rate("orders_gps_complete", "orders_total"),
                "quality_warning_rate": X.safe_rate("orders_quality_warning", "orders_total"),
                "sla_minutes": F.lit(float(sla_minutes)),
            }
        )
    )


def _stamped(daily: DataFrame, processed_at: str) -> DataFrame:
    return daily.withColumns(
        {
            "_gold_processed_at": F.lit(processed_at).cast("timestamp"),
            "_gold_version": F.lit(S.GOLD_VERSION),
        }
    )


def known_couriers(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("courier_id") > 0)


def courier_daily(
    fact: DataFrame, processed_at: str, sla_minutes: float = S.DEFAULT_SLA_MINUTES
) -> DataFrame:
    """Daily performance of every known courier."""
    daily = _daily(
        known_couriers(fact), S.COURIER_DAY_KEYS, {"unique_aois": F.col("aoi_id")}, sla_minutes
    )
    return _stamped(daily, processed_at)


def city_daily(
    fact: DataFrame, processed_at: str, sla_minutes: float = S.DEFAULT_SLA_MINUTES
) -> DataFrame:
    """Daily performance of every city; unknown couriers count as orders, not as couriers."""
    distinct = {
        "unique_couriers": F.when(F.col("courier_id") > 0, F.col("courier_id")),
        "unique_aois": F.col("aoi_id"),
    }
    return _stamped(_daily(fact, S.CITY_DAY_KEYS, distinct, sla_minutes), processed_at)


def write_gold(
    fact: DataFrame,
    root: str,
    processed_at: str,
    sla_minutes: float = S.DEFAULT_SLA_MINUTES,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write the fact in order, then the daily tables from the written fact.

    Rows are dealt by ranges of day, city, courier and order, so every file holds a narrow
    range of them and a filter skips row groups by their statistics.
    ``partition_by=["delivery_date"]`` puts each day into a folder of its own as well, in as many
    files as its size asks for: a filter on days then does not open the other days' files. That
    is worth it once a day fills a file; below that it only makes many small files.
    The daily tables read a few columns of the stored fact, so nothing is computed twice and
    nothing needs to be cached. Returns ``(table_name, row_count, column_count)``.
    """
    if tuple(partition_by) != FACT_ORDER[: len(partition_by)]:
        raise ValueError(f"the fact is stored by {', '.join(FACT_ORDER)}, in this order")
    spark = fact.sparkSession
    path = f"{root}/delivery_fact"
    rows = write_layer(fact_order(fact), path, partition_by, arranged=True)
    done = [("delivery_fact", rows, len(fact.columns))]
    stored = read_layer(spark, path)
    for name, daily, keys in (
        ("courier_daily_performance", courier_daily(stored, processed_at, sla_minutes),
         S.COURIER_DAY_KEYS),
        ("city_daily_performance", city_daily(stored, processed_at, sla_minutes),
         S.CITY_DAY_KEYS),
    ):
        rows = write_layer(in_order(daily, keys), f"{root}/{name}")
        done.append((name, rows, len(daily.columns)))
    return spark.createDataFrame(done, "table_name string, row_count bigint, column_count bigint")


def read_fact(spark: SparkSession, root: str) -> DataFrame:
    """The stored fact with its columns in their order; a day is a folder, not the last column."""
    return read_layer(spark, f"{root}/delivery_fact", S.FACT_COLUMNS)


# -- summaries and reconciliation ------------------------------------------------------
def layer_summary(silver: DataFrame) -> DataFrame:
    return silver.agg(
        F.count("*").alias("row_count"),
        F.count_if("is_quality_warning").alias("quality_warning_row_count"),
        F.count_if(~F.col("is_quality_warning")).alias("valid_row_count"),
        F.count_if(F.col("gps_quality_status") != "complete").alias("gps_issue_row_count"),
        F.count_if(F.col("delivery_duration_status") != "normal")
        .alias("duration_issue_row_count"),
    )


def fact_kpis(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c)).alias(n) for n, c in _FLAG_SUMS.items()],
        F.count_if(F.col("courier_id") == 0).alias("zero_courier_orders"),
        F.count_if(F.col("courier_id") > 0).alias("known_courier_orders"),
        F.sum("delivery_count").alias("orders_total"),
    )


def order_total(daily: DataFrame, name: str = "orders_total") -> DataFrame:
    return daily.agg(F.coalesce(F.sum("orders_total"), F.lit(0)).alias(name))


def reconcile(fact: DataFrame, courier: DataFrame, city: DataFrame) -> DataFrame:
    """One row: totals of the three tables and whether they agree."""
    kpis = fact_kpis(fact)
    return (
        kpis.select("row_count", "known_courier_orders", "zero_courier_orders")
        .withColumn("courier_orders", order_total(courier).scalar())
        .withColumn("city_orders", order_total(city).scalar())
        .withColumns(
            {
                "courier_matches": F.col("courier_orders") == F.col("known_courier_orders"),
                "city_matches": F.col("city_orders") == F.col("row_count"),
                "couriers_complete": F.col("known_courier_orders")
                + F.col("zero_courier_orders") == F.col("row_count"),
            }
        )
    )


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """``(layer, row_count)`` and whether every layer has the rows of the first."""
    out = None
    for name, df in layers.items():
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("layer"), "row_count"
        )
        out = one if out is None else out.unionByName(one)
    first = next(iter(layers.values())).agg(F.count("*").alias("n"))
    return out.withColumn("matches_source", F.col("row_count") == first.scalar())


def consolidate(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of equally shaped tables."""
    if not parts:
        raise ValueError("nothing to consolidate")
    out, schema = parts[0], [(f.name, f.dataType) for f in parts[0].schema]
    for other in parts[1:]:
        if [(f.name, f.dataType) for f in other.schema] != schema:
            raise ValueError("tables to consolidate differ in schema")
        out = out.union(other)
    return out


def consolidate_layer(parts: Sequence[DataFrame], path: str) -> DataFrame:
    """Write the UNION ALL of ``parts`` as one layer; its rows must be the sum of theirs.

    Each part is counted while it is written. Returns ``(part, row_count)``, parts from 0.
    """
    seen = [Observation() for _ in parts]
    counted = [p.observe(o, F.count(F.lit(1)).alias("rows"))
               for p, o in zip(parts, seen, strict=True)]
    written = write_layer(consolidate(counted), path)
    rows = [o.get["rows"] for o in seen]
    if written != sum(rows):
        raise OSError(f"{path}: {written} rows of parts with {sum(rows)}")
    return parts[0].sparkSession.createDataFrame(
        list(enumerate(rows)), "part int, row_count bigint"
    )
