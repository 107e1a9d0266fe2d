"""Model features at acceptance time: one code path for tables and streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.functions import expressions as X
from milepost.operators.distributed import known_bytes

SPLITS = ("train", "validation", "test")
# Buckets of 256 kept per split by the development sample.
SAMPLE_BUCKETS = {"train": 8, "validation": 26, "test": 20}
SAMPLE_SALT = "delivery-sample-v1"


# -- leakage ------------------------------------------------------------------------------
def leaking_columns(columns: Iterable[str]) -> list[str]:
    return sorted(set(columns) & S.POST_ACCEPT_COLUMNS)


def forbid_leakage(columns: Iterable[str]) -> None:
    """Fail at plan time if a feature list holds a column known only later."""
    found = leaking_columns(columns)
    if found:
        raise ValueError(f"known only after acceptance: {', '.join(found)}")


# -- acceptance-time columns ------------------------------------------------------------------
def add_accept_features(df: DataFrame, moment: str = "accept_timestamp") -> DataFrame:
    """Hour, ISO weekday, month, day, weekend and period of the acceptance, in UTC."""
    hour = F.hour(moment)
    weekday = X.iso_weekday(moment)
    return df.withColumns(
        {
            "accept_hour": hour,
            "accept_weekday": weekday,
            "accept_month": F.month(moment),
            "accept_day": F.dayofmonth(moment),
            "accept_is_weekend": weekday.isin(6, 7),
            "accept_period": X.day_period(hour),
        }
    )


# -- previous-day history -----------------------------------------------------------------------
def courier_history(daily: DataFrame) -> DataFrame:
    """Courier days, renamed and keyed by the day *after* (the day they serve)."""
    return daily.select(
        F.col("region_id").alias("_ch_region"),
        F.col("city").alias("_ch_city"),
        F.col("courier_id").alias("_ch_courier"),
        F.date_add(F.to_date("delivery_date"), 1).alias("_ch_day"),
        *[F.col(src).alias(name) for name, src in S.COURIER_HISTORY.items()],
    )


def city_history(daily: DataFrame) -> DataFrame:
    """City days, renamed and keyed by the day they serve."""
    return daily.select(
        F.col("region_id").alias("_th_region"),
        F.col("city").alias("_th_city"),
        F.date_add(F.to_date("delivery_date"), 1).alias("_th_day"),
        *[F.col(src).alias(name) for name, src in S.CITY_HISTORY.items()],
    )


def served_days(daily: DataFrame, first_day, last_day) -> DataFrame:
    """Only the history rows that can serve acceptances between two days.

    With a table partitioned by ``delivery_date`` the scan skips all other days.
    """
    day = F.to_date("delivery_date")
    return daily.where(day.between(F.date_sub(first_day, 1), F.date_sub(last_day, 1)))


def join_courier_history(events: DataFrame, daily: DataFrame) -> DataFrame:
    """Left join on region, city, courier and previous day.

    Unknown couriers (id 0) have no history row, yet may be a large share of
    the events; their join key gets a negative spread so that they do not meet
    in one task. Which side is broadcast, if any, is left to the size Spark
    measures, and a hot courier day is split by the adaptive skew join.
    """
    history = courier_history(daily)
    spread = -1 - F.pmod(F.xxhash64("order_id"), F.lit(1 << 20))
    key = F.when(F.col("courier_id") > 0, F.col("courier_id")).otherwise(spread)
    keyed = events.withColumns(
        {"_courier_key": key, "_accept_day": F.to_date("accept_timestamp")}
    )
    joined = keyed.join(
        history,
        (F.col("region_id") == F.col("_ch_region"))
        & (F.col("city") == F.col("_ch_city"))
        & (F.col("_courier_key") == F.col("_ch_courier"))
        & (F.col("_accept_day") == F.col("_ch_day")),
        "left",
    )
    return joined.withColumn(
        "courier_prev_day_available", F.col("_ch_courier").isNotNull()
    ).drop("_ch_region", "_ch_city", "_ch_courier", "_ch_day", "_courier_key", "_accept_day")


def join_city_history(
    events: DataFrame, daily: DataFrame, salts: int = 16, small_bytes: int = 16 << 20
) -> DataFrame:
    """Left join on region, city and previous day.

    City keys are few and hot. A history whose size Spark knows to be at most ``small_bytes``
    (a stored table, as a rule) is broadcast, and the events are not moved. A larger one, or
    one of unknown size, is joined with a salt on both sides: an event picks one of ``salts``
    by its id, and every city day (one row per key) is repeated for all of them.
    """
    if known_bytes(daily) <= small_bytes:
        joined = events.withColumn("_accept_day", F.to_date("accept_timestamp")).join(
            F.broadcast(city_history(daily)),
            (F.col("region_id") == F.col("_th_region"))
            & (F.col("city") == F.col("_th_city"))
            & (F.col("_accept_day") == F.col("_th_day")),
            "left",
        )
        return joined.withColumn("city_prev_day_available", F.col("_th_city").isNotNull()).drop(
            "_th_region", "_th_city", "_th_day", "_accept_day"
        )
    history = city_history(daily).withColumn(
        "_th_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    keyed = events.withColumns(
        {
            "_accept_day": F.to_date("accept_timestamp"),
            "_salt": F.pmod(F.xxhash64("order_id"), F.lit(salts)).cast("int"),
        }
    )
    joined = keyed.join(
        history,
        (F.col("region_id") == F.col("_th_region"))
        & (F.col("city") == F.col("_th_city"))
        & (F.col("_accept_day") == F.col("_th_day"))
        & (F.col("_salt") == F.col("_th_salt")),
        "left",
    )
    return joined.withColumn("city_prev_day_available", F.col("_th_city").isNotNull()).drop(
        "_th_region", "_th_city", "_th_day", "_th_salt", "_accept_day", "_salt"
    )


def add_history(events: DataFrame, courier: DataFrame, city: DataFrame) -> DataFrame:
    return join_city_history(join_courier_history(events, courier), city)


def realtime_features(events: DataFrame, courier: DataFrame, city: DataFrame) -> DataFrame:
    """Features of accepted events; ``events`` may be one row, a table or a stream."""
    return add_history(add_accept_features(events), courier, city)


# -- training sets ---------------------------------------------------------------------------------
def eligible(fact: DataFrame) -> DataFrame:
    """Valid durations accepted before the end of the observed period."""
    return fact.where(
        F.col("is_valid_duration")
        & (F.col("accept_timestamp") < F.lit(S.TEST_END).cast("timestamp"))
    )


def base_set(fact: DataFrame) -> DataFrame:
    """Eligible rows with acceptance-time features and the target, without history."""
    forbid_leakage(S.BASE_FEATURES)
    return add_accept_features(eligible(fact)).select(
        "order_id", "accept_timestamp", *S.BASE_FEATURES, "is_late_delivery"
    )


def training_set(fact: DataFrame, courier: DataFrame, city: DataFrame) -> DataFrame:
    """Eligible rows with all features and the target."""
    forbid_leakage(S.BASE_FEATURES + S.HISTORY_FEATURES)
    return add_history(base_set(fact), courier, city).select(
        "order_id", "accept_timestamp", *S.BASE_FEATURES, *S.HISTORY_FEATURES, "is_late_delivery"
    )


def first_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows by acceptance time and order; with a limit, only the first ones."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    ordered = df.orderBy("accept_timestamp", "order_id")
    return ordered if limit is None else ordered.limit(limit)


def split_label(moment: str = "accept_timestamp") -> Column:
    """``train`` / ``validation`` / ``test`` / ``excluded``; bounds belong to the later part."""
    t = F.col(moment)

    def before(bound):
        return t < F.lit(bound).cast("timestamp")

    return (
        F.when(before(S.TRAIN_END), "train").when(before(S.VALIDATION_END), "validation")
        .when(before(S.TEST_END), "test").otherwise("excluded")
    )


def in_split(df: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}, expected one of {', '.join(SPLITS)}")
    return df.where(split_label() == split)


def hash_sample(df: DataFrame, buckets: int, salt: str = SAMPLE_SALT) -> DataFrame:
    """Stable share ``buckets / 256`` of the rows, chosen by order id."""
    if not 1 <= buckets <= 256:
        raise ValueError("buckets must be between 1 and 256")
    return df.where(X.hash_byte("order_id", salt) < buckets)


def split_sample(df: DataFrame, split: str, salt: str = SAMPLE_SALT) -> DataFrame:
    """The development sample of one split."""
    return hash_sample(in_split(df, split), SAMPLE_BUCKETS[split], salt)


# -- model contract -----------------------------------------------------------------------------------
def model_inputs(df: DataFrame, *keep: str) -> DataFrame:
    """The 26 model inputs in fixed order; fails if one is missing."""
    S.require_columns(df, S.MODEL_INPUTS, "model inputs")
    return df.select(*keep, *S.MODEL_INPUTS)


def features_and_label(df: DataFrame, *keep: str) -> DataFrame:
    """Model inputs and a 0/1 label; a missing or other target raises when run."""
    S.require_columns(df, [*S.MODEL_INPUTS, "is_late_delivery"], "training set")
    target = F.col("is_late_delivery").cast("double")
    label = F.when(target.isin(0.0, 1.0), target).otherwise(
        F.raise_error(F.lit("the target must be 0 or 1 and not missing")).cast("double")
    )
    return df.select(*keep, *S.MODEL_INPUTS, label.alias("label"))


def class_balance(df: DataFrame) -> DataFrame:
    """Rows, late rows and late rate by split."""
    late = F.col("is_late_delivery").cast("int")
    return (
        df.groupBy(split_label().alias("split"))
        .agg(F.count("*").alias("row_count"), F.sum(late).alias("late_count"))
        .withColumn("late_rate", F.col("late_count") / F.col("row_count"))
    )
