"""Operational snapshot: latest prediction, observed outcome and alert per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.functions import expressions as X

ALERT_TYPE = "predicted_delay_risk"


def _moment(df: DataFrame) -> Column:
    return F.col("updated_at") if "updated_at" in df.columns else F.col("event_time")


def build_snapshot(
    latest: DataFrame, live: DataFrame, alerts: DataFrame, model_version: str
) -> DataFrame:
    """One row per order of one model version.

    ``observed`` is null until the order has a delivery event. All three joins
    are on unique ids, so no key is hot.
    """
    if not model_version.strip():
        raise ValueError("model_version is required")
    mine = F.col("model_version") == model_version
    predictions = latest.where(mine).withColumn("updated_at", _moment(latest))
    fields = [f for f in S.OBSERVED_FIELDS if f != "updated_at"]
    observed = live.select(
        F.col("order_id").alias("_order"),
        F.struct(*fields, _moment(live).alias("updated_at")).alias("observed"),
    )
    raised = (
        alerts.where(mine & (F.col("alert_type") == ALERT_TYPE))
        .select(F.col("prediction_id").alias("_alerted")).distinct()
    )
    joined = predictions.join(observed, F.col("order_id") == F.col("_order"), "left").join(
        raised, F.col("prediction_id") == F.col("_alerted"), "left"
    )
    return joined.select(
        "order_id", "source_event_time", "region_id", "city", "courier_id", "aoi_id",
        "delay_probability", "predicted_late", "threshold", "model_name", "model_version",
        "courier_prev_day_available", "city_prev_day_available",
        F.col("_alerted").isNotNull().alias("alert_active"), "updated_at", "observed",
    )


def add_states(snapshot: DataFrame) -> DataFrame:
    """Operational state, history coverage and prediction outcome."""
    late, risky = F.col("observed.is_late_delivery"), F.col("predicted_late")
    days = F.col("courier_prev_day_available").cast("int") + F.col(
        "city_prev_day_available"
    ).cast("int")
    return snapshot.withColumns(
        {
            "operational_state": F.when(late, "delivered_late").when(~late, "delivered_on_time")
            .when(risky, "at_risk").otherwise("monitored"),
            "history_coverage": F.when(days == 2, "full").when(days == 1, "partial")
            .otherwise("none"),
            "prediction_outcome": F.when(late.isNull(), "pending_observation")
            .when(risky & late, "true_positive").when(~risky & ~late, "true_negative")
            .when(risky, "false_positive").otherwise("false_negative"),
        }
    )


def invariant_counts(snapshot: DataFrame) -> DataFrame:
    """``(rule, failures)`` over the snapshot; all row rules in one pass."""
    o = {f: F.col(f"observed.{f}") for f in S.OBSERVED_FIELDS}
    p, t = F.col("delay_probability"), F.col("threshold")
    rules = {
        **{f"{c} negative": F.col(c) < 0
           for c in ("order_id", "region_id", "courier_id", "aoi_id")},
        "city empty": F.length(F.trim("city")) == 0,
        "delay_probability outside [0, 1]": ~p.between(0, 1),
        "threshold outside [0, 1]": ~t.between(0, 1),
        "model_name empty": F.length(F.trim("model_name")) == 0,
        "model_version empty": F.length(F.trim("model_version")) == 0,
        "predicted_late differs from score": F.col("predicted_late") != (p >= t),
        "alert without risk": F.col("alert_active") & ~F.col("predicted_late"),
        "observed event_id empty": F.length(F.trim(o["event_id"])) == 0,
        "observed event_type empty": F.length(F.trim(o["event_type"])) == 0,
        "observed duration negative": o["delivery_duration_minutes"] < 0,
        "observed sla not positive": o["sla_minutes"] <= 0,
        "observed within equals late": o["is_within_sla"] == o["is_late_delivery"],
        **{f"observed {side}_gps_{axis} out of range": ~X.in_range(o[f"{side}_gps_{axis}"], lim)
           for side in ("accept", "delivery") for axis, lim in (("lng", 180.0), ("lat", 90.0))},
    }
    names = list(rules)
    per_key = snapshot.groupBy("order_id", "model_version").agg(
        F.count("*").alias("copies"),
        *[F.count_if(F.coalesce(hit, F.lit(False))).alias(f"r{i}")
          for i, hit in enumerate(rules.values())],
    )
    wide = per_key.agg(
        F.count_if(F.col("copies") > 1).alias("_dup"),
        *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(names))],
    )
    pairs = F.array(
        F.struct(F.lit("order repeated for a model version").alias("rule"),
                 F.col("_dup").alias("failures")),
        *[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("failures"))
          for i, n in enumerate(names)],
    )
    return wide.select(F.inline(pairs))


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def _shared() -> list[Column]:
    return [
        F.count("*").alias("total_orders"),
        _count(F.col("predicted_late"), "at_risk_orders"),
        F.coalesce(F.avg("delay_probability"), F.lit(0.0)).alias("average_delay_probability"),
        F.coalesce(F.max("delay_probability"), F.lit(0.0)).alias("maximum_delay_probability"),
        _count(F.col("history_coverage") == "full", "full_history_orders"),
        # One field of the struct, so that the others are not shuffled; it is never null inside.
        _count(F.col("observed.event_id").isNotNull(), "observed_orders"),
        _count(F.col("observed.is_late_delivery"), "actual_late_orders"),
    ]


def summary(states: DataFrame) -> DataFrame:
    """One row of indicators; zeros for an empty snapshot."""
    counted = states.agg(
        *_shared(),
        _count(F.col("alert_active"), "active_alerts"),
        _count(F.col("prediction_outcome") != "pending_observation", "evaluated_predictions"),
    )
    return counted.withColumns(
        {
            "risk_rate": X.ratio("at_risk_orders", "total_orders"),
            "observation_rate": X.ratio("observed_orders", "total_orders"),
        }
    )


def outcome_matrix(states: DataFrame) -> DataFrame:
    """True and false positives and negatives, accuracy, precision and recall."""
    outcome = F.col("prediction_outcome")
    names = ("true_positive", "true_negative", "false_positive", "false_negative")
    counted = states.agg(
        *[_count(outcome == n, f"{n}s") for n in names],
        _count(outcome != "pending_observation", "evaluated_predictions"),
    )
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    return counted.withColumns(
        {
            "prediction_accuracy": X.ratio(tp + tn, F.col("evaluated_predictions")),
            "prediction_precision": X.ratio(tp, tp + F.col("false_positives")),
            "prediction_recall": X.ratio(tp, tp + F.col("false_negatives")),
        }
    )


def by_city(states: DataFrame) -> DataFrame:
    """Indicators and four rates per city, ordered by city."""
    return (
        states.groupBy("city").agg(*_shared())
        .withColumns(
            {
                "risk_rate": X.ratio("at_risk_orders", "total_orders"),
                "full_history_rate": X.ratio("full_history_orders", "total_orders"),
                "observation_rate": X.ratio("observed_orders", "total_orders"),
                "actual_late_rate": X.ratio("actual_late_orders", "observed_orders"),
            }
        )
        .orderBy("city")
    )
