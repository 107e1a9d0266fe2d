from datetime import datetime

import pytest
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.operators import snapshot as T
from milepost.operators import whatif as W

NOW = datetime(2024, 1, 1)


def orders(spark, rows):
    """(order, city, probability) as a snapshot without observations."""
    df = spark.createDataFrame(rows, "order_id bigint, city string, delay_probability double")
    return df.withColumns(
        {
            "source_event_time": F.lit(NOW), "region_id": F.lit(1), "courier_id": F.lit(1),
            "aoi_id": F.lit(1), "threshold": F.lit(S.FINAL_THRESHOLD),
            "predicted_late": F.col("delay_probability") >= S.FINAL_THRESHOLD,
            "model_name": F.lit("m"), "model_version": F.lit("v"),
            "courier_prev_day_available": F.lit(True), "city_prev_day_available": F.lit(False),
            "alert_active": F.lit(False), "updated_at": F.lit(NOW),
        }
    )


def outcome_snapshot(spark):
    rows = [(1, 0.8, True), (2, 0.1, False), (3, 0.8, False), (4, 0.1, True), (5, 0.9, None)]
    base = orders(spark, [(k, "Jilin", p) for k, p, _ in rows])
    latest = base.withColumn("prediction_id", F.concat(F.lit("p"), "order_id"))
    seen = [r for r in rows if r[2] is not None]
    live = spark.createDataFrame([(k, late) for k, _, late in seen], "order_id bigint, late boolean")
    columns = {
        "event_id": F.lit("e"), "event_type": F.lit("delivery_update"), "event_time": F.lit(NOW),
        "source_event_time": F.lit(NOW), "aoi_type": F.lit(1),
        "delivery_duration_minutes": F.lit(10.0), "sla_minutes": F.lit(240.0),
        "is_within_sla": ~F.col("late"), "is_late_delivery": F.col("late"),
        "is_quality_warning": F.lit(False), "accept_gps_lng": F.lit(1.0),
        "accept_gps_lat": F.lit(1.0), "delivery_gps_lng": F.lit(1.0),
        "delivery_gps_lat": F.lit(1.0), "kafka_partition": F.lit(0), "kafka_offset": F.lit(0),
        "kafka_timestamp": F.lit(NOW), "updated_at": F.lit(NOW),
    }
    live = live.withColumns(columns)
    alerts = spark.createDataFrame(
        [("p1", "v", "predicted_delay_risk"), ("p1", "v", "predicted_delay_risk"),
         ("p3", "other", "predicted_delay_risk"), ("p5", "v", "something else")],
        "prediction_id string, model_version string, alert_type string",
    )
    return T.build_snapshot(latest, live, alerts, "v")


def test_snapshot_states_and_summary(spark):
    states = T.add_states(outcome_snapshot(spark))
    rows = {r["order_id"]: r for r in states.collect()}
    assert [rows[i]["prediction_outcome"] for i in range(1, 6)] == [
        "true_positive", "true_negative", "false_positive", "false_negative",
        "pending_observation"]
    assert [rows[i]["operational_state"] for i in (1, 2, 5)] == [
        "delivered_late", "delivered_on_time", "at_risk"]
    assert [rows[i]["alert_active"] for i in range(1, 6)] == [True, False, False, False, False]
    assert rows[5]["observed"] is None and rows[1]["history_coverage"] == "partial"
    one = T.summary(states).first()
    assert (one["total_orders"], one["at_risk_orders"], one["observed_orders"]) == (5, 3, 4)
    assert (one["active_alerts"], one["evaluated_predictions"]) == (1, 4)
    matrix = T.outcome_matrix(states).first()
    assert (matrix["prediction_accuracy"], matrix["prediction_precision"]) == (0.5, 0.5)
    city = T.by_city(states).first()
    assert (city["actual_late_rate"], city["full_history_rate"]) == (0.5, 0.0)


def test_empty_snapshot_gives_zeros(spark):
    empty = outcome_snapshot(spark).where("false")
    one = T.summary(T.add_states(empty)).first()
    assert (one["total_orders"], one["risk_rate"], one["average_delay_probability"]) == (0, 0, 0)
    rows = W.scenario_summary(empty, W.STANDARD_CAMPAIGN).collect()
    assert len(rows) == 11 and all(r["simulated_at_risk"] == 0 for r in rows)


def test_invariants(spark):
    good = outcome_snapshot(spark)
    assert T.invariant_counts(good).where("failures > 0").count() == 0
    bad = good.unionByName(good.where("order_id = 1")).withColumn(
        "predicted_late", F.when(F.col("order_id") == 2, True).otherwise(F.col("predicted_late"))
    )
    rules = {r["rule"]: r["failures"] for r in T.invariant_counts(bad).where("failures > 0").collect()}
    assert rules == {
        "order repeated for a model version": 1, "predicted_late differs from score": 1
    }


def small(spark):
    return orders(spark, [(1, "Jilin", 0.20), (2, "Jilin", 0.40), (3, "Yantai", 0.10)])


def test_scenarios_move_risk_with_pressure(spark):
    campaign = [W.Scenario("a", demand=0.5), W.Scenario("b"), W.Scenario("c", demand=1.5),
                W.Scenario("d", demand=4.0)]
    rows = {r["scenario"]: r for r in W.scenario_summary(small(spark), campaign).collect()}
    risks = [rows[n]["simulated_at_risk"] for n in "abcd"]
    assert risks == sorted(risks) and risks[-1] == 3
    means = [rows[n]["simulated_average_probability"] for n in "abcd"]
    assert means == sorted(means)
    assert rows["b"]["average_probability_delta"] == pytest.approx(0.0)
    assert rows["c"]["simulated_demand_units"] == pytest.approx(4.5)
    both = W.best_and_worst(W.scenario_summary(small(spark), campaign)).first()
    assert (both["best"]["scenario"], both["worst"]["scenario"]) == ("a", "d")


def test_local_scenario_leaves_other_cities(spark):
    scored = W.score_scenarios(small(spark), [W.Scenario("x", demand=2.0, city="Jilin")])
    rows = {r["order_id"]: r for r in scored.collect()}
    assert not rows[3]["scenario_applied"] and rows[3]["simulated_probability"] == 0.10
    assert rows[1]["became_at_risk"] and not rows[2]["became_at_risk"]


@pytest.mark.parametrize(
    "values",
    [{"name": " "}, {"name": "x", "demand": 0}, {"name": "x", "strength": -1},
     {"name": "x", "city": " "}],
)
def test_scenario_parameters_are_checked(values):
    with pytest.raises(ValueError):
        W.Scenario(**values)


def test_campaign_rules(spark):
    with pytest.raises(ValueError, match="unique"):
        W.score_scenarios(small(spark), [W.Scenario("x"), W.Scenario("x")])
    with pytest.raises(ValueError, match="at least one"):
        W.score_scenarios(small(spark), [])
    assert W.standard_campaign("Jilin")[-1].name == "jilin_local_stress"


def test_capacity_grid_is_exact_and_ends_at_the_maximum():
    assert W.CapacityProblem("x", capacity_max=1.2, capacity_step=0.1).capacities() == [
        1.0, 1.1, 1.2]
    assert W.CapacityProblem("x", capacity_max=1.25, capacity_step=0.1).capacities() == [
        1.0, 1.1, 1.2, 1.25]
    assert W.CapacityProblem("x", capacity_max=1.0).capacities() == [1.0]
    with pytest.raises(ValueError):
        W.CapacityProblem("x", capacity_min=0.9)


def five(spark):
    return orders(spark, [(1, "Jilin", 0.20), (2, "Jilin", 0.24), (3, "Jilin", 0.40),
                          (4, "Yantai", 0.10), (5, "Yantai", 0.30)])


def test_decision_without_target_takes_least_risk(spark):
    problem = W.CapacityProblem("x", demand=1.2, budget=0.25)
    d = W.decide(five(spark), problem)
    assert d["recommended"]["capacity_multiplier"] == pytest.approx(1.25)
    assert d["reference"]["capacity_multiplier"] == 1.0
    assert d["risk_reduction"] >= 0 and d["target_met"]


def test_decision_with_target_takes_the_cheapest(spark):
    easy = W.CapacityProblem("x", demand=1.2, budget=0.5, max_risk_rate=0.8)
    d = W.decide(five(spark), easy)
    assert d["target_met"] and d["recommended"]["capacity_multiplier"] == 1.0
    hard = W.CapacityProblem("x", demand=1.2, budget=0.1, max_risk_rate=0.0)
    d = W.decide(five(spark), hard)
    assert not d["target_met"]
    assert d["recommended"]["intervention_cost"] <= 0.1 + 1e-12


def test_local_cost_counts_affected_share_only(spark):
    problem = W.CapacityProblem("x", city="Yantai", capacity_min=1.5, capacity_max=1.5)
    row = W.capacity_candidates(five(spark), problem).first()
    assert row["intervention_cost"] == pytest.approx(0.5 * 2 / 5)


def test_no_candidate_in_budget_is_an_error(spark):
    problem = W.CapacityProblem("x", capacity_min=1.5, budget=0.0)
    with pytest.raises(ValueError, match="budget"):
        W.decide(five(spark), problem)
