"""Snapshot, scenarios and capacity search on a formula score."""

from __future__ import annotations

from pyspark.sql import functions as F

from milepost.catalog import layers as L
from milepost.catalog.layers import over
from milepost.catalog.registry import query
from milepost.operators import snapshot as T
from milepost.operators import whatif as W
from milepost.operators.distributed import row_positions
from milepost.streaming import events as E

VERSION = "formula-v1"
NOW = "2024-01-01 00:00:00"
CITY = "ASIA"


# -- inputs -----------------------------------------------------------------------------------
def state_tables(spark, sf, all_rows: bool = False):
    """Latest predictions of two model versions, live status, and alerts, by formula."""
    k = F.col("order_id")
    m = F.expr("(order_id * 7919 + courier_id * 31) % 1001")
    now = F.lit(NOW).cast("timestamp")
    fact = L.stored_fact(spark, sf)
    scored = fact.select(
        k, F.col("accept_timestamp").alias("source_event_time"), "region_id", "city",
        "courier_id", "aoi_id", (m * m / 1000000.0).alias("delay_probability"),
        (k % 3 != 0).alias("courier_prev_day_available"),
        (k % 10 != 0).alias("city_prev_day_available"),
    )
    versions = F.array(F.lit(VERSION), F.when(k % 2 == 0, F.lit("formula-v0")))
    latest = (
        scored.withColumn("model_version", F.explode(F.array_compact(versions)))
        .withColumns(
            {
                "prediction_id": F.concat_ws(":", "model_version", k.cast("string")),
                "threshold": F.lit(0.246906),
                "predicted_late": F.col("delay_probability") >= 0.246906,
                "model_name": F.lit("formula"),
                "updated_at": now,
            }
        )
    )
    seen = fact.where(k % 3 != 0)
    if not all_rows:
        seen = seen.where("is_valid_duration")
    live = E.delivery_events(seen, event_time=now).withColumns(
        {
            "kafka_partition": F.lit(0), "kafka_offset": k, "kafka_timestamp": now,
            "updated_at": now,
        }
    )
    alerts = latest.where(F.col("predicted_late") & (k % 4 != 0)).select(
        "prediction_id", "model_version", F.lit("predicted_delay_risk").alias("alert_type")
    )
    return latest, live, alerts


def snapshot(spark, sf, all_rows: bool = False):
    return T.build_snapshot(*state_tables(spark, sf, all_rows), VERSION)


SNAPSHOT_SQL = """scored AS (
  SELECT order_id, region_id, city, courier_id, aoi_id, accept_timestamp,
    ((order_id * 7919 + courier_id * 31) % 1001) * ((order_id * 7919 + courier_id * 31) % 1001)
      / 1000000.0::DOUBLE AS delay_probability,
    order_id % 3 <> 0 AS courier_prev_day_available,
    order_id % 10 <> 0 AS city_prev_day_available,
    order_id % 3 <> 0 AND is_valid_duration AS seen, is_late_delivery, is_within_sla,
    delivery_duration_minutes, is_valid_duration
  FROM fact),
snap AS (
  SELECT *, delay_probability >= 0.246906::DOUBLE AS predicted_late,
    delay_probability >= 0.246906::DOUBLE AND order_id % 4 <> 0 AS alert_active,
    CASE WHEN seen THEN is_late_delivery END AS late FROM scored),
states AS (
  SELECT *, CASE WHEN late THEN 'delivered_late' WHEN NOT late THEN 'delivered_on_time'
      WHEN predicted_late THEN 'at_risk' ELSE 'monitored' END AS operational_state,
    CASE WHEN courier_prev_day_available AND city_prev_day_available THEN 'full'
         WHEN courier_prev_day_available OR city_prev_day_available THEN 'partial'
         ELSE 'none' END AS history_coverage,
    CASE WHEN late IS NULL THEN 'pending_observation'
         WHEN predicted_late AND late THEN 'true_positive'
         WHEN NOT predicted_late AND NOT late THEN 'true_negative'
         WHEN predicted_late THEN 'false_positive' ELSE 'false_negative' END
      AS prediction_outcome
  FROM snap)"""


def _round(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- snapshot -----------------------------------------------------------------------------------
@query(
    "tw01_snapshot",
    over("fact", f"""SELECT order_id,
  strftime(accept_timestamp, '%Y-%m-%d %H:%M:%S') AS source_event_time, region_id, city,
  courier_id, aoi_id, delay_probability, predicted_late, 0.246906::DOUBLE AS threshold,
  'formula' AS model_name, '{VERSION}' AS model_version, courier_prev_day_available,
  city_prev_day_available, alert_active, '{NOW}' AS updated_at FROM snap""", SNAPSHOT_SQL),
)
def tw01(spark, sf):
    return snapshot(spark, sf).drop("observed").orderBy("order_id")


@query(
    "tw02_observed_part",
    over("fact", """SELECT order_id, seen AS has_observation,
  CASE WHEN seen THEN 'delivery_update' END AS event_type,
  CASE WHEN seen THEN delivery_duration_minutes END AS delivery_duration_minutes FROM snap""",
         SNAPSHOT_SQL),
)
def tw02(spark, sf):
    return snapshot(spark, sf).select(
        "order_id", F.col("observed").isNotNull().alias("has_observation"),
        "observed.event_type", "observed.delivery_duration_minutes",
    )


def _state_query(name: str, column: str):
    sql = over("fact", f"SELECT order_id, {column} FROM states", SNAPSHOT_SQL)

    @query(name, sql)
    def run(spark, sf):
        return T.add_states(snapshot(spark, sf)).select("order_id", column)

    return run


_state_query("tw03_operational_state", "operational_state")
_state_query("tw04_history_coverage", "history_coverage")
_state_query("tw05_prediction_outcome", "prediction_outcome")


@query(
    "jn06_prediction_live_join",
    over("fact", """SELECT order_id, CASE WHEN seen THEN order_id::DOUBLE END AS kafka_offset
  FROM snap""", SNAPSHOT_SQL),
)
def jn06(spark, sf):
    offset = F.col("observed.kafka_offset").cast("double").alias("kafka_offset")
    return snapshot(spark, sf).select("order_id", offset)


@query("jn07_alert_exists", over("fact", "SELECT order_id, alert_active FROM snap", SNAPSHOT_SQL))
def jn07(spark, sf):
    return snapshot(spark, sf).select("order_id", "alert_active")


@query(
    "flt08_model_version",
    over("fact", f"""SELECT v AS model_version, count(*) AS row_count FROM fact,
  (VALUES ('{VERSION}'), ('formula-v0')) AS t(v)
  WHERE v = '{VERSION}' OR order_id % 2 = 0 GROUP BY 1"""),
)
def flt08(spark, sf):
    tables = state_tables(spark, sf)
    out = None
    for version in (VERSION, "formula-v0"):
        one = T.build_snapshot(*tables, version).groupBy("model_version").agg(
            F.count("*").alias("row_count")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "srt04_snapshot_order",
    over("fact", "SELECT order_id, row_number() OVER (ORDER BY order_id) AS position FROM snap",
         SNAPSHOT_SQL),
)
def srt04(spark, sf):
    from milepost.operators.distributed import row_positions

    rows = snapshot(spark, sf).select("order_id")
    return row_positions(rows, [F.col("order_id").asc()])


_SHARED_SQL = """count(*) AS total_orders,
  count(*) FILTER (WHERE predicted_late) AS at_risk_orders,
  round(avg(delay_probability), 9) AS average_delay_probability,
  max(delay_probability) AS maximum_delay_probability,
  count(*) FILTER (WHERE history_coverage = 'full') AS full_history_orders,
  count(*) FILTER (WHERE seen) AS observed_orders,
  count(*) FILTER (WHERE late) AS actual_late_orders,
  round(count(*) FILTER (WHERE predicted_late) / count(*)::DOUBLE, 9) AS risk_rate,
  round(count(*) FILTER (WHERE seen) / count(*)::DOUBLE, 9) AS observation_rate"""


@query(
    "agg13_snapshot_summary",
    over("fact", f"""SELECT {_SHARED_SQL}, count(*) FILTER (WHERE alert_active) AS active_alerts,
  count(*) FILTER (WHERE prediction_outcome <> 'pending_observation') AS evaluated_predictions
  FROM states""", SNAPSHOT_SQL),
)
def agg13(spark, sf):
    one = T.summary(T.add_states(snapshot(spark, sf)))
    return _round(one, "average_delay_probability", "risk_rate", "observation_rate")


@query(
    "agg14_outcome_matrix",
    over("fact", """SELECT *, evaluated AS evaluated_predictions,
  round((true_positives + true_negatives) / evaluated::DOUBLE, 9) AS prediction_accuracy,
  round(true_positives / (true_positives + false_positives)::DOUBLE, 9) AS prediction_precision,
  round(true_positives / (true_positives + false_negatives)::DOUBLE, 9) AS prediction_recall
  FROM (SELECT count(*) FILTER (WHERE prediction_outcome = 'true_positive') AS true_positives,
    count(*) FILTER (WHERE prediction_outcome = 'true_negative') AS true_negatives,
    count(*) FILTER (WHERE prediction_outcome = 'false_positive') AS false_positives,
    count(*) FILTER (WHERE prediction_outcome = 'false_negative') AS false_negatives,
    count(*) FILTER (WHERE prediction_outcome <> 'pending_observation') AS evaluated
    FROM states)""".replace("SELECT *,", "SELECT * EXCLUDE (evaluated),", 1), SNAPSHOT_SQL),
)
def agg14(spark, sf):
    one = T.outcome_matrix(T.add_states(snapshot(spark, sf)))
    return _round(one, "prediction_accuracy", "prediction_precision", "prediction_recall")


@query(
    "agg15_snapshot_by_city",
    over("fact", f"""SELECT city, {_SHARED_SQL},
  round(count(*) FILTER (WHERE history_coverage = 'full') / count(*)::DOUBLE, 9)
    AS full_history_rate,
  round(count(*) FILTER (WHERE late) / nullif(count(*) FILTER (WHERE seen), 0)::DOUBLE, 9)
    AS actual_late_rate FROM states GROUP BY city""", SNAPSHOT_SQL),
)
def agg15(spark, sf):
    rows = T.by_city(T.add_states(snapshot(spark, sf)))
    return _round(rows, "average_delay_probability", "risk_rate", "observation_rate",
                  "full_history_rate", "actual_late_rate")


@query(
    "dq28_snapshot_invariants",
    over("fact", """SELECT 'observed within equals late' AS rule, count(*) AS failures FROM fact
  WHERE order_id % 3 <> 0 AND is_within_sla = is_late_delivery"""),
)
def dq28(spark, sf):
    """Orders with an unusable duration are neither within nor late, which the rule finds."""
    return T.invariant_counts(snapshot(spark, sf, all_rows=True)).where("failures > 0")


# -- scenarios ---------------------------------------------------------------------------------
def _values(scenarios) -> str:
    rows = ", ".join(
        f"('{s.name}', {repr(s.city) if s.city else 'NULL'}, {s.demand!r}::DOUBLE, "
        f"{s.capacity!r}::DOUBLE, {s.sla!r}::DOUBLE, {s.strength!r}::DOUBLE)"
        for s in scenarios
    )
    return f"(VALUES {rows}) AS s(scenario, target_city, demand, capacity, sla, strength)"


def simulated_sql(scenarios) -> str:
    return f"""shifted AS (
  SELECT snap.*, s.*, demand / capacity / sla AS pressure_factor,
    target_city IS NULL OR city = target_city AS applied,
    ln(delay_probability) - ln(1 - delay_probability) + strength * ln(demand / capacity / sla)
      AS z
  FROM (SELECT * REPLACE (CASE WHEN delay_probability > 0 AND delay_probability < 1
          THEN delay_probability END AS delay_probability), delay_probability AS p0 FROM snap)
    AS snap, {_values(scenarios)}),
sim AS (
  SELECT *, CASE WHEN NOT applied OR z IS NULL OR strength = 0 THEN p0
    ELSE 1 / (1 + exp(-z)) END AS p1,
    CASE WHEN NOT applied OR z IS NULL OR strength = 0 THEN p0
    ELSE 1 / (1 + exp(-z)) END >= 0.246906::DOUBLE AS late1 FROM shifted)"""


ALL = W.standard_campaign(CITY)

_SUMMARY_COLS = """count(*) AS total_orders, count(*) FILTER (WHERE applied) AS affected_orders,
  round(sum(CASE WHEN applied THEN demand ELSE 1 END), 6) AS simulated_demand_units,
  count(*) FILTER (WHERE predicted_late) AS baseline_at_risk,
  count(*) FILTER (WHERE late1) AS simulated_at_risk,
  count(*) FILTER (WHERE late1 AND NOT predicted_late) AS newly_at_risk,
  count(*) FILTER (WHERE predicted_late AND NOT late1) AS recovered_from_risk,
  round(avg(p0), 9) AS baseline_average_probability,
  round(avg(p1), 9) AS simulated_average_probability,
  count(*) FILTER (WHERE late1) - count(*) FILTER (WHERE predicted_late) AS at_risk_delta,
  round(count(*) FILTER (WHERE predicted_late) / count(*)::DOUBLE, 9) AS baseline_risk_rate,
  round(count(*) FILTER (WHERE late1) / count(*)::DOUBLE, 9) AS simulated_risk_rate,
  round(count(*) FILTER (WHERE late1) / count(*)::DOUBLE
    - count(*) FILTER (WHERE predicted_late) / count(*)::DOUBLE, 9) AS risk_rate_delta,
  round(avg(p1) - avg(p0), 9) AS average_probability_delta"""
_ROUNDED = (
    "baseline_average_probability", "simulated_average_probability", "baseline_risk_rate",
    "simulated_risk_rate", "risk_rate_delta", "average_probability_delta",
)


def _shown(df):
    return _round(df, *_ROUNDED).withColumn(
        "simulated_demand_units", F.round("simulated_demand_units", 6)
    )


@query(
    "tw06_pressure_factor",
    over("fact", """SELECT scenario, demand / capacity / sla AS pressure_factor,
  count(*) FILTER (WHERE applied) AS affected_orders FROM sim GROUP BY 1, 2""",
         SNAPSHOT_SQL, simulated_sql(ALL)),
)
def tw06(spark, sf):
    rows = W.scenario_summary(snapshot(spark, sf), ALL)
    return rows.select("scenario", "pressure_factor", "affected_orders")


@query(
    "tw07_scenario_scores",
    over("fact", """SELECT order_id, scenario, p0 AS baseline_probability,
  round(p1, 9) AS simulated_probability, predicted_late AS baseline_predicted_late,
  late1 AS simulated_predicted_late, applied AS scenario_applied,
  round(p1 - p0, 9) AS probability_delta, late1 AND NOT predicted_late AS became_at_risk,
  predicted_late AND NOT late1 AS recovered_from_risk FROM sim""",
         SNAPSHOT_SQL, simulated_sql(ALL)),
)
def tw07(spark, sf):
    """Every order under every scenario of the campaign."""
    rows = W.score_scenarios(snapshot(spark, sf), ALL).select(
        "order_id", "scenario", "baseline_probability", "simulated_probability",
        "baseline_predicted_late", "simulated_predicted_late", "scenario_applied",
        "probability_delta", "became_at_risk", "recovered_from_risk",
    )
    return _round(rows, "simulated_probability", "probability_delta")


@query(
    "flt07_city_target",
    over("fact", "SELECT scenario, city, count(*) FILTER (WHERE applied) AS affected FROM sim "
         "GROUP BY 1, 2", SNAPSHOT_SQL, simulated_sql(ALL)),
)
def flt07(spark, sf):
    scored = W.score_scenarios(snapshot(spark, sf), ALL)
    return scored.groupBy("scenario", "city").agg(
        F.count_if("scenario_applied").alias("affected")
    )


@query(
    "jn10_orders_by_scenarios",
    over("fact", "SELECT scenario, count(*) AS row_count FROM sim GROUP BY 1", SNAPSHOT_SQL,
         simulated_sql(ALL)),
)
def jn10(spark, sf):
    scored = W.score_scenarios(snapshot(spark, sf), ALL)
    return scored.groupBy("scenario").agg(F.count("*").alias("row_count"))


@query(
    "tw08_scenario_summary",
    over("fact", f"""SELECT scenario, target_city, {_SUMMARY_COLS}, pressure_factor FROM sim
  GROUP BY scenario, target_city, pressure_factor""", SNAPSHOT_SQL, simulated_sql(ALL)),
)
def tw08(spark, sf):
    return _shown(W.scenario_summary(snapshot(spark, sf), ALL))


@query(
    "tw09_scenario_by_city",
    over("fact", f"SELECT scenario, city, {_SUMMARY_COLS} FROM sim GROUP BY scenario, city",
         SNAPSHOT_SQL, simulated_sql(ALL)),
)
def tw09(spark, sf):
    return _shown(W.scenario_by_city(snapshot(spark, sf), ALL))


@query(
    "tw10_campaign",
    over("fact", f"""SELECT scenario, target_city, {_SUMMARY_COLS}, pressure_factor FROM sim
  GROUP BY scenario, target_city, pressure_factor""", SNAPSHOT_SQL, simulated_sql(ALL)),
)
def tw10(spark, sf):
    """The whole campaign and a local stress, in one job."""
    return _shown(W.scenario_summary(snapshot(spark, sf), ALL))


_CAMPAIGN = f"""campaign AS (
  SELECT scenario, pressure_factor, {_SUMMARY_COLS} FROM sim GROUP BY scenario, pressure_factor)"""


@query(
    "win08_best_and_worst",
    over("fact", """SELECT (SELECT scenario FROM campaign ORDER BY simulated_at_risk,
  simulated_average_probability, pressure_factor, scenario LIMIT 1) AS best,
  (SELECT scenario FROM campaign ORDER BY simulated_at_risk DESC,
  simulated_average_probability DESC, pressure_factor DESC, scenario DESC LIMIT 1) AS worst""",
         SNAPSHOT_SQL, simulated_sql(ALL), _CAMPAIGN),
)
def win08(spark, sf):
    both = W.best_and_worst(W.scenario_summary(snapshot(spark, sf), ALL))
    return both.select(
        F.col("best.scenario").alias("best"), F.col("worst.scenario").alias("worst")
    )


def _ranked_sql(direction: str) -> str:
    keys = ("simulated_at_risk", "simulated_average_probability", "scenario")
    return over(
        "fact",
        "SELECT scenario, simulated_at_risk, row_number() OVER (ORDER BY "
        + ", ".join(f"{k} {direction}" for k in keys) + ") AS position FROM campaign",
        SNAPSHOT_SQL, simulated_sql(ALL), _CAMPAIGN,
    )


def _risk_query(name: str, descending: bool):
    @query(name, _ranked_sql("DESC" if descending else "ASC"))
    def run(spark, sf):
        rows = W.by_risk(W.scenario_summary(snapshot(spark, sf), ALL), descending)
        keys = ("simulated_at_risk", "simulated_average_probability", "scenario")
        order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
        numbered = row_positions(rows, order)
        return numbered.select("scenario", "simulated_at_risk", "position")

    return run


_risk_query("srt03_risk_ascending", False)
_risk_query("srt03_risk_descending", True)


# -- capacity ----------------------------------------------------------------------------------
# With and without a target, for all cities and for one; the last step is shorter.
FREE = W.CapacityProblem("free", demand=1.2, capacity_step=0.07, budget=0.25)
AIMED = W.CapacityProblem("aimed", demand=1.5, budget=0.4, max_risk_rate=0.55)
LOCAL = W.CapacityProblem("local", demand=1.3, city=CITY, budget=0.02, max_risk_rate=0.1)


def _candidate_sql(problem) -> str:
    scenarios = problem.scenarios()
    target = "true"
    if problem.max_risk_rate is not None:
        target = f"simulated_risk_rate <= {problem.max_risk_rate!r}::DOUBLE + 1e-12::DOUBLE"
    return simulated_sql(scenarios) + f""",
candidates0 AS (
  SELECT capacity AS capacity_multiplier, pressure_factor, count(*) AS total_orders,
    count(*) FILTER (WHERE applied) AS affected_orders,
    count(*) FILTER (WHERE predicted_late) AS baseline_at_risk,
    count(*) FILTER (WHERE predicted_late) / count(*)::DOUBLE AS baseline_risk_rate,
    avg(p0) AS baseline_average_probability, count(*) FILTER (WHERE late1) AS simulated_at_risk,
    count(*) FILTER (WHERE late1) / count(*)::DOUBLE AS simulated_risk_rate,
    avg(p1) AS simulated_average_probability,
    count(*) FILTER (WHERE late1 AND NOT predicted_late) AS newly_at_risk,
    count(*) FILTER (WHERE predicted_late AND NOT late1) AS recovered_from_risk
  FROM sim GROUP BY capacity, pressure_factor),
candidates AS (
  SELECT *, capacity_multiplier - 1 AS capacity_increase_rate,
    greatest(capacity_multiplier - 1, 0) * {problem.unit_cost!r}::DOUBLE
      * (affected_orders / total_orders::DOUBLE) AS intervention_cost,
    greatest(capacity_multiplier - 1, 0) * {problem.unit_cost!r}::DOUBLE
      * (affected_orders / total_orders::DOUBLE) <= {problem.budget!r}::DOUBLE + 1e-12::DOUBLE
      AS feasible,
    {target} AS target_met, simulated_at_risk - baseline_at_risk AS at_risk_delta
  FROM candidates0)"""


_CAND_ROUND = (
    "capacity_increase_rate", "intervention_cost", "baseline_risk_rate",
    "baseline_average_probability", "simulated_risk_rate", "simulated_average_probability",
)


@query(
    "tw11_capacity_grid",
    over("fact", "SELECT capacity_multiplier, pressure_factor, total_orders FROM candidates",
         SNAPSHOT_SQL, _candidate_sql(FREE)),
)
def tw11(spark, sf):
    rows = W.capacity_candidates(snapshot(spark, sf), FREE)
    return rows.select("capacity_multiplier", "pressure_factor", "total_orders")


def _candidate_query(label: str, problem):
    rounded = ", ".join(f"round({c}, 9) AS {c}" for c in _CAND_ROUND)
    sql = f"SELECT * REPLACE ({rounded}) FROM candidates"

    @query(
        f"tw12_candidates_{label}",
        over("fact", sql, SNAPSHOT_SQL, _candidate_sql(problem)),
    )
    def run(spark, sf):
        return _round(W.capacity_candidates(snapshot(spark, sf), problem), *_CAND_ROUND)

    return run


def _decision_query(label: str, problem):
    safest = ("simulated_at_risk, simulated_average_probability, intervention_cost, "
              "capacity_multiplier")  # fmt: skip
    cheapest = ("intervention_cost, simulated_at_risk, simulated_average_probability, "
                "capacity_multiplier")  # fmt: skip
    wants = problem.max_risk_rate is not None
    on_target = "EXISTS (SELECT 1 FROM candidates WHERE feasible AND target_met)"
    chosen = f"SELECT * FROM candidates WHERE feasible ORDER BY {safest} LIMIT 1"
    if wants:
        chosen = f"""SELECT * FROM (
    SELECT 1 AS pick, * FROM (SELECT * FROM candidates WHERE feasible AND target_met
      ORDER BY {cheapest} LIMIT 1)
    UNION ALL SELECT 2, * FROM ({chosen})) ORDER BY pick LIMIT 1"""
    sql = f"""SELECT r.total_orders, r.baseline_at_risk, r.capacity_multiplier AS recommended,
  round(r.intervention_cost, 9) AS intervention_cost, r.simulated_at_risk,
  f.capacity_multiplier AS reference, {on_target if wants else "true"} AS target_met,
  f.simulated_at_risk - r.simulated_at_risk AS risk_reduction,
  round(f.simulated_risk_rate - r.simulated_risk_rate, 9) AS risk_rate_reduction,
  r.simulated_at_risk - r.baseline_at_risk AS risk_delta_vs_baseline,
  round(r.simulated_risk_rate - r.baseline_risk_rate, 9) AS risk_rate_delta_vs_baseline,
  (SELECT count(*) FROM candidates WHERE feasible) AS feasible_candidates
FROM ({chosen}) AS r,
  (SELECT * FROM candidates ORDER BY capacity_multiplier LIMIT 1) AS f"""

    @query(
        f"tw13_decision_{label}",
        over("fact", sql, SNAPSHOT_SQL, _candidate_sql(problem)),
    )
    def run(spark, sf):
        rows = W.capacity_candidates(snapshot(spark, sf), problem)
        one = W.recommend(rows, problem).select(
            "total_orders", "baseline_at_risk",
            F.col("recommended.capacity_multiplier").alias("recommended"),
            F.col("recommended.intervention_cost").alias("intervention_cost"),
            F.col("recommended.simulated_at_risk").alias("simulated_at_risk"),
            F.col("reference.capacity_multiplier").alias("reference"), "target_met",
            "risk_reduction", "risk_rate_reduction", "risk_delta_vs_baseline",
            "risk_rate_delta_vs_baseline", "feasible_candidates",
        )
        return _round(one, "intervention_cost", "risk_rate_reduction",
                      "risk_rate_delta_vs_baseline")

    return run


for _label, _problem in (("free", FREE), ("aimed", AIMED), ("local", LOCAL)):
    _candidate_query(_label, _problem)
    _decision_query(_label, _problem)


@query(
    "win09_recommended_capacity",
    over("fact", """SELECT capacity_multiplier FROM candidates WHERE feasible
  ORDER BY simulated_at_risk, simulated_average_probability, intervention_cost,
  capacity_multiplier LIMIT 1""", SNAPSHOT_SQL, _candidate_sql(FREE)),
)
def win09(spark, sf):
    decision = W.recommend(W.capacity_candidates(snapshot(spark, sf), FREE), FREE)
    return decision.select("recommended.capacity_multiplier")
