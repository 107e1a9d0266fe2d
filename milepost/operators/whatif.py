"""What-if scenarios and capacity search over a snapshot.

Scenarios are a short list of parameters. They travel as a literal array: every
order is scored for all of them where it lies, and the partial aggregation
folds the rows again before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.functions import expressions as X

TOLERANCE = 1e-12


@dataclass(frozen=True)
class Scenario:
    """A change of demand, courier capacity and promised time, for all or one city."""

    name: str
    demand: float = 1.0
    capacity: float = 1.0
    sla: float = 1.0
    strength: float = 1.0
    city: str | None = None

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a scenario needs a name")
        if min(self.demand, self.capacity, self.sla) <= 0:
            raise ValueError("multipliers must be positive")
        if self.strength < 0:
            raise ValueError("strength must not be negative")
        if self.city is not None and not self.city.strip():
            raise ValueError("the target city must not be empty")

    @property
    def pressure(self) -> float:
        return self.demand / self.capacity / self.sla


# ---------------------------------------------------------------------------
# The standard campaign.
# ---------------------------------------------------------------------------
STANDARD_CAMPAIGN = (
    Scenario("baseline"),
    Scenario("demand+10", demand=1.10),
    Scenario("demand+20", demand=1.20),
    Scenario("demand+50", demand=1.50),
    Scenario("capacity-10", capacity=0.90),
    Scenario("capacity-20", capacity=0.80),
    Scenario("capacity-30", capacity=0.70),
    Scenario("demand+20_capacity-20", demand=1.20, capacity=0.80),
    Scenario("demand+20_capacity-20_sla+10", demand=1.20, capacity=0.80, sla=1.10),
    Scenario("capacity+20", capacity=1.20),
    Scenario("sla+20", sla=1.20),
)


def standard_campaign(city: str | None = None) -> tuple[Scenario, ...]:
    """The standard scenarios, and with a city also a local stress there."""
    if city is None:
        return STANDARD_CAMPAIGN
    local = Scenario(f"{city.lower()}_local_stress", demand=1.30, capacity=0.80, city=city)
    return (*STANDARD_CAMPAIGN, local)


def _literal(s: Scenario) -> Column:
    return F.struct(
        F.lit(s.name).alias("scenario"),
        F.lit(s.city).cast("string").alias("target_city"),
        F.lit(float(s.demand)).alias("demand_multiplier"),
        F.lit(float(s.capacity)).alias("capacity_multiplier"),
        F.lit(float(s.pressure)).alias("pressure_factor"),
        F.lit(float(s.strength)).alias("stress_strength"),
    )


def _checked(scenarios: Sequence[Scenario]) -> Sequence[Scenario]:
    if not scenarios:
        raise ValueError("a campaign needs at least one scenario")
    if len({s.name for s in scenarios}) != len(scenarios):
        raise ValueError("scenario names must be unique")
    return scenarios


def applies(city: str | Column = "city") -> Column:
    """The scenario covers this city."""
    c = F.col(city) if isinstance(city, str) else city
    return F.col("target_city").isNull() | (c == F.col("target_city"))


def score_scenarios(snapshot: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Every order under every scenario: shifted probability, class and changes."""
    params = F.array(*[_literal(s) for s in _checked(scenarios)])
    orders = snapshot.select(
        "order_id", "city", "model_version", "threshold",
        F.col("delay_probability").alias("baseline_probability"),
        F.col("predicted_late").alias("baseline_predicted_late"),
        F.inline(params),
    )
    p = F.col("baseline_probability")
    shifted = X.shift_probability(p, "pressure_factor", "stress_strength")
    before, after = F.col("baseline_predicted_late"), F.col("simulated_predicted_late")
    return (
        orders.withColumn("scenario_applied", applies())
        .withColumn("simulated_probability", F.when(F.col("scenario_applied"), shifted)
                    .otherwise(p))
        .withColumn("simulated_predicted_late",
                    F.col("simulated_probability") >= F.col("threshold"))
        .withColumns(
            {
                "probability_delta": F.col("simulated_probability") - p,
                "became_at_risk": ~before & after,
                "recovered_from_risk": before & ~after,
            }
        )
    )


def _measures() -> list[Column]:
    units = F.when(F.col("scenario_applied"), F.col("demand_multiplier")).otherwise(1.0)
    return [
        F.count("*").alias("total_orders"),
        F.count_if("scenario_applied").alias("affected_orders"),
        F.sum(units).alias("simulated_demand_units"),
        F.count_if("baseline_predicted_late").alias("baseline_at_risk"),
        F.count_if("simulated_predicted_late").alias("simulated_at_risk"),
        F.count_if("became_at_risk").alias("newly_at_risk"),
        F.count_if("recovered_from_risk").alias("recovered_from_risk"),
        F.avg("baseline_probability").alias("baseline_average_probability"),
        F.avg("simulated_probability").alias("simulated_average_probability"),
    ]


def _derived() -> dict[str, Column]:
    base = X.ratio("baseline_at_risk", "total_orders")
    sim = X.ratio("simulated_at_risk", "total_orders")
    return {
        "at_risk_delta": F.col("simulated_at_risk") - F.col("baseline_at_risk"),
        "baseline_risk_rate": base,
        "simulated_risk_rate": sim,
        "risk_rate_delta": sim - base,
        "average_probability_delta": F.col("simulated_average_probability")
        - F.col("baseline_average_probability"),
    }


def scenario_summary(snapshot: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """One comparable row per scenario, all in one job; zeros for an empty snapshot."""
    _checked(scenarios)
    spark = snapshot.sparkSession
    params = spark.createDataFrame(
        [(s.name, s.city, float(s.pressure)) for s in scenarios],
        "scenario string, target_city string, pressure_factor double",
    )
    grouped = score_scenarios(snapshot, scenarios).groupBy("scenario").agg(*_measures())
    joined = params.join(grouped, "scenario", "left").na.fill(0)
    return joined.withColumns(_derived())


def scenario_by_city(snapshot: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """One row per scenario and city."""
    grouped = score_scenarios(snapshot, scenarios).groupBy("scenario", "city").agg(*_measures())
    return grouped.withColumns(_derived())


_RISK_ORDER = ("simulated_at_risk", "simulated_average_probability", "pressure_factor", "scenario")


def best_and_worst(summary: DataFrame) -> DataFrame:
    """The scenario with the least and with the most risk; ties by mean, pressure, name."""
    key = F.struct(*_RISK_ORDER)
    row = F.struct("scenario", "simulated_at_risk", "simulated_average_probability")
    return summary.agg(F.min_by(row, key).alias("best"), F.max_by(row, key).alias("worst"))


def by_risk(summary: DataFrame, descending: bool = False) -> DataFrame:
    """Scenarios in order of risk, mean probability and name."""
    keys = [F.col(c) for c in ("simulated_at_risk", "simulated_average_probability", "scenario")]
    return summary.orderBy(*[k.desc() if descending else k.asc() for k in keys])


# -- capacity search -----------------------------------------------------------------------
@dataclass(frozen=True)
class CapacityProblem:
    """Find the courier capacity that lowers risk within a budget."""

    name: str
    demand: float = 1.0
    capacity_min: float = 1.0
    capacity_max: float = 1.5
    capacity_step: float = 0.05
    budget: float = 0.50
    unit_cost: float = 1.0
    max_risk_rate: float | None = None
    strength: float = 1.0
    city: str | None = None

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a problem needs a name")
        if self.demand <= 0 or self.capacity_step <= 0 or self.unit_cost <= 0:
            raise ValueError("demand, step and unit cost must be positive")
        if self.capacity_min < 1.0 or self.capacity_max < self.capacity_min:
            raise ValueError("capacity must start at 1 or more and not end before it starts")
        if self.budget < 0 or self.strength < 0:
            raise ValueError("budget and strength must not be negative")
        if self.max_risk_rate is not None and not 0.0 <= self.max_risk_rate <= 1.0:
            raise ValueError("max_risk_rate must be between 0 and 1")
        if self.city is not None and not self.city.strip():
            raise ValueError("the target city must not be empty")

    def capacities(self) -> list[float]:
        """Exact decimal steps from the minimum; the maximum always belongs to them."""
        low, high = Decimal(str(self.capacity_min)), Decimal(str(self.capacity_max))
        step = Decimal(str(self.capacity_step))
        grid = [low + i * step for i in range(int((high - low) // step) + 1)]
        return [float(x) for x in sorted({*grid, high})]

    def scenarios(self) -> list[Scenario]:
        return [
            Scenario(f"capacity {c!r}", demand=self.demand, capacity=c, strength=self.strength,
                     city=self.city)
            for c in self.capacities()
        ]


def capacity_candidates(snapshot: DataFrame, problem: CapacityProblem) -> DataFrame:
    """One row per capacity: cost, feasibility, target and simulated risk."""
    spark = snapshot.sparkSession
    params = spark.createDataFrame(
        [(s.name, s.capacity, float(s.pressure)) for s in problem.scenarios()],
        "scenario string, capacity_multiplier double, pressure_factor double",
    )
    grouped = score_scenarios(snapshot, problem.scenarios()).groupBy("scenario").agg(*_measures())
    joined = params.join(grouped, "scenario", "left").na.fill(0).withColumns(_derived())
    extra = F.greatest(F.col("capacity_multiplier") - 1.0, F.lit(0.0))
    cost = extra * problem.unit_cost * X.ratio("affected_orders", "total_orders")
    target = F.lit(True)
    if problem.max_risk_rate is not None:
        target = F.col("simulated_risk_rate") <= problem.max_risk_rate + TOLERANCE
    return joined.withColumn("intervention_cost", cost).select(
        "capacity_multiplier",
        (F.col("capacity_multiplier") - 1.0).alias("capacity_increase_rate"),
        "pressure_factor", "total_orders", "affected_orders", "intervention_cost",
        (F.col("intervention_cost") <= problem.budget + TOLERANCE).alias("feasible"),
        target.alias("target_met"), "baseline_at_risk", "baseline_risk_rate",
        "baseline_average_probability", "simulated_at_risk", "simulated_risk_rate",
        "simulated_average_probability", "at_risk_delta", "newly_at_risk", "recovered_from_risk",
    )


def recommend(candidates: DataFrame, problem: CapacityProblem) -> DataFrame:
    """One decision row.

    With a target that some affordable capacity meets, the cheapest of those;
    otherwise the affordable one with the least risk. ``recommended`` is null if
    no capacity fits the budget.
    """
    row = F.struct(
        "capacity_multiplier", "intervention_cost", "simulated_at_risk", "simulated_risk_rate",
        "simulated_average_probability",
    )
    cheapest = F.struct("intervention_cost", "simulated_at_risk", "simulated_average_probability",
                        "capacity_multiplier")
    safest = F.struct("simulated_at_risk", "simulated_average_probability", "intervention_cost",
                      "capacity_multiplier")
    fits = F.col("feasible")
    on_target = fits & F.col("target_met")
    wants_target = problem.max_risk_rate is not None
    one = candidates.agg(
        F.first("baseline_at_risk").alias("baseline_at_risk"),
        F.first("baseline_risk_rate").alias("baseline_risk_rate"),
        F.first("total_orders").alias("total_orders"),
        F.min_by(row, F.when(on_target, cheapest)).alias("_on_target"),
        F.min_by(row, F.when(fits, safest)).alias("_safest"),
        F.min_by(row, F.col("capacity_multiplier")).alias("reference"),
        F.count_if(fits).alias("feasible_candidates"),
        F.count_if(on_target).alias("target_candidates"),
    )
    chosen = F.coalesce("_on_target", "_safest") if wants_target else F.col("_safest")
    met = F.col("target_candidates") > 0 if wants_target else F.lit(True)
    r = "recommended."
    return one.withColumn("recommended", chosen).select(
        "total_orders", "baseline_at_risk", "baseline_risk_rate", "feasible_candidates",
        "recommended", "reference", met.alias("target_met"),
        (F.col("reference.simulated_at_risk") - F.col(r + "simulated_at_risk"))
        .alias("risk_reduction"),
        (F.col("reference.simulated_risk_rate") - F.col(r + "simulated_risk_rate"))
        .alias("risk_rate_reduction"),
        (F.col(r + "simulated_at_risk") - F.col("baseline_at_risk"))
        .alias("risk_delta_vs_baseline"),
        (F.col(r + "simulated_risk_rate") - F.col("baseline_risk_rate"))
        .alias("risk_rate_delta_vs_baseline"),
    )


def decide(snapshot: DataFrame, problem: CapacityProblem):
    """The decision as one row; an error if no capacity fits the budget."""
    decision = recommend(capacity_candidates(snapshot, problem), problem).first()
    if decision["recommended"] is None:
        raise ValueError("no candidate fits the budget")
    return decision
