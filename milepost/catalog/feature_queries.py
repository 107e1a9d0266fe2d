"""Features, previous-day joins, splits, samples and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.catalog import layers as L
from milepost.catalog.layers import over
from milepost.catalog.registry import query
from milepost.operators import features as P
from milepost.operators import metrics as M

T0_SQL = """t0 AS (
  SELECT order_id, accept_timestamp, region_id, city, courier_id, aoi_id, aoi_type, sla_minutes,
    accept_gps_lng, accept_gps_lat, accept_gps_valid,
    CAST(hour(accept_timestamp) AS INT) AS accept_hour,
    CAST(isodow(accept_timestamp) AS INT) AS accept_weekday,
    CAST(month(accept_timestamp) AS INT) AS accept_month,
    CAST(day(accept_timestamp) AS INT) AS accept_day,
    isodow(accept_timestamp) IN (6, 7) AS accept_is_weekend,
    CASE WHEN hour(accept_timestamp) < 6 THEN 'night' WHEN hour(accept_timestamp) < 12
         THEN 'morning' WHEN hour(accept_timestamp) < 18 THEN 'afternoon' ELSE 'evening' END
      AS accept_period, is_late_delivery, is_valid_duration
  FROM fact)"""
ENRICHED_SQL = """enriched AS (
  SELECT t0.*, c.orders_total::DOUBLE AS courier_prev_day_orders_total,
    c.orders_late::DOUBLE AS courier_prev_day_orders_late,
    c.avg_duration_minutes AS courier_prev_day_avg_duration_minutes,
    c.sla_compliance_rate AS courier_prev_day_sla_compliance_rate,
    c.quality_warning_rate AS courier_prev_day_quality_warning_rate,
    c.courier_id IS NOT NULL AS courier_prev_day_available,
    t.orders_total::DOUBLE AS city_prev_day_orders_total, t.orders_late::DOUBLE AS city_prev_day_orders_late,
    t.unique_couriers::DOUBLE AS city_prev_day_unique_couriers,
    t.avg_duration_minutes AS city_prev_day_avg_duration_minutes,
    t.sla_compliance_rate AS city_prev_day_sla_compliance_rate,
    t.quality_warning_rate AS city_prev_day_quality_warning_rate,
    t.city IS NOT NULL AS city_prev_day_available
  FROM t0 LEFT JOIN courier_daily c ON c.region_id = t0.region_id AND c.city = t0.city
    AND c.courier_id = t0.courier_id
    AND CAST(c.delivery_date AS DATE) = CAST(t0.accept_timestamp AS DATE) - 1
  LEFT JOIN city_daily t ON t.region_id = t0.region_id AND t.city = t0.city
    AND CAST(t.delivery_date AS DATE) = CAST(t0.accept_timestamp AS DATE) - 1)"""
TRAIN_SQL = """training AS (
  SELECT * EXCLUDE (is_valid_duration) FROM enriched
  WHERE is_valid_duration AND accept_timestamp < TIMESTAMP '2000-11-01')"""
_TEXT = "strftime(accept_timestamp, '%Y-%m-%d %H:%M:%S') AS accept_timestamp"
_SPLIT = """CASE WHEN accept_timestamp < TIMESTAMP '2000-10-01' THEN 'train'
  WHEN accept_timestamp < TIMESTAMP '2000-10-15' THEN 'validation'
  WHEN accept_timestamp < TIMESTAMP '2000-11-01' THEN 'test' ELSE 'excluded' END"""
_BASE = ", ".join(S.BASE_FEATURES)
_COURIER = ", ".join((*S.COURIER_HISTORY, "courier_prev_day_available"))
_CITY = ", ".join((*S.CITY_HISTORY, "city_prev_day_available"))


_COUNTS = (
    "courier_prev_day_orders_total", "courier_prev_day_orders_late",
    "city_prev_day_orders_total", "city_prev_day_orders_late", "city_prev_day_unique_couriers",
)


def shown(df):
    """Counts that may be missing are shown as doubles, which every client shows alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in _COUNTS if c in df.columns})


def training(spark, sf):
    return P.training_set(L.stored_fact(spark, sf), L.stored_courier_daily(spark, sf), L.stored_city_daily(spark, sf))


@query(
    "prj05_accept_features",
    over("fact", f"SELECT order_id, {_BASE} FROM t0", T0_SQL),
)
def prj05(spark, sf):
    return P.add_accept_features(L.fact(spark, sf)).select("order_id", *S.BASE_FEATURES)


@query(
    "prj06_history_projection",
    over("daily", """SELECT region_id AS _th_region, city AS _th_city,
  CAST(CAST(delivery_date AS DATE) + 1 AS VARCHAR) AS _th_day,
  orders_total AS city_prev_day_orders_total, orders_late AS city_prev_day_orders_late,
  unique_couriers AS city_prev_day_unique_couriers,
  avg_duration_minutes AS city_prev_day_avg_duration_minutes,
  sla_compliance_rate AS city_prev_day_sla_compliance_rate,
  quality_warning_rate AS city_prev_day_quality_warning_rate FROM city_daily"""),
)
def prj06(spark, sf):
    history = P.city_history(L.stored_city_daily(spark, sf))
    return history.withColumn("_th_day", F.col("_th_day").cast("string"))


@query(
    "prj08_model_inputs",
    over("daily", f"SELECT order_id, {', '.join(S.MODEL_INPUTS)} FROM training", T0_SQL,
         ENRICHED_SQL, TRAIN_SQL),
)
def prj08(spark, sf):
    return shown(P.model_inputs(training(spark, sf), "order_id"))


@query(
    "prj09_features_and_label",
    over("daily", "SELECT city, accept_period, count(*) AS row_count, "
         "CAST(sum(is_late_delivery::INT) AS DOUBLE) AS late FROM training GROUP BY 1, 2",
         T0_SQL, ENRICHED_SQL, TRAIN_SQL),
)
def prj09(spark, sf):
    rows = P.features_and_label(training(spark, sf))
    return rows.groupBy("city", "accept_period").agg(
        F.count("*").alias("row_count"), F.sum("label").alias("late")
    )


@query(
    "flt02_eligible_rows",
    over("fact", "SELECT order_id FROM fact WHERE is_valid_duration "
         "AND accept_timestamp < TIMESTAMP '2000-11-01'"),
)
def flt02(spark, sf):
    return P.eligible(L.fact(spark, sf)).select("order_id")


@query(
    "flt03_temporal_split",
    over("fact", f"SELECT {_SPLIT} AS split, count(*) AS row_count FROM fact GROUP BY 1"),
)
def flt03(spark, sf):
    labelled = L.fact(spark, sf).select(P.split_label().alias("split"))
    return labelled.groupBy("split").agg(F.count("*").alias("row_count"))


_BYTE = f"CAST('0x' || substr(md5(order_id || ':{P.SAMPLE_SALT}'), 1, 2) AS INT)"
_SAMPLE = (
    f"CASE {_SPLIT} WHEN 'train' THEN 8 WHEN 'validation' THEN 26 WHEN 'test' THEN 20 ELSE 0 END"
)


@query(
    "flt04_hash_sample",
    over("fact", f"SELECT order_id, {_SPLIT} AS split FROM fact WHERE {_BYTE} < {_SAMPLE}"),
)
def flt04(spark, sf):
    fact = L.fact(spark, sf)
    out = None
    for split in P.SPLITS:
        one = P.split_sample(fact, split).select("order_id", F.lit(split).alias("split"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "flt06_leakage_guard",
    over("fact", "SELECT column_name, (SELECT count(*) FROM fact) AS row_count FROM (VALUES "
         + ", ".join(f"('{c}')" for c in sorted(S.POST_ACCEPT_COLUMNS))
         + ") AS t(column_name)"),
)
def flt06(spark, sf):
    """The fact columns that may never be model inputs."""
    fact = L.fact(spark, sf)
    names = F.array(*[F.lit(c) for c in P.leaking_columns(fact.columns)])
    return fact.agg(F.count("*").alias("row_count")).select(
        F.explode(names).alias("column_name"), "row_count"
    )


@query(
    "jn01_courier_previous_day",
    over("daily", f"SELECT order_id, {_COURIER} FROM enriched", T0_SQL, ENRICHED_SQL),
)
def jn01(spark, sf):
    joined = P.join_courier_history(L.stored_fact(spark, sf), L.stored_courier_daily(spark, sf))
    return shown(joined.select("order_id", *S.COURIER_HISTORY, "courier_prev_day_available"))


@query(
    "jn02_city_previous_day",
    over("daily", f"SELECT order_id, {_CITY} FROM enriched", T0_SQL, ENRICHED_SQL),
)
def jn02(spark, sf):
    joined = P.join_city_history(L.stored_fact(spark, sf), L.stored_city_daily(spark, sf))
    return shown(joined.select("order_id", *S.CITY_HISTORY, "city_prev_day_available"))


@query(
    "jn03_training_set",
    over("daily", f"SELECT * REPLACE ({_TEXT}) FROM training", T0_SQL, ENRICHED_SQL, TRAIN_SQL),
)
def jn03(spark, sf):
    return shown(training(spark, sf))


@query(
    "jn04_realtime_features",
    over("daily", f"SELECT order_id, {', '.join(S.MODEL_INPUTS)} FROM enriched", T0_SQL,
         ENRICHED_SQL),
)
def jn04(spark, sf):
    """The same features for accepted events that hold no later column."""
    events = L.stored_fact(spark, sf).select(
        "order_id", "accept_timestamp", "region_id", "city", "courier_id", "aoi_id", "aoi_type",
        "sla_minutes", "accept_gps_lng", "accept_gps_lat", "accept_gps_valid",
    )
    rows = P.realtime_features(events, L.stored_courier_daily(spark, sf), L.stored_city_daily(spark, sf))
    return shown(P.model_inputs(rows, "order_id"))


@query(
    "srt02_first_training_rows",
    over("fact", f"""SELECT order_id, {_TEXT}, {_BASE}, is_late_delivery FROM (
  SELECT * FROM t0 WHERE is_valid_duration AND accept_timestamp < TIMESTAMP '2000-11-01'
  ORDER BY accept_timestamp, order_id LIMIT 500)""", T0_SQL),
)
def srt02(spark, sf):
    """A limited training set is a feature of the dataset query: first rows in time order."""
    return P.first_rows(P.base_set(L.stored_fact(spark, sf)), 500)


@query(
    "srt05_split_sample_order",
    over("fact", f"""SELECT order_id, {_SPLIT} AS split, row_number() OVER (
  PARTITION BY {_SPLIT} ORDER BY accept_timestamp, order_id) AS position
  FROM fact WHERE {_BYTE} < {_SAMPLE}"""),
)
def srt05(spark, sf):
    from milepost.operators.distributed import row_positions

    fact = L.fact(spark, sf)
    out = None
    for split in P.SPLITS:
        one = P.split_sample(fact, split).select(
            "order_id", "accept_timestamp", F.lit(split).alias("split")
        )
        out = one if out is None else out.unionByName(one)
    order = [F.col("accept_timestamp").asc(), F.col("order_id").asc()]
    return row_positions(out, order, ["split"]).drop("accept_timestamp")


@query(
    "set02_train_and_validation",
    over("fact", f"SELECT order_id FROM t0 WHERE is_valid_duration AND {_SPLIT} "
         "IN ('train', 'validation')", T0_SQL),
)
def set02(spark, sf):
    rows = P.base_set(L.fact(spark, sf))
    return P.in_split(rows, "train").unionByName(P.in_split(rows, "validation")).select("order_id")


@query(
    "agg12_class_balance",
    over("fact", f"""SELECT {_SPLIT} AS split, count(*) AS row_count,
  CAST(sum(is_late_delivery::INT) AS BIGINT) AS late_count,
  sum(is_late_delivery::INT) / count(*)::DOUBLE AS late_rate
  FROM t0 WHERE is_valid_duration AND accept_timestamp < TIMESTAMP '2000-11-01' GROUP BY 1""",
         T0_SQL),
)
def agg12(spark, sf):
    return P.class_balance(P.base_set(L.fact(spark, sf)))


# -- metrics on a formula score --------------------------------------------------------------
SCORED_SQL = """scored AS (
  SELECT order_id, city, is_late_delivery::INT AS label,
    ((order_id * 7919 + courier_id * 31) % 997 + 400 * is_late_delivery::INT) / 1500.0::DOUBLE
      AS score FROM fact WHERE is_valid_duration)"""


def scored(spark, sf):
    """Eligible orders with a score that is a plain formula of ids and outcome."""
    late = F.col("is_late_delivery").cast("int")
    return L.fact(spark, sf).where("is_valid_duration").select(
        "order_id", "city", late.alias("label"),
        ((F.expr("(order_id * 7919 + courier_id * 31) % 997") + 400 * late) / 1500.0)
        .alias("score"),
    )


def _with_prediction(df):
    return df.withColumn("prediction", M.apply_threshold("score", S.FINAL_THRESHOLD))


def _metric_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""curve AS (
  SELECT {keys}score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored
  GROUP BY {keys}score),
ranked AS (
  SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp,
    sum(neg) OVER ({part} ORDER BY score DESC) AS fp FROM curve),
ranks AS (
  SELECT {keys}sum(neg * (tp - pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE
      AS roc_auc,
    sum(pos * (tp::DOUBLE / (tp + fp))) / nullif(sum(pos), 0)::DOUBLE AS pr_auc
  FROM ranked {group}),
hits AS (
  SELECT {keys}count(*) AS row_count,
    count(*) FILTER (WHERE label = 1 AND score >= 0.246906::DOUBLE) AS true_positives,
    count(*) FILTER (WHERE label = 0 AND score < 0.246906::DOUBLE) AS true_negatives,
    count(*) FILTER (WHERE label = 0 AND score >= 0.246906::DOUBLE) AS false_positives,
    count(*) FILTER (WHERE label = 1 AND score < 0.246906::DOUBLE) AS false_negatives
  FROM scored {group}),
metrics AS (
  SELECT hits.*, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc,
    true_positives::DOUBLE / (true_positives + false_positives) AS precision,
    true_positives::DOUBLE / (true_positives + false_negatives) AS recall,
    2.0::DOUBLE * true_positives / (2 * true_positives + false_positives + false_negatives) AS f1,
    round((true_positives::DOUBLE / (true_positives + false_negatives)
      + true_negatives::DOUBLE / (true_negatives + false_positives)) / 2, 9)
      AS balanced_accuracy,
    (true_positives + false_positives)::DOUBLE / row_count AS predicted_positive_rate,
    '' AS note
  FROM hits JOIN ranks {on})"""


def _rounded(df):
    return df.withColumns(
        {c: F.round(c, 9) for c in ("roc_auc", "pr_auc", "balanced_accuracy")}
    )


@query(
    "agg16_binary_metrics", over("fact", "SELECT * FROM metrics", SCORED_SQL, _metric_sql(""))
)
def agg16(spark, sf):
    return _rounded(M.binary_metrics(_with_prediction(scored(spark, sf))))


@query(
    "agg17_city_metrics", over("fact", "SELECT * FROM metrics", SCORED_SQL, _metric_sql("city"))
)
def agg17(spark, sf):
    return _rounded(M.binary_metrics(_with_prediction(scored(spark, sf)), ["city"]))


@query(
    "agg18_confusion_matrix",
    over("fact", "SELECT * FROM hits", SCORED_SQL, _metric_sql("")),
)
def agg18(spark, sf):
    return M.confusion(_with_prediction(scored(spark, sf)))


_PR_SQL = """pr0 AS (
  SELECT score AS threshold, tp, fp, tp::DOUBLE / (tp + fp) AS precision,
    tp::DOUBLE / (SELECT sum(label) FROM scored) AS recall FROM ranked),
pr AS (
  SELECT *, CASE WHEN precision + recall > 0
    THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr0)"""


@query(
    "win06_pr_curve",
    over("fact", "SELECT threshold, precision, recall, f1, CAST(tp AS BIGINT) AS tp, "
         "CAST(fp AS BIGINT) AS fp FROM pr", SCORED_SQL, _metric_sql(""), _PR_SQL),
)
def win06(spark, sf):
    return M.pr_curve(scored(spark, sf))


@query(
    "win06_best_f1_threshold",
    over("fact", "SELECT threshold, precision, recall, f1 FROM pr ORDER BY f1 DESC, threshold "
         "LIMIT 1", SCORED_SQL, _metric_sql(""), _PR_SQL),
)
def win06_best(spark, sf):
    return M.best_f1(M.pr_curve(scored(spark, sf)))
