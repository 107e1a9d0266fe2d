import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.operators import features as P
from milepost.operators import metrics as M
from milepost.operators.distributed import known_bytes


def test_leakage_guard():
    assert P.leaking_columns(["city", "delivery_hour"]) == ["delivery_hour"]
    with pytest.raises(ValueError, match="delivery_hour"):
        P.forbid_leakage(["delivery_hour"])
    P.forbid_leakage(S.MODEL_INPUTS)
    assert len(S.MODEL_INPUTS) == len(set(S.MODEL_INPUTS)) == 26


def test_splits_belong_to_the_later_part(spark):
    moments = ["2000-09-30 23:59:59", "2000-10-01 00:00:00", "2000-10-14 23:59:59",
               "2000-10-15 00:00:00", "2000-10-31 23:59:59", "2000-11-01 00:00:00"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").select(
        F.col("m").cast("timestamp").alias("accept_timestamp")
    )
    got = [r[0] for r in df.select(P.split_label()).collect()]
    assert got == ["train", "validation", "validation", "test", "test", "excluded"]
    with pytest.raises(ValueError, match="unknown split"):
        P.in_split(df, "later")
    with pytest.raises(ValueError, match="buckets"):
        P.hash_sample(df, 0)
    with pytest.raises(ValueError, match="limit"):
        P.first_rows(df, 0)


def _history(spark):
    courier = spark.createDataFrame(
        [(datetime(2000, 9, 24), 31, "Jilin", 7, 5, 1, 100.0, 80.0, 20.0)],
        "delivery_date timestamp, region_id bigint, city string, courier_id bigint, "
        "orders_total bigint, orders_late bigint, avg_duration_minutes double, "
        "sla_compliance_rate double, quality_warning_rate double",
    )
    city = courier.drop("courier_id").withColumn("unique_couriers", F.lit(3))
    return courier, city


def test_previous_day_join(spark):
    events = spark.createDataFrame(
        [
            (1, datetime(2000, 9, 25, 8), 31, "Jilin", 7),
            (2, datetime(2000, 9, 26, 8), 31, "Jilin", 7),  # two days later
            (3, datetime(2000, 9, 25, 0), 31, "Jilin", 0),  # unknown courier
            (4, datetime(2000, 9, 25, 8), 32, "Jilin", 7),
            (5, datetime(2000, 9, 25, 8), 31, None, 7),
        ],
        "order_id bigint, accept_timestamp timestamp, region_id bigint, city string, "
        "courier_id bigint",
    )
    rows = {r["order_id"]: r for r in P.add_history(events, *_history(spark)).collect()}
    assert len(rows) == 5
    assert [rows[i]["courier_prev_day_available"] for i in range(1, 6)] == [
        True, False, False, False, False]
    assert [rows[i]["city_prev_day_available"] for i in range(1, 6)] == [
        True, False, True, False, False]
    assert rows[1]["courier_prev_day_orders_total"] == 5
    assert rows[3]["city_prev_day_unique_couriers"] == 3
    assert rows[3]["courier_id"] == 0


def test_served_days_prunes_history(spark):
    _, city = _history(spark)
    day = F.lit("2000-09-25").cast("date")
    assert P.served_days(city, day, day).count() == 1
    assert P.served_days(city, F.date_add(day, 1), F.date_add(day, 1)).count() == 0


def test_label_must_be_binary(spark):
    row = spark.range(1).select(
        *[F.lit(None).cast("double").alias(c) for c in S.MODEL_INPUTS],
        F.lit(None).cast("boolean").alias("is_late_delivery"),
    )
    with pytest.raises(Exception, match="target must be 0 or 1"):
        P.features_and_label(row).collect()
    with pytest.raises(ValueError, match="missing columns sla_minutes"):
        P.model_inputs(row.drop("sla_minutes"))


def brute(labels, scores):
    pos = [s for y, s in zip(labels, scores, strict=True) if y]
    neg = [s for y, s in zip(labels, scores, strict=True) if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    ap, best = 0.0, (-1.0, 0.0)
    last = 0.0
    for cut in sorted(set(scores), reverse=True):
        tp = sum(p >= cut for p in pos)
        fp = sum(n >= cut for n in neg)
        precision, recall = tp / (tp + fp), tp / len(pos)
        ap += (recall - last) * precision
        last = recall
        f1 = 2 * precision * recall / (precision + recall) if tp else 0.0
        best = max(best, (f1, -cut))
    return pairs / (len(pos) * len(neg)), ap, -best[1], best[0]


def test_metrics_match_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.random() < 0.3, rng.randint(0, 30) / 30) for _ in range(400)]
    df = spark.createDataFrame(
        [(int(y), s, int(s >= 0.5)) for y, s in rows], "label int, score double, prediction int"
    )
    roc, ap, cut, f1 = brute(*zip(*rows, strict=True))
    got = M.binary_metrics(df).first()
    assert got["roc_auc"] == pytest.approx(roc, abs=1e-12)
    assert got["pr_auc"] == pytest.approx(ap, abs=1e-12)
    best = M.best_f1(M.pr_curve(df)).first()
    assert (best["threshold"], best["f1"]) == (cut, pytest.approx(f1))


def test_tied_f1_takes_the_lowest_threshold(spark):
    # F1 is 2/3 both at 0.9 (1 of 2 found) and at 0.2 (2 of 4 right)
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (0, 0.4), (1, 0.2)], "label int, score double")
    assert M.best_f1(M.pr_curve(df)).first()["threshold"] == 0.2


def test_one_class_is_noted(spark):
    df = spark.createDataFrame([(0, 0.9, 1), (0, 0.1, 0)], "label int, score double, prediction int")
    row = M.binary_metrics(df).first()
    assert row["roc_auc"] is None and row["note"] == "one class only"
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_threshold_is_checked():
    with pytest.raises(ValueError, match="between 0 and 1"):
        M.apply_threshold("score", 1.5)


def test_a_stored_city_history_is_broadcast_and_events_stay(spark, sf):
    from milepost.catalog import layers as L

    fact, city = L.stored_fact(spark, sf), L.stored_city_daily(spark, sf)
    columns = ["order_id", *S.CITY_HISTORY, "city_prev_day_available"]
    stored = P.join_city_history(fact, city).select(columns)
    salted = P.join_city_history(fact, city, small_bytes=0).select(columns)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(map(str, stored.collect())) == sorted(map(str, salted.collect()))
    computed = L.city_daily(spark, sf)
    assert known_bytes(city) <= 16 << 20 < known_bytes(computed)
