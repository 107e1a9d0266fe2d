import pytest
from delivery_rows import golden_raw, raw_frame, raw_row
from pyspark.sql import functions as F

from milepost.operators import quality as Q
from milepost.session import fresh_path


def failing(spark, **changes):
    df = raw_frame(spark, [raw_row(**changes)])
    return {r["rule"] for r in Q.contract_counts(df).where("failures > 0").collect()}


def warned(spark, **changes):
    df = Q.add_warning_flags(raw_frame(spark, [raw_row(**changes)]))
    return {r["rule"] for r in Q.warning_report(df).collect()}


def test_golden_rows_pass_the_contract(spark):
    assert Q.enforce_contract(golden_raw(spark)).count() == 2
    numbered = golden_raw(spark).withColumn("line", F.lit(2))
    assert Q.enforce_contract(numbered, "line").columns[-1] == "line"


@pytest.mark.parametrize(
    ("changes", "rule"),
    [
        ({"accept_gps_lat": None}, "accept_gps_pair_consistent"),
        ({"lng": 181.0}, "lng:valid_longitude"),
        ({"lat": -91.0}, "lat:valid_latitude"),
        ({"city": "  "}, "city:non_empty_string"),
        ({"accept_time": "02-30 08:00:00"}, "accept_time:valid_month_day_time"),
        ({"ds": "1332"}, "ds:valid_day_partition"),
        ({"courier_id": None}, "courier_id:not_nullable"),
        ({"aoi_id": -1}, "aoi_id:non_negative_integer"),
    ],
)
def test_blocking_rules(spark, changes, rule):
    assert failing(spark, **changes) == {rule}


def test_contract_on_text_columns(spark):
    df = raw_frame(spark, [raw_row(1)])
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    bad = text.withColumn("aoi_id", F.lit("abc"))
    assert Q.contract_counts(text).where("failures > 0").count() == 0
    rules = {r["rule"] for r in Q.contract_counts(bad).where("failures > 0").collect()}
    assert rules == {"aoi_id:coercible"}


def test_duplicates_and_header_block(spark):
    twice = raw_frame(spark, [raw_row(1), raw_row(1), raw_row(2)])
    assert Q.duplicate_rows(twice).count() == 2
    with pytest.raises(Q.QualityError, match="uniqueness"):
        Q.enforce_contract(twice)
    with pytest.raises(Q.QualityError, match="column contract"):
        Q.enforce_contract(twice.drop("ds"))
    moved = twice.select("city", *[c for c in twice.columns if c != "city"])
    assert not Q.column_order_problems(moved.columns)["ordered"]


@pytest.mark.parametrize(
    ("changes", "rule"),
    [
        ({"order_id": 0}, "zero_order_id"),
        ({"courier_id": 0}, "zero_courier_id"),
        ({"accept_gps_lng": None, "accept_gps_lat": None}, "missing_accept_gps"),
        ({"accept_gps_lng": 0.00004}, "near_zero_accept_gps"),
        ({"delivery_gps_lat": 0.00003}, "near_zero_delivery_gps"),
        ({"delivery_time": "06-12 10:10:00"}, "zero_or_negative_duration"),
        ({"delivery_time": "06-14 10:10:00"}, "long_delivery_duration"),
        ({"ds": "0926"}, "partition_accept_date_mismatch"),
    ],
)
def test_warning_rules(spark, changes, rule):
    assert warned(spark, **changes) == {rule}


def test_no_warning_without_a_reason(spark):
    assert warned(spark) == set()


def test_gate_raises_on_any_count(spark):
    df = raw_frame(spark, [raw_row(1), raw_row(None), raw_row(3), raw_row(3)])
    row = Q.key_gate(df, ["order_id"]).first()
    assert (row["row_count"], row["null_keys"], row["duplicate_keys"]) == (4, 1, 1)
    with pytest.raises(Q.QualityError):
        Q.pass_gate(Q.key_gate(df, ["order_id"]), "x")


def test_declared_checks(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 0), (2, "z", 0)], "k int, s string, n int")
    checks = [
        {"kind": "unique", "column": "k"},
        {"kind": "not_null", "column": "s"},
        {"kind": "not_null", "column": "s", "where": "n > 0"},
        {"kind": "accepted_values", "column": "s", "values": ("a", "b")},
    ]
    got = sorted(r["failures"] for r in Q.run_checks(df, "t", checks).collect())
    assert got == [0, 1, 1, 1]


def test_checks_of_a_table_share_one_scan(spark):
    path = fresh_path(spark, "checked")
    rows = [(1, 1, "a"), (1, 2, None), (2, 3, "x"), (None, 3, "b"), (None, 4, None)]
    spark.createDataFrame(rows, "k int, n int, s string").write.parquet(path)
    checks = [
        {"kind": "not_null", "column": "k"},
        {"kind": "unique", "column": "n"},
        {"kind": "accepted_values", "column": "s", "values": ("a", "b")},
        {"kind": "unique", "column": "k"},
        {"kind": "not_null", "column": "s", "where": "n > 2"},
        {"kind": "unique", "column": "s"},
    ]
    got = Q.run_checks(spark.read.parquet(path), "t", checks)
    assert [r["failures"] for r in got.collect()] == [2, 1, 1, 1, 1, 0]
    assert [r["column_name"] for r in got.collect()] == [c["column"] for c in checks]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    none = Q.run_checks(spark.read.parquet(path).where("false"), "t", checks).collect()
    assert [r["failures"] for r in none] == [0] * 6


@pytest.mark.parametrize(("hours", "status"), [(1, "pass"), (25, "warn"), (80, "error")])
def test_freshness(spark, hours, status):
    df = spark.sql("SELECT timestamp '2000-01-01 00:00:00' AS _gold_processed_at")
    now = F.expr(f"timestamp '2000-01-01 00:00:00' + INTERVAL {hours} HOURS")
    assert Q.freshness(df, now).first()["status"] == status


def test_profile(spark):
    df = raw_frame(spark, [raw_row(1), raw_row(1), raw_row(2, accept_gps_lng=None)])
    table = Q.table_profile(df).first()
    assert (table["row_count"], table["duplicate_row_count"]) == (3, 1)
    numbered = df.withColumn("line", F.monotonically_increasing_id())
    profile = {r["name"]: r for r in Q.column_profile(numbered, "line").collect()}
    assert profile["order_id"]["dtype"] == "int64"
    assert profile["order_id"]["sample_values"] == "1|2"
    assert profile["accept_gps_lng"]["null_percentage"] == 33.333
    assert profile["city"]["dtype"] == "object"
    assert profile["ds"]["sample_values"] == "612"
    assert "line" not in profile
    bounds = {r["name"]: r["maximum"] for r in Q.coordinate_bounds(df).collect()}
    assert bounds["lng"] == 121.4


def test_duration_profile_has_no_leap_day(spark):
    df = raw_frame(
        spark,
        [raw_row(1), raw_row(2, accept_time="02-29 08:00:00"),
         raw_row(3, accept_time="06-12 23:50:00", delivery_time="06-12 00:25:00")],
    )
    row = Q.duration_profile(df).first()
    assert (row["valid_count"], row["missing_or_invalid_count"]) == (2, 1)
    assert (row["median"], row["midnight_rollover_count"]) == (70.0, 1)


def test_failure_sample_counts_all(spark):
    rows = [raw_row(i, lng=200.0) for i in range(1, 31)]
    df = raw_frame(spark, rows).withColumn("line", F.col("order_id"))
    sample = Q.failure_sample(Q.failure_cases(df, "line"), "line").collect()
    assert len(sample) == 20
    assert {r["total_failures"] for r in sample} == {30}
