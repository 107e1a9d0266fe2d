import glob
import hashlib

import pytest
from delivery_rows import golden_raw, raw_frame, raw_row, silver_frame
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.operators import quality as Q
from milepost.plans import marts, medallion
from milepost.session import fresh_path
from milepost.sources import files

AT = "2001-01-01 00:00:00"


def bronze(spark, raw):
    numbered = raw.withColumn("_source_row_number", F.col("order_id") + 1)
    return medallion.add_bronze_columns(numbered, "A" * 64, "rev", AT, "data/yantai.csv")


def test_bronze(spark):
    rows = {r["order_id"]: r for r in bronze(spark, golden_raw(spark)).collect()}
    assert rows[1]["delivery_duration_minutes"] == 105.0
    assert rows[2]["delivery_duration_minutes"] == 35.0
    assert rows[2]["_warning_missing_accept_gps"]
    assert rows[1]["_quality_status"] == "valid"
    assert rows[2]["_quality_warning_count"] == 1
    assert rows[1]["_source_file"] == "yantai.csv"
    assert rows[1]["_source_sha256"] == "a" * 64


def test_bronze_checks_its_parameters(spark):
    raw = golden_raw(spark).withColumn("_source_row_number", F.lit(2))
    with pytest.raises(ValueError, match="sha256"):
        medallion.add_bronze_columns(raw, "zz", "rev", AT)
    with pytest.raises(ValueError, match="revision"):
        medallion.add_bronze_columns(raw, "a" * 64, " ", AT)


def test_silver_statuses(spark):
    raw = raw_frame(
        spark,
        [
            raw_row(1, city=" Yantai "),
            raw_row(2, accept_gps_lng=None, accept_gps_lat=None, delivery_gps_lng=0.00004,
                    delivery_gps_lat=0.00003, delivery_time="06-12 10:10:00"),
            raw_row(3, delivery_time="06-13 12:10:00"),
        ],
    )
    rows = {r["order_id"]: r for r in medallion.build_silver(bronze(spark, raw), AT).collect()}
    assert [rows[i]["delivery_duration_status"] for i in (1, 2, 3)] == [
        "normal", "zero_or_negative", "long"]
    assert [rows[i]["gps_quality_status"] for i in (1, 2, 3)] == [
        "complete", "missing_or_invalid_both", "complete"]
    assert rows[1]["city"] == "Yantai"
    assert rows[2]["delivery_gps_lng_clean"] is None
    assert rows[3]["delivery_duration_minutes"] == 1560.0
    with pytest.raises(ValueError, match="missing columns"):
        medallion.build_silver(bronze(spark, raw).drop("ds"), AT)


def test_fact_golden(spark):
    fact = medallion.build_fact(silver_frame(spark), AT)
    assert tuple(fact.columns) == S.FACT_COLUMNS
    rows = {r["order_id"]: r for r in fact.collect()}
    assert [rows[i]["is_valid_duration"] for i in range(1, 5)] == [True, True, False, True]
    assert [rows[i]["is_within_sla"] for i in range(1, 5)] == [True, False, False, True]
    assert [rows[i]["is_late_delivery"] for i in range(1, 5)] == [False, True, False, False]
    assert rows[3]["kpi_duration_minutes"] is None
    with pytest.raises(ValueError, match="positive"):
        medallion.build_fact(silver_frame(spark), AT, 0)


def test_daily_golden(spark):
    fact = medallion.build_fact(silver_frame(spark), AT)
    couriers = {r["courier_id"]: r for r in medallion.courier_daily(fact, AT).collect()}
    c = couriers[11]
    assert (c["orders_total"], c["orders_valid_duration"], c["orders_within_sla"]) == (2, 2, 1)
    assert (c["orders_late"], c["unique_aois"], c["avg_duration_minutes"]) == (1, 2, 165.0)
    assert (c["sla_compliance_rate"], c["gps_completeness_rate"]) == (50.0, 100.0)
    assert c["quality_warning_rate"] == 50.0
    assert couriers[12]["sla_compliance_rate"] == 0.0
    assert couriers[12]["avg_duration_minutes"] is None
    cities = {r["city"]: r for r in medallion.city_daily(fact, AT).collect()}
    j = cities["Yantai"]
    assert (j["orders_total"], j["orders_valid_duration"], j["unique_couriers"]) == (3, 2, 2)
    assert (j["unique_aois"], j["median_duration_minutes"]) == (3, 165.0)
    assert (j["gps_completeness_rate"], j["quality_warning_rate"]) == (66.67, 66.67)
    assert (fact.count(), len(couriers), len(cities)) == (4, 3, 2)
    row = medallion.reconcile(fact, medallion.courier_daily(fact, AT),
                              medallion.city_daily(fact, AT)).first()
    assert row["courier_matches"] and row["city_matches"] and row["couriers_complete"]


def test_unknown_couriers_count_as_orders_only(spark):
    silver = silver_frame(spark).withColumn(
        "courier_id", F.when(F.col("order_id") == 2, 0).otherwise(F.col("courier_id"))
    )
    fact = medallion.build_fact(silver, AT)
    assert {r["courier_id"] for r in medallion.courier_daily(fact, AT).collect()} == {11, 12, 21}
    city = medallion.city_daily(fact, AT).where("city = 'Yantai'").first()
    assert (city["orders_total"], city["unique_couriers"]) == (3, 2)


def test_null_keys_form_a_group(spark):
    silver = silver_frame(spark).withColumn("city", F.lit(None).cast("string"))
    rows = medallion.city_daily(medallion.build_fact(silver, AT), AT).collect()
    assert sorted(r["orders_total"] for r in rows) == [1, 3]


def test_ranking_puts_a_missing_rate_first(spark):
    fact = medallion.build_fact(silver_frame(spark), AT)
    daily = marts.stage_courier_daily(medallion.courier_daily(fact, AT))
    ranks = {r["courier_id"]: r["city_rank"] for r in marts.courier_ranking(daily).collect()}
    assert ranks == {12: 1, 11: 2, 21: 1}


def test_consolidate_wants_equal_schemas(spark):
    a, b = spark.range(2), spark.range(3)
    assert medallion.consolidate([a, b]).count() == 5
    with pytest.raises(ValueError, match="schema"):
        medallion.consolidate([a, b.withColumn("x", F.lit(1))])
    with pytest.raises(ValueError, match="nothing"):
        medallion.consolidate([])


def test_consolidated_layer_counts_its_parts(spark):
    path = fresh_path(spark, "whole")
    got = medallion.consolidate_layer([spark.range(2), spark.range(0), spark.range(3)], path)
    assert [(r["part"], r["row_count"]) for r in got.orderBy("part").collect()] == [
        (0, 2), (1, 0), (2, 3)]
    assert spark.read.parquet(path).count() == 5


def days_of_fact(spark):
    rows = [raw_row(i, ds=f"06{12 + i % 3}", accept_time=f"06-{12 + i % 3} 10:00:00",
                    delivery_time=f"06-{12 + i % 3} 11:00:00", city="AB"[i % 2] + "x")
            for i in range(40)]
    return medallion.build_fact(medallion.build_silver(bronze(spark, raw_frame(spark, rows)), AT), AT)


def test_gold_lies_in_order_and_by_day(spark):
    fact = days_of_fact(spark)
    flat, daily = fresh_path(spark, "flat"), fresh_path(spark, "by-day")
    medallion.write_gold(fact, flat, AT)
    medallion.write_gold(fact, daily, AT, partition_by=["delivery_date"])
    keys = list(medallion.FACT_ORDER)
    want = [tuple(r) for r in fact.select(*keys).orderBy(*keys).collect()]
    for root in (flat, daily):
        read = medallion.read_fact(spark, root)
        assert read.schema["delivery_date"].dataType == fact.schema["delivery_date"].dataType
        assert tuple(read.columns) == S.FACT_COLUMNS
        by_file = {}
        for r in read.select(F.input_file_name().alias("f"), *keys).collect():
            by_file.setdefault(r["f"], []).append(tuple(r)[1:])
        assert all(rows == sorted(rows) for rows in by_file.values())
        assert sorted(sum(by_file.values(), [])) == want
        ranges = sorted((min(rows), max(rows)) for rows in by_file.values())
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    day = medallion.read_fact(spark, daily).where(
        F.col("delivery_date") == F.lit("2000-06-13").cast("timestamp")
    )
    assert day.count() == 13
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(delivery_date" in plan
    with pytest.raises(ValueError, match="in this order"):
        medallion.write_gold(fact, flat, AT, partition_by=["city"])


def test_every_row_gets_the_digest_of_its_file(spark):
    path = fresh_path(spark, "two cities")
    for city in ("North West", "Süd"):
        raw_frame(spark, [raw_row(len(city), city=city)]).coalesce(1).write.option(
            "header", True).csv(f"{path}/part={city}")
    digests = files.file_digests(spark, path)
    text = files.read_csv_text(spark, f"{path}/*", numbered=True)
    rows = medallion.add_bronze_columns(
        Q.typed(files.with_digests(text, digests), "_source_path", "_source_row_number",
                "_source_sha256"),
        F.col("_source_sha256"), "rev", AT, F.col("_source_path"),
    ).collect()
    got = {r["city"]: r["_source_sha256"] for r in rows}
    for city in ("North West", "Süd"):
        (file,) = glob.glob(f"{path}/part={city}/*.csv")
        assert got[city] == hashlib.sha256(open(file, "rb").read()).hexdigest()
    with pytest.raises(Exception, match="no digest of"):
        files.with_digests(text, digests.where("false")).collect()
