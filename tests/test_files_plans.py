import re

import pytest
from delivery_rows import raw_frame, raw_row, silver_frame
from pyspark.sql import functions as F

from milepost.catalog import ORACLES, QUERIES
from milepost.catalog import layers as L
from milepost.operators import features as P
from milepost.operators import quality as Q
from milepost.operators import whatif as W
from milepost.plans import medallion
from milepost.session import fresh_path
from milepost.sources import files

AT = "2001-01-01 00:00:00"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_keeps_text_and_numbers_lines(spark):
    path = fresh_path(spark, "csv")
    for city, ids in (("Jilin", range(1, 6)), ("Yantai", range(6, 9))):
        rows = [raw_row(i, city=city, accept_gps_lng=None) for i in ids]
        df = raw_frame(spark, rows).coalesce(1)
        df.write.option("header", True).option("nullValue", "NAN").csv(f"{path}/{city}")
    got = files.read_csv_text(spark, f"{path}/*", numbered=True)
    lines = {int(r["order_id"]): r["_source_row_number"] for r in got.collect()}
    assert lines == {1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 2, 7: 3, 8: 4}
    row = got.first()
    assert row["ds"] == "0612" and row["accept_gps_lng"] is None
    assert Q.contract_counts(got).where("failures > 0").collect()[0]["rule"] == (
        "accept_gps_pair_consistent")


def test_lines_are_numbered_across_byte_ranges(spark):
    path = fresh_path(spark, "csv")
    raw_frame(spark, [raw_row(i) for i in range(1, 2001)]).coalesce(1).write.option(
        "header", True
    ).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_csv_text(spark, path, numbered=True)
        assert got.rdd.getNumPartitions() > 4
        bad = got.where(F.col("order_id").cast("bigint") + 1 != F.col("_source_row_number"))
        assert got.count() == 2000 and bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")


def test_layers_round_trip_and_fail_when_empty(spark):
    path = fresh_path(spark, "layer")
    assert files.write_layer(spark.range(5), path) == 5
    assert files.read_layer(spark, path, ["id"]).count() == 5
    with pytest.raises(ValueError, match="missing columns"):
        files.read_layer(spark, path, ["other"])
    with pytest.raises(files.SourceError):
        files.read_layer(spark, path + "-absent")
    files.write_layer(spark.range(0), path + "-empty")
    with pytest.raises(files.SourceError, match="empty"):
        files.read_layer(spark, path + "-empty")


def test_publish_refuses_repeated_keys(spark):
    fact = medallion.build_fact(silver_frame(spark), AT)
    root = fresh_path(spark, "published")
    assert files.publish(fact, "delivery_fact", root) == ("delivery_fact", 4, 41)
    with pytest.raises(Q.QualityError, match="duplicate_keys"):
        files.publish(fact.union(fact), "delivery_fact", root)
    assert spark.read.parquet(f"{root}/delivery_fact").count() == 4
    with pytest.raises(ValueError, match="unknown table"):
        files.publish(fact, "other", root)
    with pytest.raises(Q.QualityError, match="no rows"):
        files.publish(fact.where("false"), "delivery_fact", root)


# -- plan shapes -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def written_fact(spark, sf):
    path = fresh_path(spark, "fact")
    files.write_layer(L.fact(spark, sf), path, ["delivery_date"])
    return spark.read.parquet(path)


def test_kpi_scan_reads_only_counted_columns(written_fact):
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plan(medallion.fact_kpis(written_fact)))
    assert scan and len(scan.group(1).split(",")) <= 8


def test_eligibility_reaches_the_scan(written_fact):
    text = plan(P.eligible(written_fact))
    assert re.search(r"PushedFilters: \[.*is_valid_duration", text)


def test_history_is_pruned_by_day(spark, written_fact):
    day = F.lit("2000-05-02").cast("date")
    text = plan(P.served_days(written_fact.select("delivery_date", "order_id"), day, day))
    assert "PartitionFilters: [" in text and "delivery_date" in text.split("PartitionFilters")[1]


def test_no_python_and_no_cross_products(spark, sf):
    fact = L.fact(spark, sf)
    plans = [
        plan(L.courier_daily(spark, sf)), plan(L.city_daily(spark, sf)),
        plan(P.training_set(fact, L.courier_daily(spark, sf), L.city_daily(spark, sf))),
        plan(Q.warning_report(L.flagged(spark, sf))),
    ]
    from milepost.catalog.snapshot_queries import snapshot

    plans.append(plan(W.score_scenarios(snapshot(spark, sf), W.STANDARD_CAMPAIGN)))
    for text in plans:
        assert "Python" not in text and "Pandas" not in text
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_limit_is_a_top_k(spark, sf):
    assert "TakeOrderedAndProject" in plan(P.first_rows(P.base_set(L.fact(spark, sf)), 10))


def test_daily_tables_aggregate_before_the_shuffle(spark, sf):
    text = plan(L.city_daily(spark, sf))
    assert text.count("Exchange hashpartitioning") == 2
    first = text.rindex("Exchange hashpartitioning")
    assert "partial_count" in text[first:]


# -- registered queries -----------------------------------------------------------------------
def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150


COMPARED = (
    "agg01_courier_daily_performance", "agg02_city_daily_performance",
    "agg05_mart_city_performance", "win01_courier_ranking", "dq02_contract_rule_counts",
    "dq30_column_profile", "jn03_training_set", "agg16_binary_metrics", "win04_round_robin",
    "str06_live_status", "str08_batch_counters", "str10_alerts", "tw10_campaign",
    "tw13_decision_aimed",
)


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, sf, name):
    import duckdb

    from check_oracle import TABLES, compare

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = compare(spark, connection, name, sf)
    assert result.startswith("ok"), result


def test_digest_of_files_larger_than_a_piece(spark, tmp_path):
    import hashlib

    from milepost.sources import files

    (tmp_path / "empty.bin").write_bytes(b"")  # left out, as in every file source
    bodies = {"b.bin": bytes(range(256)) * 50, "c.bin": b"x" * 4096}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256)
           for r in files.file_digests(spark, str(tmp_path), piece=4096).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
