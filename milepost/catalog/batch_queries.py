"""Scans, quality, medallion layers, daily tables and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.catalog import layers as L
from milepost.catalog.layers import over, text_dates
from milepost.catalog.registry import query
from milepost.functions import expressions as X
from milepost.operators import quality as Q
from milepost.plans import marts, medallion
from milepost.session import fresh_path
from milepost.sources import deliveries, files

RAW_LIST = ", ".join(S.RAW_COLUMNS)


# -- scans and sinks ---------------------------------------------------------------------
def _csv(spark, sf):
    """All raw deliveries as one CSV folder per city name, like one file per city."""
    path = fresh_path(spark, "raw-csv")
    raw = L.raw(spark, sf)
    raw.withColumn("part", F.trim("city")).write.partitionBy("part").option("header", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).option("nullValue", "nan").csv(path)
    return path


@query("src01_csv_text_scan", over("raw", f"SELECT {RAW_LIST} FROM raw"))
def src01(spark, sf):
    """CSV scan with text columns, null tokens and leading zeros, then typed."""
    return Q.typed(files.read_csv_text(spark, f"{_csv(spark, sf)}/*"))


_LONGS = ("order_id", "region_id", "courier_id", "aoi_id", "aoi_type", "ds")


@query(
    "src02_profile_scan_types",
    "SELECT name, dtype FROM (VALUES "
    + ", ".join(
        f"('{c}', '{'int64' if c in _LONGS else 'float64' if k == 'double' else 'object'}')"
        for c, k in S.RAW_FIELDS
    )
    + ") AS t(name, dtype)",
)
def src02(spark, sf):
    """Type inference on a text scan of the CSV files."""
    text = files.read_csv_text(spark, f"{_csv(spark, sf)}/*", numbered=True)
    profile = Q.column_profile(text.drop("_source_path"), "_source_row_number")
    return profile.select("name", "dtype")


@query("src03_layer_scan", over("fact", f"SELECT {RAW_LIST} FROM silver"))
def src03(spark, sf):
    path = fresh_path(spark, "silver")
    files.write_layer(L.silver(spark, sf), path)
    return files.read_layer(spark, path, S.RAW_COLUMNS)


_KPI_SQL = """SELECT count(*) AS row_count,
  count(*) FILTER (WHERE is_valid_duration) AS orders_valid_duration,
  count(*) FILTER (WHERE is_within_sla) AS orders_within_sla,
  count(*) FILTER (WHERE is_late_delivery) AS orders_late,
  count(*) FILTER (WHERE is_quality_warning) AS orders_quality_warning,
  count(*) FILTER (WHERE has_complete_gps) AS orders_gps_complete,
  count(*) FILTER (WHERE courier_id = 0) AS zero_courier_orders,
  count(*) FILTER (WHERE courier_id > 0) AS known_courier_orders,
  CAST(sum(delivery_count) AS BIGINT) AS orders_total FROM fact"""


@query("src04_pruned_kpi_scan", over("fact", _KPI_SQL))
def src04(spark, sf):
    """KPI check over a written fact: only the counted columns are read."""
    path = fresh_path(spark, "fact")
    files.write_layer(L.fact(spark, sf), path)
    return medallion.fact_kpis(files.read_layer(spark, path))


@query(
    "src05_replay_records",
    over("fact", f"SELECT * REPLACE ({text_dates('delivery_timestamp')}) FROM "
         f"(SELECT {', '.join(S.REPLAY_COLUMNS)} FROM fact)"),
)
def src05(spark, sf):
    path = fresh_path(spark, "fact")
    files.write_layer(L.fact(spark, sf), path)
    return files.replay_records(spark, path)


@query("snk01_layer_write_read_back", over("fact", "SELECT count(*) AS row_count FROM fact"))
def snk01(spark, sf):
    path = fresh_path(spark, "bronze")
    files.write_layer(L.bronze(spark, sf), path)
    return files.read_layer(spark, path).agg(F.count("*").alias("row_count"))


_GOLD_COUNTS = """SELECT 'delivery_fact' AS table_name, count(*) AS row_count,
  CAST(41 AS BIGINT) AS column_count FROM fact
UNION ALL SELECT 'courier_daily_performance', count(*), 23 FROM courier_daily
UNION ALL SELECT 'city_daily_performance', count(*), 23 FROM city_daily"""


@query("snk02_write_gold_tables", over("daily", _GOLD_COUNTS))
def snk02(spark, sf):
    return medallion.write_gold(L.fact(spark, sf), fresh_path(spark, "gold"), L.PROCESSED)


_RULES_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {f}) AS row_count, "
    "count(*) FILTER (WHERE _quality_status = 'warning') AS warning_row_count, "
    "count(*) AS total_rows FROM flagged"
    for r, f in S.WARNING_FLAGS.items()
)


@query("snk03_json_report", over("flagged", f"SELECT * FROM ({_RULES_SQL}) WHERE row_count > 0"))
def snk03(spark, sf):
    path = fresh_path(spark, "report")
    report = Q.warning_report(L.flagged(spark, sf))
    files.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "snk04_publish_checks",
    over("daily", """SELECT 'courier_daily_performance' AS table_name, count(*) AS row_count,
  count(*) FILTER (WHERE city IS NULL) AS null_keys, CAST(0 AS BIGINT) AS duplicate_keys
  FROM courier_daily"""),
)
def snk04(spark, sf):
    return files.publish_checks(L.courier_daily(spark, sf), "courier_daily_performance")


@query("snk05_publish_gold", over("daily", _GOLD_COUNTS))
def snk05(spark, sf):
    gold = fresh_path(spark, "gold")
    medallion.write_gold(L.fact(spark, sf), gold, L.PROCESSED)
    tables = {n: files.read_layer(spark, f"{gold}/{n}") for n in S.PUBLISHED_TABLES}
    return files.publish_gold(tables, fresh_path(spark, "published"))


# -- projections -----------------------------------------------------------------------
_FLAG_LIST = ", ".join(S.WARNING_FLAGS.values())


@query(
    "prj01_bronze",
    over("flagged", f"""SELECT {RAW_LIST}, {_FLAG_LIST}, _quality_warning_count, _quality_status,
  {", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in (
      "accept_timestamp", "accept_gps_timestamp", "delivery_timestamp",
      "delivery_gps_timestamp"))},
  delivery_duration_minutes, _source_row_number, 'orders.parquet' AS _source_file,
  '{L.SOURCE}' AS _source_path, '{L.SHA256}' AS _source_sha256,
  '{L.REVISION}' AS _dataset_revision, '{L.PROCESSED}' AS _ingested_at,
  true AS _quality_contract_passed FROM flagged"""),
)
def prj01(spark, sf):
    return L.bronze(spark, sf)


@query(
    "prj01_bronze_lineage",
    over("flagged", f"""SELECT order_id, l._source_row_number, sha256(body) AS _source_sha256,
  _quality_status, _quality_warning_count
  FROM flagged JOIN csv_lines l USING (order_id) JOIN csv_files USING (part, slice)""",
         L.SLICED_SQL),
)
def prj01_lineage(spark, sf):
    """Bronze over many raw files: every row with its line and the digest of its own file."""
    path = L.sliced_csv(spark, sf)
    stored = fresh_path(spark, "digests")
    files.file_digests(spark, path).write.parquet(stored)
    text = files.with_digests(
        files.read_csv_text(spark, f"{path}/*/*", numbered=True), spark.read.parquet(stored)
    )
    source, line, digest = "_source_path", "_source_row_number", "_source_sha256"
    bronze = medallion.add_bronze_columns(
        Q.typed(text, source, line, digest), F.col(digest), L.REVISION, L.PROCESSED, F.col(source)
    )
    return bronze.select("order_id", line, digest, "_quality_status", "_quality_warning_count")


@query(
    "prj02_source_row_number",
    over("raw", "SELECT part AS city, order_id, _source_row_number FROM csv_lines", L.SLICED_SQL),
)
def prj02(spark, sf):
    """Line numbers of sorted CSV files, found without moving the rows."""
    text = files.read_csv_text(spark, f"{L.sliced_csv(spark, sf)}/*/*", numbered=True)
    return text.select(
        F.trim("city").alias("city"), F.col("order_id").cast("bigint").alias("order_id"),
        "_source_row_number",
    )


@query(
    "prj03_silver",
    over("fact", f"""SELECT order_id, region_id, city, courier_id, aoi_id, aoi_type,
  {text_dates("partition_timestamp", "accept_timestamp", "delivery_timestamp")},
  accept_gps_lng_clean, accept_gps_lat_clean, delivery_gps_lng_clean, delivery_gps_lat_clean,
  accept_gps_valid, delivery_gps_valid, gps_quality_status, delivery_duration_minutes,
  delivery_duration_hours, delivery_duration_status,
  delivery_duration_status = 'zero_or_negative' AS is_zero_or_negative_duration,
  delivery_duration_status = 'long' AS is_long_delivery, accept_hour, delivery_hour,
  is_quality_warning, '{L.PROCESSED}' AS _silver_processed_at, '1.0' AS _silver_version
  FROM silver"""),
)
def prj03(spark, sf):
    return L.silver(spark, sf).select(
        "order_id", "region_id", "city", "courier_id", "aoi_id", "aoi_type",
        "partition_timestamp", "accept_timestamp", "delivery_timestamp",
        "accept_gps_lng_clean", "accept_gps_lat_clean", "delivery_gps_lng_clean",
        "delivery_gps_lat_clean", "accept_gps_valid", "delivery_gps_valid",
        "gps_quality_status", "delivery_duration_minutes", "delivery_duration_hours",
        "delivery_duration_status", "is_zero_or_negative_duration", "is_long_delivery",
        "accept_hour", "delivery_hour", "is_quality_warning", "_silver_processed_at",
        "_silver_version",
    )


_FACT_TEXT = text_dates(
    "delivery_date", "accept_timestamp", "delivery_timestamp", "_gold_processed_at"
)
_DAY_TEXT = text_dates(
    "delivery_date", "first_accept_timestamp", "last_delivery_timestamp", "_gold_processed_at"
)


@query("prj04_delivery_fact", over("fact", f"SELECT * REPLACE ({_FACT_TEXT}) FROM fact"))
def prj04(spark, sf):
    return L.fact(spark, sf)


@query("prj07_staging_fact", over("fact", f"SELECT * REPLACE ({_FACT_TEXT}) FROM fact"))
def prj07_fact(spark, sf):
    return marts.stage_fact(L.fact(spark, sf))


@query(
    "prj07_staging_courier_daily", over("marts", f"SELECT * REPLACE ({_DAY_TEXT}) FROM stg_courier")
)
def prj07_courier(spark, sf):
    return marts.stage_courier_daily(L.courier_daily(spark, sf))


@query("prj07_staging_city_daily", over("marts", f"SELECT * REPLACE ({_DAY_TEXT}) FROM stg_city"))
def prj07_city(spark, sf):
    return marts.stage_city_daily(L.city_daily(spark, sf))


@query("flt05_known_couriers", over("fact", "SELECT order_id FROM fact WHERE courier_id > 0"))
def flt05(spark, sf):
    return medallion.known_couriers(L.fact(spark, sf)).select("order_id")


# -- quality ------------------------------------------------------------------------------
@query(
    "dq01_column_contract",
    over("raw", "SELECT count(*) AS row_count, '' AS missing, '' AS unexpected, true AS ordered "
         "FROM raw"),
)
def dq01(spark, sf):
    raw = L.raw(spark, sf)
    header = Q.column_order_problems(raw.columns)
    return raw.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.lit(",".join(header["missing"])).alias("missing"),
        F.lit(",".join(header["unexpected"])).alias("unexpected"),
        F.lit(header["ordered"]).alias("ordered"),
    )


_BROKEN_SQL = """broken AS (
  SELECT order_id, _source_row_number,
    CASE WHEN order_id % 101 = 0 THEN -region_id - 1 ELSE region_id END AS region_id,
    CASE WHEN order_id % 103 = 0 THEN '   ' ELSE city END AS city,
    CASE WHEN order_id % 107 = 0 THEN NULL ELSE courier_id END AS courier_id,
    CASE WHEN order_id % 109 = 0 THEN lng + 200 ELSE lng END AS lng,
    CASE WHEN order_id % 113 = 0 THEN lat - 200 ELSE lat END AS lat,
    CASE WHEN order_id % 127 = 0 THEN '02-30 08:00:00' ELSE accept_time END AS accept_time,
    CASE WHEN order_id % 131 = 0 THEN '1332' ELSE ds END AS ds,
    accept_gps_lng, CASE WHEN order_id % 137 = 0 THEN NULL ELSE accept_gps_lat END
      AS accept_gps_lat
  FROM raw)"""


def _broken(spark, sf):
    """The raw deliveries with one contract violation of every kind."""
    k = F.col("order_id")
    return L.raw(spark, sf, with_row=True).withColumns(
        {
            "region_id": F.when(k % 101 == 0, -F.col("region_id") - 1)
            .otherwise(F.col("region_id")),
            "city": F.when(k % 103 == 0, "   ").otherwise(F.col("city")),
            "courier_id": F.when(k % 107 != 0, F.col("courier_id")),
            "lng": F.when(k % 109 == 0, F.col("lng") + 200).otherwise(F.col("lng")),
            "lat": F.when(k % 113 == 0, F.col("lat") - 200).otherwise(F.col("lat")),
            "accept_time": F.when(k % 127 == 0, "02-30 08:00:00").otherwise(F.col("accept_time")),
            "ds": F.when(k % 131 == 0, "1332").otherwise(F.col("ds")),
            "accept_gps_lat": F.when(k % 137 != 0, F.col("accept_gps_lat")),
        }
    )


_CASE_RULES = {
    "region_id:non_negative_integer": ("region_id < 0", "region_id"),
    "city:non_empty_string": ("length(trim(city)) = 0", "city"),
    "courier_id:not_nullable": ("courier_id IS NULL", "courier_id"),
    "lng:valid_longitude": ("lng NOT BETWEEN -180 AND 180", "lng"),
    "lat:valid_latitude": ("lat NOT BETWEEN -90 AND 90", "lat"),
    "accept_time:valid_month_day_time": (
        "try_strptime('2000-' || accept_time, '%Y-%m-%d %H:%M:%S') IS NULL", "accept_time"),
    "ds:valid_day_partition": ("try_strptime('2000' || ds, '%Y%m%d') IS NULL", "ds"),
    "accept_gps_pair_consistent": (
        "(accept_gps_lng IS NULL) <> (accept_gps_lat IS NULL)", "accept_gps_lng"),
}
_CASES_SQL = "cases AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, _source_row_number, {c} IS NULL AS no_value FROM broken WHERE {w}"
    for r, (w, c) in _CASE_RULES.items()
) + ")"


@query(
    "dq02_contract_rule_counts",
    over("raw", "SELECT rule, count(*) AS failures FROM cases GROUP BY rule", _BROKEN_SQL,
         _CASES_SQL),
)
def dq02(spark, sf):
    return Q.contract_counts(_broken(spark, sf)).where("failures > 0")


@query(
    "dq03_accept_gps_pair",
    over("raw", "SELECT order_id FROM broken WHERE (accept_gps_lng IS NULL) <> "
         "(accept_gps_lat IS NULL)", _BROKEN_SQL),
)
def dq03(spark, sf):
    broken = _broken(spark, sf)
    rule = next(r for r in Q.contract_rules(broken) if r.name == "accept_gps_pair_consistent")
    return broken.where(rule.hit).select("order_id")


@query(
    "dq04_duplicate_rows",
    """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line,
  l_partkey % 50 AS aoi_id, l_suppkey % 10 AS courier_id, l_quantity AS quantity, copies
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem)
WHERE copies > 1""",
)
def dq04(spark, sf):
    """Every copy of a repeated key."""
    from milepost.session import configure

    return Q.duplicate_rows(
        deliveries.duplicated_deliveries(configure(spark), sf), ["order_id", "line"]
    )


@query(
    "dq05_failure_sample",
    over("raw", """SELECT rule, _source_row_number, no_value, count(*) OVER () AS total_failures
  FROM cases QUALIFY row_number() OVER (ORDER BY _source_row_number, rule) <= 20""",
         _BROKEN_SQL, _CASES_SQL),
)
def dq05(spark, sf):
    """The first 20 failing checks, with the total."""
    cases = Q.failure_cases(_broken(spark, sf), "_source_row_number")
    return Q.failure_sample(cases, "_source_row_number").select(
        "rule", "_source_row_number", F.col("failure_case").isNull().alias("no_value"),
        "total_failures",
    )


def _warning_query(number: int, rule: str):
    flag = S.WARNING_FLAGS[rule]

    @query(f"dq{number:02d}_{rule}", over("flagged", f"SELECT order_id FROM flagged WHERE {flag}"))
    def run(spark, sf):
        return L.flagged(spark, sf).where(flag).select("order_id")

    return run


for _i, _rule in enumerate(S.WARNING_FLAGS):
    _warning_query(6 + _i, _rule)


@query(
    "dq14_warning_report", over("flagged", f"SELECT * FROM ({_RULES_SQL}) WHERE row_count > 0")
)
def dq14(spark, sf):
    return Q.warning_report(L.flagged(spark, sf))


_SAMPLES_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, order_id AS sample_order, _source_row_number FROM flagged WHERE {f} "
    "QUALIFY row_number() OVER (ORDER BY _source_row_number) <= 20"
    for r, f in S.WARNING_FLAGS.items()
)


@query("win05_warning_samples", over("flagged", _SAMPLES_SQL))
def win05(spark, sf):
    """The first 20 rows of every warning rule."""
    samples = Q.warning_samples(L.bronze(spark, sf), "_source_row_number")
    order = F.get_json_object("record", "$.order_id").cast("bigint")
    return samples.select("rule", order.alias("sample_order"), "_source_row_number")


@query(
    "dq15_row_flags",
    over("flagged", f"SELECT order_id, {_FLAG_LIST}, _quality_warning_count, _quality_status "
         "FROM flagged"),
)
def dq15(spark, sf):
    return L.flagged(spark, sf).select(
        "order_id", *S.WARNING_FLAGS.values(), "_quality_warning_count", "_quality_status"
    )


@query("dq16_contract_gate", over("raw", "SELECT count(*) AS row_count FROM raw"))
def dq16(spark, sf):
    """Rows that pass the whole contract; a single failure would raise."""
    return Q.enforce_contract(L.raw(spark, sf)).agg(F.count("*").alias("row_count"))


@query(
    "dq17_bronze_gate",
    over("raw", "SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS null_keys, "
         "CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS contract_failures FROM raw"),
)
def dq17(spark, sf):
    return Q.bronze_gate_counts(L.bronze(spark, sf))


@query(
    "dq18_silver_gate",
    over("fact", """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS null_keys,
  CAST(0 AS BIGINT) AS duplicate_keys,
  count(*) FILTER (WHERE partition_timestamp IS NULL) AS null_partition_timestamp,
  count(*) FILTER (WHERE accept_timestamp IS NULL) AS null_accept_timestamp,
  count(*) FILTER (WHERE delivery_timestamp IS NULL) AS null_delivery_timestamp FROM silver"""),
)
def dq18(spark, sf):
    return Q.silver_gate_counts(L.silver(spark, sf))


@query(
    "dq19_clean_coordinates",
    over("fact", "SELECT order_id, accept_gps_lng_clean, accept_gps_lat_clean, accept_gps_valid, "
         "delivery_gps_lng_clean, delivery_gps_lat_clean, delivery_gps_valid FROM silver"),
)
def dq19(spark, sf):
    return L.silver(spark, sf).select(
        "order_id", "accept_gps_lng_clean", "accept_gps_lat_clean", "accept_gps_valid",
        "delivery_gps_lng_clean", "delivery_gps_lat_clean", "delivery_gps_valid",
    )


@query("dq20_gps_status", over("fact", "SELECT order_id, gps_quality_status FROM silver"))
def dq20(spark, sf):
    return L.silver(spark, sf).select("order_id", "gps_quality_status")


@query(
    "dq21_duration_status",
    over("fact", "SELECT delivery_duration_status, count(*) AS row_count FROM silver GROUP BY 1"),
)
def dq21(spark, sf):
    silver = L.silver(spark, sf)
    return silver.groupBy("delivery_duration_status").agg(F.count("*").alias("row_count"))


@query(
    "dq22_layer_row_counts",
    over("fact", " UNION ALL ".join(
        f"SELECT '{n}' AS layer, (SELECT count(*) FROM {t}) AS row_count, true AS matches_source"
        for n, t in (("raw", "raw"), ("bronze", "flagged"), ("silver", "silver"),
                     ("fact", "fact")))),
)
def dq22(spark, sf):
    return medallion.layer_counts(
        {
            "raw": L.raw(spark, sf),
            "bronze": L.bronze(spark, sf),
            "silver": L.silver(spark, sf),
            "fact": L.fact(spark, sf),
        }
    )


@query(
    "dq23_reconciliation",
    over("daily", """SELECT *, courier_orders = known_courier_orders AS courier_matches,
  city_orders = row_count AS city_matches,
  known_courier_orders + zero_courier_orders = row_count AS couriers_complete
  FROM (SELECT (SELECT count(*) FROM fact) AS row_count,
    (SELECT count(*) FROM fact WHERE courier_id > 0) AS known_courier_orders,
    (SELECT count(*) FROM fact WHERE courier_id = 0) AS zero_courier_orders,
    (SELECT CAST(sum(orders_total) AS BIGINT) FROM courier_daily) AS courier_orders,
    (SELECT CAST(sum(orders_total) AS BIGINT) FROM city_daily) AS city_orders)"""),
)
def dq23(spark, sf):
    fact = L.stored_fact(spark, sf)
    return medallion.reconcile(fact, L.stored_courier_daily(spark, sf), L.stored_city_daily(spark, sf))


_SQL_TABLE = {
    "delivery_fact": "fact", "stg_delivery_fact": "fact",
    "courier_daily_performance": "courier_daily", "city_daily_performance": "city_daily",
    "stg_courier_daily_performance": "stg_courier", "stg_city_daily_performance": "stg_city",
    "mart_delivery_overview": "mart_overview", "mart_courier_ranking": "mart_courier",
    "mart_city_performance": "mart_city",
}


def _check_sql() -> str:
    lines = []
    for table, checks in marts.DECLARED_CHECKS.items():
        for c in checks:
            col, src = c["column"], _SQL_TABLE[table]
            if c["kind"] == "unique":
                count = f"(SELECT count(*) FROM (SELECT {col} FROM {src} WHERE {col} IS NOT NULL "
                count += f"GROUP BY {col} HAVING count(*) > 1))"
            else:
                where = f"{col} IS NULL"
                if c["kind"] == "accepted_values":
                    where = f"{col} NOT IN ({', '.join(repr(v) for v in c['values'])})"
                if c.get("where"):
                    where += f" AND {c['where']}"
                count = f"(SELECT count(*) FROM {src} WHERE {where})"
            lines.append(f"SELECT '{table}' AS table_name, '{c['kind']}' AS check_name, "
                         f"'{col}' AS column_name, {count} AS failures")  # fmt: skip
    return over("marts", " UNION ALL ".join(lines))


@query("dq24_declared_checks", _check_sql())
def dq24(spark, sf):
    """All declared checks of the published, staged and mart tables."""
    gold = {
        "delivery_fact": L.stored_fact(spark, sf),
        "courier_daily_performance": L.stored_courier_daily(spark, sf),
        "city_daily_performance": L.stored_city_daily(spark, sf),
    }
    staged = {
        "stg_delivery_fact": marts.stage_fact(gold["delivery_fact"]),
        "stg_courier_daily_performance": marts.stage_courier_daily(
            gold["courier_daily_performance"]
        ),
        "stg_city_daily_performance": marts.stage_city_daily(gold["city_daily_performance"]),
    }
    final = {
        "mart_delivery_overview": marts.delivery_overview(staged["stg_delivery_fact"]),
        "mart_courier_ranking": marts.courier_ranking(staged["stg_courier_daily_performance"]),
        "mart_city_performance": marts.city_performance(staged["stg_city_daily_performance"]),
    }
    out = None
    for name, df in {**gold, **staged, **final}.items():
        one = Q.run_checks(df, name, marts.DECLARED_CHECKS[name])
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dq25_freshness",
    over("fact", f"""SELECT '{L.PROCESSED}' AS newest, 30.0::DOUBLE AS age_hours,
  CASE WHEN count(*) > 0 THEN 'warn' ELSE 'error' END AS status FROM fact"""),
)
def dq25(spark, sf):
    now = F.lit("2001-01-02 06:00:00").cast("timestamp")
    return Q.freshness(L.stored_fact(spark, sf), now)


@query(
    "dq29_table_profile",
    over("raw", "SELECT count(*) AS row_count, CAST(17 AS BIGINT) AS column_count, "
         "CAST(0 AS BIGINT) AS duplicate_row_count, '' AS missing_columns, "
         "'' AS unexpected_columns FROM raw"),
)
def dq29(spark, sf):
    return Q.table_profile(L.raw(spark, sf))


def _profile_sql() -> str:
    def shown(value, kind):
        text = f"CAST({value} AS VARCHAR)"
        small = ("3e-05", "3.0E-5"), ("4e-05", "4.0E-5")
        for ours, theirs in small if kind == "double" else ():
            text = f"replace({text}, '{ours}', '{theirs}')"
        return text

    parts = []
    for c, kind in S.RAW_FIELDS:
        number = c in _LONGS or kind == "double"
        value = f"CAST({c} AS BIGINT)" if c == "ds" else c
        dtype = "int64" if c in _LONGS else "float64" if number else "object"
        low, high = (f"min({value})::DOUBLE", f"max({value})::DOUBLE") if number else ("NULL",) * 2
        parts.append(
            f"SELECT '{c}' AS name, '{dtype}' AS dtype, count(*) AS row_count, "
            f"count({c}) AS non_null_count, count(*) - count({c}) AS null_count, "
            f"round_even((count(*) - count({c}))::DOUBLE / count(*) * 100 * 1000, 0) / 1000 "
            f"AS null_percentage, count(DISTINCT {value}) AS unique_count, "
            f"{low} AS numeric_minimum, {high} AS numeric_maximum, "
            "(SELECT string_agg(v, '|' ORDER BY r, v) FROM (SELECT "
            f"{shown(value, kind)} AS v, min(_source_row_number) AS r "
            f"FROM raw WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY r, v LIMIT 5)) "
            "AS sample_values FROM raw"
        )
    return over("raw", " UNION ALL ".join(parts))


@query("dq30_column_profile", _profile_sql())
def dq30(spark, sf):
    """Column statistics with the first values of every column."""
    return Q.column_profile(L.raw(spark, sf, with_row=True), "_source_row_number")


# -- aggregates -----------------------------------------------------------------------
@query(
    "agg01_courier_daily_performance",
    over("daily", f"SELECT * REPLACE ({_DAY_TEXT}) FROM courier_daily"),
)
def agg01(spark, sf):
    return L.courier_daily(spark, sf)


@query(
    "agg02_city_daily_performance",
    over("daily", f"SELECT * REPLACE ({_DAY_TEXT}) FROM city_daily"),
)
def agg02(spark, sf):
    return L.city_daily(spark, sf)


@query(
    "agg03_safe_rates",
    over("fact", """SELECT city, aoi_type, CASE WHEN sum(is_valid_duration::INT) > 0 THEN
  round_even(sum(is_late_delivery::INT)::DOUBLE / sum(is_valid_duration::INT) * 100 * 100, 0)
  / 100 ELSE 0 END AS late_rate FROM fact GROUP BY 1, 2"""),
)
def agg03(spark, sf):
    grouped = L.fact(spark, sf).groupBy("city", "aoi_type").agg(
        F.count_if("is_late_delivery").alias("late"), F.count_if("is_valid_duration").alias("ok")
    )
    return grouped.select("city", "aoi_type", X.safe_rate("late", "ok").alias("late_rate"))


@query(
    "agg04_mart_delivery_overview",
    over("marts", f"SELECT * REPLACE ({text_dates('delivery_date')}) FROM mart_overview"),
)
def agg04(spark, sf):
    return marts.delivery_overview(marts.stage_fact(L.stored_fact(spark, sf)))


@query(
    "agg05_mart_city_performance",
    over("marts", f"SELECT * REPLACE ({text_dates('first_delivery_date', 'last_delivery_date')}) "
         "FROM mart_city"),
)
def agg05(spark, sf):
    return marts.city_performance(marts.stage_city_daily(L.stored_city_daily(spark, sf)))


@query("agg06_courier_performance", over("marts", "SELECT * FROM courier_performance"))
def agg06(spark, sf):
    return marts.courier_performance(marts.stage_courier_daily(L.stored_courier_daily(spark, sf)))


@query("agg07_fact_kpis", over("fact", _KPI_SQL))
def agg07(spark, sf):
    return medallion.fact_kpis(L.stored_fact(spark, sf))


@query(
    "agg08_order_totals",
    over("daily", """SELECT (SELECT CAST(sum(orders_total) AS BIGINT) FROM courier_daily)
  AS courier_orders, (SELECT CAST(sum(orders_total) AS BIGINT) FROM city_daily)
  AS city_orders"""),
)
def agg08(spark, sf):
    city = medallion.order_total(L.stored_city_daily(spark, sf), "city_orders")
    courier = medallion.order_total(L.stored_courier_daily(spark, sf), "courier_orders")
    return courier.withColumn("city_orders", city.scalar())


@query(
    "agg09_coordinate_bounds",
    over("raw", " UNION ALL ".join(
        f"SELECT '{c}' AS name, min({c}) AS minimum, max({c}) AS maximum FROM raw"
        for c in S.COORDINATE_COLUMNS)),
)
def agg09(spark, sf):
    return Q.coordinate_bounds(L.raw(spark, sf))


@query(
    "agg10_duration_profile",
    over("raw", """SELECT count(mins) AS valid_count, count(*) - count(mins)
  AS missing_or_invalid_count, round_even(min(mins) * 1000, 0) / 1000 AS minimum,
  round_even(max(mins) * 1000, 0) / 1000 AS maximum,
  round_even(avg(mins) * 1000, 0) / 1000 AS mean,
  round_even(median(mins) * 1000, 0) / 1000 AS median,
  count(*) FILTER (WHERE d < a) AS midnight_rollover_count
FROM (SELECT *, date_diff('second', a, d) / 60.0::DOUBLE + CASE WHEN d < a THEN 1440 ELSE 0 END
      AS mins FROM (
  SELECT try_strptime('1900-' || accept_time, '%Y-%m-%d %H:%M:%S') AS a,
    try_strptime('1900-' || delivery_time, '%Y-%m-%d %H:%M:%S') AS d FROM raw))"""),
)
def agg10(spark, sf):
    return Q.duration_profile(L.raw(spark, sf))


@query(
    "agg11_layer_summary",
    over("fact", """SELECT count(*) AS row_count,
  count(*) FILTER (WHERE is_quality_warning) AS quality_warning_row_count,
  count(*) FILTER (WHERE NOT is_quality_warning) AS valid_row_count,
  count(*) FILTER (WHERE gps_quality_status <> 'complete') AS gps_issue_row_count,
  count(*) FILTER (WHERE delivery_duration_status <> 'normal') AS duration_issue_row_count
  FROM silver"""),
)
def agg11(spark, sf):
    return medallion.layer_summary(L.silver(spark, sf))


@query("win01_courier_ranking", over("marts", "SELECT * FROM mart_courier"))
def win01(spark, sf):
    return marts.courier_ranking(marts.stage_courier_daily(L.stored_courier_daily(spark, sf)))


# -- sorts and sets ------------------------------------------------------------------------
@query(
    "srt01_fact_order",
    over("fact", f"""SELECT {text_dates("delivery_date")}, city, courier_id, order_id,
  row_number() OVER (ORDER BY fact.delivery_date, city, courier_id, order_id) AS position
  FROM fact"""),
)
def srt01(spark, sf):
    """The fact as written, in order; the position proves the order."""
    path = fresh_path(spark, "sorted-fact")
    medallion.fact_order(L.fact(spark, sf)).write.parquet(path)
    from milepost.operators.distributed import row_positions

    keys = ["delivery_date", "city", "courier_id", "order_id"]
    read = spark.read.parquet(path).select(*keys)
    return row_positions(read, [F.col(k).asc() for k in keys])


@query(
    "snk02_gold_by_day",
    over("daily", f"""SELECT 'fact' AS kind, {text_dates("delivery_date")}, count(*) AS row_count,
  min(order_id) AS first_order FROM fact WHERE month(fact.delivery_date) = 7 GROUP BY ALL"""),
)
def snk02_by_day(spark, sf):
    """The fact in one folder a day; one month of it is read back from its own folders."""
    root = fresh_path(spark, "gold-by-day")
    medallion.write_gold(L.stored_fact(spark, sf), root, L.PROCESSED,
                         partition_by=["delivery_date"])
    july = medallion.read_fact(spark, root).where(
        F.col("delivery_date").between(F.lit("2000-07-01").cast("timestamp"),
                                       F.lit("2000-07-31").cast("timestamp"))
    )
    return july.groupBy(F.lit("fact").alias("kind"), "delivery_date").agg(
        F.count("*").alias("row_count"), F.min("order_id").alias("first_order")
    )


@query(
    "set01_consolidate",
    over("fact", "SELECT city, count(*) AS row_count, CAST(sum(order_id) AS BIGINT) AS id_sum "
         "FROM fact GROUP BY city"),
)
def set01(spark, sf):
    """One table per city, written as one layer whose rows are the sum of theirs."""
    path, whole = fresh_path(spark, "by-city"), fresh_path(spark, "consolidated")
    L.stored_fact(spark, sf).withColumn("part", F.col("city")).write.partitionBy("part").parquet(path)
    names = [r["r_name"] for r in deliveries.table(spark, sf, "region").collect()]
    parts = [spark.read.parquet(f"{path}/part={n}") for n in sorted(names)]
    medallion.consolidate_layer(parts, whole)
    return files.read_layer(spark, whole).groupBy("city").agg(
        F.count("*").alias("row_count"), F.sum("order_id").alias("id_sum")
    )


@query(
    "set03_distinct_values",
    over("raw", "SELECT DISTINCT trim(city) AS city, aoi_type FROM raw"),
)
def set03(spark, sf):
    return L.raw(spark, sf).select(F.trim("city").alias("city"), "aoi_type").distinct()
