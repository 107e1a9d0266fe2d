"""Scalar functions, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from milepost.catalog import layers as L
from milepost.catalog.layers import MEAN, RATE, over
from milepost.catalog.registry import query
from milepost.catalog.stream_queries import uuid5_sql
from milepost.functions import expressions as X
from milepost.session import configure
from milepost.sources import files
from milepost.sources.deliveries import table


@query("fn01_trim", over("raw", "SELECT order_id, trim(city) AS city FROM raw"))
def fn01(spark, sf):
    return L.raw(spark, sf).select("order_id", F.trim("city").alias("city"))


@query(
    "fn02_slice_concat",
    over("raw", "SELECT order_id, substr(accept_time, 1, 2) || substr(accept_time, 4, 2) AS ds "
         "FROM raw"),
)
def fn02(spark, sf):
    both = F.concat(F.substring("accept_time", 1, 2), F.substring("accept_time", 4, 2))
    return L.raw(spark, sf).select("order_id", both.alias("ds"))


@query(
    "fn03_length_lower_match",
    """SELECT c_custkey, length(c_name) AS n, lower(c_name) AS low,
  regexp_full_match(lower(c_mktsegment), '[a-z_][a-z0-9_]*') AS plain FROM customer""",
)
def fn03(spark, sf):
    rows = table(configure(spark), sf, "customer")
    plain = F.lower("c_mktsegment").rlike("^[a-z_][a-z0-9_]*$").alias("plain")
    return rows.select(
        "c_custkey", F.length("c_name").cast("bigint").alias("n"), F.lower("c_name").alias("low"),
        plain,
    )


@query(
    "fn04_key_hash",
    over("raw", "SELECT order_id, md5(region_id || '||' || coalesce(trim(city), '') || '||' || "
         "courier_id) AS key FROM raw"),
)
def fn04(spark, sf):
    key = X.key_hash(
        F.col("region_id").cast("string"), F.coalesce(F.trim("city"), F.lit("")),
        F.col("courier_id").cast("string"),
    )
    return L.raw(spark, sf).select("order_id", key.alias("key"))


@query(
    "fn05_hash_byte",
    "SELECT o_orderkey AS order_id, "
    "CAST('0x' || substr(md5(o_orderkey || ':salt'), 1, 2) AS INT) AS byte FROM orders",
)
def fn05(spark, sf):
    rows = table(configure(spark), sf, "orders")
    return rows.select(
        F.col("o_orderkey").alias("order_id"), X.hash_byte("o_orderkey", "salt").alias("byte")
    )


@query(
    "fn06_uuid5",
    f"SELECT c_custkey, {uuid5_sql(chr(39) + 'é:' + chr(39) + ' || c_name')} AS id FROM customer",
)
def fn06(spark, sf):
    rows = table(configure(spark), sf, "customer")
    return rows.select("c_custkey", X.uuid5(F.concat(F.lit("é:"), "c_name")).alias("id"))


@query("fn07_uuid4", "SELECT count(*) AS row_count, count(*) AS ids, true AS well_formed FROM orders")
def fn07(spark, sf):
    ids = table(configure(spark), sf, "orders").select(F.uuid().alias("id"))
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return ids.agg(
        F.count("*").alias("row_count"), F.count_distinct("id").alias("ids"),
        F.bool_and(F.col("id").rlike(shape)).alias("well_formed"),
    )


@query(
    "fn08_file_sha256",
    over("raw", "SELECT strlen(body)::BIGINT AS bytes, sha256(body) AS sha256 FROM csv_files",
         L.SLICED_SQL),
)
def fn08(spark, sf):
    """Digests of all raw CSV files, streamed in the tasks."""
    path = L.sliced_csv(spark, sf)
    return files.file_digests(spark, path).select("bytes", "sha256")


@query(
    "fn09_parse_or_null",
    over("raw", """SELECT order_id, strftime(try_strptime('2000-' || CASE WHEN order_id % 7 = 0
  THEN '02-30 08:00:00' ELSE accept_time END, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')
  AS moment FROM raw"""),
)
def fn09(spark, sf):
    text = F.when(F.col("order_id") % 7 == 0, "02-30 08:00:00").otherwise(F.col("accept_time"))
    return L.raw(spark, sf).select("order_id", X.parse_month_day_time(text).alias("moment"))


@query(
    "fn10_date_parts",
    """SELECT o_orderkey AS order_id, CAST(year(o_orderdate) AS INT) AS y,
  CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d,
  CAST(isodow(o_orderdate) - 1 AS INT) AS monday0, CAST(isodow(o_orderdate) AS INT) AS monday1,
  strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS day FROM orders""",
)
def fn10(spark, sf):
    t = F.col("o_orderdate").cast("timestamp")
    return table(configure(spark), sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.year(t).alias("y"), F.month(t).alias("m"),
        F.dayofmonth(t).alias("d"), F.weekday(t).alias("monday0"),
        X.iso_weekday(t).alias("monday1"), F.date_trunc("day", t).alias("day"),
    )


@query(
    "fn11_extract_previous_day",
    """SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(isodow(ts) AS INT) AS dow,
  CAST(CAST(ts AS DATE) - 1 AS VARCHAR) AS previous FROM events""",
)
def fn11(spark, sf):
    t = F.col("ts").cast("timestamp")
    return table(configure(spark), sf, "events").select(
        "event_id", F.hour(t).alias("h"), X.iso_weekday(t).alias("dow"),
        F.date_sub(F.to_date(t), 1).cast("string").alias("previous"),
    )


@query(
    "fn12_minutes",
    """SELECT event_id, CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts)
  / 6e7::DOUBLE) AS BIGINT) AS minutes, strftime(ts - to_microseconds(CAST(event_id AS BIGINT) * 1500000),
    '%Y-%m-%d %H:%M:%S') AS earlier FROM events""",
)
def fn12(spark, sf):
    t = F.col("ts").cast("timestamp")
    start = F.lit("2024-01-01").cast("timestamp")
    return table(configure(spark), sf, "events").select(
        "event_id", F.floor(X.minutes_between(start, t)).alias("minutes"),
        X.minus_minutes(t, F.col("event_id") * 0.025).alias("earlier"),
    )


@query(
    "fn13_naive_to_utc",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00' AS utc FROM events",
)
def fn13(spark, sf):
    utc = X.utc_text(F.col("ts").cast("timestamp"))
    return table(configure(spark), sf, "events").select("event_id", utc.alias("utc"))


@query(
    "fn14_rounding",
    f"""SELECT o_orderkey AS order_id,
  round_even(o_orderkey / 8.0::DOUBLE * 100, 0) / 100 AS half_even,
  {RATE.format(n="o_custkey % 17", d="o_orderkey % 40")} AS mart_rate,
  {MEAN.format(n="(o_orderkey % 1000)::DOUBLE", d="o_custkey % 8")} AS mart_mean FROM orders""",
)
def fn14(spark, sf):
    k, cu = F.col("o_orderkey"), F.col("o_custkey")
    return table(configure(spark), sf, "orders").select(
        k.alias("order_id"), X.half_even(k / 8.0, 2).alias("half_even"),
        X.mart_rate(cu % 17, k % 40).alias("mart_rate"),
        X.mart_mean((k % 1000).cast("double"), cu % 8).alias("mart_mean"),
    )


@query(
    "fn15_shift_probability",
    """SELECT order_id, round(CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 1
  ELSE 1 / (1 + exp(-(ln(p) - ln(1 - p) + ln(1.5::DOUBLE)))) END, 9) AS p
FROM (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 1001 = 0 THEN 0::DOUBLE
  ELSE (o_orderkey % 1001) / 1000.0::DOUBLE END AS p FROM orders)""".replace(
        "ln(p) - ln(1 - p)", "ln(CASE WHEN p > 0 AND p < 1 THEN p END)"
        " - ln(CASE WHEN p > 0 AND p < 1 THEN 1 - p END)"),
)
def fn15(spark, sf):
    p = (F.col("o_orderkey") % 1001) / 1000.0
    moved = X.shift_probability(p, F.lit(1.5), F.lit(1.0))
    return table(configure(spark), sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.round(moved, 9).alias("p")
    )


@query(
    "fn16_finite",
    """SELECT CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 7 = 0 THEN false
  WHEN event_id % 11 = 0 THEN false ELSE value IS NOT NULL END AS ok, count(*) AS row_count
FROM events GROUP BY 1""",
)
def fn16(spark, sf):
    k = F.col("event_id")
    v = (
        F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf")))
        .when(k % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    )
    rows = table(configure(spark), sf, "events").select(X.finite(v).alias("ok"))
    return rows.groupBy("ok").agg(F.count("*").alias("row_count"))


@query(
    "fn17_conditional",
    """SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning'
  WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS period, count(*) AS row_count
FROM events GROUP BY 1""",
)
def fn17(spark, sf):
    period = X.day_period(F.hour(F.col("ts").cast("timestamp"))).alias("period")
    rows = table(configure(spark), sf, "events").select(period)
    return rows.groupBy("period").agg(F.count("*").alias("row_count"))


@query(
    "fn18_cast_or_null",
    """SELECT o_orderkey AS order_id, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE)
  AS level, TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders""",
)
def fn18(spark, sf):
    level = F.split("o_orderpriority", "-")[0].try_cast("double")
    return table(configure(spark), sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), level.alias("level"),
        F.col("o_orderstatus").try_cast("double").alias("status"),
    )


@query(
    "fn19_json_round_trip",
    over("raw", "SELECT order_id, city, accept_gps_lng, "
         "accept_gps_lng IS NULL AS kept_null FROM raw"),
)
def fn19(spark, sf):
    """Encoded with nulls kept, decoded with a fixed schema."""
    text = F.to_json(
        F.struct("order_id", "city", "accept_gps_lng"), {"ignoreNullFields": "false"}
    )
    kept = F.col("text").contains('"accept_gps_lng":null').alias("kept_null")
    back = F.from_json("text", "order_id bigint, city string, accept_gps_lng double").alias("e")
    rows = L.raw(spark, sf).select(text.alias("text")).select(kept, back)
    return rows.select("e.*", "kept_null")


@query(
    "flt01_event_filter",
    over("fact", "SELECT order_id FROM fact WHERE order_id % 4 <> 0"),
)
def flt01(spark, sf):
    """Messages without id, order or time, or of another type, are dropped."""
    from milepost.streaming import events as E

    k = F.col("order_id")
    now = F.lit("2024-01-01").cast("timestamp")
    events = E.delivery_events(L.fact(spark, sf), event_time=now).withColumns(
        {
            "event_id": F.when(k % 12 != 0, F.col("event_id")),
            "event_time": F.when(k % 12 != 4, F.col("event_time")),
            "event_type": F.when(k % 12 == 8, "other").otherwise(F.col("event_type")),
        }
    )
    messages = E.to_messages(events).select(
        F.col("value").cast("binary").alias("value"), F.lit(0).alias("partition"),
        F.lit(0).cast("bigint").alias("offset"), now.alias("timestamp"),
    )
    return E.parse_events(messages, E.DELIVERY).select("order_id")
