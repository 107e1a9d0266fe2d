"""Events, replay, live state, scoring stream: the end state after the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.catalog import layers as L
from milepost.catalog.feature_queries import ENRICHED_SQL, T0_SQL, shown
from milepost.catalog.layers import over, text_dates
from milepost.catalog.registry import query
from milepost.functions import expressions as X
from milepost.session import fresh_path
from milepost.streaming import events as E
from milepost.streaming import scoring, state

NOW = "2024-01-01 00:00:00"
MODEL, VERSION = "formula", "formula-v1"
ARRIVALS = (0, 1, 2)
_done: dict[tuple[str, str, str], str] = {}


def now():
    return F.lit(NOW).cast("timestamp")


def uuid5_sql(name: str) -> str:
    """A version 5 UUID in the URL namespace of the SQL text ``name``."""
    d = f"sha1(unhex('{X.URL_NAMESPACE}') || encode({name}))"
    nibble = f"CAST('0x' || substr({d}, 17, 1) AS INT)"
    return (
        f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || "
        f"substr('89ab', ({nibble} & 3) + 1, 1) || substr({d}, 18, 3) || '-' || "
        f"substr({d}, 21, 12)"
    )


def once(label: str, spark: SparkSession, sf: str, run) -> str:
    """Run a stream once per session and input; several queries look at its end state."""
    key = (label, sf, spark.sparkContext.applicationId)
    if key not in _done:
        root = fresh_path(spark, label)
        run(spark, sf, root)
        _done[key] = root
    return _done[key]


# -- events and replay ---------------------------------------------------------------------
def _id(prefix: str):
    return F.concat(F.lit(f"{prefix}-"), F.col("order_id").cast("string"))


_DELIVERY_COLS = """'delivery_update' AS event_type, order_id, region_id, city, courier_id, aoi_id,
  CAST(aoi_type AS INT) AS aoi_type, delivery_duration_minutes, sla_minutes, is_within_sla,
  is_late_delivery, is_quality_warning, accept_gps_lng, accept_gps_lat, delivery_gps_lng,
  delivery_gps_lat"""


@query(
    "prj10_delivery_events",
    over("fact", f"""SELECT {uuid5_sql("'delivery_update:replay:' || order_id")} AS event_id,
  '{NOW}' AS event_time, strftime(delivery_timestamp, '%Y-%m-%d %H:%M:%S') AS source_event_time,
  {_DELIVERY_COLS} FROM fact"""),
)
def prj10(spark, sf):
    return E.delivery_events(L.fact(spark, sf), event_time=now())


@query(
    "prj11_accepted_events",
    over("fact", f"""SELECT 'a-' || order_id AS event_id, 'delivery_accepted' AS event_type,
  '{NOW}' AS event_time, strftime(CASE WHEN order_id % 2 = 0 THEN accept_timestamp
    ELSE delivery_timestamp - to_seconds(delivery_duration_minutes * 60) END,
    '%Y-%m-%d %H:%M:%S') AS source_event_time,
  order_id, region_id, city, courier_id, aoi_id, CAST(aoi_type AS INT) AS aoi_type, sla_minutes,
  accept_gps_lng, accept_gps_lat, CASE WHEN order_id % 2 = 0 THEN accept_gps_valid
    ELSE accept_gps_lng IS NOT NULL AND accept_gps_lat IS NOT NULL END AS accept_gps_valid
  FROM fact"""),
)
def prj11(spark, sf):
    """Every second row has lost its acceptance time and flag; both are rebuilt."""
    even = F.col("order_id") % 2 == 0
    records = L.fact(spark, sf).withColumns(
        {
            "accept_timestamp": F.when(even, F.col("accept_timestamp")),
            "accept_gps_valid": F.when(even, F.col("accept_gps_valid")),
        }
    )
    return E.accepted_events(records, event_time=now(), event_id=_id("a"))


@query(
    "win04_round_robin",
    over("fact", """SELECT order_id, city, turn,
  row_number() OVER (ORDER BY turn, city) AS replay_position FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY delivery_date, courier_id, order_id)
    AS turn FROM fact)"""),
)
def win04(spark, sf):
    keys = ["delivery_date", "courier_id", "order_id"]
    fact = L.fact(spark, sf).select("city", *keys)
    turned = E.round_robin(fact, "city", [F.col(k).asc() for k in keys])
    return turned.select("order_id", "city", "turn", "replay_position")


@query(
    "str14_replay_messages",
    over("fact", """SELECT CAST(order_id AS VARCHAR) AS key, order_id, city,
  courier_id, sla_minutes, accept_gps_valid FROM (SELECT *, order_id % 10 = 0 AS lost FROM fact)
  WHERE NOT lost"""),
)
def str14(spark, sf):
    """Accepted replay as JSON messages; every tenth row has no usable time and is skipped."""
    lost = F.col("order_id") % 10 == 0
    records = L.fact(spark, sf).withColumns(
        {
            "accept_timestamp": F.when(~lost, F.col("accept_timestamp")),
            "delivery_duration_minutes": F.when(lost, F.lit(-5.0))
            .otherwise(F.col("delivery_duration_minutes")),
        }
    )
    messages = E.replay_messages(records, E.ACCEPTED, event_time=now())
    event = F.from_json("value", S.ACCEPTED_EVENT_SCHEMA).alias("e")
    return messages.select("key", event).select(
        "key", "e.order_id", "e.city", "e.courier_id", "e.sla_minutes", "e.accept_gps_valid"
    )


@query(
    "str14_replay_counts",
    over("fact", """SELECT count(*) FILTER (WHERE order_id % 10 <> 0) AS published,
  count(*) FILTER (WHERE order_id % 10 = 0) AS skipped FROM fact"""),
)
def str14_counts(spark, sf):
    lost = F.col("order_id") % 10 == 0
    records = L.fact(spark, sf).withColumns(
        {
            "accept_timestamp": F.when(~lost, F.col("accept_timestamp")),
            "delivery_duration_minutes": F.when(~lost, F.col("delivery_duration_minutes")),
        }
    )
    return E.replay_counts(records)


@query(
    "snk07_keyed_messages",
    over("fact", "SELECT CAST(order_id AS VARCHAR) AS key, courier_id, is_late_delivery "
         "FROM fact"),
)
def snk07(spark, sf):
    """Messages as a topic publish writes them, key = order."""
    path = fresh_path(spark, "topic")
    E.replay_messages(L.fact(spark, sf), event_time=now()).write.json(path)
    read = spark.read.schema("key string, value string").json(path)
    event = F.from_json("value", S.DELIVERY_EVENT_SCHEMA).alias("e")
    return read.select("key", event).select("key", "e.courier_id", "e.is_late_delivery")


# -- delivery stream to live state ------------------------------------------------------------
LOG_SQL = """updates AS (
  SELECT fact.*, v, copy, 'd-' || order_id || '-' || v AS event_id,
    TIMESTAMP '2024-01-01' + to_minutes(order_id % 5000) + to_hours(v) AS event_time,
    (order_id + 2 * v + CASE WHEN copy = 1 THEN 1 ELSE 0 END) % 3 AS arrival
  FROM fact, (VALUES (0), (1), (2)) AS a(v), (VALUES (0), (1), (2)) AS b(copy)
  WHERE v <= order_id % 3 AND (copy = 0 OR copy = 1 AND order_id % 5 = 0
    OR copy = 2 AND order_id % 7 = 0)),
log AS (
  SELECT * REPLACE (v % 2 = 1 AS is_quality_warning),
    event_time + to_seconds(1) + to_minutes(copy) AS kafka_timestamp,
    CAST(order_id % 3 AS INT) AS kafka_partition, order_id * 10 + v * 3 + copy AS kafka_offset
  FROM updates)"""


def delivery_log(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery messages with updates out of order, copies, and unreadable values.

    Order ``k`` has ``k % 3 + 1`` updates one hour apart; some are sent again
    later or twice at once; ``arrival`` says with which of three deliveries to
    the topic a message comes.
    """
    k = F.col("order_id")
    again = F.array_compact(
        F.array(F.lit(0), F.when(k % 5 == 0, F.lit(1)), F.when(k % 7 == 0, F.lit(2)))
    )
    rows = (
        L.fact(spark, sf)
        .withColumn("v", F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))))
        .withColumn("copy", F.explode(again))
    )
    minute = (k % 5000) * 60 + F.col("v") * 3600
    event_time = F.timestamp_seconds(F.unix_seconds(now()) + minute)
    named = rows.withColumn("is_quality_warning", F.col("v") % 2 == 1).withColumn(
        "_at", event_time
    )
    shown_columns = {
        "event_id": F.concat_ws("-", F.lit("d"), k.cast("string"), F.col("v").cast("string")),
        "event_type": F.lit(E.DELIVERY),
        "event_time": F.col("_at"),
        "source_event_time": F.col("delivery_timestamp"),
        "aoi_type": F.col("aoi_type").cast("int"),
    }
    value = F.to_json(
        F.struct(*[shown_columns.get(n, F.col(n)).alias(n)
                   for n in S.DELIVERY_EVENT_SCHEMA.names]),
        {"ignoreNullFields": "false"},
    )
    good = named.select(
        k.cast("string").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit("delivery-events").alias("topic"),
        (k % 3).cast("int").alias("partition"),
        (k * 10 + F.col("v") * 3 + F.col("copy")).alias("offset"),
        F.timestamp_seconds(
            F.unix_seconds(now()) + minute + 1 + F.col("copy") * 60
        ).alias("timestamp"),
        ((k + 2 * F.col("v") + F.when(F.col("copy") == 1, 1).otherwise(0)) % 3)
        .cast("int").alias("arrival"),
    )
    bad = good.where(F.col("offset") % 50 == 0).withColumns(
        {"value": F.lit("{not json").cast("binary"), "offset": F.col("offset") + 9}
    )
    return good.unionByName(bad)


def _followed(spark, start) -> list:
    """Run a query to its end; the counters that its batches reported."""
    counters = state.Counters()
    spark.streams.addListener(counters)
    try:
        counters.follow(start())
    finally:
        spark.streams.removeListener(counters)
    return counters.rows


def _save_counters(spark, rows, names: dict[str, str], root: str) -> None:
    """One row per batch; ``names`` maps observed names to column names."""
    data = [(k, *[found[n] for n in names]) for k, found in rows]
    columns = ", ".join(f"{c} bigint" for c in ("batch_id", *names.values()))
    spark.createDataFrame(data, columns).coalesce(1).write.parquet(f"{root}/counters")


def _delivery_state(spark, root):
    messages = state.message_files(spark, f"{root}/topic")
    return state.start_delivery_state(
        E.parse_events(messages, E.DELIVERY), f"{root}/state", f"{root}/checkpoint",
        available_now=True,
    )


def _publish(spark, source: str, topic: str, prefix: str) -> None:
    """Move the data files of ``source`` into the topic; a prefix keeps names of parts apart."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(topic).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(topic))
    for file in store.listStatus(path(source)) if store.exists(path(source)) else ():
        name = file.getPath().getName()
        if not store.rename(file.getPath(), path(topic, prefix + name)):
            raise OSError(f"{name} could not be moved to {topic}")


def _deliver(spark, sf, root):
    # Computed and stored once; each part is moved into the topic when its turn comes.
    (
        delivery_log(spark, sf).write.partitionBy("arrival").option("compression", "zstd")
        .parquet(f"{root}/to-come")
    )
    rows = []
    for arrival in ARRIVALS:
        _publish(spark, f"{root}/to-come/arrival={arrival}", f"{root}/topic", f"{arrival}-")
        rows += _followed(spark, lambda: _delivery_state(spark, root))
    names = {"staged": "staged", "events": "inserted", "live": "updated"}
    _save_counters(spark, rows, names, root)


def delivered(spark: SparkSession, sf: str) -> str:
    return once("delivery-state", spark, sf, _deliver)


_EVENT_TEXT = f"""event_id, event_type, order_id, region_id, city, courier_id, aoi_id,
  aoi_type, delivery_duration_minutes, sla_minutes, is_within_sla, is_late_delivery,
  is_quality_warning, accept_gps_lng, accept_gps_lat, delivery_gps_lng, delivery_gps_lat,
  kafka_partition, kafka_offset,
  {text_dates("event_time", "source_event_time", "kafka_timestamp")}"""
_EVENTS_BODY = """(SELECT * REPLACE (CAST(aoi_type AS INT) AS aoi_type),
  'delivery_update' AS event_type, delivery_timestamp AS source_event_time FROM log)"""


@query("str01_decode_filter", over("fact", f"SELECT {_EVENT_TEXT} FROM {_EVENTS_BODY}", LOG_SQL))
def str01(spark, sf):
    """All readable messages of the topic, decoded on a stream."""
    topic = delivered(spark, sf) + "/topic"
    path, checkpoint = fresh_path(spark, "decoded"), fresh_path(spark, "checkpoint")
    parsed = E.parse_events(state.message_files(spark, topic), E.DELIVERY)
    writer = parsed.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    state.with_trigger(writer, available_now=True).start(path).awaitTermination()
    return spark.read.parquet(path)


@query(
    "str05_event_log",
    over("fact", f"""SELECT {_EVENT_TEXT} FROM (SELECT * FROM {_EVENTS_BODY}
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival, event_time DESC,
    kafka_timestamp DESC, kafka_partition DESC, kafka_offset DESC) = 1)""", LOG_SQL),
)
def str05(spark, sf):
    """One row per event: the newest of the first micro-batch that held it."""
    return state.event_log(spark, delivered(spark, sf) + "/state")


@query(
    "str06_live_status",
    over("fact", f"""SELECT {_EVENT_TEXT} FROM (SELECT * FROM {_EVENTS_BODY}
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY event_time DESC,
    kafka_timestamp DESC, event_id DESC) = 1)""", LOG_SQL),
)
def str06(spark, sf):
    """The latest event per order; older events that come late change nothing."""
    return state.live_status(spark, delivered(spark, sf) + "/checkpoint")


@query(
    "str07_batch_replay",
    over("fact", """SELECT (SELECT count(DISTINCT event_id) FROM log) AS events,
  (SELECT count(DISTINCT order_id) FROM log) AS live""", LOG_SQL),
)
def str07(spark, sf):
    """A restart without the last commit runs that micro-batch again; nothing changes."""
    root = delivered(spark, sf)
    state.forget_last_commit(spark, f"{root}/checkpoint")
    _delivery_state(spark, root).awaitTermination()
    events = state.event_log(spark, f"{root}/state").agg(F.count("*").alias("events"))
    live = state.live_status(spark, f"{root}/checkpoint").agg(F.count("*"))
    return events.withColumn("live", live.scalar())


@query(
    "str08_batch_counters",
    over("fact", """SELECT CAST(b AS BIGINT) AS batch_id,
  (SELECT count(*) FROM log WHERE arrival = b) AS staged,
  (SELECT count(*) FROM (SELECT event_id FROM log GROUP BY event_id HAVING min(arrival) = b))
    AS inserted,
  (SELECT count(*) FROM (
    SELECT order_id, max(version) FILTER (WHERE arrival = b) AS here,
      max(version) FILTER (WHERE arrival < b) AS held
    FROM (SELECT order_id, arrival, {'e': event_time, 'k': kafka_timestamp, 'i': event_id}
            AS version FROM log) GROUP BY order_id)
    WHERE here IS NOT NULL AND (held IS NULL OR here > held)) AS updated
  FROM (VALUES (0), (1), (2)) AS t(b)""", LOG_SQL),
)
def str08(spark, sf):
    return spark.read.parquet(f"{delivered(spark, sf)}/counters")


@query(
    "win02_newest_per_event",
    over("fact", """SELECT event_id, kafka_offset FROM log QUALIFY row_number() OVER (
  PARTITION BY event_id ORDER BY event_time DESC, kafka_timestamp DESC, kafka_partition DESC,
  kafka_offset DESC) = 1""", LOG_SQL),
)
def win02(spark, sf):
    events = E.parse_events(delivery_log(spark, sf), E.DELIVERY)
    return state.newest(events, ["event_id"], state.EVENT_NEWEST).select(
        "event_id", "kafka_offset"
    )


@query(
    "win03_newest_per_order",
    over("fact", """SELECT order_id, event_id, kafka_offset FROM log QUALIFY row_number() OVER (
  PARTITION BY order_id ORDER BY event_time DESC, kafka_timestamp DESC, event_id DESC) = 1""",
         LOG_SQL),
)
def win03(spark, sf):
    events = E.parse_events(delivery_log(spark, sf), E.DELIVERY)
    return state.newest(events, ["order_id"], state.LIVE_VERSION).select(
        "order_id", "event_id", "kafka_offset"
    )


def _kept(spark, batches, kind: state.Kind) -> str:
    """The root of a state that ``batches`` fed one after the other."""
    root = fresh_path(spark, kind.name)
    for batch in batches:
        batch.write.mode("append").parquet(f"{root}/rows")
        rows = state.row_files(spark, f"{root}/rows", batch.schema)
        state.start_state(
            rows, [kind], root, f"{root}/checkpoint", kind.name, available_now=True
        ).awaitTermination()
    return root


@query(
    "jn08_insert_if_absent",
    """SELECT CAST(user_id AS BIGINT) AS user_id, max(event_id) AS event_id FROM events
WHERE event_type = 'error' AND user_id NOT IN
  (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 97) GROUP BY user_id""",
)
def jn08(spark, sf):
    """Users with an error whose key the target (users with a large purchase) lacks."""
    from milepost.session import configure
    from milepost.sources.deliveries import table

    rows = table(configure(spark), sf, "events")
    held = rows.where("event_type = 'purchase' AND value > 97").groupBy("user_id").agg(
        F.max("event_id").alias("event_id")
    )
    fresh = rows.where("event_type = 'error'").groupBy("user_id").agg(
        F.max("event_id").alias("event_id")
    )
    root = _kept(spark, (held, fresh), state.Kind("users", ("user_id",), ("event_id",), first=True))
    rows = state.changes(spark, root, "users", fresh.schema)
    return rows.where("batch_id = 1").drop("batch_id")


@query(
    "jn09_conditional_upsert",
    """SELECT user_id, event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def jn09(spark, sf):
    """Held rows and a new batch, the strictly newer one per user stays; JSON is decoded."""
    from milepost.session import configure
    from milepost.sources.deliveries import table

    rows = table(configure(spark), sf, "events").select(
        "user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
        F.from_json("props", "k bigint")["k"].alias("k"),
    )
    batches = (rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"))
    root = _kept(spark, batches, state.Kind("users", ("user_id",), ("ts", "event_id")))
    return state.held(spark, f"{root}/checkpoint", "users").drop("ts")


@query(
    "src08_json_payload",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(event_id % 4 AS INT) AS kafka_partition, event_id AS kafka_offset FROM events""",
)
def src08(spark, sf):
    """JSON payloads of a message table, decoded with a fixed schema plus metadata."""
    from milepost.session import configure
    from milepost.sources.deliveries import table

    messages = table(configure(spark), sf, "events").select(
        F.col("props").cast("binary").alias("value"),
        (F.col("event_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )
    body = F.from_json(F.col("value").cast("string"), "k bigint").alias("body")
    return messages.select(
        F.col("offset").alias("event_id"), body, F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    ).select("event_id", "body.k", "kafka_partition", "kafka_offset")


# -- scoring stream --------------------------------------------------------------------------
_PROBABILITY = "(order_id * 7919 % 1001) / 1000.0::DOUBLE"
ACCEPTED_SQL = f"""arrived AS (
  SELECT *, 'a-' || order_id AS event_id, {_PROBABILITY} AS delay_probability,
    CASE WHEN order_id % 71 = 0 THEN 'not a JSON object'
         WHEN order_id % 73 = 0 THEN 'city missing or malformed'
         WHEN order_id % 79 = 0 THEN 'unexpected field'
         WHEN order_id % 83 = 0 THEN 'region_id negative'
         WHEN order_id % 89 = 0 THEN 'the model returned a non-finite probability'
         WHEN order_id % 97 = 0 THEN 'the model returned a probability outside [0, 1]' END
      AS error
  FROM enriched),
predicted AS (
  SELECT *, {uuid5_sql(f"'milepost:{VERSION}:' || event_id")} AS prediction_id,
    delay_probability >= 0.246906::DOUBLE AS predicted_late FROM arrived WHERE error IS NULL)"""


def accepted_log(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance messages, some broken in each way the contract knows."""
    k = F.col("order_id")
    events = E.accepted_events(L.fact(spark, sf), event_time=now(), event_id=_id("a"))
    events = events.withColumns(
        {
            "city": F.when(k % 73 != 0, F.col("city")),
            "region_id": F.when(k % 83 == 0, -F.col("region_id") - 1)
            .otherwise(F.col("region_id")),
        }
    )
    options = {"ignoreNullFields": "false"}
    names = S.ACCEPTED_EVENT_SCHEMA.names
    extra = F.to_json(F.struct(*names, F.lit(1).alias("colour")), options)
    value = (
        F.when(k % 71 == 0, F.lit("{broken")).when((k % 79 == 0) & (k % 73 != 0), extra)
        .otherwise(F.to_json(F.struct(*names), options))
    )
    return events.select(
        k.cast("string").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit("accepted").alias("topic"),
        (k % 3).cast("int").alias("partition"),
        k.alias("offset"),
        now().alias("timestamp"),
    )


def formula_score(featured: DataFrame) -> DataFrame:
    """A stand-in model: a formula of the order id, wrong for some orders."""
    k = F.col("order_id")
    return featured.withColumn(
        "delay_probability",
        F.when(k % 89 == 0, F.lit(float("nan"))).when(k % 97 == 0, F.lit(1.5))
        .otherwise((k * 7919 % 1001) / 1000.0),
    )


def _gold_history(spark, sf, root):
    L.stored_courier_daily(spark, sf).write.parquet(f"{root}/courier_daily")
    L.stored_city_daily(spark, sf).write.parquet(f"{root}/city_daily")

    def read():
        return (
            spark.read.parquet(f"{root}/courier_daily"), spark.read.parquet(f"{root}/city_daily")
        )

    return read


def _score(spark, sf, root):
    history = _gold_history(spark, sf, root)
    # Every message is delivered twice, in two runs of the queries.
    rows = []
    for again in (False, True):
        stored = spark.read.schema(S.MESSAGE_SCHEMA)
        sent = stored.parquet(f"{root}/topic") if again else accepted_log(spark, sf)
        sent.write.mode("append").option("compression", "zstd").parquet(f"{root}/topic")
        scoring.start_scoring(
            state.message_files(spark, f"{root}/topic"), f"{root}/state", f"{root}/scoring",
            history, formula_score, MODEL, VERSION, event_time=now(), available_now=True,
        ).awaitTermination()
        rows += _followed(spark, lambda: scoring.start_predictions(
            spark, f"{root}/state", f"{root}/checkpoint", available_now=True
        ))
    names = {"staged": "staged", "predicted_late": "predicted_late", "predictions": "inserted",
             "latest": "updated", "alerts": "alerts"}
    _save_counters(spark, rows, names, root)


def scored_state(spark: SparkSession, sf: str) -> str:
    return once("scoring-state", spark, sf, _score)


_PREDICTED = f"""prediction_id, event_id AS source_event_id,
  'delivery_delay_prediction' AS event_type, '{NOW}' AS event_time,
  strftime(accept_timestamp, '%Y-%m-%d %H:%M:%S') AS source_event_time, order_id, region_id,
  city, courier_id, aoi_id, delay_probability, predicted_late, 0.246906::DOUBLE AS threshold,
  '{MODEL}' AS model_name, '{VERSION}' AS model_version, courier_prev_day_available,
  city_prev_day_available"""
_STREAM = (T0_SQL, ENRICHED_SQL, ACCEPTED_SQL)


@query("str09_predictions", over("daily", f"SELECT {_PREDICTED} FROM predicted", *_STREAM))
def str09(spark, sf):
    """The prediction log after every message came twice: one row per event."""
    return state.prediction_log(spark, scored_state(spark, sf) + "/state")


@query(
    "str10_alerts",
    over("daily", f"""SELECT {uuid5_sql("'milepost:delivery-delay-alert:' || prediction_id")}
  AS alert_id, prediction_id, event_id AS source_event_id, 'delivery_delay_alert' AS event_type,
  '{NOW}' AS event_time, strftime(accept_timestamp, '%Y-%m-%d %H:%M:%S') AS source_event_time,
  order_id, region_id, city, courier_id, aoi_id, 'predicted_delay_risk' AS alert_type,
  'warning' AS severity, delay_probability, 0.246906::DOUBLE AS threshold,
  '{VERSION}' AS model_version FROM predicted WHERE predicted_late""", *_STREAM),
)
def str10(spark, sf):
    return scoring.alert_log(spark, scored_state(spark, sf) + "/state")


@query("str11_latest_predictions", over("daily", f"SELECT {_PREDICTED} FROM predicted", *_STREAM))
def str11(spark, sf):
    return state.latest_predictions(spark, scored_state(spark, sf) + "/checkpoint")


@query(
    "str12_dead_letters",
    over("daily", """SELECT 'ml_inference_dead_letter' AS event_type, 'accepted' AS source_topic,
  CAST(order_id % 3 AS INT) AS source_partition, order_id AS source_offset,
  'ValueError' AS error_type, error AS error_message, CAST(b AS BIGINT) AS batch_id
  FROM arrived, (VALUES (0), (1)) AS t(b) WHERE error IS NOT NULL""", *_STREAM),
)
def str12(spark, sf):
    letters = spark.read.parquet(f"{scored_state(spark, sf)}/state/dead_letters")
    return letters.drop("event_time", "raw_payload").withColumn(
        "batch_id", F.col("batch_id").cast("bigint")
    )


@query(
    "str13_run_counters",
    over("daily", """SELECT CAST(b AS BIGINT) AS batch_id,
  (SELECT count(*) FROM predicted) AS staged,
  (SELECT count(*) FROM predicted WHERE predicted_late) AS predicted_late,
  CASE WHEN b = 0 THEN (SELECT count(*) FROM predicted) ELSE 0 END AS inserted,
  CASE WHEN b = 0 THEN (SELECT count(*) FROM predicted) ELSE 0 END AS updated,
  CASE WHEN b = 0 THEN (SELECT count(*) FROM predicted WHERE predicted_late) ELSE 0 END AS alerts,
  (SELECT count(*) FROM arrived WHERE error IS NOT NULL) AS dead_letters
  FROM (VALUES (0), (1)) AS t(b)""", *_STREAM),
)
def str13(spark, sf):
    root = scored_state(spark, sf)
    letters = spark.read.parquet(f"{root}/state/dead_letters").groupBy("batch_id")
    counted = letters.agg(F.count("*").alias("dead_letters"))
    counters = spark.read.parquet(f"{root}/counters").join(counted, "batch_id", "left")
    return counters.fillna(0, ["dead_letters"])


@query(
    "dq26_event_contract",
    over("daily", """SELECT coalesce(error, 'ok') AS error, count(*) AS row_count FROM (
  SELECT CASE WHEN error LIKE 'the model%' THEN NULL ELSE error END AS error FROM arrived)
  GROUP BY 1""", *_STREAM),
)
def dq26(spark, sf):
    """Messages by the first contract rule they break."""
    decoded = E.decode(accepted_log(spark, sf), E.ACCEPTED)
    return decoded.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(
        F.count("*").alias("row_count")
    )


@query(
    "dq27_score_check",
    over("fact", """SELECT coalesce(error, 'ok') AS error, count(*) AS row_count FROM (
  SELECT CASE WHEN order_id % 89 = 0 THEN 'the model returned a non-finite probability'
    WHEN order_id % 97 = 0 THEN 'the model returned a probability outside [0, 1]' END AS error
  FROM fact) GROUP BY 1"""),
)
def dq27(spark, sf):
    checked = formula_score(L.fact(spark, sf)).select(scoring.score_error().alias("e"))
    return checked.groupBy(F.coalesce("e", F.lit("ok")).alias("error")).agg(
        F.count("*").alias("row_count")
    )


@query(
    "snk09_dead_letter_payload",
    over("daily", """SELECT order_id AS source_offset, error AS error_message,
  'accepted:' || order_id % 3 || ':' || order_id AS key, order_id % 71 = 0 AS unreadable FROM arrived WHERE error IS NOT NULL
  AND error NOT LIKE 'the model%'""", *_STREAM),
)
def snk09(spark, sf):
    """Dead letters of the decode step as messages, keyed by their place, the raw text kept."""
    decoded = E.decode(accepted_log(spark, sf), E.ACCEPTED)
    letters = E.dead_letters(decoded.where(F.col("error").isNotNull()), event_time=now())
    sent = E.dead_letter_messages(letters)
    fields = "source_offset bigint, error_message string, raw_payload string"
    body = sent.select("key", F.explode(F.array(F.from_json("value", fields))).alias("body"))
    return body.select(
        "body.source_offset", "body.error_message", "key",
        (F.col("body.raw_payload") == "{broken").alias("unreadable"),
    )


_OK = "error IS NULL OR error LIKE 'the model%'"


@query(
    "str02_feature_stream",
    over("daily", f"SELECT order_id, {', '.join(S.MODEL_INPUTS)} FROM arrived WHERE {_OK}",
         *_STREAM),
)
def str02(spark, sf):
    """Accepted events joined with static history on a stream, written as JSON messages."""
    root = scored_state(spark, sf)
    path, checkpoint = fresh_path(spark, "features"), fresh_path(spark, "checkpoint")
    topic = fresh_path(spark, "accepted")
    accepted_log(spark, sf).write.parquet(topic)
    decoded = E.decode(state.message_files(spark, topic), E.ACCEPTED)
    courier = spark.read.parquet(f"{root}/courier_daily")
    city = spark.read.parquet(f"{root}/city_daily")
    featured = scoring.event_features(E.well_formed(decoded), courier, city)
    writer = (
        scoring.feature_messages(featured).writeStream.format("json").outputMode("append")
        .option("checkpointLocation", checkpoint).queryName("accepted-features")
    )
    state.with_trigger(writer, available_now=True).start(path).awaitTermination()
    kinds = {f.name: f.dataType for f in featured.schema}
    payload = F.from_json(
        "value", ", ".join(f"{c} {kinds[c].simpleString()}" for c in ("order_id", *S.MODEL_INPUTS))
    )
    messages = spark.read.schema("key string, value string").json(path)
    return shown(messages.select(payload.alias("p")).select("p.*"))
