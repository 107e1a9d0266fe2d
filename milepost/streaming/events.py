"""Delivery and acceptance events: built from the fact, replayed, decoded, checked.

Everything here works on tables and on streams alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milepost import schemas as S
from milepost.functions import expressions as X
from milepost.operators.distributed import row_positions

DELIVERY, ACCEPTED = "delivery_update", "delivery_accepted"
SCHEMAS = {DELIVERY: S.DELIVERY_EVENT_SCHEMA, ACCEPTED: S.ACCEPTED_EVENT_SCHEMA}


def _optional_number(name: str) -> Column:
    return F.when(X.finite(name), F.col(name))


def event_key(kind: str, run: str = "replay") -> Column:
    """A name-based id per order and run.

    A random id would change when a lost task is run again; this one does not.
    """
    return X.uuid5(F.concat_ws(":", F.lit(kind), F.lit(run), F.col("order_id").cast("string")))


# -- events from fact rows ----------------------------------------------------------------
def delivery_events(
    fact: DataFrame, event_time: Column | None = None, event_id: Column | None = None
) -> DataFrame:
    """One ``delivery_update`` per fact row."""
    columns = {
        "event_id": event_key(DELIVERY) if event_id is None else event_id,
        "event_type": F.lit(DELIVERY),
        "event_time": F.current_timestamp() if event_time is None else event_time,
        "source_event_time": F.col("delivery_timestamp"),
        "city": F.trim("city"),
        "aoi_type": F.col("aoi_type").cast("int"),
        **{
            c: _optional_number(c)
            for c in ("delivery_duration_minutes", "accept_gps_lng", "accept_gps_lat",
                      "delivery_gps_lng", "delivery_gps_lat")
        },
    }
    names = S.DELIVERY_EVENT_SCHEMA.names
    return fact.select(*[columns.get(n, F.col(n)).alias(n) for n in names])


def accept_moment(columns: Sequence[str]) -> Column:
    """The acceptance time, or delivery time minus duration where it is unknown.

    Null if neither is usable: no delivery time, or a missing, non-finite or
    negative duration.
    """
    minutes = F.col("delivery_duration_minutes")
    rebuilt = F.when(
        X.finite(minutes) & (minutes >= 0), X.minus_minutes("delivery_timestamp", minutes)
    )
    if "accept_timestamp" in columns:
        return F.coalesce(F.col("accept_timestamp"), rebuilt)
    return rebuilt


def accept_position_ok(columns: Sequence[str]) -> Column:
    """The known flag, or a plain range check of the pair."""
    lng, lat = _optional_number("accept_gps_lng"), _optional_number("accept_gps_lat")
    in_range = F.coalesce(X.in_range(lng, 180.0) & X.in_range(lat, 90.0), F.lit(False))
    if "accept_gps_valid" in columns:
        return F.coalesce(F.col("accept_gps_valid"), in_range)
    return in_range


def accepted_events(
    records: DataFrame, event_time: Column | None = None, event_id: Column | None = None
) -> DataFrame:
    """One ``delivery_accepted`` per row; nothing known only later is published.

    Rows whose acceptance time cannot be found keep a null ``source_event_time``
    so that :func:`replay_messages` can count and skip them.
    """
    columns = {
        "event_id": event_key(ACCEPTED) if event_id is None else event_id,
        "event_type": F.lit(ACCEPTED),
        "event_time": F.current_timestamp() if event_time is None else event_time,
        "source_event_time": accept_moment(records.columns),
        "aoi_type": F.col("aoi_type").cast("int"),
        "accept_gps_lng": _optional_number("accept_gps_lng"),
        "accept_gps_lat": _optional_number("accept_gps_lat"),
        "accept_gps_valid": accept_position_ok(records.columns),
    }
    names = S.ACCEPTED_EVENT_SCHEMA.names
    return records.select(*[columns.get(n, F.col(n)).alias(n) for n in names])


# -- replay ----------------------------------------------------------------------------------
def round_robin(
    records: DataFrame, source: str, order_by: Sequence[Column], cities: Sequence[str] | None = None
) -> DataFrame:
    """Interleave the sources: the first row of each, then the second of each, ...

    Adds ``turn`` (row number in its source) and ``replay_position``, which counts the
    rows by turn and then by source, or by the place of the source in ``cities``.
    """
    turned = row_positions(records, order_by, [source], "turn")
    place = F.col(source)
    if cities is not None:
        turned = turned.where(place.isin(list(cities)))
        place = F.array_position(F.array(*[F.lit(c) for c in cities]), place)
    return row_positions(turned, [F.col("turn").asc(), place.asc()], name="replay_position")


def to_messages(events: DataFrame, key: str = "order_id", *keep: str) -> DataFrame:
    """Events as ``(key, value)`` with a JSON value that keeps nulls."""
    fields = [c for c in events.columns if c not in keep]
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return events.select(F.col(key).cast("string").alias("key"), value.alias("value"), *keep)


def replay_messages(records: DataFrame, mode: str = DELIVERY, **times) -> DataFrame:
    """Fact rows as messages; in accepted mode unusable rows are left out."""
    if mode == DELIVERY:
        return to_messages(delivery_events(records, **times))
    if mode != ACCEPTED:
        raise ValueError(f"unknown replay mode {mode}")
    return to_messages(
        accepted_events(records, **times).where(F.col("source_event_time").isNotNull())
    )


def replay_counts(records: DataFrame) -> DataFrame:
    """Rows that an accepted replay publishes and skips."""
    usable = accept_moment(records.columns).isNotNull()
    return records.agg(
        F.count_if(usable).alias("published"), F.count_if(~usable).alias("skipped")
    )


# -- decode and check -----------------------------------------------------------------------------
def event_rules(kind: str) -> list[tuple[str, Column]]:
    """Named failures of a decoded event in the struct column ``event``."""
    schema = SCHEMAS[kind]
    e = {n: F.col(f"event.{n}") for n in schema.names}
    optional = {"delivery_duration_minutes", "accept_gps_lng", "accept_gps_lat",
                "delivery_gps_lng", "delivery_gps_lat"}
    known = F.array(*[F.lit(n) for n in schema.names])
    keys = F.json_object_keys(F.col("value").cast("string"))
    rules = [("not a JSON object", F.col("event").isNull() | keys.isNull())]
    rules += [(f"{n} missing or malformed", e[n].isNull()) for n in e if n not in optional]
    rules += [("unexpected field", F.size(F.array_except(keys, known)) > 0)]
    rules += [("event_type differs", e["event_type"] != kind)]
    rules += [(f"{n} negative", e[n] < 0)
              for n in ("order_id", "region_id", "courier_id", "aoi_id", "aoi_type")]
    rules += [(f"{n} empty", F.length(e[n]) == 0) for n in ("event_id", "city")]
    rules += [("sla_minutes not positive", e["sla_minutes"] <= 0)]
    if kind == DELIVERY:
        rules += [("delivery_duration_minutes negative", e["delivery_duration_minutes"] < 0)]
    return rules


def with_event(messages: DataFrame, kind: str) -> DataFrame:
    """Messages with the decoded struct ``event``.

    The one-element explode keeps the optimizer from copying the JSON parse
    into every later condition; each payload is parsed once.
    """
    event = F.from_json(F.col("value").cast("string"), SCHEMAS[kind])
    return messages.select(*messages.columns, F.explode(F.array(event)).alias("event"))


def decode(messages: DataFrame, kind: str) -> DataFrame:
    """Messages with their decoded ``event`` and the first broken rule in ``error``."""
    decoded = with_event(messages, kind)
    # Exploded for the same reason: a filter on ``error`` stays a plain null test.
    first = F.coalesce(
        *[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in event_rules(kind)]
    )
    return decoded.select("*", F.explode(F.array(first)).alias("error"))


def well_formed(decoded: DataFrame) -> DataFrame:
    """Checked events with their place in the topic."""
    return decoded.where(F.col("error").isNull()).select(
        "event.*",
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
    )


def parse_events(messages: DataFrame, kind: str) -> DataFrame:
    """The light filter of the live jobs: id, order and time present, type as expected."""
    moment = "event_time" if kind == DELIVERY else "source_event_time"
    rows = with_event(messages, kind).select(
        "event.*",
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
    )
    return rows.where(
        F.col("event_id").isNotNull() & F.col("order_id").isNotNull()
        & F.col(moment).isNotNull() & (F.col("event_type") == kind)
    )


def dead_letters(
    failed: DataFrame, error_type: str = "ValueError", event_time: Column | None = None
) -> DataFrame:
    """Failed messages with their place in the topic, the reason and the raw text."""
    return failed.select(
        F.lit("ml_inference_dead_letter").alias("event_type"),
        (F.current_timestamp() if event_time is None else event_time).alias("event_time"),
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.lit(error_type).alias("error_type"),
        F.col("error").alias("error_message"),
        F.col("value").cast("string").alias("raw_payload"),
    )


def dead_letter_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as ``(key, value)``, keyed by their place ``topic:partition:offset``."""
    place = F.concat_ws(":", "source_topic", "source_partition", "source_offset")
    return to_messages(letters.withColumn("_place", place), "_place", "_place").drop("_place")


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
