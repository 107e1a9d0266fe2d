from datetime import datetime, timedelta

import pytest
from delivery_rows import silver_frame
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.plans import medallion
from milepost.session import fresh_path
from milepost.streaming import events as E
from milepost.streaming import scoring, state

AT = "2001-01-01 00:00:00"
T0 = datetime(2024, 1, 1)


def event_rows(spark, rows):
    """(event_id, order_id, hours, kafka minutes, offset, late) as decoded events."""
    data = [
        (e, E.DELIVERY, T0 + timedelta(hours=h), T0, o, 1, "Jilin", 1, 1, 1, 30.0, 240.0,
         not late, late, False, 1.0, 1.0, 1.0, 1.0, 0, off, T0 + timedelta(minutes=m))
        for e, o, h, m, off, late in rows
    ]
    return spark.createDataFrame(data, state.EVENT_TABLE)


def feed(spark, root, rows, kinds=state.DELIVERIES):
    """Bring ``rows`` as one more micro-batch; its counters."""
    event_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return resume(spark, root, kinds)


def resume(spark, root, kinds=state.DELIVERIES):
    counters = state.Counters()
    spark.streams.addListener(counters)
    stream = state.row_files(spark, f"{root}/in", state.EVENT_TABLE)
    counters.follow(
        state.start_state(stream, kinds, root, f"{root}/checkpoint", "fed", available_now=True)
    )
    spark.streams.removeListener(counters)
    return counters.rows


def live(spark, root):
    rows = state.live_status(spark, f"{root}/checkpoint").collect()
    return {r["order_id"]: r["event_id"] for r in rows}


def log(spark, root):
    return sorted((r["event_id"], r["kafka_offset"]) for r in state.event_log(spark, root).collect())


def test_state_keeps_first_event_and_newest_status(spark):
    root = fresh_path(spark, "state")
    first = [("a", 1, 2, 0, 1, False), ("a", 1, 2, 5, 2, True), ("b", 2, 1, 0, 3, False)]
    assert feed(spark, root, first) == [(0, {"staged": 3, "events": 2, "live": 2})]
    assert live(spark, root) == {1: "a", 2: "b"} and log(spark, root) == [("a", 2), ("b", 3)]
    # an older event, a repeated id with other content, and a newer event
    second = [("c", 1, 1, 0, 4, False), ("b", 2, 1, 0, 9, True), ("d", 2, 3, 0, 5, False)]
    assert feed(spark, root, second) == [(1, {"staged": 3, "events": 2, "live": 1})]
    end = {1: "a", 2: "d"}, [("a", 2), ("b", 3), ("c", 4), ("d", 5)]
    assert (live(spark, root), log(spark, root)) == end
    # A crash before the commit: the batch runs again under its id, with the same outcome.
    assert state.forget_last_commit(spark, f"{root}/checkpoint") == 1
    assert resume(spark, root) == [(1, {"staged": 3, "events": 2, "live": 1})]
    assert (live(spark, root), log(spark, root)) == end
    assert resume(spark, root) == []


def test_equal_version_is_not_newer(spark):
    root = fresh_path(spark, "state")
    rows = [("a", 1, 2, 0, 1, False)]
    feed(spark, root, rows)
    assert feed(spark, root, [("a", 1, 2, 0, 7, True)]) == [(1, {"staged": 1, "events": 0, "live": 0})]
    held = state.live_status(spark, f"{root}/checkpoint").first()
    assert held["kafka_offset"] == 1 and log(spark, root) == [("a", 1)]


def test_a_batch_writes_only_its_changes(spark):
    root = fresh_path(spark, "state")
    feed(spark, root, [(f"e{k}", k, 1, 0, k, False) for k in range(60)])
    for n in range(1, 4):
        feed(spark, root, [("late", 7, 1 + n, 0, 100 + n, False)])
    rows = state.changes(spark, root, "live", state.EVENT_TABLE).groupBy("batch_id").count()
    assert sorted(map(tuple, rows.collect())) == [(0, 60), (1, 1), (2, 1), (3, 1)]
    # The new event has one row in the log, although it came three times.
    assert len(log(spark, root)) == 61 and len(live(spark, root)) == 60


def test_kinds_with_conditions_and_missing_keys(spark):
    root = fresh_path(spark, "state")
    kinds = [state.Kind("late", ("city",), ("event_time",), where="is_late_delivery")]
    rows = [("a", 1, 1, 0, 1, True), ("b", 2, 3, 0, 2, False), ("c", 3, 2, 0, 3, True)]
    assert feed(spark, root, rows, kinds) == [(0, {"staged": 3, "late": 1})]
    assert [r["event_id"] for r in state.held(spark, f"{root}/checkpoint", "late").collect()] == ["c"]
    nothing = feed(spark, root, [("d", 4, 9, 0, 4, False)], kinds)
    assert nothing == [(1, {"staged": 1, "late": 0})]
    assert state.changes(spark, fresh_path(spark, "none"), "late", state.EVENT_TABLE).count() == 0


def messages(spark, values):
    rows = [(None, v.encode(), "t", 0, i, T0) for i, v in enumerate(values)]
    from milepost.schemas import MESSAGE_SCHEMA

    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


def accepted_json(**changes):
    import json

    event = {
        "event_id": "e1", "event_type": "delivery_accepted",
        "event_time": "2024-01-01T00:00:00Z", "source_event_time": "2000-10-15T08:30:00Z",
        "order_id": 1, "region_id": 48, "city": "Chongqing", "courier_id": 100, "aoi_id": 200,
        "aoi_type": 14, "sla_minutes": 240.0, "accept_gps_lng": 107.1, "accept_gps_lat": 29.8,
        "accept_gps_valid": True,
    }
    event.update(changes)
    return json.dumps(event)


@pytest.mark.parametrize(
    ("changes", "error"),
    [
        ({}, None),
        ({"source_event_time": "2000-10-15T08:30:00"}, None),  # naive means UTC
        ({"accept_gps_lng": None}, None),
        ({"colour": 1}, "unexpected field"),
        ({"order_id": -1}, "order_id negative"),
        ({"city": ""}, "city empty"),
        ({"sla_minutes": 0}, "sla_minutes not positive"),
        ({"event_type": "delivery_update"}, "event_type differs"),
        ({"event_id": None}, "event_id missing or malformed"),
    ],
)
def test_event_contract(spark, changes, error):
    decoded = E.decode(messages(spark, [accepted_json(**changes)]), E.ACCEPTED)
    assert decoded.first()["error"] == error


def test_times_are_utc(spark):
    decoded = E.decode(
        messages(spark, [accepted_json(source_event_time="2000-10-15T10:30:00+02:00")]), E.ACCEPTED
    )
    assert decoded.first()["event"]["source_event_time"] == datetime(2000, 10, 15, 8, 30)


def test_unreadable_message_becomes_a_dead_letter(spark):
    decoded = E.decode(messages(spark, ["{oops", accepted_json()]), E.ACCEPTED)
    letters = E.dead_letters(decoded.where("error IS NOT NULL")).collect()
    assert [(r["source_offset"], r["raw_payload"]) for r in letters] == [(0, "{oops")]


def test_lost_acceptance_time_is_rebuilt(spark):
    fact = medallion.build_fact(silver_frame(spark), AT)
    records = fact.drop("accept_timestamp", "accept_gps_valid")
    got = {r["order_id"]: r for r in E.accepted_events(records).collect()}
    want = {r["order_id"]: r["accept_timestamp"] for r in fact.collect()}
    assert {k: r["source_event_time"] for k, r in got.items()} == want
    assert not got[3]["accept_gps_valid"] and got[1]["accept_gps_valid"]
    bad = records.withColumn("delivery_duration_minutes", F.lit(-1.0))
    assert E.replay_messages(bad, E.ACCEPTED).count() == 0
    counts = E.replay_counts(bad).first()
    assert (counts["published"], counts["skipped"]) == (0, 4)


def test_event_ids_do_not_change_when_run_again(spark):
    fact = medallion.build_fact(silver_frame(spark), AT)
    first = [r["event_id"] for r in E.delivery_events(fact).orderBy("order_id").collect()]
    again = [r["event_id"] for r in E.delivery_events(fact).orderBy("order_id").collect()]
    assert first == again and len(set(first)) == 4


def test_round_robin_interleaves_sources(spark):
    rows = [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5), ("c", 6)]
    df = spark.createDataFrame(rows, "city string, k int")
    order = [F.col("k").asc()]
    got = E.round_robin(df, "city", order).orderBy("replay_position").collect()
    assert [(r["k"], r["replay_position"]) for r in got] == [
        (1, 1), (4, 2), (5, 3), (2, 4), (6, 5), (3, 6)]
    chosen = E.round_robin(df, "city", order, ["c", "a"]).orderBy("replay_position").collect()
    assert [r["k"] for r in chosen] == [5, 1, 6, 2, 3]


def test_scores_are_checked(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (1.5,), (None,)], "delay_probability double")
    got = [r[0] for r in df.select(scoring.score_error()).collect()]
    assert got[0] is None and "non-finite" in got[1] and "outside" in got[2]
    assert "non-finite" in got[3]


def test_stream_resumes_from_its_checkpoint(spark):
    root = fresh_path(spark, "stream")
    fact = medallion.build_fact(silver_frame(spark), AT)
    for part in (0, 1):
        event_time = F.lit(T0 + timedelta(hours=part))
        E.replay_messages(fact.where(F.col("order_id") % 2 == part), event_time=event_time).select(
            F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
            F.lit("t").alias("topic"), F.lit(0).alias("partition"),
            F.lit(part).cast("bigint").alias("offset"), event_time.alias("timestamp"),
        ).write.mode("append").parquet(f"{root}/topic")
        stream = E.parse_events(state.message_files(spark, f"{root}/topic"), E.DELIVERY)
        state.start_delivery_state(
            stream, f"{root}/state", f"{root}/checkpoint", available_now=True
        ).awaitTermination()
    inserted = state.changes(spark, f"{root}/state", "events", state.EVENT_TABLE)
    counts = inserted.groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in counts] == [2, 2]
    assert state.live_status(spark, f"{root}/checkpoint").count() == 4


def test_predictions_latest_and_alerts_come_from_one_stream(spark):
    root = fresh_path(spark, "predictions")
    scored = spark.createDataFrame(
        [("e1", 1, 0.9), ("e2", 2, 0.1), ("e3", 1, 0.8)], "event_id string, order_id bigint, p double"
    )
    columns = {"event_id": F.col("event_id"), "order_id": F.col("order_id"),
               "delay_probability": F.col("p"), "city": F.lit("Jilin"),
               "source_event_time": F.lit(T0) + F.expr("make_interval(0, 0, 0, 0, int(p * 10))")}
    names = {f.name: f.dataType for f in S.PREDICTION_SCHEMA.fields}
    for n in names:
        columns.setdefault(n, F.lit(None).cast(names[n]))
    events = scored.select(*[c.alias(n) for n, c in columns.items()])
    rows = scoring.prediction_events(events, "m", "v1", 0.5, F.lit(T0))
    for batch in (0, 1):  # the same messages twice
        state.write_batch(E.as_schema(rows, S.PREDICTION_SCHEMA), root, "scored", batch)
        query = scoring.start_predictions(spark, root, f"{root}/checkpoint", available_now=True)
        query.awaitTermination()
    assert state.prediction_log(spark, root).count() == 3
    latest = state.latest_predictions(spark, f"{root}/checkpoint").collect()
    assert sorted((r["order_id"], r["source_event_id"]) for r in latest) == [(1, "e1"), (2, "e2")]
    alerts = scoring.alert_log(spark, root)
    assert alerts.columns == S.ALERT_SCHEMA.names
    assert sorted(r["source_event_id"] for r in alerts.collect()) == ["e1", "e3"]


def test_dead_letters_are_keyed_by_their_place(spark):
    decoded = E.decode(messages(spark, ["{oops"]), E.ACCEPTED)
    letters = E.dead_letters(decoded.where("error IS NOT NULL"))
    assert [r["key"] for r in E.dead_letter_messages(letters).collect()] == ["t:0:0"]


def daily_rows(spark):
    fact = medallion.build_fact(silver_frame(spark), AT)
    return medallion.courier_daily(fact, AT), medallion.city_daily(fact, AT)


def test_a_scored_batch_is_not_cached_and_leaves_no_scratch_files(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from milepost.session import path_exists

    root = fresh_path(spark, "scored")
    texts = [accepted_json(order_id=k, event_id=f"e{k}") for k in (1, 2, 3)]
    batch = messages(spark, [*texts, "{oops"])
    history = daily_rows(spark)

    def uncached(self, *level):
        raise AssertionError("the rows of a batch may be too many for a cache")

    spools = []

    def seen(spark, label):
        spools.append(fresh_path(spark, label))
        return spools[-1]

    def score(rows):
        p = F.when(F.col("order_id") == 3, float("nan")).otherwise(F.col("order_id") / 4)
        return rows.withColumn("delay_probability", p)

    monkeypatch.setattr(DataFrame, "persist", uncached)
    monkeypatch.setattr("milepost.session.fresh_path", seen)
    scoring.score_batch(batch, 0, root, lambda: history, score, "m", "v1", 0.5, F.lit(T0))
    monkeypatch.undo()
    found = spark.read.parquet(f"{root}/scored/batch_id=0").orderBy("order_id").collect()
    assert [(r["order_id"], r["predicted_late"]) for r in found] == [(1, False), (2, True)]
    letters = spark.read.parquet(f"{root}/dead_letters/batch_id=0").orderBy("source_offset")
    assert [(r["source_offset"], r["raw_payload"]) for r in letters.collect()] == [
        (2, texts[2]), (3, "{oops")]
    assert len(spools) == 2 and not any(path_exists(spark, p) for p in spools)


def test_parts_of_a_log_are_moved_into_the_topic_one_by_one(spark):
    from milepost.catalog.stream_queries import _publish

    root = fresh_path(spark, "log")
    rows = spark.range(30).selectExpr("id", "id % 3 AS part").coalesce(1)
    rows.write.partitionBy("part").parquet(f"{root}/parts")
    for part in (0, 1, 2):
        _publish(spark, f"{root}/parts/part={part}", f"{root}/topic", f"{part}-")
        held = [r["id"] for r in spark.read.parquet(f"{root}/topic").collect()]
        assert sorted(held) == [k for k in range(30) if k % 3 <= part]


def test_state_stores_of_an_executor_share_their_memory(spark):
    prefix = "spark.sql.streaming.stateStore.rocksdb."
    assert spark.conf.get(f"{prefix}boundedMemoryUsage") == "true"
    assert spark.conf.get(f"{prefix}compression") == "zstd"
