"""Live state of event streams, kept in the engine's state store.

Every row of a stream is tagged once per kind of state it feeds; one streaming
aggregation keeps one row per kind and key. A kind holds either the first row of its
key or the newest one. A micro-batch touches only the keys it brings, however long
the stream has run, and writes only what it changed, all kinds in one job, into a
folder of its batch id. A batch that is run again starts from the same stored state
and the same batch time, so it overwrites its folder with the same rows.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from milepost import schemas as S
from milepost.session import path_exists

KAFKA_FIELDS = [
    T.StructField("kafka_partition", T.IntegerType()),
    T.StructField("kafka_offset", T.LongType()),
    T.StructField("kafka_timestamp", T.TimestampType()),
]
EVENT_TABLE = T.StructType([*S.DELIVERY_EVENT_SCHEMA.fields, *KAFKA_FIELDS])
LIVE_VERSION = ("event_time", "kafka_timestamp", "event_id")
EVENT_NEWEST = ("event_time", "kafka_timestamp", "kafka_partition", "kafka_offset")
LATEST_VERSION = ("source_event_time", "prediction_id")


@dataclass(frozen=True)
class Kind:
    """One kind of state: a row per ``key``.

    ``first`` keeps the row of the first micro-batch that held the key, the newest by
    ``version`` among that batch's rows; else the newest of all stays, and on a tie
    the one that came first. Only rows that fulfil ``where`` take part.
    """

    name: str
    key: tuple[str, ...]
    version: tuple[str, ...]
    first: bool = False
    where: str | None = None


DELIVERIES = (
    Kind("events", ("event_id",), EVENT_NEWEST, first=True),
    Kind("live", ("order_id",), LIVE_VERSION),
)
# Predictions of equal ids have equal content, so any one of the copies may stay.
PREDICTIONS = (
    Kind("predictions", ("source_event_id", "model_version"), LATEST_VERSION, first=True),
    Kind("latest", ("order_id", "model_version"), LATEST_VERSION),
    Kind("alerts", ("prediction_id",), LATEST_VERSION, first=True, where="predicted_late"),
)


def newest(rows: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the greatest version per key; an aggregation, so hot keys collapse early."""
    row = F.max_by(F.struct(*rows.columns), F.struct(*version))
    return rows.groupBy(*key).agg(row.alias("_row")).select("_row.*")


# -- the transition ----------------------------------------------------------------------------
def transition(
    rows: DataFrame, kinds: Sequence[Kind], counts: dict[str, Column] | None = None
) -> DataFrame:
    """``kind``, ``changed`` and the held row of every key that a micro-batch brings.

    ``changed`` tells whether the row came with this batch: whether the key was
    inserted or its row replaced. Batches are told apart by their time, which the
    engine records with their offsets. Counters of the batch are observed on the way:
    ``staged`` and the aggregates ``counts`` of its rows, and the changes per kind.
    """
    now, arrival = F.unix_micros(F.current_timestamp()), F.col("_arrival")
    names, types = rows.columns, dict(rows.dtypes)
    seen = {"staged": F.count(F.lit(1)), **(counts or {})}
    rows = rows.observe("input", *[c.alias(n) for n, c in seen.items()])
    rows = rows.withColumn("_arrival", now)

    def entry(kind: Kind) -> Column:
        version = [(-arrival if kind.first else F.lit(0).cast("bigint")).alias("first")]
        for k in kinds:
            version += [
                (F.col(c) if k is kind else F.lit(None).cast(types[c])).alias(f"{k.name}_{c}")
                for c in k.version
            ]
        made = F.struct(
            F.lit(kind.name).alias("kind"),
            F.array(*[F.col(c).cast("string") for c in kind.key]).alias("key"),
            F.struct(*version, (-arrival).alias("last")).alias("version"),
        )
        return made if kind.where is None else F.when(F.expr(kind.where), made)

    entries = F.array_compact(F.array(*[entry(k) for k in kinds]))
    tagged = rows.select(
        F.struct(F.struct(*names).alias("row"), arrival.alias("arrival")).alias("came"),
        F.explode(entries).alias("entry"),
    ).select("came", "entry.*")
    kept = tagged.groupBy("kind", "key").agg(F.max_by("came", "version").alias("held"))
    changed = kept.select(
        "kind", (F.col("held.arrival") == now).alias("changed"), "held.row.*"
    )
    per_kind = [F.count_if(F.col("changed") & (F.col("kind") == k.name)).alias(k.name)
                for k in kinds]
    return changed.observe("changes", *per_kind)


def _write_changes(root: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.where("changed").drop("changed").write.mode("overwrite").partitionBy("kind")
            .option("compression", "zstd").parquet(f"{root}/changes/batch_id={batch_id}")
        )

    return write


def start_state(
    rows: DataFrame, kinds: Sequence[Kind], root: str, checkpoint: str, name: str,
    counts: dict[str, Column] | None = None, **trigger,
) -> StreamingQuery:
    """Keep ``kinds`` of a stream of rows: the state in ``checkpoint``, the changes in ``root``."""
    writer = (
        transition(rows, kinds, counts).writeStream.outputMode("update")
        .foreachBatch(_write_changes(root)).queryName(name)
        .option("checkpointLocation", checkpoint)
    )
    return with_trigger(writer, **trigger).start()


# -- reading -------------------------------------------------------------------------------------
def changes(spark: SparkSession, root: str, kind: str, schema: T.StructType) -> DataFrame:
    """What the batches changed of one kind, with their ``batch_id``; the log of a ``first`` kind."""
    full = T.StructType([
        *schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("kind", T.StringType()),
    ])
    if not path_exists(spark, f"{root}/changes"):
        return spark.createDataFrame([], full).drop("kind")
    rows = spark.read.schema(full).parquet(f"{root}/changes")
    return rows.where(F.col("kind") == kind).drop("kind")


def held(spark: SparkSession, checkpoint: str, kind: str) -> DataFrame:
    """The rows of one kind as of the last batch, straight from the state store."""
    stored = spark.read.format("statestore").load(checkpoint)
    row = stored.schema["value"].dataType.fields[0].name
    return stored.where(F.col("key.kind") == kind).select(f"value.{row}.row.*")


def event_log(spark: SparkSession, root: str) -> DataFrame:
    return changes(spark, root, "events", EVENT_TABLE).drop("batch_id")


def live_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    return held(spark, checkpoint, "live").select(*EVENT_TABLE.names)


def prediction_log(spark: SparkSession, root: str) -> DataFrame:
    return changes(spark, root, "predictions", S.PREDICTION_SCHEMA).drop("batch_id")


def latest_predictions(spark: SparkSession, checkpoint: str) -> DataFrame:
    return held(spark, checkpoint, "latest").select(*S.PREDICTION_SCHEMA.names)


def late_predictions(spark: SparkSession, root: str) -> DataFrame:
    """The predictions that raised an alert, one per prediction."""
    return changes(spark, root, "alerts", S.PREDICTION_SCHEMA).drop("batch_id")


# -- counters -------------------------------------------------------------------------------------
class Counters(StreamingQueryListener):
    """Observed counters of every micro-batch, as ``(batch_id, {name: count})``; no extra job."""

    def __init__(self):
        self.rows: list[tuple[int, dict[str, int]]] = []
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        metrics = event.progress.observedMetrics
        found = {n: v for row in metrics.values() for n, v in row.asDict().items()}
        if found:
            with self._changed:
                self.rows.append((event.progress.batchId, found))

    def onQueryTerminated(self, event):
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def follow(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait until ``query`` has ended and its last batch has been reported."""
        query.awaitTermination()
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError(f"no report of the end of {query.name}")


def write_batch(rows: DataFrame, root: str, table: str, batch_id: int) -> int:
    """Write a batch's rows to its folder; their number is counted on the way."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    path = f"{root}/{table}/batch_id={batch_id}"
    counted.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return seen.get["rows"]


def forget_last_commit(spark: SparkSession, checkpoint: str) -> int:
    """Undo the commit of a stopped query's last batch, so that a restart runs it again.

    The state a crash between the batch's writes and its commit leaves behind.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    last = max(int(n) for n in names if n.isdigit())
    store.delete(jvm.org.apache.hadoop.fs.Path(folder, str(last)), False)
    return last


# -- queries ------------------------------------------------------------------------------------
def with_trigger(
    writer: DataStreamWriter, available_now: bool = False, every: str = "5 seconds"
) -> DataStreamWriter:
    """Process what is there and stop, or keep going at an interval."""
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every)


def start_batches(
    stream: DataFrame, handle, checkpoint: str, name: str, available_now: bool = False,
    every: str = "5 seconds",
) -> StreamingQuery:
    """Run ``handle(batch, batch_id)`` for every micro-batch, with its own checkpoint."""
    writer = (
        stream.writeStream.foreachBatch(handle).queryName(name)
        .option("checkpointLocation", checkpoint)
    )
    return with_trigger(writer, available_now, every).start()


def start_delivery_state(
    events: DataFrame, root: str, checkpoint: str, name: str = "delivery-live-state", **trigger
) -> StreamingQuery:
    """Keep the event log and the live status of a delivery event stream."""
    rows = events.select(*EVENT_TABLE.names)
    return start_state(rows, DELIVERIES, root, checkpoint, name, **trigger)


def start_prediction_state(
    predictions: DataFrame, root: str, checkpoint: str, name: str = "prediction-state", **trigger
) -> StreamingQuery:
    """Keep the log, the latest per order and model, and the alerts of a prediction stream."""
    rows = predictions.select(*S.PREDICTION_SCHEMA.names)
    late = {"predicted_late": F.count_if("predicted_late")}
    return start_state(rows, PREDICTIONS, root, checkpoint, name, late, **trigger)


def message_files(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """A folder of message files as a stream with the columns of a Kafka source."""
    return row_files(spark, path, S.MESSAGE_SCHEMA, files_per_batch)


def row_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
