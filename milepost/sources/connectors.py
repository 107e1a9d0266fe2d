"""Kafka and JDBC endpoints: options around the tested transforms.

The connector jars are not part of Spark's distribution; add them to the
session to use these functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def read_jdbc_table(
    spark: SparkSession, url: str, name: str, options: Mapping[str, str] | None = None,
    partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1,
) -> DataFrame:
    """A table over JDBC; with a partition column it is read in parallel ranges."""
    reader = (
        spark.read.format("jdbc").option("url", url).option("dbtable", name)
        .option("fetchsize", "10000").options(**(options or {}))
    )
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
            .option("upperBound", bounds[1]).option("numPartitions", partitions)
        )
    return reader.load()


def write_jdbc_table(df: DataFrame, url: str, name: str, options: Mapping[str, str] | None = None):
    """Replace the rows of a table, keeping its definition."""
    (
        df.write.format("jdbc").option("url", url).option("dbtable", name)
        .option("truncate", True).option("batchsize", "10000").options(**(options or {}))
        .mode("overwrite").save()
    )


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, starting: str = "earliest",
    max_per_trigger: int | None = None,
) -> DataFrame:
    """A topic as a stream of messages."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", starting)
        .option("failOnDataLoss", "false")
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load()


def kafka_sink(
    messages: DataFrame, servers: str, topic: str, checkpoint: str, name: str
) -> DataStreamWriter:
    """A stream of ``(key, value)`` messages to a topic."""
    return (
        messages.writeStream.format("kafka").outputMode("append")
        .option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint).queryName(name)
    )


def kafka_publish(messages: DataFrame, servers: str, topic: str) -> None:
    """A finished table of ``(key, value)`` messages to a topic."""
    (
        messages.select("key", "value").write.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    )
