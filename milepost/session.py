"""Session settings and the shared folder that survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()

# Runtime settings every plan in this package relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time, even if that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM interprets generated methods above 8000 bytes; run such wide
    # projections operator by operator instead, which it compiles.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Keyed state of streams lives outside the heap and is written as changes.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # One cache for all stores of an executor; else each store of each partition and run
    # brings its own, and their number grows with the input.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    name: str = "milepost", cores: str = "*", memory: str = "8g", partitions: int = 8
) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder of its own, which
    goes when the process ends;
    a cluster without it is an error, since executors could not see the files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="milepost-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def session_root(spark: SparkSession) -> str:
    """The one folder below the shared one that holds everything this application writes.

    A local session removes it when the process ends; on a cluster call
    :func:`remove_session_root`.
    """
    root = f"{shared_dir(spark).rstrip('/')}/milepost-{spark.sparkContext.applicationId}"
    if spark.sparkContext.master.startswith("local[") and root not in _roots:
        _roots.add(root)
        # Runs before PySpark's own handler, which ends the JVM.
        atexit.register(_remove_if_running, spark)
    return root


def _remove_if_running(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        remove_session_root(spark)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the session's root."""
    return f"{session_root(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in any store that Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what is at ``path``, if anything is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_session_root(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; results read from it are gone."""
    remove_path(spark, session_root(spark))


@contextmanager
def spooled(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` from compressed files in the shared folder, which go at the end.

    For rows that are read several times but are too many to be cached.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove_path(spark, path)


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
