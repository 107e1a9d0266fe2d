"""File scans and sinks: CSV and Parquet in, Parquet and JSON out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.operators import quality as Q


class SourceError(FileNotFoundError):
    """A source is missing or empty."""


# -- scans --------------------------------------------------------------------------------
def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line of a CSV file or folder."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_csv_text(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """All columns as text; null tokens become null; leading zeros stay.

    ``numbered`` adds ``_source_row_number``: the line in its file, with the
    header as line 1. A file is read in byte ranges; the rows of each range are
    counted once and earlier ranges of the same file are added, so the rows
    themselves are not moved.
    """
    columns = header_of(spark, path)
    schema = ", ".join(f"`{c}` string" for c in columns)
    lines = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    )
    text = lines.select(
        *[F.when(~F.col(c).isin(list(S.NULL_TOKENS)), F.col(c)).alias(c) for c in columns],
        F.col("_metadata.file_path").alias("_source_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    if not numbered:
        return text.drop("_block", "_at", "_source_path")
    blocks = lines.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    ).groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = (
        W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = blocks.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        text.join(
            offsets,
            (F.col("_source_path") == F.col("_file")) & (F.col("_block") == F.col("_start")),
        )
        .withColumn("_source_row_number", F.col("_skip") + F.col("_at") - F.col("_first") + 2)
        .select(*columns, "_source_path", "_source_row_number")
    )


def read_layer(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of a layer; fails if it is missing, empty or lacks a column."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise SourceError(f"no layer at {path}") from e
    if columns:
        S.require_columns(df, columns, path)
        df = df.select(*columns)
    if df.isEmpty():
        raise SourceError(f"layer {path} is empty")
    return df


def replay_records(spark: SparkSession, path: str) -> DataFrame:
    """The fact columns a replay needs; nothing else is read."""
    return read_layer(spark, path, S.REPLAY_COLUMNS)


def file_digests(spark: SparkSession, path: str, piece: int = 1 << 20) -> DataFrame:
    """``(path, uri, bytes, sha256)`` of every file below ``path``, read piece by piece.

    ``uri`` is the name that Spark's readers give as ``_metadata.file_path``.

    Files of any size need the memory of one piece; empty ones are left out, as in
    Spark's file sources. Paths are those that
    ``pyarrow.fs`` can open on the executors.
    """

    def digest(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name, uri in zip(batch["path"], batch["uri"], strict=True):
                local = name.removeprefix("file:")
                plain = local != name or "://" not in name
                store, inner = (
                    (fs.LocalFileSystem(), "/" + local.lstrip("/")) if plain
                    else fs.FileSystem.from_uri(name)
                )
                seen, size = hashlib.sha256(), 0
                with store.open_input_stream(inner) as stream:
                    while part := stream.read(piece):
                        seen.update(part)
                        size += len(part)
                rows.append((name, uri, size, seen.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "uri", "bytes", "sha256"])

    names = spark.read.format("binaryFile").load(path).select(
        "path", F.col("_metadata.file_path").alias("uri")
    )
    return names.mapInPandas(digest, "path string, uri string, bytes bigint, sha256 string")


def with_digests(raw: DataFrame, digests: DataFrame, path: str = "_source_path") -> DataFrame:
    """Rows with ``_source_sha256``, the digest of the file that they were read from.

    ``digests`` are :func:`file_digests`, best stored first, so that Spark sees their size
    and broadcasts them where they are few. A row of a file without a digest raises when run.
    """
    known = digests.select(F.col("uri").alias("_digest_uri"), F.col("sha256").alias("_digest"))
    joined = raw.join(known, F.col(path) == F.col("_digest_uri"), "left")
    missing = F.raise_error(F.concat(F.lit("no digest of "), F.col(path))).cast("string")
    return joined.withColumn("_source_sha256", F.coalesce("_digest", missing)).drop(
        "_digest_uri", "_digest"
    )


# -- sinks --------------------------------------------------------------------------------
def write_layer(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    compression: str = "zstd",
    arranged: bool = False,
) -> int:
    """Write a layer, read it back, and compare rows and columns with the commit.

    ``arranged`` rows already lie in ranges and order that begin with ``partition_by``;
    they are written as they lie.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if partition_by and not arranged:
        # Rows of one folder meet before writing, and large folders are split
        # again, so there are neither millions of tiny files nor one huge task.
        counted = counted.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = counted.write.mode("overwrite").option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = df.sparkSession.read.parquet(path)
    if set(back.columns) != set(df.columns):
        raise OSError(f"{path}: columns differ after writing")
    rows = back.count()
    if rows != seen.get["rows"]:
        raise OSError(f"{path}: {rows} rows after writing {seen.get['rows']}")
    return rows


def write_report(df: DataFrame, path: str) -> None:
    """A report or manifest as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def publish_checks(df: DataFrame, table: str) -> DataFrame:
    """One row: the counts that must be zero before a table is published."""
    if table not in S.PUBLISHED_TABLES:
        raise ValueError(f"unknown table {table}")
    spec = S.PUBLISHED_TABLES[table]
    S.require_columns(df, spec["required"], table)
    for name in df.columns:
        if not name.replace("_", "a").isalnum() or name[0].isdigit() or name != name.lower():
            raise ValueError(f"{table}: {name!r} is no plain column name")
    return Q.key_gate(df, spec["key"]).select(F.lit(table).alias("table_name"), "*")


def publish(df: DataFrame, table: str, root: str) -> tuple[str, int, int]:
    """Check the key, replace the published table, compare its count with the source."""
    row = Q.pass_gate(publish_checks(df, table).drop("table_name"), table, allow_empty=False)
    written = write_layer(df, f"{root}/{table}")
    if written != row["row_count"]:
        raise OSError(f"{table}: {written} rows published of {row['row_count']}")
    return table, written, len(df.columns)


def publish_gold(tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Publish the gold tables and return one summary row per table."""
    spark = next(iter(tables.values())).sparkSession
    done = [publish(df, name, root) for name, df in tables.items()]
    return spark.createDataFrame(done, "table_name string, row_count bigint, column_count bigint")
