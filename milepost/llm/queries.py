"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm import (
    compression,
    crf,
    importance,
    lines,
    minhash,
    mixing,
    mtree,
    negatives,
    packing,
    secret_scan,
    sharding,
    suffix,
    warc,
)
from milepost.llm.text import configure, documents
from milepost.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_minhash_near_dedup")
def near_dedup(spark, sf_dir):
    """Groups of documents whose sets of two-word shingles overlap by 80 % or more."""
    return minhash.near_duplicates(documents(spark, sf_dir), width=2, num=80, den=100)


@query("op3_secret_scan")
def secrets(spark, sf_dir):
    """Secrets of all documents, scanned once per blob into a new ledger."""
    docs = documents(spark, sf_dir)
    return secret_scan.findings(docs, secret_scan.open_ledger(spark, fresh_path(spark, "ledger")))


@query("op7_sharding")
def shards(spark, sf_dir):
    """All documents in eight shards of near equal bytes."""
    return sharding.shard(documents(spark, sf_dir), 8)


@query("op8_compression_bands")
def compressed(spark, sf_dir):
    """Base counts and compression verdict of every document."""
    return compression.compression_rules(documents(spark, sf_dir))


@query("op2_line_spread", lines.oracle())
def spread(spark, sf_dir):
    """Documents without the lines that stand on ten sources or more."""
    return lines.report(documents(spark, sf_dir))


@query("op4_suffix_dedup")
def suffixes(spark, sf_dir):
    """All texts without the bytes of repeated 400-byte strings, and what is left of them."""
    rows = suffix.cut_repeats(documents(spark, sf_dir), 400, with_text=True)
    # A cut may part a character's bytes; these become replacement characters.
    left = F.expr("make_valid_utf8(CAST(kept AS string))")
    return rows.withColumn("kept_text", left).drop("kept")


_DOT = "list_inner_product(q.v, c.v)::BIGINT"


@query(
    "op5_mtree_top_k",
    f"""
    WITH e AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    r AS (
        SELECT q.vec_id AS query_id, c.vec_id, {_DOT} AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, c.vec_id) AS k
        FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        WHERE q.vec_id % 50 = 0)
    SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
    """,
)
def top_k(spark, sf_dir):
    """The five best of all vectors for every fiftieth one."""
    rows = configure(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = mtree.vectors(rows).where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return mtree.search(mtree.index(rows), asked, 5)


@query("op6_source_mixing", mixing.oracle())
def mix_sources(spark, sf_dir):
    """Three fifths of all tokens, by the weights of domains, languages and sources."""
    return mixing.report(documents(spark, sf_dir))


@query("op9_cutting_stock_packing")
def packed(spark, sf_dir):
    """All documents in sequences of 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), 1024)


@query("op10_crf_quality")
def quality(spark, sf_dir):
    """Quality of every document, learnt from the labels outside the held-out quarter."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return crf.score(documents(spark, sf_dir), labels)


@query("op13_importance_resampling", importance.oracle())
def resampled(spark, sf_dir):
    """A quarter of the documents, drawn by their likeness to the benchmark texts."""
    target = configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.resample(documents(spark, sf_dir), target)


@query("op11_hard_negatives", negatives.oracle())
def hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector, with the labels of every seventh moved on."""
    rows = configure(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = negatives.whole_vectors(rows.withColumn("label", moved))
    return negatives.mine(ready, ready.where("id % 100 = 0"))


@query("op12_warc_archives", warc.oracle())
def archived(spark, sf_dir):
    """All pages as records in archives, read back by ranges."""
    return warc.report(warc.pages_of(spark, sf_dir))
