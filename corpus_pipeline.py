"""The corpus pipeline: stages over documents, each written and read again.

``STAGES`` are in the order in which they run. A stage takes ``(spark, docs,
sf_dir)`` and works on all rows that its predecessor kept; all but the last return
the columns of ``docs``. A row whose columns are null is handled as its operator
says. Tables other than documents are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from milepost.llm import crf, lines, minhash, mixing, packing
from milepost.llm.text import configure, documents, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels table."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return crf.accepted(docs, labels)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on ten sources or more go; documents stay, even empty ones."""
    configure(spark)
    return lines.cleaned(docs)


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate documents go, except the one that names its group."""
    configure(spark)
    return minhash.one_of_each(docs)


def by_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens stay, by the weights of domain, language and source.

    One epoch, so that no document comes twice after the duplicates are gone.
    """
    configure(spark)
    return mixing.mixed(docs, share=(4, 5), epochs=1)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences of 1024."""
    configure(spark)
    return packing.pack(docs, 1024)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_boilerplate),
    ("minhash_near_dedup", one_near_copy),
    ("source_mixing", by_target_weights),
    ("packing", packed),
]

# The classifier, the signatures and the linear programme are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
