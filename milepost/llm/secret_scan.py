"""Secret scans against a ledger of blobs.

Every version of every document is a blob named by the SHA-256 of its text. The
ledger says which (blob, rule version) pairs have been scanned and what was
found; a run scans the pairs that are missing, appends them, and joins the
findings back to every path that ever held the blob. A copy is scanned once,
and a changed rule is scanned alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm.text import stored


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))

# Rule versions in the order in which spans of one start are listed: pattern, the
# group whose length counts (0: the whole match), and its least length. A match that
# is too short is dropped, but what it covers is not searched again.
RULES: Mapping[str, tuple[str, int, int]] = {
    "assign@1": (rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access@1": (r"AKIA[A-Z0-9]+", 0, 20),
    # Shorter runs than 24 fail anyway, and a run cannot start inside another.
    "hex@1": (r"[0-9a-f]{24,}", 0, 24),
    "pem@1": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    # The user may be empty, and neither part has a longest length.
    "login@2": (r"://[^\s/:@]*:[^\s/:@]+@", 0, 1),
}

_FOUND = "array<struct<rule:string,start:bigint,end:bigint>>"
LEDGER = f"blob binary, scanned array<string>, found {_FOUND}"


def open_ledger(spark: SparkSession, path: str) -> str:
    """Make sure that a ledger exists at ``path``, by appending no row to it."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return path


def _scan(rules: Mapping[str, tuple[str, int, int]]):
    patterns = {name: (re.compile(p), g, n) for name, (p, g, n) in rules.items()}
    kind = pa.list_(
        pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    )

    def run(batches):
        for batch in batches:
            pending = batch.column("pending").to_pylist()
            found = []
            for text, names in zip(batch.column("text"), pending, strict=True):
                text = text.as_py()
                spans = []
                for name in names:
                    pattern, group, least = patterns[name]
                    for m in pattern.finditer(text):
                        if m.end(group) - m.start(group) >= least:
                            spans.append({"rule": name, "start": m.start(), "end": m.end()})
                found.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob").cast(pa.binary()),
                 pa.array(pending, pa.list_(pa.string())), pa.array(found, kind)],
                names=["blob", "scanned", "found"],
            )

    return run


def _blobs(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan(
    docs: DataFrame, ledger: str, rules: Mapping[str, tuple[str, int, int]] = RULES
) -> DataFrame:
    """Bring the ledger at ``ledger`` up to date and return ``(blob, found)`` per known blob.

    ``docs(doc_id, text)`` holds the versions, old ones included; several rows of
    one doc_id are several versions. A null text is the empty blob. ``found``
    lists ``(rule, start, end)`` in code points, end exclusive, for ``rules`` only.
    A text is scanned whole, so a task holds a batch of texts in memory twice.
    """
    spark = docs.sparkSession
    wanted = F.array(*map(F.lit, rules))
    past = spark.read.schema(LEDGER).parquet(ledger)
    seen = past.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
    unseen = (
        _blobs(docs).groupBy("blob").agg(F.first("text").alias("text"))
        .join(seen, "blob", "left")
        .withColumn("pending", F.array_except(wanted, F.coalesce("seen", F.array())))
        .where(F.size("pending") > 0).select("blob", "text", "pending")
    )
    unseen.mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(ledger)
    return (
        spark.read.schema(LEDGER).parquet(ledger).groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        .withColumn("found", F.filter("found", lambda f: F.array_contains(wanted, f.rule)))
    )


def _joined(spans, rules: Mapping, names) -> F.Column:
    """``rule:start:end`` of the named rules, by start and then by the rules' order."""
    order = F.create_map(*[F.lit(v) for k, n in enumerate(rules) for v in (n, k)])
    rows = F.transform(
        F.filter(spans, lambda f: f.rule.isin(list(names))),
        lambda f: F.struct(f.start, order[f.rule].alias("k"), f.end, f.rule.alias("rule")),
    )
    return F.concat_ws(",", F.transform(F.array_sort(rows), lambda f: F.concat_ws(
        ":", F.substring_index(f.rule, "@", 1), f.start.cast("string"), f.end.cast("string"))))


def findings(
    docs: DataFrame, ledger: str, rules: Mapping[str, tuple[str, int, int]] = RULES
) -> DataFrame:
    """One row per row of ``docs``: counts and spans of what its text holds.

    ``n_assign``, ``n_access`` and ``n_hex`` count the base rules; ``base_sha256``
    is the digest of their spans, ``spans`` lists those of all rules. Null or empty
    texts have none. Repeated rows and versions are answered row by row; other
    columns are ignored; no row gives no row.
    """
    base = [r for r in rules if r.split("@")[0] in ("assign", "access", "hex")]
    # Written, so that the join below can split the rows of a blob with very many paths.
    found = stored(scan(docs, ledger, rules).where(F.size("found") > 0), "found")
    rows = _blobs(docs).select("doc_id", "blob").join(found, "blob", "left")
    spans = F.coalesce("found", F.array().cast(_FOUND))

    def count(kind):
        return F.size(F.filter(spans, lambda f: f.rule.startswith(f"{kind}@"))).cast("bigint")

    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(spans, rules, base), 256).alias("base_sha256"),
        _joined(spans, rules, rules).alias("spans"),
        F.lower(F.hex("blob")).alias("blob"),
    )
