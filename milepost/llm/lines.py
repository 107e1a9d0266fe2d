"""Line dedup by cross-site spread: lines that stand on many sites are boilerplate.

The spread of a line is the number of distinct sites whose texts hold it. HyperLogLog
sketches per line hash give estimates by plain aggregation; only lines near the
threshold are counted exactly. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost.llm.text import stored

MIN_SITES = 10
#: Lines of fewer different texts are those of a copied document, not boilerplate.
MIN_TEXTS = 10
#: Estimates within this part of the threshold are not trusted. Sketches of 2**12
#: registers have a relative standard error of 1.6 %.
NEAR = 0.1
_BITS = 12
_BLANK = r"^[\x20\x09-\x0D]*$"


def _hash(text):
    return F.unhex(F.md5(text))


def spread_lines(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS
) -> DataFrame:
    """``(line, text)`` hashes of every line on ``min_sites`` sites or more, per text.

    Every site of every row counts. The line must also stand in ``min_texts`` different
    texts: a document that is copied to many sites does not make its own lines
    boilerplate. A null site is the site ''.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(
        F.coalesce(F.col(site), F.lit("")).alias("site"), _hash(text).alias("text"),
        F.explode(F.split(text, "\n", -1)).alias("line"),
    ).where(~F.col("line").rlike(_BLANK))
    held = stored(lines.select("site", "text", _hash(F.col("line")).alias("line")).distinct(), "lines")
    least = {"site": min_sites, "text": min_texts}
    sketched = held.groupBy("line").agg(*[
        F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(_BITS))).alias(f"{c}s") for c in least
    ])

    def all_beyond(part: float):
        """Both estimates lie beyond this part of their thresholds."""
        return reduce(Column.__and__, [F.col(f"{c}s") > F.lit(n * part) for c, n in least.items()])

    # Below the band is not boilerplate, above it is, inside it is counted.
    likely = sketched.where(all_beyond(1 - NEAR)).select("line", all_beyond(1 + NEAR).alias("sure"))
    likely = stored(likely, "likely")
    found = likely.where("sure").select("line")
    near = held.join(likely.where("NOT sure"), "line", "left_semi")
    counted = [
        near.select("line", c).distinct().groupBy("line").count()
        .where(F.col("count") >= n).select("line") for c, n in least.items()
    ]
    found = found.union(counted[0].join(counted[1], "line", "left_semi"))
    return held.select("line", "text").join(found, "line", "left_semi")


def remove_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_removed`` and ``_kept_text`` added.

    Lines are what line feeds separate, compared byte by byte; blank lines always
    stay. Every occurrence of a line that :func:`spread_lines` finds goes, and the
    others are joined again by line feeds. A null text stays null, with no line; an
    empty text has one, blank, line. Each row, repeated ones too, is answered.
    """
    hits = spread_lines(docs, site, min_sites).groupBy("text")
    hits = hits.agg(F.collect_set("line").alias("_gone")).withColumnRenamed("text", "_text_hash")
    parts = F.split("text", "\n", -1)
    gone = F.filter(parts, lambda x: F.array_contains("_gone", _hash(x)))
    left = F.filter(parts, lambda x: ~F.array_contains("_gone", _hash(x)))
    rows = docs.withColumn("_text_hash", _hash(F.coalesce("text", F.lit(""))))
    rows = rows.join(hits, "_text_hash", "left")
    some = F.col("_gone").isNotNull() & F.col("text").isNotNull()
    return rows.select(
        *docs.columns,
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("_n_lines"),
        F.when(some, F.size(gone)).otherwise(0).cast("bigint").alias("_n_removed"),
        F.when(some, F.array_join(left, "\n")).otherwise(F.col("text")).alias("_kept_text"),
    )


def report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept_text)`` of :func:`remove_boilerplate`."""
    rows = remove_boilerplate(docs.select("doc_id", "text", site), site, min_sites)
    return rows.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.col("_kept_text").alias("kept_text"),
    )


def cleaned(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the boilerplate lines cut from ``text``, and ``n_chars`` to match."""
    rows = remove_boilerplate(docs, site, min_sites)
    new = {"text": F.col("_kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("_kept_text")).otherwise(
            F.col("n_chars")
        ).cast("bigint")
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def oracle(min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS) -> str:
    """The report as SQL."""
    return f"""
    WITH texts AS (
        SELECT DISTINCT text, coalesce(source, '') AS site FROM documents
        WHERE text IS NOT NULL),
    lines AS (SELECT site, text, unnest(string_split(text, chr(10))) AS line FROM texts),
    spread AS (
        SELECT line FROM lines
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
        GROUP BY line
        HAVING count(DISTINCT site) >= {min_sites} AND count(DISTINCT text) >= {min_texts}),
    split AS (
        SELECT row_number() OVER () AS k, doc_id, string_split(text, chr(10)) AS parts, text
        FROM documents),
    each AS (
        SELECT k, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split),
    kept AS (
        SELECT k, count(*) - count(s.line) AS n_left,
               string_agg(e.line, chr(10) ORDER BY e.place) FILTER (WHERE s.line IS NULL) AS kept_text
        FROM each e LEFT JOIN spread s ON e.line = s.line GROUP BY k)
    SELECT doc_id, coalesce(len(parts), 0) AS n_lines,
           coalesce(len(parts) - n_left, 0) AS n_removed,
           CASE WHEN text IS NOT NULL THEN coalesce(kept_text, '') END AS kept_text
    FROM split LEFT JOIN kept USING (k)
    """
