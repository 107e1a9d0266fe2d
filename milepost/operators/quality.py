"""Data quality: the blocking contract, warnings, reports, gates and profiles.

Rules are data: a name, the columns they look at and one boolean column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.functions import expressions as X
from milepost.operators.distributed import counted_medians, top_rows
from milepost.session import durable


class Rule(NamedTuple):
    name: str
    columns: tuple[str, ...]
    hit: Column


class QualityError(ValueError):
    """A blocking check failed."""


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# -- blocking contract ----------------------------------------------------------
def column_order_problems(columns: Sequence[str]) -> dict[str, list[str] | bool]:
    """Compare a header with the contract: exact set and exact order."""
    missing = [c for c in S.RAW_COLUMNS if c not in columns]
    unexpected = [c for c in columns if c not in S.RAW_COLUMNS]
    known = [c for c in columns if c in S.RAW_COLUMNS]
    expected = [c for c in S.RAW_COLUMNS if c in columns]
    return {
        "missing": missing,
        "unexpected": unexpected,
        "ordered": known == expected and len(columns) == len(set(columns)),
    }


def contract_rules(df: DataFrame) -> list[Rule]:
    """One rule per column and check; ``hit`` marks a failing row."""
    rules: list[Rule] = []
    kinds = dict(S.RAW_FIELDS)
    optional = {"accept_gps_lng", "accept_gps_lat"}
    for name in S.RAW_COLUMNS:
        kind, raw = kinds[name], F.col(name)
        if name not in optional:
            rules.append(Rule(f"{name}:not_nullable", (name,), raw.isNull()))
        if kind == "string":
            if name == "city":
                rules.append(Rule("city:non_empty_string", (name,), F.length(F.trim(raw)) == 0))
            elif name == "ds":
                rules.append(
                    Rule("ds:valid_day_partition", (name,),
                         raw.isNotNull() & X.parse_day_partition(raw).isNull())
                )
            else:
                rules.append(
                    Rule(f"{name}:valid_month_day_time", (name,),
                         raw.isNotNull() & X.parse_month_day_time(raw).isNull())
                )
            continue
        value = raw.try_cast(kind)
        rules.append(Rule(f"{name}:coercible", (name,), raw.isNotNull() & value.isNull()))
        if kind == "bigint":
            rules.append(Rule(f"{name}:non_negative_integer", (name,), value < 0))
        else:
            lng = name.endswith("lng")
            limit, label = (180.0, "valid_longitude") if lng else (90.0, "valid_latitude")
            rules.append(Rule(f"{name}:{label}", (name,), ~X.in_range(value, limit)))
    rules.append(
        Rule("accept_gps_pair_consistent", ("accept_gps_lng", "accept_gps_lat"),
             F.col("accept_gps_lng").isNull() != F.col("accept_gps_lat").isNull())
    )
    return rules


def contract_counts(df: DataFrame) -> DataFrame:
    """``(rule, failures)`` of the row rules, all counted in one pass."""
    rules = contract_rules(df)
    counted = df.agg(*[F.count_if(_true(r.hit)).alias(f"r{i}") for i, r in enumerate(rules)])
    pairs = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("failures"))
          for i, r in enumerate(rules)]
    )
    return counted.select(F.inline(pairs))


def duplicate_rows(df: DataFrame, key: Sequence[str] = ("order_id",)) -> DataFrame:
    """Every row whose key occurs more than once, with ``copies``.

    Keys are counted first (a hot key collapses before the shuffle) and only
    repeated keys are joined back.
    """
    repeated = df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
    renamed = repeated.select(*[F.col(k).alias(f"_key_{k}") for k in key], "copies")
    cond = X.all_of([F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key])
    return df.join(renamed, cond).select(*df.columns, "copies")


def duplicate_summary(df: DataFrame, key: Sequence[str] = ("order_id",)) -> DataFrame:
    """Number of repeated keys and of the rows that hold them."""
    return (
        df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
        .agg(F.count("*").alias("duplicate_keys"),
             F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_rows"))
    )


def failure_cases(df: DataFrame, row_id: str) -> DataFrame:
    """One row per failing check: ``(rule, row_id, failure_case)``."""
    rules = contract_rules(df)
    cases = F.array(
        *[F.when(_true(r.hit),
                 F.struct(F.lit(r.name).alias("rule"),
                          F.col(r.columns[0]).cast("string").alias("failure_case")))
          for r in rules]
    )
    by_row = df.select(row_id, F.inline(F.array_compact(cases))).select(
        "rule", row_id, "failure_case"
    )
    dup = duplicate_rows(df.select("order_id", row_id)).select(
        F.lit("order_id:field_uniqueness").alias("rule"),
        row_id,
        F.col("order_id").cast("string").alias("failure_case"),
    )
    return by_row.unionByName(dup)


def failure_sample(cases: DataFrame, row_id: str, limit: int = S.SAMPLE_LIMIT) -> DataFrame:
    """The first failing checks in row order, each with the total count."""
    total = cases.agg(F.count("*").alias("n"))
    first = cases.orderBy(F.col(row_id), F.col("rule")).limit(limit)
    return first.withColumn("total_failures", total.scalar())


def enforce_contract(df: DataFrame, *keep: str) -> DataFrame:
    """Return the typed rows, or raise with the counts of the failed rules.

    Columns named in ``keep`` (such as a line number) are not part of the contract.
    """
    header = column_order_problems([c for c in df.columns if c not in keep])
    if header["missing"] or header["unexpected"] or not header["ordered"]:
        raise QualityError(f"column contract failed: {header}")
    bad = [(r["rule"], r["failures"]) for r in contract_counts(df).where("failures > 0").collect()]
    copies = duplicate_summary(df).first()
    if copies["duplicate_rows"]:
        bad.append(("order_id:field_uniqueness", copies["duplicate_rows"]))
    if bad:
        raise QualityError(f"contract failed: {bad}")
    return typed(df, *keep)


def typed(df: DataFrame, *keep: str) -> DataFrame:
    """Raw columns in contract order and type; a bad value raises."""
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in S.RAW_FIELDS], *keep)


# -- warnings -----------------------------------------------------------------------
def warning_rules() -> list[Rule]:
    """The eight non-blocking rules, in report order, on rows with a duration."""
    accept_lng, accept_lat = F.col("accept_gps_lng"), F.col("accept_gps_lat")
    lasted = F.col("delivery_duration_minutes")

    def tiny(c):
        return F.abs(F.col(c)) < S.NEAR_ZERO_DEGREES

    def either_tiny(side):
        # "or" over the pair, with a missing part counted as not tiny
        return _true(tiny(f"{side}_gps_lng")) | _true(tiny(f"{side}_gps_lat"))

    month_day = F.concat(F.substring("accept_time", 1, 2), F.substring("accept_time", 4, 2))
    return [
        Rule("zero_order_id", ("order_id",), F.col("order_id") == 0),
        Rule("zero_courier_id", ("order_id", "courier_id", "city"), F.col("courier_id") == 0),
        Rule("missing_accept_gps", ("order_id", "accept_gps_lng", "accept_gps_lat"),
             accept_lng.isNull() & accept_lat.isNull()),
        Rule("near_zero_accept_gps", ("order_id", "accept_gps_lng", "accept_gps_lat"),
             accept_lng.isNotNull() & accept_lat.isNotNull() & either_tiny("accept")),
        Rule("near_zero_delivery_gps", ("order_id", "delivery_gps_lng", "delivery_gps_lat"),
             either_tiny("delivery")),
        Rule("zero_or_negative_duration", ("order_id", "accept_time", "delivery_time"),
             lasted <= 0),
        Rule("long_delivery_duration", ("order_id", "accept_time", "delivery_time"),
             lasted > S.LONG_DURATION_MINUTES),
        Rule("partition_accept_date_mismatch", ("order_id", "accept_time", "ds"),
             F.col("ds") != month_day),
    ]


def add_times(df: DataFrame) -> DataFrame:
    """The four parsed moments and the duration; every text is parsed once."""
    parsed = {
        f"{name}_timestamp": X.parse_month_day_time(f"{name}_time")
        for name in ("accept", "accept_gps", "delivery", "delivery_gps")
    }
    return df.withColumns(parsed).withColumn(
        "delivery_duration_minutes",
        X.rollover_duration("accept_timestamp", "delivery_timestamp"),
    )


def add_warning_flags(df: DataFrame) -> DataFrame:
    """Parsed times, eight flags, their count and ``valid`` / ``warning``."""
    flagged = add_times(df).withColumns(
        {S.WARNING_FLAGS[r.name]: _true(r.hit) for r in warning_rules()}
    )
    count = sum((F.col(f).cast("int") for f in S.WARNING_FLAGS.values()), F.lit(0))
    return flagged.withColumn("_quality_warning_count", count).withColumn(
        "_quality_status",
        F.when(F.col("_quality_warning_count") > 0, "warning").otherwise("valid"),
    )


def warning_report(flagged: DataFrame) -> DataFrame:
    """``(rule, row_count, warning_row_count, total_rows)``; rules without a row are absent."""
    counts = flagged.agg(
        *[F.count_if(F.col(f)).alias(name) for name, f in S.WARNING_FLAGS.items()],
        F.count_if(F.col("_quality_status") == "warning").alias("warning_row_count"),
        F.count("*").alias("total_rows"),
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("row_count")) for n in S.WARNING_FLAGS]
    )
    return (
        counts.select(F.inline(pairs), "warning_row_count", "total_rows").where("row_count > 0")
    )


def warning_samples(flagged: DataFrame, row_id: str, limit: int = S.SAMPLE_LIMIT) -> DataFrame:
    """The first rows of every rule, with the values the rule looked at as JSON."""
    options = {"ignoreNullFields": "false"}
    hits = F.array(
        *[F.when(F.col(S.WARNING_FLAGS[r.name]),
                 F.struct(F.lit(r.name).alias("rule"),
                          F.to_json(F.struct(*r.columns), options).alias("record")))
          for r in warning_rules()]
    )
    rows = flagged.select(row_id, F.inline(F.array_compact(hits)))
    return top_rows(rows, [F.col(row_id).asc()], limit, ["rule"], F.col(row_id))


# -- gates ----------------------------------------------------------------------------
def key_gate(df: DataFrame, key: Sequence[str], extra: Mapping[str, Column] | None = None):
    """One row: rows, rows with a null key part, repeated keys, and extra counts.

    Rows are counted per key first, so the check is one aggregation whose
    partial step absorbs any hot key.
    """
    extra = extra or {}
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("_copies"),
        *[F.count_if(_true(c)).alias(n) for n, c in extra.items()],
    )
    null_part = X.any_of([F.col(k).isNull() for k in key])
    return per_key.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(null_part, F.col("_copies"))), F.lit(0)).alias("null_keys"),
        F.count_if((F.col("_copies") > 1) & ~null_part).alias("duplicate_keys"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in extra],
    )


def bronze_gate_counts(bronze: DataFrame) -> DataFrame:
    S.require_columns(bronze, S.BRONZE_REQUIRED, "bronze")
    return key_gate(
        bronze, ["order_id"], {"contract_failures": ~_true(F.col("_quality_contract_passed"))}
    )


def silver_gate_counts(silver: DataFrame) -> DataFrame:
    S.require_columns(silver, S.SILVER_REQUIRED, "silver")
    moments = ("partition_timestamp", "accept_timestamp", "delivery_timestamp")
    return key_gate(silver, ["order_id"], {f"null_{m}": F.col(m).isNull() for m in moments})


def pass_gate(counts: DataFrame, what: str, allow_empty: bool = True) -> dict[str, int]:
    """Raise unless every count but ``row_count`` is zero."""
    row = counts.first().asDict()
    bad = {k: v for k, v in row.items() if k != "row_count" and v}
    if bad or (not allow_empty and not row["row_count"]):
        raise QualityError(f"{what}: {bad or 'no rows'}")
    return row


# -- declared checks on a table --------------------------------------------------------
def run_checks(df: DataFrame, table: str, checks: Sequence[Mapping]) -> DataFrame:
    """``(table_name, check_name, column_name, failures)`` for declared checks.

    A check has ``kind`` (``not_null``, ``unique``, ``accepted_values``), ``column``,
    and optionally ``values`` and ``where``. All checks share one scan: rows are counted
    per value of each unique column (grouping sets, where there are several), failing rows
    along with the first one, and these counts are added up. A null value repeats nothing.
    """
    row_checks = [(i, c) for i, c in enumerate(checks) if c["kind"] != "unique"]
    unique = [(i, c["column"]) for i, c in enumerate(checks) if c["kind"] == "unique"]

    def failing(c):
        col = F.col(c["column"])
        hit = col.isNull() if c["kind"] == "not_null" else (
            col.isNotNull() & ~col.isin(list(c["values"]))
        )
        return hit & F.expr(c["where"]) if c.get("where") else hit

    if not checks:
        raise ValueError(f"{table}: no checks")
    fails = [F.count_if(_true(failing(c))).alias(f"_c{i}") for i, c in row_checks]
    if unique:
        # Checked columns keep their names below, so the keys are copies.
        keys = {f"_u{i}": F.col(name) for i, name in unique}
        per_value = df.withColumns(keys).groupingSets(
            [[F.col(k)] for k in keys], *[F.col(k) for k in keys]
        ).agg(F.grouping_id().alias("_set"), F.count("*").alias("_copies"), *fails)
        # The bit of every column but the set's own is 1, the first column's bit is the highest.
        of = {k: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - at)) for at, k in enumerate(keys)}
        first = F.col("_set") == next(iter(of.values()))
        counted = per_value.agg(
            *[F.count_if((F.col("_set") == of[k]) & F.col(k).isNotNull() & (F.col("_copies") > 1))
              .alias(f"c{k[2:]}") for k in keys],
            *[F.coalesce(F.sum(F.when(first, F.col(f"_c{i}"))), F.lit(0)).alias(f"c{i}")
              for i, _ in row_checks],
        )
    else:
        counted = df.agg(*fails).withColumnsRenamed({f"_c{i}": f"c{i}" for i, _ in row_checks})
    pairs = F.array(
        *[F.struct(F.lit(c["kind"]).alias("check_name"), F.lit(c["column"]).alias("column_name"),
                   F.col(f"c{i}").alias("failures"))
          for i, c in enumerate(checks)]
    )
    return counted.select(F.lit(table).alias("table_name"), F.inline(pairs))


def freshness(
    df: DataFrame, now: Column, column: str = "_gold_processed_at",
    warn_hours: float = 24.0, error_hours: float = 72.0,
) -> DataFrame:
    """Age of the newest row and ``pass`` / ``warn`` / ``error``."""
    aged = df.agg(F.max(column).alias("newest")).withColumn(
        "age_hours", X.minutes_between("newest", now) / 60
    )
    return aged.select(
        "newest",
        "age_hours",
        F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error")
        .when(F.col("age_hours") > warn_hours, "warn").otherwise("pass").alias("status"),
    )


# -- profiles ----------------------------------------------------------------------------
def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, repeated rows, and the difference to the expected header."""
    missing = [c for c in S.RAW_COLUMNS if c not in df.columns]
    unexpected = [c for c in df.columns if c not in S.RAW_COLUMNS]
    per_row = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return per_row.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_row_count"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(",".join(unexpected)).alias("unexpected_columns"),
    )


def column_profile(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Inferred type, nulls, distinct values, numeric bounds and first values per column.

    ``df`` holds text columns. Each (column, text) pair is counted once, so the
    later steps work on distinct values only.
    """
    names = [c for c in (columns or df.columns) if c != row_id]
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("text")) for c in names]
    )
    texts = (
        df.select(row_id, F.inline(cells)).groupBy("name", "text")
        .agg(F.count("*").alias("n"), F.min(row_id).alias("first_row"))
    )
    filled = F.col("text").isNotNull()
    kinds = texts.groupBy("name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(filled).alias("_texts"),
        F.count_if(F.col("text").try_cast("bigint").isNotNull()).alias("_longs"),
        F.count_if(F.col("text").try_cast("double").isNotNull()).alias("_doubles"),
        F.count_if(F.col("text").isin("True", "False")).alias("_booleans"),
    )
    dtype = (
        F.when((F.col("_texts") > 0) & (F.col("_booleans") == F.col("_texts"))
               & (F.col("null_count") == 0), "bool")
        .when((F.col("_longs") == F.col("_texts")) & (F.col("null_count") == 0), "int64")
        .when(F.col("_doubles") == F.col("_texts"), "float64").otherwise("object")
    )
    kinds = kinds.withColumn("dtype", dtype)
    numeric = F.col("dtype").isin("int64", "float64")
    number = F.col("text").try_cast("double")
    value = (
        F.when(F.col("dtype") == "int64", F.col("text").try_cast("bigint").cast("string"))
        .when(F.col("dtype") == "float64", number.cast("string")).otherwise(F.col("text"))
    )
    values = (
        texts.where(filled).join(kinds.select("name", "dtype"), "name")
        .groupBy("name", value.alias("value"))
        .agg(F.min("first_row").alias("first_row"),
             F.min(F.when(numeric, number)).alias("low"),
             F.max(F.when(numeric, number)).alias("high"))
    )
    stats = values.groupBy("name").agg(
        F.count("*").alias("unique_count"),
        F.min("low").alias("numeric_minimum"),
        F.max("high").alias("numeric_maximum"),
    )
    first = top_rows(values, [F.col("first_row").asc(), F.col("value").asc()], 5, ["name"],
                     F.col("value"))
    samples = first.groupBy("name").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("first_row", "value"))), lambda s: s["value"]
            ),
            "|",
        ).alias("sample_values")
    )
    return (
        kinds.join(stats, "name", "left").join(samples, "name", "left")
        .select(
            "name", "dtype", "row_count",
            (F.col("row_count") - F.col("null_count")).alias("non_null_count"), "null_count",
            X.half_even(F.col("null_count") / F.col("row_count") * 100, 3)
            .alias("null_percentage"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            "numeric_minimum", "numeric_maximum", "sample_values",
        )
    )


def coordinate_bounds(df: DataFrame) -> DataFrame:
    """Smallest and largest value per coordinate column."""
    names = [c for c in S.COORDINATE_COLUMNS if c in df.columns]
    wide = df.agg(
        *[F.min(F.col(c).try_cast("double")).alias(f"min_{c}") for c in names],
        *[F.max(F.col(c).try_cast("double")).alias(f"max_{c}") for c in names],
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(f"min_{c}").alias("minimum"),
                   F.col(f"max_{c}").alias("maximum")) for c in names]
    )
    return wide.select(F.inline(pairs))


def duration_profile(df: DataFrame) -> DataFrame:
    """Counts and statistics of the durations, on the profiler's calendar (no 29 February).

    Durations are counted per value first; the median comes from running totals
    over those counts, so no task holds all values.
    """
    a = X.parse_month_day_time("accept_time", S.PROFILE_YEAR)
    d = X.parse_month_day_time("delivery_time", S.PROFILE_YEAR)
    values = durable(
        df.select(X.rollover_duration(a, d).alias("minutes"), _true(d < a).alias("rolled"))
        .groupBy("minutes", "rolled").agg(F.count("*").alias("n"))
    )
    known = F.col("minutes").isNotNull()
    valid = F.when(known, F.col("n"))
    per_value = values.where(known).groupBy(
        F.lit("minutes").alias("name"), F.col("minutes").alias("value")
    ).agg(F.sum("n").alias("n"))
    median = counted_medians(per_value).agg(F.max("median"))
    return values.agg(
        F.coalesce(F.sum(valid), F.lit(0)).alias("valid_count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_or_invalid_count"),
        X.half_even(F.min("minutes"), 3).alias("minimum"),
        X.half_even(F.max("minutes"), 3).alias("maximum"),
        X.half_even(F.sum(F.col("minutes") * valid) / F.sum(valid), 3).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("rolled"), F.col("n"))), F.lit(0))
        .alias("midnight_rollover_count"),
    ).withColumn("median", X.half_even(median.scalar(), 3))
