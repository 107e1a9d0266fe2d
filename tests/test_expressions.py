import hashlib
import math
import uuid
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.functions import expressions as X


def one(spark, column, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x", [0.125, 2.675, 66.665, 0.005, 1.015, -0.125, 12.345, 99.995])
def test_half_even_rounds_like_numpy(spark, x):
    assert one(spark, X.half_even(F.lit(x), 2)) == np.round(x, 2)


def test_mart_rounding_goes_away_from_zero(spark):
    assert one(spark, X.mart_rate(F.lit(1), F.lit(800))) == 0.13  # 0.125 exactly
    assert one(spark, X.mart_mean(F.lit(20.01), F.lit(2))) == 10.01
    assert one(spark, X.mart_rate(F.lit(1), F.lit(0))) is None
    assert one(spark, X.safe_rate(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, X.safe_rate(F.lit(1), F.lit(800))) == 0.12


@pytest.mark.parametrize(
    ("text", "year", "want"),
    [
        ("02-29 10:00:00", "2000", datetime(2000, 2, 29, 10)),
        ("02-29 10:00:00", "1900", None),
        ("02-30 10:00:00", "2000", None),
        ("13-01 10:00:00", "2000", None),
        ("09-25 24:00:00", "2000", None),
        ("9-25 8:00:00", "2000", datetime(2000, 9, 25, 8)),
        ("09-25", "2000", None),
        ("09-25 08:00", "2000", None),
        ("09-25T08:00:00", "2000", None),
        (None, "2000", None),
    ],
)
def test_month_day_time(spark, text, year, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.parse_month_day_time("t", year)).first()[0] == want


def test_day_partition(spark):
    df = spark.createDataFrame([("0925",), ("1332",), ("0229",), ("925x",)], "t string")
    got = [r[0] for r in df.select(X.parse_day_partition("t")).collect()]
    assert got == [datetime(2000, 9, 25), None, datetime(2000, 2, 29), None]


def test_rollover_adds_one_day_once(spark):
    df = spark.createDataFrame(
        [("09-25 23:30:00", "09-25 00:15:00"), ("12-31 23:00:00", "01-01 01:00:00")],
        "a string, b string",
    )
    a, b = X.parse_month_day_time("a"), X.parse_month_day_time("b")
    got = [r[0] for r in df.select(X.rollover_duration(a, b)).collect()]
    assert got[0] == 45.0
    assert got[1] < 0


def test_ids_match_the_standard_library(spark):
    names = ["a", "milepost:v1:é", "x" * 200, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(X.uuid5("n")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    byte = [r[0] for r in spark.range(50).select(X.hash_byte("id", "s")).collect()]
    assert byte == [hashlib.md5(f"{i}:s".encode()).digest()[0] for i in range(50)]


def test_shift_probability(spark):
    def shift(p, pressure, strength=1.0):
        return one(spark, X.shift_probability(F.lit(p), F.lit(pressure), F.lit(strength)))

    assert shift(0.0, 2.0) == 0.0
    assert shift(1.0, 0.5) == 1.0
    assert shift(0.3, 2.0, 0.0) == 0.3
    odds = 0.3 / 0.7 * 2.0
    assert math.isclose(shift(0.3, 2.0), odds / (1 + odds), rel_tol=1e-12)
    assert shift(0.3, 1.2) > 0.3 > shift(0.3, 0.8)


def test_iso_weekday_and_period(spark):
    df = spark.createDataFrame([(datetime(2000, 10, 15, 5),)], "t timestamp")  # a Sunday
    assert tuple(df.select(X.iso_weekday("t"), X.day_period(F.hour("t"))).first()) == (7, "night")
