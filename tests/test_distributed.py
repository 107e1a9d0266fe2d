import random
from statistics import median

import pandas as pd
from pyspark.sql import functions as F

from milepost.operators import distributed as D


def skewed(spark, n=3000):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), i, rng.randint(1, 9))
            for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, k int, v int").repartition(7)


def test_running_totals_match_brute_force(spark):
    df = skewed(spark)
    got = D.running_totals(df, [F.col("k").asc()], {"upto": F.col("v")}, ["g"]).toPandas()
    want = df.toPandas().sort_values(["g", "k"])
    want["upto"] = want.groupby("g")["v"].cumsum()
    merged = got.merge(want, on=["g", "k"])
    assert len(merged) == len(want)
    assert (merged["upto_x"] == merged["upto_y"]).all()


def test_running_totals_over_many_slices(spark):
    # without coalescing every slice is its own partition
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).withColumn("k", 999 - F.col("id"))
        got = D.row_positions(df, [F.col("k").asc()]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert (got["position"] == got["k"] + 1).all()


def test_null_groups_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, k int")
    got = {(r["g"], r["k"]): r["position"]
           for r in D.row_positions(df, [F.col("k").asc()], ["g"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


def test_dense_ranks_with_ties_and_nulls(spark):
    rows = [("c", 1, None), ("c", 2, 50.0), ("c", 3, 90.0), ("c", 4, 90.0), ("d", 5, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, rate double")
    ranked = D.dense_ranks(df, {"rate": F.col("rate").desc_nulls_first()}, ["g"], "r")
    assert {r["k"]: r["r"] for r in ranked.collect()} == {1: 1, 3: 2, 4: 2, 2: 3, 5: 1}


def test_top_rows_keeps_the_first_rows_of_a_hot_group(spark):
    df = skewed(spark)
    got = D.top_rows(df, [F.col("k").asc()], 20, ["g"], F.col("k")).toPandas()
    want = df.toPandas().sort_values("k").groupby("g").head(20)
    assert set(map(tuple, got.values)) == set(map(tuple, want.values))


def test_exact_medians(spark):
    values = [1.0, 5.0, 5.0, 5.0, 9.0, None, 2.0, 100.0, 4.0]
    df = spark.createDataFrame(
        [(v, None if v is None else -v) for v in values], "a double, b double"
    ).withColumn("empty", F.lit(None).cast("double"))
    got = {r["name"]: r["median"] for r in D.exact_medians(df, ["a", "b", "empty"]).collect()}
    known = [v for v in values if v is not None]
    assert got == {"a": median(known), "b": -median(known), "empty": None}


def test_medians_of_random_columns(spark):
    rng = random.Random(3)
    frame = pd.DataFrame({"x": [rng.randint(0, 40) / 4 for _ in range(501)]})
    got = D.exact_medians(spark.createDataFrame(frame), ["x"]).first()["median"]
    assert got == frame["x"].median()
