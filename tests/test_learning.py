import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milepost import schemas as S
from milepost.plans import learning as K
from milepost.session import fresh_path

KINDS = {c: T.DoubleType() for c in S.NUMERIC_INPUTS} | {
    "region_id": T.LongType(), "city": T.StringType(), "aoi_type": T.LongType(),
    "accept_period": T.StringType(),
} | {c: T.BooleanType() for c in S.BOOLEAN_INPUTS}
SCHEMA = T.StructType([T.StructField(c, KINDS[c]) for c in S.MODEL_INPUTS]
                      + [T.StructField("label", T.DoubleType())])


def frame(spark, n=200):
    rng = random.Random(5)
    rows = []
    for _ in range(n):
        late = float(rng.random() < 0.3)
        values = {c: rng.random() for c in S.NUMERIC_INPUTS}
        values["sla_minutes"] = 240.0
        values["accept_hour"] = late * 5 + rng.random() * 3
        values["accept_gps_lng"] = None
        values |= {"region_id": 1, "city": rng.choice(["Jilin", "Yantai"]), "aoi_type": 2,
                   "accept_period": rng.choice(["night", "morning", None])}
        values |= {c: rng.choice([True, False, None]) for c in S.BOOLEAN_INPUTS}
        rows.append(tuple(values[c] for c in S.MODEL_INPUTS) + (late,))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def train(spark):
    return frame(spark).persist()


def test_statistics_fill_and_scale(spark, train):
    stats = {r["name"]: r for r in K.numeric_statistics(train).collect()}
    assert stats["sla_minutes"]["scale"] == 1.0  # constant column
    assert stats["accept_gps_lng"]["median"] == 0.0  # no value at all
    column = train.toPandas()["accept_hour"]
    assert stats["accept_hour"]["median"] == pytest.approx(column.median())
    assert stats["accept_hour"]["scale"] == pytest.approx(column.std(ddof=0))


def test_unknown_category_is_all_zeros(spark, train):
    from pyspark.ml import Pipeline

    model = Pipeline(stages=K.preprocessing(train)).fit(train)
    other = train.limit(1).withColumns({"city": F.lit("Nowhere"), "accept_period": F.lit("noon")})
    vector = model.transform(other).select(vector_to_array("features")).first()[0]
    width = 18 + 1 + 2 + 1 + 3 + 4
    assert len(vector) == width
    city, period = vector[19:21], vector[22:25]
    assert city == [0.0, 0.0] and period == [0.0, 0.0, 0.0]


def test_logistic_learns_and_survives_storage(spark, train):
    model, info = K.fit_final(K.candidates()["logistic_balanced"], train, "v1")
    path = fresh_path(spark, "model")
    K.save_model(spark, model, info, path)
    again, read = K.load_model(spark, path)
    assert read == info and read.training_rows == 200
    first = K.predict(model, train).select("delay_probability").toPandas()
    second = K.predict(again, train).select("delay_probability").toPandas()
    assert first.equals(second)
    total, cities = K.final_evaluation(again, read, train)
    assert total.first()["roc_auc"] > 0.9
    assert cities.count() == 2


def test_prior_and_margin(spark, train):
    rate = train.agg(F.avg("label")).first()[0]
    scored = K.add_score(K.prior_model(train), train)
    assert scored.select("delay_probability").distinct().first()[0] == pytest.approx(rate)
    chosen = {"linear_svm": K.candidates()["linear_svm"]}
    svm = K.compare(train, train, chosen).first()
    assert svm["score_method"] == "decision_function" and svm["roc_auc"] > 0.9


def test_comparison_is_ranked(spark, train):
    chosen = {n: c for n, c in K.candidates().items()
              if n in ("dummy_prior", "decision_tree", "logistic")}
    rows = K.compare(train, train, chosen).orderBy("rank").collect()
    scores = [r["pr_auc"] for r in rows]
    assert scores == sorted(scores, reverse=True) and rows[-1]["model"] == "dummy_prior"


def test_inputs_and_metadata_are_checked(spark, train):
    with pytest.raises(ValueError, match="missing columns city"):
        K.predict(K.prior_model(train), train.drop("city"))
    with pytest.raises(ValueError, match="threshold"):
        K.ModelInfo("m", "v", 1.2, 1, 0.1)
    with pytest.raises(ValueError, match="positive"):
        K.ModelInfo("m", "v", 0.2, 0, 0.1)
    assert len(K.candidates()) == 9


def test_shared_preparation_gives_the_same_models(spark, train):
    chosen = {n: K.candidates()[n] for n in ("logistic_balanced", "decision_tree")}
    alone = {n: K.fit(c, train) for n, c in chosen.items()}
    together = K.fit_all(chosen, train, parallelism=2)
    for n in chosen:
        a, b = (K.add_score(m[n], train).select("delay_probability").toPandas()
                for m in (alone, together))
        assert (a - b).abs().max().iloc[0] < 1e-9


def test_boosting_stops_when_held_out_rows_gain_nothing(spark):
    noise = frame(spark, 600).withColumn("label", (F.xxhash64("accept_hour") % 2 == 0).cast("double"))
    assert noise.select("label").distinct().count() == 2
    model = K.fit(K.candidates()["boosting_balanced"], noise)
    assert model.stages[-1].getNumTrees < 60  # of 150


def test_thresholds_of_all_models_are_tuned_at_once(spark):
    rows = [("a", y, s) for y, s in ((1, 0.9), (1, 0.4), (0, 0.3), (0, 0.1))]
    rows += [("b", y, s) for y, s in ((1, 0.2), (0, 0.6), (1, 0.6), (0, 0.1))]
    scored = spark.createDataFrame(rows, "model string, label int, score double")
    got = {r["model"]: r for r in K.tune(scored).collect()}
    assert (got["a"]["threshold"], got["a"]["optimized_f1"]) == (0.4, 1.0)
    assert got["a"]["default_recall"] == 0.5
    assert (got["b"]["threshold"], got["b"]["optimized_f1"]) == (0.2, 0.8)
    ranked = K.rank_models(K.tune(scored), "optimized_f1").orderBy("rank").collect()
    assert [r["model"] for r in ranked] == ["a", "b"]


def test_one_class_cannot_be_balanced(spark, train):
    with pytest.raises(ValueError, match="both classes"):
        K.fit(K.candidates()["logistic_balanced"], train.where("label = 1"))


def test_svm_reaches_the_least_loss_in_few_passes(spark, train, monkeypatch):
    from pyspark.ml.classification import LinearSVC

    from milepost.plans import svm

    prepared = K.Prepared(train.withColumn("label", F.when(F.rand(3) < 0.2, 1 - F.col("label"))
                                           .otherwise(F.col("label"))).persist())
    rows, n = prepared.vectors(True), prepared.rows

    def loss(model):
        margin = vector_to_array("rawPrediction")[1] * (2 * F.col("label") - 1)
        hinge = F.greatest(F.lit(0.0), 1 - margin) * F.col("weight")
        b = model.coefficients.toArray()
        mean = model.transform(rows).agg(F.sum(hinge) / F.sum("weight")).first()[0]
        return mean + float(b @ b) / n / 2

    passes = []
    for name in ("_curvature", "_along"):
        made = getattr(svm, name)
        monkeypatch.setattr(svm, name, lambda *a, made=made: passes.append(1) or made(*a))
    got = K.candidates()["linear_svm"].build(n).fit(rows)
    settings = {"regParam": 1 / n, "standardization": False, "weightCol": "weight"}
    path = fresh_path(spark, "svc")
    LinearSVC(maxIter=300, **settings).fit(rows).write().save(path)
    from pyspark.ml.classification import LinearSVCModel

    assert loss(got) <= loss(LinearSVCModel.load(path)) * (1 + 1e-5)
    assert len(passes) < 150
    prepared.release()


def test_final_evaluation_scores_each_row_once(spark, train):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(p):
        seen.add(1)
        return p

    class Model:
        def transform(self, rows):
            p = counted(F.rand(1))
            return rows.withColumn("probability", F.array(1 - F.col("label"), p))

    info = K.ModelInfo("m", "v1", 0.5, 200, 0.3)
    total, cities = K.final_evaluation(Model(), info, train)
    assert total.first()["row_count"] == 200 and cities.count() == 2
    assert seen.value == 200
